"""Embedding prototypes: selection, centroids, scores, gates and the threshold grid."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions.lineage import cut
from plumbline.schemas import DECISIONS

#: Components, and rows, of a block of queries or of centroids at most.
NUMBERS, ROWS = 1 << 20, 2048
#: What a meeting of a block of queries and one of centroids returns.
MET = [("_row", pa.int64()), *[(f"{p}_{c}", k) for p in ("first", "second") for c, k in (("score", pa.float64()), ("label", pa.string()))]]
MET += [("no_intent_score", pa.float64()), ("oos_score", pa.float64())]
AXES = ["tau_actionability", "tau_oos_margin", "tau_activity_min", "tau_ambiguity"]


def representatives(cases: DataFrame, by: list[str]) -> DataFrame:
    """The smallest case of each cluster."""
    return cases.groupBy(*by, "cluster_id").agg(F.min("case_id").alias("case_id"))


def stratified_round_robin(cases: DataFrame, strata: list[str], maximum: int, by: str = "decision") -> DataFrame:
    """One case of each stratum in turn. The n-th case of each stratum comes before any (n+1)-th.

    The rank is cut at ``maximum`` per stratum, so only a top-k per stratum is ever sorted.
    """
    chosen = representatives(cases, [by]).select("case_id")
    known = [s for s in strata if s != "__other__"]
    found = F.filter(F.array(*[F.lit(s) for s in known]), lambda s: F.array_contains("tags", s))
    stratum = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("__other__"))
    rows = cases.join(chosen, "case_id", "left_semi").withColumn("stratum", stratum)
    rank = F.row_number().over(Window.partitionBy(by, "stratum").orderBy("case_id"))
    place = F.array_position(F.array(*[F.lit(s) for s in strata]), F.col("stratum"))
    top = rows.withColumn("rank", rank).filter(F.col("rank") <= maximum).withColumn("place", place)
    order = F.row_number().over(Window.partitionBy(by).orderBy("rank", "place"))
    return top.withColumn("position", order).filter(F.col("position") <= maximum)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row, also where the optimiser would copy it into a lambda."""
    return F.transform(F.array(value), body)[0]


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    return let(norm(v), lambda n: F.transform(v, lambda x: x / n))


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """Unit vectors, averaged by position with map-side combine, made unit again. One row per label."""
    spread = vectors.select(label, F.posexplode_outer(unit(F.col("embedding"))).alias("pos", "v"))
    means = spread.groupBy(label, "pos").agg(F.avg("v").alias("v"))
    lined = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("pv"))
    return lined.select(label, let(F.transform("pv", lambda p: p["v"]), unit).alias("embedding"))


def _packed(column, dims: int) -> np.ndarray:
    """A list column as a matrix of unit rows; short lists are filled up with zeros."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), place] = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def _products(dims: int, digits: int):
    """The best two labels of each query among a block of centroids, and its scores with the two that are no intents."""

    def meet(queries: pa.Table, centers: pa.Table) -> pa.Table:
        if not len(queries) or not len(centers):
            return pa.table({name: pa.array([], kind) for name, kind in MET})
        order = np.argsort(np.array(centers["label"].to_pylist(), object), kind="stable")  # of equal scores the first label wins
        names = np.array(centers["label"].to_pylist(), object)[order]
        # the whole product is in blocks; + 0.0 makes every zero the same one
        found = np.round(_packed(queries["e"], dims) @ _packed(centers["e"], dims)[order].T, digits) + 0.0
        rivals = np.flatnonzero(~np.isin(names, ["oos", "no_intent"]))
        best = rivals[np.argsort(-found[:, rivals], axis=1, kind="stable")[:, :2]] if len(rivals) else np.empty((len(queries), 0), int)
        rows = np.arange(len(queries))
        columns = {"_row": queries["_row"].to_pylist()}
        for i, place in enumerate(("first", "second")):
            here = best[:, i] if best.shape[1] > i else None
            columns[f"{place}_score"] = [None] * len(rows) if here is None else found[rows, here].tolist()
            columns[f"{place}_label"] = [None] * len(rows) if here is None else names[here].tolist()
        for name in ("no_intent", "oos"):
            at = np.flatnonzero(names == name)
            columns[f"{name}_score"] = found[:, at[0]].tolist() if len(at) else [None] * len(rows)
        return pa.table([pa.array(columns[name], kind) for name, kind in MET], names=[name for name, _ in MET])

    return meet


def scores(queries: DataFrame, centers: DataFrame, label: str, digits: int = 9, numbers: int = NUMBERS) -> DataFrame:
    """Cosines with all centroids as matrix products of blocks; a meeting keeps a query's best two labels only.

    Blocks of queries and of centroids hold ``numbers`` components, so neither the centroids nor anything else is in one place, and
    the plan is the same for five labels and for a million.
    """
    rows = cut(queries.withColumn("_row", F.monotonically_increasing_id()))
    named = cut(centers.select(F.col(label).alias("label"), F.col("embedding").alias("e")))
    n, dims = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    labels, other = named.agg(F.count("*"), F.max(F.size("e"))).first()
    dims = max(dims or 1, other or 1, 1)
    in_block = max(1, min(numbers // dims, ROWS))
    wide, long = max(1, -(-n // in_block)), max(1, -(-labels // in_block))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    deal = lambda by, parts: F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")
    left = rows.select("_row", F.col("embedding").alias("e"), deal("_row", wide).alias("i"), every(long).alias("j"))
    right = named.select("label", "e", deal("label", long).alias("j")).withColumn("i", every(wide))
    kinds = ", ".join(f"{name} {'string' if kind == pa.string() else 'bigint' if kind == pa.int64() else 'double'}" for name, kind in MET)
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_products(dims, digits), kinds)
    pair = lambda place: F.struct((-F.col(f"{place}_score")).alias("neg"), F.col(f"{place}_label").alias("label"))
    both = F.array_compact(F.flatten(F.collect_list(F.array(*[F.when(F.col(f"{p}_label").isNotNull(), pair(p)) for p in ("first", "second")]))))
    found = met.groupBy("_row").agg(F.array_sort(both).alias("_r"), F.max("no_intent_score").alias("no_intent_score"), F.max("oos_score").alias("oos_score"))
    found = found.withColumns(
        {
            "top_intent": F.get("_r", F.lit(0))["label"],
            "second_intent": F.get("_r", F.lit(1))["label"],
            "activity_score": -F.get("_r", F.lit(0))["neg"],
            "second_score": -F.get("_r", F.lit(1))["neg"],
        }
    ).drop("_r")
    best = F.greatest("activity_score", "oos_score") - F.col("no_intent_score")
    out = rows.drop("embedding").join(found, "_row", "left").drop("_row")
    return out.withColumns(
        {
            "actionability": F.round(best, digits),
            "oos_margin": F.round(F.col("oos_score") - F.col("activity_score"), digits),
            "ambiguity_margin": F.round(F.col("activity_score") - F.col("second_score"), digits),
        }
    )


def gated(taus: dict[str, Column]) -> Column:
    """T09."""
    return (
        F.when(F.col("actionability") < taus["tau_actionability"], "no_intent")
        .when(
            (F.col("oos_margin") >= taus["tau_oos_margin"]) | (F.col("activity_score") < taus["tau_activity_min"]), "oos"
        )
        .when(F.col("ambiguity_margin") < taus["tau_ambiguity"], "ambiguous")
        .otherwise("in_scope")
    )


def grid_scores(scored: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """Every point of the grid scored on all rows.

    A row's fate at a grid point depends only on how many values of each axis it reaches, so rows are first counted by
    these four ranks and their labels. The grid meets a few thousand counted cells, not the rows.
    """
    axes = [sorted(grid[a]) for a in AXES]
    measured = ["actionability", "oos_margin", "activity_score", "ambiguity_margin"]

    def reached(column, values):
        flags = [L.as_flag(F.col(column) >= v) for v in values]
        return sum(flags[1:], flags[0])

    cells = (
        scored.select(
            "decision",
            L.as_flag(F.col("target_intent").eqNullSafe(F.col("top_intent"))).alias("top_right"),
            *[reached(c, v).alias(f"k{i}") for i, (c, v) in enumerate(zip(measured, axes, strict=True))],
        )
        .groupBy("decision", "top_right", "k0", "k1", "k2", "k3")
        .agg(F.count("*").alias("n"))
    )
    met = cells
    for i, (axis, levels) in enumerate(zip(AXES, axes, strict=True)):
        entries = [F.struct(F.lit(j + 1).alias(f"j{i}"), F.lit(v).alias(axis)) for j, v in enumerate(levels)]
        met = met.select("*", F.inline(F.array(*entries)))
    c = F.col
    predicted = (
        F.when(c("j0") > c("k0"), "no_intent")
        .when((c("j1") <= c("k1")) | (c("j2") > c("k2")), "oos")
        .when(c("j3") > c("k3"), "ambiguous")
        .otherwise("in_scope")
    )
    met = met.withColumn("predicted", predicted)
    hit = (c("predicted") == c("decision")) & ((c("decision") != "in_scope") | (c("top_right") == 1))
    zero = F.lit(0).cast("bigint")
    count = lambda x: F.sum(F.when(x, c("n")).otherwise(zero))
    tallies = []
    for d in DECISIONS:
        gold, said = c("decision") == d, c("predicted") == d
        tallies += [count(gold & said).alias(f"tp_{d}"), count(said).alias(f"p_{d}"), count(gold).alias(f"g_{d}")]
    sums = met.groupBy(*AXES).agg(F.sum("n").alias("n"), count(hit).alias("hits"), *tallies)
    scores_ = []
    for d in DECISIONS:
        p, r = L.ratio(c(f"tp_{d}"), c(f"p_{d}")), L.ratio(c(f"tp_{d}"), c(f"g_{d}"))
        scores_.append(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    macro = sum(scores_[1:], scores_[0]) / F.lit(float(len(DECISIONS)))
    return sums.select(
        *AXES, "n", "hits", F.round(L.ratio(c("hits"), c("n")), 9).alias("hem"), F.round(macro, 9).alias("decision_macro_f1")
    )


def best_point(scored_grid: DataFrame) -> DataFrame:
    """Best HEM, then macro-F1, then the smallest values in alphabetical order of the parameter names."""
    return scored_grid.orderBy(
        F.desc("hem"), F.desc("decision_macro_f1"), *[F.asc(a) for a in sorted(AXES)]
    ).limit(1)


def route(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """T09 with one stored row of thresholds."""
    taus = {a: thresholds.select(a).scalar() for a in AXES}
    routed = scored.withColumns({f"_{a}": t for a, t in taus.items()})
    decision = gated({a: F.col(f"_{a}") for a in AXES})
    return routed.withColumn("p_decision", decision).withColumn(
        "p_intent", F.when(F.col("p_decision") == "in_scope", F.col("top_intent"))
    ).drop(*[f"_{a}" for a in AXES])
