"""Paired comparison of runs: domains, cluster bootstrap, intervals and the three-way verdict.

All metrics are sums over clusters, so a resample is a weighted sum of one small row per cluster: the cases are read
once, and only cluster rows are drawn from.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import hashing as H
from plumbline.functions import labels as L
from plumbline.functions.lineage import cut
from plumbline.functions.quantiles import exact_quantiles
from plumbline.functions.ranges import range_totals
from plumbline.operators.evaluate import invalid_runs
from plumbline.schemas import CONFIDENCE, MIN_CLUSTERS

DOMAINS = ["full_hem", "gold_in_scope_intent_macro_f1", "near_oos_recall", "no_intent_recall"]
#: Draws that are too few to be dealt further, and tasks for each block of classes at most: each of them gets a copy of the block.
DRAWS_PER_TASK, MOST_TASKS = 20_000_000, 128
#: Positions and classes that a task makes draws for at a time, classes in a row, and counts of classes that are held at a time.
POSITIONS_AT_ONCE, CLASSES_AT_ONCE, CLASSES_IN_ROW, DRAWS_AT_ONCE = 1 << 20, 1 << 20, 1 << 16, 1 << 22
#: Cells in which draws are looked up at most, cells for each class, and draws that stay in a core's cache.
CELLS, LEAST_CELLS, CELLS_OF_CLASS, DRAWS_IN_CACHE = 1 << 23, 1 << 16, 64, 1 << 16
#: Keeps seeds apart from iterations, which go through the same mixer.
SEED_SIDE = 0x9E3779B9


def domains() -> Column:
    """The domains a gold case is in."""
    return F.array_compact(
        F.array(
            F.lit("full_hem"),
            F.when(F.col("decision") == "in_scope", "gold_in_scope_intent_macro_f1"),
            F.when(L.has_tag("near_oos"), "near_oos_recall"),
            F.when(F.col("decision") == "no_intent", "no_intent_recall"),
        )
    )


def paired(labelled: DataFrame, left: str, right: str) -> DataFrame:
    """Both arms of a case in one row, by one aggregation instead of two joins."""

    def side(arm, column):
        return F.max(F.when(F.col("arm") == arm, F.col(column)))

    return labelled.filter(F.col("arm").isin(left, right)).groupBy("case_id").agg(
        side(left, "hit").alias("left_hit"),
        side(right, "hit").alias("right_hit"),
        side(left, "pred_decision").alias("left_decision"),
        side(right, "pred_decision").alias("right_decision"),
    )


def cluster_statistics(labelled: DataFrame, arms: list[str], intents: list[str]) -> DataFrame:
    """Additive counts per (domain, cluster). With the arms as columns, one draw serves every pair of arms.

    Cases are summed once per (cluster, arm); arms become columns, and domains rows, on what is left.
    """
    near, quiet, inside = L.has_tag("near_oos"), F.col("decision") == "no_intent", F.col("decision") == "in_scope"
    said = F.col("pred_decision")
    near_unit = near & (F.col("decision") == "oos")
    sums = {
        "all_cases": F.lit(1),
        "all_n": F.lit(1),
        "all_h": F.col("hit"),
        "near_cases": L.as_flag(near),
        "near_n": L.as_flag(near_unit),
        "near_h": L.as_flag(near_unit & (said == "oos")),
        "quiet_cases": L.as_flag(quiet),
        "quiet_n": L.as_flag(quiet),
        "quiet_h": L.as_flag(quiet & (said == "no_intent")),
        "in_cases": L.as_flag(inside),
    }
    for i, intent in enumerate(intents):
        gold = inside & F.col("target_intent").eqNullSafe(F.lit(intent))
        predicted = inside & (F.col("pred_intent") == intent)
        sums |= {f"g{i}": L.as_flag(gold), f"p{i}": L.as_flag(predicted), f"t{i}": L.as_flag(gold & predicted)}
    per_arm = labelled.filter(F.col("arm").isin(*arms)).groupBy("cluster_id", "arm").agg(
        *[F.sum(c).alias(k) for k, c in sums.items()]
    )

    def of(arm, column):
        return F.coalesce(F.max(F.when(F.col("arm") == arm, F.col(column))), F.lit(0))

    parts = ["all", "near", "quiet"]
    wide = {f"{part}_{c}": of(arms[0], f"{part}_{c}") for part in [*parts, "in"] for c in ["cases", "n"] if (part, c) != ("in", "n")}
    wide |= {f"{part}_h_{arm}": of(arm, f"{part}_h") for part in parts for arm in arms}
    for i in range(len(intents)):
        wide[f"g{i}"] = of(arms[0], f"g{i}")
        wide |= {f"{k}{i}_{arm}": of(arm, f"{k}{i}") for k in "pt" for arm in arms}
    clusters = per_arm.groupBy("cluster_id").agg(*[c.alias(k) for k, c in wide.items()])
    zero = F.lit(0).cast("bigint")

    def row(domain, part, tallies):
        counts = [F.col(f"{part}_n").alias("n") if part != "in" else zero.alias("n")]
        counts += [(F.col(f"{part}_h_{a}") if part != "in" else zero).alias(f"hits_{a}") for a in arms]
        counts += [(F.col(k) if tallies else zero).alias(k) for k in tally_columns(arms, intents)]
        return F.struct(F.lit(domain).alias("domain"), F.col(f"{part}_cases").alias("cases"), *counts)

    rows = F.array(*[row(d, p, p == "in") for d, p in zip(DOMAINS, ["all", "in", "near", "quiet"], strict=True)])
    return clusters.select("cluster_id", F.inline(rows)).filter("cases > 0")


def tally_columns(arms: list[str], intents: list[str]) -> list[str]:
    names = [f"g{i}" for i in range(len(intents))]
    return names + [f"{k}{i}_{arm}" for i in range(len(intents)) for k in "pt" for arm in arms]


def _metric(arm: str, intents: list[str]) -> Column:
    scores = []
    for i in range(len(intents)):
        tp, predicted, gold = F.col(f"t{i}_{arm}"), F.col(f"p{i}_{arm}"), F.col(f"g{i}")
        p, r = L.ratio(tp, predicted), L.ratio(tp, gold)
        scores.append(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    macro = sum(scores[1:], scores[0]) / F.lit(float(len(intents)))
    return F.when(F.col("domain") == "gold_in_scope_intent_macro_f1", macro).otherwise(
        L.ratio(F.col(f"hits_{arm}"), F.col("n"))
    )


def _differences(sums: DataFrame, keys: list[str], pairs: list[tuple[str, str]], intents: list[str]) -> DataFrame:
    arms = sorted({arm for pair in pairs for arm in pair})
    scored = sums.select(*keys, *[_metric(arm, intents).alias(f"m_{arm}") for arm in arms])
    entries = [
        F.struct(
            F.lit(a).alias("left_arm"), F.lit(b).alias("right_arm"), (F.col(f"m_{b}") - F.col(f"m_{a}")).alias("d")
        )
        for a, b in pairs
    ]
    return scored.select(*keys, F.inline(F.array(*entries)))


def _summed(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def cluster_rows(labelled: DataFrame, arms: list[str], intents: list[str]) -> DataFrame:
    """The cluster rows, written once: they are small, and every later step reads them."""
    return cut(cluster_statistics(labelled, arms, intents))


def vector_classes(clusters: DataFrame, columns: list[str]) -> DataFrame:
    """(domain, start, copies, place, *columns): clusters of a domain with equal counts as one class.

    Slots of a domain are numbered class by class, in the order of the counts, so a class is the run of ``copies`` slots after ``start``;
    which of its clusters has which slot does not matter. ``place`` numbers the classes from 1.
    """
    same = clusters.groupBy("domain", *columns).agg(F.count("*").alias("copies"))
    numbered = range_totals(same, ["domain"], columns, {"end": F.col("copies"), "place": F.lit(1).cast("bigint")})
    return numbered.select("domain", (F.col("end") - F.col("copies")).alias("start"), "copies", "place", *columns)


def _mixed(x: np.ndarray) -> np.ndarray:
    """``hashing.mixed`` for arrays of uint32, which wrap by themselves; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(H.MIX_1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(H.MIX_2 & H.LOW_32)
    x ^= x >> np.uint32(16)
    return x


class SlotClasses:
    """Which class of a block a draw falls in; classes of other blocks are number ``len(starts)``.

    The range of draws is cut into cells, one for each slot where they are not too many. A cell that lies in one class is looked up; draws
    of the others are searched for.
    """

    def __init__(self, starts: np.ndarray, end: int, clusters: int):
        self.starts, self.end, self.clusters = starts, end, clusters
        self.cells = min(clusters, CELLS, max(LEAST_CELLS, CELLS_OF_CLASS * len(starts)))
        self.first, self.whole = np.empty(self.cells, dtype=np.int32), np.empty(self.cells, dtype=bool)
        for low in range(0, self.cells, POSITIONS_AT_ONCE):
            some = slice(low, min(low + POSITIONS_AT_ONCE, self.cells))
            edges = -((-np.arange(some.start, some.stop + 1, dtype=np.int64) << 32) // self.cells)  # the first draw of each cell
            self.first[some] = self._searched((edges[:-1] * clusters) >> 32)
            self.whole[some] = self.first[some] == self._searched(((edges[1:] - 1) * clusters) >> 32)
        self.all_whole = bool(self.whole.all())

    def _searched(self, slots: np.ndarray) -> np.ndarray:
        outside = (slots < self.starts[0]) | (slots >= self.end)
        return np.where(outside, len(self.starts), np.searchsorted(self.starts, slots, side="right") - 1)

    def __call__(self, draws: np.ndarray) -> np.ndarray:
        cell = ((draws * np.uint64(self.cells)) >> np.uint64(32)).astype(np.int64)
        found = self.first[cell]
        if not self.all_whole:
            open_draws = np.flatnonzero(~self.whole[cell])
            slots = ((draws[open_draws] * np.uint64(self.clusters)) >> np.uint64(32)).astype(np.int64)
            found[open_draws] = self._searched(slots)
        return found


def _classes_drawn(class_of: SlotClasses, positions: np.ndarray, turned: np.uint32) -> np.ndarray:
    """How often each class of the block is drawn at mixed positions by one iteration; draws of other blocks come last."""
    found = np.empty(len(positions), dtype=np.int64)
    for low in range(0, len(positions), DRAWS_IN_CACHE):
        some = slice(low, low + DRAWS_IN_CACHE)
        found[some] = class_of(_mixed(positions[some] ^ turned).astype(np.uint64))
    return np.bincount(found, minlength=len(class_of.starts) + 1)


def packed_classes(classes: DataFrame, columns: list[str]) -> DataFrame:
    """(domain, block, pack, starts, upto, kind, counts): up to ``CLASSES_IN_ROW`` neighbouring classes in a row, counts as small as they fit."""
    in_row = min(CLASSES_IN_ROW, CLASSES_AT_ONCE)
    placed = classes.withColumn("pack", F.floor((F.col("place") - 1) / in_row).cast("bigint"))
    placed = placed.withColumn("block", F.floor(F.col("pack") / (CLASSES_AT_ONCE // in_row)).cast("bigint"))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        counts = np.stack([rows[c].to_numpy() for c in columns], axis=1)
        kind = np.result_type(np.min_scalar_type(counts.min()), np.min_scalar_type(counts.max()))
        starts = rows["start"].to_numpy()
        packed = {k: [rows[k][0].as_py()] for k in ("domain", "block", "pack")}
        packed |= {"starts": [starts.astype(np.int64).tobytes()], "upto": [int(starts[-1]) + rows["copies"][-1].as_py()]}
        return pa.table(packed | {"kind": [kind.str], "counts": [counts.astype(kind).tobytes()]})

    # a domain, block and pack are a group of bounded size
    return placed.groupBy("domain", "block", "pack").applyInArrow(
        pack, "domain string, block bigint, pack bigint, starts binary, upto bigint, kind string, counts binary"
    )


def dealt_classes(classes: DataFrame, clusters: dict[str, int], columns: list[str], iterations: int) -> DataFrame:
    """The packed classes with the tasks that draw from them, a task in each partition.

    A block of classes goes to no more than ``MOST_TASKS`` tasks, so the copies grow no faster than the classes.
    """
    places = {r["domain"]: r["n"] for r in classes.groupBy("domain").agg(F.max("place").alias("n")).collect()}  # a row per domain
    # one row for each domain, so the tasks of a domain are a few numbers in it
    spans, tasks = [], 0
    for domain, count in clusters.items():
        blocks = -(-places[domain] // CLASSES_AT_ONCE)
        wanted = min(MOST_TASKS, -(-count * iterations // DRAWS_PER_TASK))
        turns = min(iterations, wanted)
        ranges = min(count, wanted // turns)
        numbers = {"clusters": count, "blocks": blocks, "ranges": ranges, "turns": turns, "earlier": tasks}
        spans.append(F.struct(F.lit(domain).alias("domain"), *[F.lit(n).cast("bigint").alias(k) for k, n in numbers.items()]))
        tasks += blocks * ranges * turns
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = classes.sparkSession.range(1).select(F.inline(F.array(*spans)))
    dealt = dealt.withColumn("block", every("blocks")).withColumn("range", every("ranges")).withColumn("turn", every("turns"))
    task = F.col("earlier") + (F.col("block") * F.col("ranges") + F.col("range")) * F.col("turns") + F.col("turn")
    dealt = F.broadcast(dealt.withColumn("task", task.cast("int")))
    return packed_classes(classes, columns).join(dealt, ["domain", "block"]).repartitionById(tasks, F.col("task"))


def drawn_sums(classes: DataFrame, clusters: dict[str, int], columns: list[str], iterations: int, seed: int) -> DataFrame:
    """(domain, iteration, *columns): the sums over the clusters that each iteration draws with replacement.

    A draw is 32 mixed bits of its position, iteration and seed, each mixed by itself first, so neighbouring seeds share no draws; it is
    scaled to the number of clusters of the domain. Holds for up to 2^31 clusters. No draw is ever a row: a task has one block of
    classes, a range of positions and a range of iterations, counts its draws for each class and adds up the classes' counts, so one
    row for each iteration leaves it. The work is dealt alike whatever the size.
    """
    work = dealt_classes(classes, clusters, columns, iterations)
    wanted = ", ".join(f"{c} bigint" for c in columns)

    def sums(batches):
        rows = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["pack"])
        if not rows:
            return
        got = rows[0]
        side = _mixed(np.array([(seed & H.LOW_32) ^ SEED_SIDE], dtype=np.uint32))
        turned = _mixed(np.arange(iterations, dtype=np.uint32)) ^ side
        starts = np.concatenate([np.frombuffer(row["starts"], dtype=np.int64) for row in rows])
        tables = [np.frombuffer(row["counts"], dtype=row["kind"]).reshape(-1, len(columns)) for row in rows]
        ends = np.cumsum([len(table) for table in tables])
        class_of = SlotClasses(starts, rows[-1]["upto"], got["clusters"])
        share = lambda n, k, of: range(n * k // of, n * (k + 1) // of)
        here = share(got["clusters"], got["range"], got["ranges"])
        wanted_turns = share(iterations, got["turn"], got["turns"])
        step = max(1, DRAWS_AT_ONCE // len(starts))
        for start in range(wanted_turns.start, wanted_turns.stop, step):
            some = range(start, min(start + step, wanted_turns.stop))
            drawn = np.zeros((len(some), len(starts) + 1), dtype=np.int64)
            for low in range(here.start, here.stop, POSITIONS_AT_ONCE):
                positions = _mixed(np.arange(low + 1, min(low + POSITIONS_AT_ONCE, here.stop) + 1, dtype=np.uint32))
                for k, iteration in enumerate(some):
                    drawn[k] += _classes_drawn(class_of, positions, turned[iteration])
            found = np.zeros((len(some), len(columns)))
            for end, table in zip(ends, tables, strict=True):
                found += drawn[:, end - len(table) : end].astype(np.float64) @ table.astype(np.float64)
            found = np.rint(found).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([got["domain"]] * len(some)), pa.array(np.array(some, dtype=np.int32))]
                + [pa.array(np.ascontiguousarray(found[:, j])) for j in range(len(columns))],
                names=["domain", "iteration", *columns],
            )

    made = work.mapInArrow(sums, f"domain string, iteration int, {wanted}")
    return _summed(made, ["domain", "iteration"], columns)


def resampled_differences(
    clusters: DataFrame, arms: list[str], pairs: list[tuple[str, str]], intents: list[str], iterations: int, seed: int
) -> DataFrame:
    """Per (domain, iteration, pair) the metric difference over the drawn clusters.

    The label tallies are only carried for the domain that needs them.
    """
    macro = "gold_in_scope_intent_macro_f1"
    rates = ["n", *[f"hits_{arm}" for arm in arms]]
    tallies = tally_columns(arms, intents)
    counts = {r["domain"]: r["count"] for r in clusters.groupBy("domain").count().collect()}  # a row per domain
    found = []
    for wanted, columns in [([d for d in counts if d == macro], tallies), ([d for d in counts if d != macro], rates)]:
        if wanted:
            classes = vector_classes(clusters.filter(F.col("domain").isin(wanted)).select("domain", *columns), columns)
            sums = drawn_sums(cut(classes), {d: counts[d] for d in wanted}, columns, iterations, seed)
            sums = sums.select("*", *[F.lit(0).alias(c) for c in [*rates, *tallies] if c not in columns])
            found.append(_differences(sums, ["domain", "iteration"], pairs, intents))
    return reduce(DataFrame.unionByName, found) if found else _differences(
        clusters.select("domain", F.lit(0).alias("iteration"), *rates, *tallies).filter("false"), ["domain", "iteration"], pairs, intents
    )


def iteration_differences(
    labelled: DataFrame, pairs: list[tuple[str, str]], intents: list[str], iterations: int, seed: int
) -> DataFrame:
    arms = sorted({arm for pair in pairs for arm in pair})
    clusters = cluster_rows(labelled, arms, intents)
    return resampled_differences(clusters, arms, pairs, intents, iterations, seed)


def compare_domains(
    labelled: DataFrame,
    pairs: list[tuple[str, str]],
    intents: list[str],
    iterations: int,
    seed: int,
    minimum: int = MIN_CLUSTERS,
    confidence: float = CONFIDENCE,
    validity: DataFrame | None = None,
) -> DataFrame:
    """Point and percentile interval of right minus left for each of the fixed domains and pairs.

    Too few clusters give the point only; a domain without a case has counts of 0 and no point. ``validity`` (see
    ``evaluate.run_validity``): a pair with a run that is not valid has neither point nor interval.
    """
    arms = sorted({arm for pair in pairs for arm in pair})
    clusters = cluster_rows(labelled, arms, intents)
    columns = [c for c in clusters.columns if c not in ("domain", "cluster_id")]
    keys = ["domain", "left_arm", "right_arm"]
    whole = clusters.groupBy("domain").agg(
        F.count("*").alias("cluster_count"), *[F.sum(c).alias(c) for c in columns]
    )
    point = _differences(
        whole.withColumn("case_count", F.col("cases")), ["domain", "cluster_count", "case_count"], pairs, intents
    ).withColumnRenamed("d", "point")
    alpha = 1 - confidence
    spread = (
        resampled_differences(clusters, arms, pairs, intents, iterations, seed)
        .groupBy(*keys)
        .agg(F.percentile("d", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    )
    enough = F.coalesce(F.col("cluster_count") >= minimum, F.lit(False))
    named = F.array(*[F.struct(F.lit(a).alias("left_arm"), F.lit(b).alias("right_arm")) for a, b in pairs])
    every = labelled.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, DOMAINS))).alias("domain"), named.alias("pairs"))
    every = every.select("domain", F.inline("pairs"))
    found = every.join(point, keys, "left").join(spread, keys, "left").select(
        *keys,
        F.coalesce("case_count", F.lit(0)).cast("bigint").alias("case_count"),
        F.coalesce("cluster_count", F.lit(0)).cast("bigint").alias("cluster_count"),
        L.as_flag(enough).alias("estimable"),
        F.round("point", 9).alias("point"),
        F.when(enough, F.round(F.col("q")[0], 9)).alias("lower"),
        F.when(enough, F.round(F.col("q")[1], 9)).alias("upper"),
        F.when(~enough, "insufficient_clusters").alias("unavailable_reason"),
    )
    if validity is None:
        return found
    bad = F.arrays_overlap(invalid_runs(validity), F.array("left_arm", "right_arm"))
    return found.withColumn("_bad", bad).select(
        *keys,
        "case_count",
        "cluster_count",
        F.when(F.col("_bad"), 0).otherwise(F.col("estimable")).alias("estimable"),
        *[F.when(~F.col("_bad"), F.col(c)).alias(c) for c in ("point", "lower", "upper")],
        F.when(F.col("_bad"), "invalid_run").otherwise(F.col("unavailable_reason")).alias("unavailable_reason"),
    )


def type7_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation at h = (n - 1)q."""
    return exact_quantiles(df, by, value, probabilities, [f"q{int(p * 1000):03d}" for p in probabilities])


# ---- verdict ---------------------------------------------------------------------------------------------------

# Margins and the budget limit of the decision rule.
INTENT_MARGIN, RECALL_MARGIN, BUDGET_LIMIT = -0.03, -0.05, 0.10


def token_difference_rate(left="left_tokens", right="right_tokens") -> Column:
    a, b = F.col(left), F.col(right)
    return F.abs(b - a) / F.greatest(a, F.lit(1))


def _reasons(clauses: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, name) for name, condition in clauses.items()]))


def decide(evidence: DataFrame) -> DataFrame:
    """T05 as columns, so any number of comparisons is decided in one projection.

    Needs flags valid, aligned, estimable, usage_complete, cost_complete, latency_complete; hem, intent, near and
    quiet as structs of point, lower and upper; counts left/right_context_errors, left/right_schema_invalid and
    left/right_tokens.
    """
    c = F.col
    lacking = c("left_tokens").isNull() | c("right_tokens").isNull()
    rate = F.when(~lacking, token_difference_rate())
    bounds = [c(f"{i}.{b}") for i in ("hem", "intent", "near", "quiet") for b in ("point", "lower", "upper")]
    unknown = reduce(lambda a, b: a | b, [x.isNull() | F.isnan(x) for x in bounds])
    blocked = _reasons(
        {
            "missing_token_totals": lacking,
            "budget_confounded": rate > BUDGET_LIMIT,
            "incomplete_usage_metadata": ~c("usage_complete"),
            "incomplete_cost": ~c("cost_complete"),
            "incomplete_latency": ~c("latency_complete"),
            "required_ci_unavailable": ~F.coalesce(c("estimable"), F.lit(False)) | unknown,
            "comparison_contract_mismatch": ~c("aligned"),
        }
    )
    worse = _reasons(
        {
            "hem_not_improved": c("hem.upper") <= 0,
            "id_intent_regressed": c("intent.upper") < INTENT_MARGIN,
            "near_oos_regressed": c("near.upper") < RECALL_MARGIN,
            "no_intent_regressed": c("quiet.upper") < RECALL_MARGIN,
            "more_context_distractor_errors": c("right_context_errors") > c("left_context_errors"),
            "more_schema_invalid_predictions": c("right_schema_invalid") > c("left_schema_invalid"),
        }
    )
    unsure = _reasons(
        {
            "hem_ci_crosses_zero": c("hem.lower") <= 0,
            "id_intent_noninferiority_unproven": c("intent.lower") < INTENT_MARGIN,
            "near_oos_noninferiority_unproven": c("near.lower") < RECALL_MARGIN,
            "no_intent_noninferiority_unproven": c("quiet.lower") < RECALL_MARGIN,
            "near_oos_point_regressed": c("near.point") < 0,
        }
    )
    judged = evidence.withColumns({"_blocked": blocked, "_worse": worse, "_unsure": unsure, "_rate": rate})

    def pick(invalid, contract, negative, open_, fine):
        return (
            F.when(~c("valid"), invalid)
            .when(F.size("_blocked") > 0, contract)
            .when(F.size("_worse") > 0, negative)
            .when(F.size("_unsure") > 0, open_)
            .otherwise(fine)
        )

    none = F.lit(None).cast("string")
    passed = F.array(F.lit("all_pre_registered_gates_passed"))
    return judged.withColumns(
        {
            "verdict": pick(none, F.lit("inconclusive"), F.lit("negative"), F.lit("inconclusive"), F.lit("promising")),
            "reasons": pick(F.array(F.lit("invalid_run")), c("_blocked"), c("_worse"), c("_unsure"), passed),
            "token_difference_rate": F.when(c("valid"), c("_rate")),
        }
    ).drop("_blocked", "_worse", "_unsure", "_rate")
