"""Group-safe splits, their statistics, and the audit sample."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import hashing as H
from plumbline.functions import labels as L
from plumbline.functions.lineage import cut

#: Units of a sample that are broadcast at most; a larger sample is joined by a shuffle.
BROADCAST_UNITS = 100_000
FEATURES = [
    "near_oos",
    "far_oos",
    "hard_negative",
    "context_distractor",
    "context_control",
    "multi_turn",
    "slot_required",
    "quiet_control",
]


def group_table(cases: DataFrame, group: str) -> DataFrame:
    """One row per component: its stratum, its size and its feature counts."""
    flags = L.feature_flags(FEATURES)
    totals = cases.groupBy(F.col(group).alias("group_id")).agg(
        F.count("*").cast("bigint").alias("cases"),
        F.min("target_intent").alias("target"),
        F.min("decision").alias("decision"),
        *[F.sum(c).alias(f"f_{k}") for k, c in flags.items()],
    )
    stratum = F.when(F.col("target").isNotNull(), F.concat(F.lit("intent:"), "target")).otherwise(
        F.concat(F.lit("decision:"), "decision")
    )
    return totals.withColumn("stratum", stratum).drop("target", "decision")


def half_up_share(count: Column, share: int, whole: int) -> Column:
    return F.floor((count * share + F.lit(whole // 2)) / whole).cast("bigint")


def candidate_splits(groups: DataFrame, seeds: int | list[int], share: int, whole: int) -> DataFrame:
    """Per seed (so many from 0 on, or those given) and stratum, whole groups in hash order while they fit the quota.

    A group larger than the quota can never fit; it stays out of the running sum, so the others still fill it. The sum only grows, so what
    is taken ends at one place of the order. The first hex digits of the hash deal the groups of a seed and stratum to 4096 buckets:
    their totals tell the bucket of that place, and only that bucket's groups are put in order.
    """
    quota = groups.groupBy("stratum").agg(half_up_share(F.sum("cases"), share, whole).alias("quota"))
    fits = F.col("cases") <= F.col("quota")
    sized = groups.join(F.broadcast(quota), "stratum").withColumn("_cases", F.when(fits, F.col("cases")).otherwise(0))
    tried = range(seeds) if isinstance(seeds, int) else seeds
    seeded = sized.withColumn("seed", F.explode(F.array(*map(F.lit, tried))))
    keyed = seeded.withColumn(
        "key", F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col("group_id").cast("string")), 256)
    ).withColumn("_bucket", F.substring("key", 1, 3))
    by = ["seed", "stratum"]
    running = lambda *parts: Window.partitionBy(*by, *parts)
    totals = keyed.groupBy(*by, "quota", "_bucket").agg(F.sum("_cases").alias("_total"))
    up_to = totals.withColumn("_up_to", F.sum("_total").over(running().orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    over = up_to.filter("_up_to > quota").withColumn("_before", F.col("_up_to") - F.col("_total"))
    edge = cut(over.groupBy(*by).agg(F.min(F.struct("_bucket", "_before")).alias("_e")).select(*by, F.col("_e._bucket").alias("_edge"), "_e._before"))
    there = keyed.join(F.broadcast(edge), by).filter("_bucket = _edge")
    inside = F.sum("_cases").over(running().orderBy("key", "group_id").rowsBetween(Window.unboundedPreceding, 0))
    place = F.struct("key", "group_id")
    taken = there.withColumn("_inside", F.col("_before") + inside).filter("_inside <= quota")
    ends = edge.join(taken.groupBy(*by).agg(F.max(place).alias("_last")), by, "left").drop("_before")
    placed = keyed.join(F.broadcast(cut(ends)), by, "left")
    early = F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge"))
    last = (F.col("_bucket") == F.col("_edge")) & F.coalesce(place <= F.col("_last"), F.lit(False))
    return placed.withColumn("dev", L.as_flag(fits & (early | last))).drop("_cases", "_bucket", "_edge", "_last")


def score_seeds(candidates: DataFrame, features: list[str], share: int, whole: int) -> DataFrame:
    """Unfilled quota and squared relative feature error of every seed, from one aggregation."""
    per_stratum = candidates.groupBy("seed", "stratum").agg(
        F.max("quota").alias("quota"),
        F.sum(F.col("dev") * F.col("cases")).alias("taken"),
        *[F.sum(f"f_{f}").alias(f"all_{f}") for f in features],
        *[F.sum(F.col("dev") * F.col(f"f_{f}")).alias(f"dev_{f}") for f in features],
    )
    per_seed = per_stratum.groupBy("seed").agg(
        F.sum(F.col("quota") - F.col("taken")).alias("unfilled"),
        *[F.sum(f"all_{f}").alias(f"all_{f}") for f in features],
        *[F.sum(f"dev_{f}").alias(f"dev_{f}") for f in features],
    )
    error = F.lit(0.0)
    for f in features:
        target = half_up_share(F.col(f"all_{f}"), share, whole)
        error = error + F.pow((F.col(f"dev_{f}") - target) / F.greatest(target, F.lit(1)), 2)
    return per_seed.select("seed", "unfilled", F.round(error, 9).alias("objective"))


def best_seed(scores: DataFrame) -> DataFrame:
    return scores.orderBy("unfilled", "objective", "seed").limit(1)


ALL_FEATURES = [*FEATURES, "open_intent_candidate", "horizon_later", "horizon_unspecified"]


def choose_split(cases: DataFrame, group: str, seeds: int = 8, share: int = 3, whole: int = 10) -> DataFrame:
    """(group_id, split, stratum, cases) of the best seed."""
    groups = cut(group_table(cases, group))
    best = best_seed(score_seeds(candidate_splits(groups, seeds, share, whole), ALL_FEATURES, share, whole)).first()
    chosen = candidate_splits(groups, [best["seed"] if best else 0], share, whole)
    return chosen.select("group_id", F.when(F.col("dev") == 1, "dev").otherwise("test").alias("split"), "stratum", "cases")


def split_statistics(cases: DataFrame) -> DataFrame:
    """Per split, case counts of every dimension, and clusters per tag, in one pass over facts."""
    fact = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    single = [
        fact("all", F.lit("cases")),
        fact("decision", F.col("decision")),
        fact("intent", F.col("target_intent")),
        fact("horizon", F.col("horizon")),
        fact("open_intent", F.when(F.col("open_intent").isNotNull(), "present")),
    ]
    tags = F.transform("tags", lambda t: F.struct(F.lit("tag").alias("dimension"), t.alias("value")))
    return (
        cases.select("split", "cluster_id", F.inline(F.concat(F.array(*single), tags)))
        .filter("value IS NOT NULL")
        .groupBy("split", "dimension", "value")
        .agg(F.count("*").alias("cases"), F.count_distinct("cluster_id").alias("clusters"))
    )


# ---- samples that never take two cases of a cluster ------------------------------------------------------------


def phased_sample(
    rows: DataFrame, phases: list[tuple[Column, int]], order: list[str], unit: str, item: str, limit: int | None = None
) -> DataFrame:
    """(position, phase, item): phase after phase, the first ``quota`` items in order whose unit is not taken yet.

    One aggregation finds each unit's best item for every phase. A phase is then one job: a top-k over the units that are open,
    written, whose units are closed for the next phases. Only what is chosen is numbered. Phases that no row is in, or that ``limit``
    leaves nothing for, add no rows.
    """
    candidate = F.struct(*order, F.col(item).alias("item"))
    best = [F.min(F.when(condition, candidate)).alias(f"b{i}") for i, (condition, _) in enumerate(phases)]
    units = cut(rows.groupBy(F.col(unit).alias("unit")).agg(*best))
    few = sum(quota for _, quota in phases) <= BROADCAST_UNITS
    taken, count = None, 0
    for i, (_, quota) in enumerate(phases):
        quota = quota if limit is None else min(quota, limit - count)
        if quota <= 0:
            break
        left = units.filter(F.col(f"b{i}").isNotNull()).select("unit", F.col(f"b{i}").alias("b"))
        if taken is not None:
            closed = taken.select("unit")
            left = left.join(F.broadcast(closed) if few else closed, "unit", "left_anti")
        place = F.row_number().over(Window.orderBy("b")) - 1
        chosen = left.orderBy("b").limit(quota).select((place + count).cast("int").alias("position"), F.lit(i).alias("phase"), F.col("b.item").alias("item"), "unit")
        chosen = cut(chosen)
        count += chosen.count()
        taken = chosen if taken is None else taken.unionByName(chosen)
    if taken is None:
        return units.select(F.lit(0).alias("position"), F.lit(0).alias("phase"), F.col("unit").alias(item)).filter("false")
    return taken.select("position", "phase", F.col("item").alias(item))


def audit_sample(cases: DataFrame, intents: list[str], namespace: str) -> DataFrame:
    """Risky cases of distinct clusters: one per intent, four more in scope, four of each other decision."""
    rows = cases.withColumns({"neg_risk": -L.audit_risk(), "key": H.stable_key(namespace, "case_id")})
    phases = [(F.col("target_intent") == intent, 1) for intent in intents]
    phases += [(F.col("decision") == d, 4) for d in ["in_scope", "oos", "no_intent", "ambiguous"]]
    return phased_sample(rows, phases, ["neg_risk", "key"], "cluster_id", "case_id").drop("position")
