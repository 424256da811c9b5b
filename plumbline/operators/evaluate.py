"""Gold against predictions. The gold set is the universe: a missing or failed prediction stays in, as wrong.

Most metrics are read off one small table of counts (``outcome_counts``), so a run report needs one join and one
aggregation with map-side combine, however many metrics it has.
"""

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions.skew import skew_join
from plumbline.schemas import DECISIONS, ERROR_PRIORITY, PREDICTED_DECISIONS, SLICE_TAGS

PREDICTION_COLUMNS = [
    "status",
    "decision",
    "predicted_intent",
    "candidate_intents",
    "horizon",
    "desired_experience",
    "object_slot",
    "latency_ms",
    "total_tokens",
]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def literal_rows(values: list[str]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def _said(predictions: DataFrame) -> tuple[Column, list[Column]]:
    """What a prediction says, as one value, and that value's parts ``p`` named apart from the columns of the gold rows."""
    columns = [c for c in PREDICTION_COLUMNS if c in predictions.columns]
    renamed = {"decision": "p_decision", "predicted_intent": "p_intent", "horizon": "p_horizon"}
    renamed |= {"desired_experience": "p_experience", "object_slot": "p_object"}
    return F.struct(*columns), [F.col(f"p.{c}").alias(renamed.get(c, c)) for c in columns]


def prediction_side(predictions: DataFrame) -> DataFrame:
    """The columns that metrics need, one row per (arm, case), named apart from those of the gold rows.

    Repeats that say the same are one prediction; where they differ none is chosen, and the case counts as missing.
    Repeats are combined before the shuffle, so a hot id cannot swell the join.
    """
    said, parts = _said(predictions)
    each = predictions.groupBy("arm", "case_id").agg(F.min(said).alias("low"), F.max(said).alias("high"))
    agreed = each.select("arm", "case_id", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("high")).alias("p"))
    return agreed.select("arm", "case_id", *parts)


def run_validity(gold: DataFrame, predictions: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, repeated, unknown, valid): a run that predicts a case twice, or one that gold does not have, is not valid."""
    counts = predictions.filter(F.col("arm").isin(*arms)).groupBy("arm", "case_id").agg(F.count("*").alias("n"))
    known = gold.select("case_id", F.lit(True).alias("known")).distinct()
    per_arm = counts.join(known, "case_id", "left").groupBy("arm").agg(
        F.sum(L.as_flag(F.col("n") > 1)).alias("repeated"), F.sum(L.as_flag(F.col("known").isNull())).alias("unknown")
    )
    return _validity(per_arm, arms)


def validity_from(counts: DataFrame, arms: list[str]) -> DataFrame:
    """``run_validity`` from sums over ``join_all_predictions``: cases ``predicted``, and those predicted ``repeated``ly, by (arm, known)."""
    strange = F.when(~F.col("known"), F.col("predicted")).otherwise(0)
    return _validity(counts.groupBy("arm").agg(F.sum("repeated").alias("repeated"), F.sum(strange).alias("unknown")), arms)


def _validity(per_arm: DataFrame, arms: list[str]) -> DataFrame:
    every = per_arm.sparkSession.range(1).select(literal_rows(arms).alias("arm"))
    rows = every.join(per_arm, "arm", "left").fillna(0, ["repeated", "unknown"])
    return rows.withColumn("valid", (F.col("repeated") == 0) & (F.col("unknown") == 0))


def invalid_runs(validity: DataFrame) -> Column:
    """The arms that ``run_validity`` refuses, as one array."""
    return validity.filter(~F.col("valid")).agg(F.collect_set("arm").alias("runs")).scalar()


def join_predictions(gold: DataFrame, predictions: DataFrame, arms: list[str], need: list[str] | None = None) -> DataFrame:
    """Every gold case once per arm, with its prediction if there is one (see ``prediction_side``).

    ``run_validity`` tells the runs that have repeats; reports, intervals and verdicts null what they say of these.
    """
    return _labelled(_joined(gold, predictions, arms, need, "left"))


def join_all_predictions(gold: DataFrame, predictions: DataFrame, arms: list[str], need: list[str]) -> DataFrame:
    """The rows of ``join_predictions``, with ``known``, and of each arm's cases that gold does not have one row, not ``known``.

    ``times`` is how often the arm predicts the case, told once however often gold has it, so sums of it are those of ``run_validity``.
    """
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("case_id"))
    joined = _joined(gold.withColumn("_nth", nth), predictions, arms, need, "full")
    once = F.when(F.coalesce("_nth", F.lit(1)) == 1, F.col("times")).otherwise(F.lit(0).cast("bigint"))
    return _labelled(joined.withColumns({"known": F.col("_nth").isNotNull(), "times": once}).drop("_nth"), "times")


def _joined(gold: DataFrame, predictions: DataFrame, arms: list[str], need: list[str] | None, how: str) -> DataFrame:
    """Cases meet what all arms say of them in one row, which is made a row per arm after the join, so no shuffle moves a case once per arm."""
    arms = list(dict.fromkeys(arms))
    if need is not None:
        predictions = predictions.select("arm", "case_id", *need)
    said, parts = _said(predictions)
    sides = []
    for i, arm in enumerate(arms):
        its = F.when(F.col("arm") == arm, said)
        sides += [F.min(its).alias(f"_low{i}"), F.max(its).alias(f"_high{i}"), F.count_if(F.col("arm") == arm).alias(f"_n{i}")]
    each = predictions.filter(F.col("arm").isin(*arms)).groupBy("case_id").agg(*sides)
    agreed = [F.when(F.col(f"_low{i}").eqNullSafe(F.col(f"_high{i}")), F.col(f"_high{i}")) for i in range(len(arms))]
    runs = [
        F.struct(F.lit(arm).alias("arm"), F.coalesce(f"_n{i}", F.lit(0).cast("bigint")).alias("times"), p.alias("p"))
        for i, (arm, p) in enumerate(zip(arms, agreed, strict=True))
    ]
    rest = [F.col(c) for c in gold.columns if c not in ("arm", "case_id")]
    joined = gold.drop("arm").join(each, "case_id", how)
    return joined.select(F.inline(F.array(*runs)), "case_id", *rest).select("arm", "case_id", *rest, "times", *parts)


def _labelled(joined: DataFrame, *kept: str) -> DataFrame:
    rows = joined if kept else joined.drop("times")
    return rows.withColumns(
        {"pred_decision": L.predicted_decision(), "pred_intent": L.predicted_intent(), "hit": L.exact_match()}
    )


def near_siblings(gold: DataFrame) -> DataFrame:
    """In-scope cases whose (contrast group, target) is named as a sibling by a near-OOS case."""
    named = (
        gold.filter(L.has_tag("near_oos"))
        .select("contrast_id", F.explode("siblings").alias("target_intent"))
        .distinct()
    )
    return gold.filter("decision = 'in_scope'").join(named, ["contrast_id", "target_intent"], "left_semi")


def prediction_signature() -> Column:
    return F.when(F.col("status").isNull(), "missing").otherwise(
        F.concat_ws(
            "/",
            "status",
            F.coalesce("p_decision", F.lit("-")),
            F.coalesce("p_intent", F.lit("-")),
            F.coalesce(F.array_join(F.array_sort("candidate_intents"), ","), F.lit("")),
        )
    )


def context_controls(labelled: DataFrame) -> DataFrame:
    """The (last) control of each contrast group, per arm."""
    return (
        labelled.withColumn("signature", prediction_signature())
        .filter(L.has_tag("context_control"))
        .groupBy("arm", "contrast_id")
        .agg(F.max(F.struct("case_id", "signature", "hit")).alias("c"))
        .select(
            "arm",
            "contrast_id",
            F.col("c.case_id").alias("control_id"),
            F.col("c.signature").alias("control_signature"),
            F.col("c.hit").alias("control_hit"),
        )
    )


def context_pairs(labelled: DataFrame) -> DataFrame:
    """Each distractor with the (last) control of its contrast group, per arm."""
    distractors = labelled.withColumn("signature", prediction_signature()).filter(L.has_tag("context_distractor")).select(
        "arm", "contrast_id", "case_id", "signature", "hit"
    )
    return skew_join(distractors, context_controls(labelled), ["arm", "contrast_id"]).withColumns(
        {
            "flip": L.as_flag(F.col("signature") != F.col("control_signature")),
            "adverse": L.as_flag((F.col("control_hit") == 1) & (F.col("hit") == 0)),
        }
    )


def with_adverse(labelled: DataFrame) -> DataFrame:
    """Every row, with ``adverse`` of 1 where it is a wrong distractor whose control is right, else null.

    The rows meet the controls as they are, so they are made twice, not once more for the pairs. Rows without a pair are dealt out by
    case; as nulls they would be one key.
    """
    paired = L.has_tag("context_distractor") & F.col("contrast_id").isNotNull()
    alone = F.xxhash64("case_id").bitwiseAND(F.lit(1023)) + 1
    rows = labelled.withColumns({"_pair": F.when(paired, F.col("contrast_id")), "_alone": F.when(paired, 0).otherwise(alone)})
    controls = context_controls(labelled).select(
        "arm", F.col("contrast_id").alias("_pair"), F.lit(0).cast("bigint").alias("_alone"), "control_hit"
    )
    adverse = F.when((F.col("control_hit") == 1) & (F.col("hit") == 0), 1)
    joined = skew_join(rows, controls, ["arm", "_pair", "_alone"], "left")
    return joined.withColumn("adverse", adverse).drop("_pair", "_alone", "control_hit")


# ---- counts and fixed-label metrics ----------------------------------------------------------------------------


def outcome_counts(labelled: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "decision", "target_intent", "pred_decision", "pred_intent"]
    return labelled.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


def hit_rate(counts: DataFrame, by: list[str]) -> DataFrame:
    """A01 from counts."""
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).withColumn(
        "hem", L.ratio(F.col("hits"), F.col("n"))
    )


def label_counts(counts: DataFrame, by: list[str], gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """TP, FP and FN of every fixed label: absent labels are there with zeros, other labels only as errors."""
    value = F.lit(0).cast("bigint")
    tallies = []
    for label in labels:
        is_gold, is_predicted = F.col(gold) == label, F.col(predicted) == label
        is_gold, is_predicted = F.coalesce(is_gold, F.lit(False)), F.coalesce(is_predicted, F.lit(False))
        tallies.append(
            F.struct(
                F.lit(label).alias("label"),
                F.sum(F.when(is_gold & is_predicted, F.col("n")).otherwise(value)).alias("tp"),
                F.sum(F.when(~is_gold & is_predicted, F.col("n")).otherwise(value)).alias("fp"),
                F.sum(F.when(is_gold & ~is_predicted, F.col("n")).otherwise(value)).alias("fn"),
            )
        )
    return counts.groupBy(*by).agg(F.array(*tallies).alias("t")).select(*by, F.inline("t"))


def with_prf(tallies: DataFrame) -> DataFrame:
    """Precision, recall and F1 with zero for a zero denominator."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = tallies.withColumns({"precision": L.ratio(tp, tp + fp), "recall": L.ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def macro_f1(tallies: DataFrame, by: list[str], name: str) -> DataFrame:
    return with_prf(tallies).groupBy(*by).agg(F.round(F.avg("f1"), 9).alias(name))


def in_scope(df: DataFrame) -> DataFrame:
    return df.filter("decision = 'in_scope'")


def full_grid(counts: DataFrame, by: list[str], keys: dict[str, list[str]]) -> DataFrame:
    """Sum of n on the complete grid of fixed labels, zero where nothing fell; one aggregation, no join."""
    cells = []
    for values in product(*keys.values()):
        here = F.lit(True)
        for name, value in zip(keys, values, strict=True):
            here = here & F.coalesce(F.col(name) == value, F.lit(False))
        labels = [F.lit(v).alias(k) for k, v in zip(keys, values, strict=True)]
        cells.append(F.struct(*labels, F.sum(F.when(here, F.col("n")).otherwise(F.lit(0).cast("bigint"))).alias("n")))
    found = counts.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
    return found.groupBy(*by).agg(F.array(*cells).alias("g")).select(*by, F.inline("g"))


def confusion(counts: DataFrame, by: list[str]) -> DataFrame:
    """Four gold rows by five predicted columns."""
    return full_grid(counts, by, {"decision": DECISIONS, "pred_decision": PREDICTED_DECISIONS})


def normalised_confusion(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts, gold row totals and row fractions."""
    total = F.sum("n").over(Window.partitionBy(*by, "decision"))
    return confusion(counts, by).withColumn("gold_count", total).withColumn(
        "row_fraction", F.round(L.ratio(F.col("n"), F.col("gold_count")), 6)
    )


def failure_counts(labelled: DataFrame, by: list[str]) -> DataFrame:
    """A08."""
    reason = F.coalesce("status", F.lit("missing"))
    counts = labelled.withColumn("failure", reason).groupBy(*by, "failure").agg(F.count("*").alias("n"))
    return full_grid(counts, by, {"failure": ["missing", "provider_failure", "schema_invalid"]})


def tagged_recall(labelled: DataFrame, tag: str, decision: str) -> DataFrame:
    """Share of a tag's cases that got the wanted decision."""
    right = L.as_flag(F.col("pred_decision") == decision)
    picked = L.as_flag(L.has_tag(tag))
    return labelled.groupBy("arm").agg(
        F.sum(picked).alias("n"), F.sum(picked * right).alias("hits")
    ).withColumn("recall", L.ratio(F.col("hits"), F.col("n")))


def sibling_false_rejects(labelled_siblings: DataFrame) -> DataFrame:
    """A10, over the cases of ``near_siblings``."""
    return labelled_siblings.groupBy("arm").agg(
        F.count("*").alias("n"), F.sum(L.as_flag(F.col("pred_decision") == "oos")).alias("false_rejects")
    ).withColumn("rate", L.ratio(F.col("false_rejects"), F.col("n")))


def context_errors(labelled: DataFrame) -> DataFrame:
    """A11."""
    wrong = 1 - F.col("hit")
    return labelled.groupBy("arm").agg(
        F.sum(wrong * L.as_flag(L.has_tag("context_distractor"))).alias("distractor_errors"),
        F.sum(wrong * L.as_flag(L.has_tag("context_control"))).alias("control_errors"),
    ).withColumn("delta", F.col("distractor_errors") - F.col("control_errors"))


def flip_rates(pairs: DataFrame) -> DataFrame:
    """A12, A13."""
    return pairs.groupBy("arm").agg(
        F.count("*").alias("pairs"), F.sum("flip").alias("flips"), F.sum("adverse").alias("adverse_flips")
    ).withColumns(
        {
            "flip_rate": L.ratio(F.col("flips"), F.col("pairs")),
            "adverse_rate": L.ratio(F.col("adverse_flips"), F.col("pairs")),
        }
    )


def by_tag(labelled: DataFrame) -> DataFrame:
    """One row per registered tag of a case."""
    known = F.array(*[F.lit(t) for t in SLICE_TAGS])
    return labelled.withColumn("tag", F.explode(F.array_intersect("tags", known)))


def slice_counts(labelled: DataFrame) -> DataFrame:
    return by_tag(labelled).groupBy("arm", "tag", "decision", "pred_decision").agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits")
    )


def slice_metrics(labelled: DataFrame, gold: DataFrame, arms: list[str]) -> DataFrame:
    """Every registered tag, also the empty ones. Clusters are a property of gold, counted once for all arms."""
    return slice_metrics_from(slice_counts(labelled), gold, arms)


def slice_metrics_from(counts: DataFrame, gold: DataFrame, arms: list[str]) -> DataFrame:
    right = F.when(F.col("decision") == F.col("pred_decision"), F.col("n")).otherwise(0)
    per_tag = counts.groupBy("arm", "tag").agg(
        F.sum("n").alias("case_count"), F.sum("hits").alias("hits"), F.sum(right).alias("right")
    )
    clusters = by_tag(gold).groupBy("tag").agg(F.count_distinct("cluster_id").alias("cluster_count"))
    spark = gold.sparkSession
    grid = spark.range(1).select(literal_rows(SLICE_TAGS).alias("tag")).withColumn("arm", literal_rows(arms))
    return (
        grid.join(per_tag, ["arm", "tag"], "left")
        .join(clusters, "tag", "left")
        .fillna(0, ["case_count", "hits", "right", "cluster_count"])
        .select(
            "arm",
            "tag",
            "case_count",
            "cluster_count",
            L.ratio(F.col("hits"), F.col("case_count")).alias("hem"),
            L.ratio(F.col("right"), F.col("case_count")).alias("decision_accuracy"),
        )
    )


def slice_confusion(labelled: DataFrame, arms: list[str]) -> DataFrame:
    """A15."""
    return slice_confusion_from(slice_counts(labelled), arms)


def slice_confusion_from(counts: DataFrame, arms: list[str]) -> DataFrame:
    spark = counts.sparkSession
    grid = spark.range(1).select(literal_rows(arms).alias("arm"))
    for name, values in [("tag", SLICE_TAGS), ("decision", DECISIONS), ("pred_decision", PREDICTED_DECISIONS)]:
        grid = grid.withColumn(name, literal_rows(values))
    keys = ["arm", "tag", "decision", "pred_decision"]
    return grid.join(counts.select(*keys, "n"), keys, "left").fillna(0, ["n"])


def tag_set() -> Column:
    """The registered tags of a case in one order, as a grouping key: far fewer sets than cases. (``array_sort`` is a lambda.)"""
    return F.sort_array(F.array_intersect(F.array_distinct("tags"), F.array(*[F.lit(t) for t in SLICE_TAGS])))


def slice_overlap(gold: DataFrame) -> DataFrame:
    """Tag by tag co-occurrence with the diagonal, on the complete grid."""
    return slice_overlap_from(gold.groupBy(tag_set().alias("tagset")).agg(F.count("*").alias("n")))


def slice_overlap_from(sets: DataFrame) -> DataFrame:
    found = (
        sets.select("tagset", "n", F.explode("tagset").alias("left_tag"))
        .select("n", "left_tag", F.explode("tagset").alias("right_tag"))
        .groupBy("left_tag", "right_tag")
        .agg(F.sum("n").alias("n"))
    )
    grid = sets.sparkSession.range(1).select(literal_rows(SLICE_TAGS).alias("left_tag")).withColumn(
        "right_tag", literal_rows(SLICE_TAGS)
    )
    return grid.join(found, ["left_tag", "right_tag"], "left").fillna(0, ["n"])


def competitor_hit() -> Column:
    named = F.array_contains("hard_negative_against", F.col("pred_intent"))
    return L.as_flag((F.col("pred_intent") != "invalid") & named)


def competitor_hits(labelled: DataFrame) -> DataFrame:
    """A17."""
    hard = L.as_flag(L.has_tag("hard_negative"))
    return labelled.groupBy("arm").agg(
        F.sum(hard).alias("n"), F.sum(hard * competitor_hit()).alias("hits")
    ).withColumn("rate", L.ratio(F.col("hits"), F.col("n")))


def _slot_missing(gold: str, predicted: str) -> Column:
    return F.col(gold).isNotNull() & F.col(predicted).isNull()


def slot_metrics(labelled: DataFrame) -> DataFrame:
    """Required slots filled, and horizon right, on slot_required cases."""
    required = L.as_flag(L.has_tag("slot_required"))
    filled = L.ok() & ~_slot_missing("desired_experience", "p_experience") & ~_slot_missing("object_slot", "p_object")
    horizon = L.ok() & F.col("horizon").eqNullSafe(F.col("p_horizon"))
    return labelled.groupBy("arm").agg(
        F.sum(required).alias("n"),
        F.sum(required * L.as_flag(filled)).alias("complete"),
        F.sum(required * L.as_flag(horizon)).alias("horizon_right"),
    ).withColumns(
        {
            "completeness": L.ratio(F.col("complete"), F.col("n")),
            "horizon_accuracy": L.ratio(F.col("horizon_right"), F.col("n")),
        }
    )


# ---- badcases --------------------------------------------------------------------------------------------------


def with_errors(labelled: DataFrame) -> DataFrame:
    """Every case with its errors in priority order, and the priority of the first; none is an empty list."""
    gold, predicted = F.col("decision"), F.col("p_decision")
    wrong = ~gold.eqNullSafe(predicted)
    slots = L.ok() & L.has_tag("slot_required")
    route = (
        F.when(F.col("status").isNull(), "missing_prediction")
        .when(F.col("status") != "success", F.col("status"))
        .when(wrong & (gold == "in_scope") & (predicted == "oos"), "known_intent_false_reject")
        .when(wrong & (gold == "oos") & (predicted == "in_scope"), "oos_false_accept")
        .when(wrong & (gold == "no_intent"), "no_intent_overaction")
        .when(wrong & (gold == "ambiguous") & (predicted == "in_scope"), "ambiguity_forced_choice")
        .when(wrong, "decision_mismatch")
        .when(F.col("hit") == 0, "intent_misroute")
    )
    errors = F.array_compact(
        F.array(
            route,
            F.when(competitor_hit() == 1, "hard_negative_competitor_hit"),
            F.when(F.col("adverse") == 1, "context_adverse_flip"),
            F.when(slots & _slot_missing("desired_experience", "p_experience"), "desired_experience_missing"),
            F.when(slots & _slot_missing("object_slot", "p_object"), "object_missing"),
            F.when(slots & ~F.col("horizon").eqNullSafe(F.col("p_horizon")), "horizon_mismatch"),
        )
    )
    order = F.array(*[F.lit(e) for e in ERROR_PRIORITY])
    found = with_adverse(labelled).withColumn("errors", errors)
    return found.withColumn("priority", F.array_position(order, F.get("errors", F.lit(0))))


def badcases(labelled: DataFrame) -> DataFrame:
    """Every case with at least one error, errors in priority order."""
    return with_errors(labelled).filter(F.size("errors") > 0)


def ordered_badcases(bad: DataFrame) -> DataFrame:
    """First error's priority, then id; a range-partitioned sort."""
    return bad.orderBy("arm", "priority", "case_id")


def badcase_error_counts(bad: DataFrame, arms: list[str]) -> DataFrame:
    """A22."""
    counts = bad.select("arm", F.explode("errors").alias("error")).groupBy("arm", "error").agg(F.count("*").alias("n"))
    grid = bad.sparkSession.range(1).select(literal_rows(arms).alias("arm")).withColumn("error", literal_rows(ERROR_PRIORITY))
    return grid.join(counts, ["arm", "error"], "left").fillna(0, ["n"])
