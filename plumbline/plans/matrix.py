"""Run matrix, pilot report and robustness report over any number of runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions.lineage import cut
from plumbline.operators import budget as B
from plumbline.operators import compare as C
from plumbline.operators import evaluate as E
from plumbline.schemas import DECISIONS


def _cells(spark, expected: list[tuple[str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(r).alias("role"), F.lit(a).alias("arm")) for r, a in expected]
    return spark.range(1).select(F.inline(F.array(*rows)))


def run_matrix(labelled: DataFrame, expected: list[tuple[str, str]], rates: tuple[float, float]) -> DataFrame:
    """A32 for rows with a role: one row per expected cell, also when no run filled it."""
    keys = ["role", "arm"]
    got = F.col("status").isNotNull()
    won = L.as_flag(F.col("status") == "success")
    counts = cut(
        labelled.groupBy(*keys, "decision", "pred_decision").agg(
            F.count("*").alias("n"),
            F.sum("hit").alias("hits"),
            F.sum(L.as_flag(got)).alias("predictions"),
            F.sum(won).alias("success"),
            F.sum(L.as_flag(got & F.col("total_tokens").isNull())).alias("unknown_usage"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in B.TOKEN_FIELDS],
        )
    )
    sums = ["n", "hits", "predictions", "success", "unknown_usage", *B.TOKEN_FIELDS]
    totals = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).withColumn(
        "cost", F.round(L.token_cost(*[F.lit(r) for r in rates]), 9)
    )
    f1 = E.macro_f1(E.label_counts(counts, keys, "decision", "pred_decision", DECISIONS), keys, "decision_macro_f1")
    known = F.col("unknown_usage") == 0
    return (
        _cells(labelled.sparkSession, expected)
        .join(totals, keys, "left")
        .join(f1, keys, "left")
        .select(
            *keys,
            L.as_flag(F.col("n").isNotNull()).alias("present"),
            F.coalesce("predictions", F.lit(0)).alias("prediction_count"),
            F.coalesce("success", F.lit(0)).alias("success_count"),
            F.coalesce(F.col("predictions") - F.col("success"), F.lit(0)).alias("failed_count"),
            F.coalesce(L.ratio(F.col("hits"), F.col("n")), F.lit(0.0)).alias("hem"),
            F.coalesce("decision_macro_f1", F.lit(0.0)).alias("decision_macro_f1"),
            L.as_flag(F.coalesce(known, F.lit(False))).alias("usage_complete"),
            F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
            F.coalesce("cost", F.lit(0.0)).alias("cost"),
        )
    )


def run_summaries(labelled: DataFrame, arms: list[str], intents: list[str], authority: str) -> DataFrame:
    """One row per run with its quality, failures, latency, usage and badcases."""
    near, quiet = L.has_tag("near_oos"), F.col("decision") == "no_intent"
    got = F.col("status").isNotNull()
    won = L.as_flag(F.col("status") == "success")
    sums = {
        "prediction_count": L.as_flag(got),
        "success_count": won,
        "near_n": L.as_flag(near),
        "near_hit": L.as_flag(near & (F.col("pred_decision") == "oos")),
        "quiet_n": L.as_flag(quiet),
        "quiet_hit": L.as_flag(quiet & (F.col("pred_decision") == "no_intent")),
        "context_distractor_errors": L.as_flag(L.has_tag("context_distractor")) * (1 - F.col("hit")),
        "schema_invalid": L.as_flag(F.col("status") == "schema_invalid"),
        "unknown_usage": L.as_flag(got & F.col("total_tokens").isNull()),
        "badcase_count": L.as_flag(F.size("errors") > 0),
    }
    keys = ["arm", "decision", "target_intent", "pred_decision", "pred_intent"]
    counts = cut(
        E.with_errors(labelled).groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.sum("hit").alias("hits"),
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
            *[F.sum(c).alias(k) for k, c in sums.items()],
        )
    )
    totals = counts.groupBy("arm").agg(*[F.sum(c).alias(c) for c in ["n", "hits", "tokens", *sums]])
    decision = E.label_counts(counts, ["arm"], "decision", "pred_decision", DECISIONS)
    intent = E.label_counts(E.in_scope(counts), ["arm"], "target_intent", "pred_intent", intents)
    latency = B.latency_summary(labelled.filter(got), ["arm"])
    return (
        totals.join(E.macro_f1(decision, ["arm"], "decision_macro_f1"), "arm")
        .join(E.macro_f1(intent, ["arm"], "intent_macro_f1"), "arm")
        .join(latency, "arm")
        .select(
            "arm",
            L.as_flag(F.col("arm") == authority).alias("verdict_authority"),
            "prediction_count",
            "success_count",
            (F.col("prediction_count") - F.col("success_count")).alias("failure_count"),
            L.ratio(F.col("hits"), F.col("n")).alias("hem"),
            "decision_macro_f1",
            "intent_macro_f1",
            L.ratio(F.col("near_hit"), F.col("near_n")).alias("near_oos_recall"),
            L.ratio(F.col("quiet_hit"), F.col("quiet_n")).alias("no_intent_recall"),
            "context_distractor_errors",
            "schema_invalid",
            "latency_complete",
            "p50",
            "p95",
            L.as_flag(F.col("unknown_usage") == 0).alias("usage_complete"),
            F.when(F.col("unknown_usage") == 0, F.col("tokens")).alias("total_tokens"),
            "badcase_count",
        )
    )


def pilot_verdicts(intervals: DataFrame, summaries: DataFrame, validity: DataFrame) -> DataFrame:
    """The intervals of each pair of runs and the two summaries, decided.

    A pair with a run that ``evaluate.run_validity`` refuses, or does not list, has no verdict. Both runs are aligned by
    construction: ``join_predictions`` gives every run the same gold cases.
    """
    def domain(name):
        here = F.col("domain") == name
        lower, upper = F.coalesce("lower", "point"), F.coalesce("upper", "point")
        return F.max(F.when(here, F.struct("point", lower.alias("lower"), upper.alias("upper"))))

    wide = intervals.groupBy("left_arm", "right_arm").agg(
        domain("full_hem").alias("hem"),
        domain("gold_in_scope_intent_macro_f1").alias("intent"),
        domain("near_oos_recall").alias("near"),
        domain("no_intent_recall").alias("quiet"),
        ((F.min("estimable") == 1) & (F.count_distinct("domain") == 4)).alias("estimable"),
    )

    def side(name):
        return gated.select(
            F.col("arm").alias(f"{name}_arm"),
            F.coalesce("valid", F.lit(0)).alias(f"{name}_valid"),
            F.col("context_distractor_errors").alias(f"{name}_context_errors"),
            F.col("schema_invalid").alias(f"{name}_schema_invalid"),
            F.col("total_tokens").alias(f"{name}_tokens"),
            F.col("usage_complete").alias(f"{name}_usage"),
            F.col("latency_complete").alias(f"{name}_latency"),
        )

    both = lambda f: (F.col(f"left_{f}") == 1) & (F.col(f"right_{f}") == 1)
    gated = summaries.join(validity.select("arm", L.as_flag(F.col("valid")).alias("valid")), "arm", "left")
    evidence = wide.join(side("left"), "left_arm").join(side("right"), "right_arm").withColumns(
        {
            "valid": both("valid"),
            "aligned": F.lit(True),
            "usage_complete": both("usage"),
            "cost_complete": both("usage"),
            "latency_complete": both("latency"),
        }
    )
    return C.decide(evidence)


SUMMARY_METRICS = ["prediction_count", "success_count", "failure_count", "hem", "decision_macro_f1", "intent_macro_f1", "near_oos_recall"]
SUMMARY_METRICS += ["no_intent_recall", "context_distractor_errors", "schema_invalid", "p50", "p95", "total_tokens"]


def robustness_report(
    matrix: DataFrame,
    role: str,
    reference: str,
    calls: DataFrame,
    cap: int,
    audit_rows: DataFrame,
    labelled: DataFrame,
    predictions: DataFrame,
    formed: DataFrame,
    arms: list[str],
    intents: list[str],
) -> DataFrame:
    """Each run of a role summarised, its deltas against the reference, pressure on the output cap, formed intentions, audit coverage.

    ``labelled`` are the role's rows as ``run_summaries`` takes them, ``predictions`` (arm, error_type) what it stored, and ``formed``
    (arm, status) its formed intentions. A total that is not known has a null value.
    """
    def tall(df, part, name, metrics):
        entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        return df.select(F.lit(part).alias("part"), F.col(name).alias("name"), F.inline(F.array(*entries)))

    fields = ["hem", "success_count"]
    deltas = B.run_deltas(matrix, role, reference, fields).select("arm", *[F.col(f"{f}_delta").alias(f) for f in fields])
    ended = F.coalesce(F.endswith("error_type", F.lit("incomplete")), F.lit(False))
    cut_off = predictions.groupBy("arm").agg(F.sum(L.as_flag(ended)).alias("incomplete_prediction_count"))
    won = L.as_flag(F.col("status") == "success")
    shaped = formed.groupBy("arm").agg(F.sum(won).alias("formed_success_count"), F.sum(1 - won).alias("formed_failure_count"))
    coverage = audit_rows.groupBy("role", "stage_status").agg(F.count("*").alias("n"))
    return E.union(
        [
            tall(run_summaries(labelled, arms, intents, reference), "summary", "arm", SUMMARY_METRICS),
            tall(cut_off, "summary", "arm", ["incomplete_prediction_count"]),
            tall(shaped, "formed", "arm", ["formed_success_count", "formed_failure_count"]),
            tall(deltas, "delta", "arm", fields),
            tall(B.cap_pressure(calls, cap), "cap", "arm", ["incomplete_calls", "within_one_of_cap"]),
            coverage.select(
                F.lit("audit").alias("part"),
                F.col("role").alias("name"),
                F.col("stage_status").alias("metric"),
                F.col("n").cast("double").alias("value"),
            ),
        ]
    ).withColumn("value", F.round("value", 9))
