"""The whole report of any number of runs, in tall form."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions.lineage import cut
from plumbline.operators import evaluate as E
from plumbline.schemas import DECISIONS


def _tall(df: DataFrame, slices: str | None, metrics: dict) -> DataFrame:
    entries = [
        F.struct(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))
        for name, column in metrics.items()
    ]
    key = F.lit("all") if slices is None else F.col(slices)
    return df.select("arm", key.alias("slice"), F.inline(F.array(*entries)))


def run_report(gold: DataFrame, predictions: DataFrame, arms: list[str], intents: list[str]) -> DataFrame:
    """A run that ``run_validity`` refuses has null values, and two more rows that tell why."""
    named = E.near_siblings(gold).select("case_id", F.lit(1).alias("sibling"))
    need = ["status", "decision", "predicted_intent", "horizon", "desired_experience", "object_slot"]
    marked = gold.withColumn("tagset", E.tag_set()).join(named, "case_id", "left")
    labelled = E.join_all_predictions(marked, predictions, arms, need)
    # One pass over the joined rows, down to one small table; every metric but the pairs, and the validity of the runs, is read
    # off that. Only what the keys do not tell is summed by row.
    missing = E._slot_missing("desired_experience", "p_experience") | E._slot_missing("object_slot", "p_object")
    keys = ["arm", "known", "decision", "target_intent", "pred_decision", "pred_intent", "status", "tagset"]
    every = cut(
        labelled.groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.sum("hit").alias("hits"),
            F.sum(F.coalesce("sibling", F.lit(0))).alias("sib_n"),
            F.sum(E.competitor_hit()).alias("rival"),
            F.sum(L.as_flag(L.ok() & ~missing)).alias("full"),
            F.sum(L.as_flag(L.ok() & F.col("horizon").eqNullSafe(F.col("p_horizon")))).alias("on_time"),
            F.sum(L.as_flag(F.col("times") > 1)).alias("repeated"),
            F.sum(L.as_flag(F.col("times") > 0)).alias("predicted"),
        )
    )
    validity = E.validity_from(every, arms)
    cells = every.filter("known").drop("known", "repeated", "predicted")

    def where(condition, value="n"):
        return F.when(condition, F.col(value)).otherwise(F.lit(0).cast("bigint"))

    tagged = lambda tag: F.array_contains("tagset", tag)
    wrong = F.col("n") - F.col("hits")
    none = F.lit(0).cast("bigint")
    flags = {
        "near_n": where(tagged("near_oos")),
        "near_hit": where(tagged("near_oos") & (F.col("pred_decision") == "oos")),
        "sib_reject": where(F.col("pred_decision") == "oos", "sib_n"),
        "ctx_d": F.when(tagged("context_distractor"), wrong).otherwise(none),
        "ctx_c": F.when(tagged("context_control"), wrong).otherwise(none),
        "hard_n": where(tagged("hard_negative")),
        "hard_hit": where(tagged("hard_negative"), "rival"),
        "slot_n": where(tagged("slot_required")),
        "slot_full": where(tagged("slot_required"), "full"),
        "slot_horizon": where(tagged("slot_required"), "on_time"),
        "quiet_n": where(tagged("quiet_control")),
        "quiet_hit": where(tagged("quiet_control") & (F.col("pred_decision") == "no_intent")),
        "got": where(F.col("status").isNotNull()),
        "missing": where(F.col("status").isNull()),
        "provider_failure": where(F.col("status") == "provider_failure"),
        "schema_invalid": where(F.col("status") == "schema_invalid"),
    }
    counts = cells.withColumns(flags)
    totals = counts.groupBy("arm").agg(*[F.sum(k).alias(k) for k in ["n", "hits", "sib_n", *flags]])
    rates = {
        "hierarchical_exact_match": ("hits", "n"),
        "near_oos_recall": ("near_hit", "near_n"),
        "sibling_false_reject_rate": ("sib_reject", "sib_n"),
        "hard_negative_hit_rate": ("hard_hit", "hard_n"),
        "slot_completeness": ("slot_full", "slot_n"),
        "horizon_accuracy": ("slot_horizon", "slot_n"),
        "quiet_control_recall": ("quiet_hit", "quiet_n"),
    }
    totals = totals.withColumns({k: L.ratio(F.col(a), F.col(b)) for k, (a, b) in rates.items()})
    totals = totals.withColumn("ctx_delta", F.col("ctx_d") - F.col("ctx_c"))
    plain = {k: k for k in rates} | {
        "gold_case_count": "n",
        "prediction_count": "got",
        "context_distractor_errors": "ctx_d",
        "context_control_errors": "ctx_c",
        "context_error_delta": "ctx_delta",
        "hard_negative_hits": "hard_hit",
        "failures_missing": "missing",
        "failures_provider_failure": "provider_failure",
        "failures_schema_invalid": "schema_invalid",
    }
    decision_tallies = E.label_counts(counts, ["arm"], "decision", "pred_decision", DECISIONS)
    intent_tallies = E.label_counts(E.in_scope(counts), ["arm"], "target_intent", "pred_intent", intents)
    confusion = E.confusion(counts, ["arm"]).withColumn("cell", F.concat_ws(">", "decision", "pred_decision"))
    pair_need = ["status", "decision", "predicted_intent", "candidate_intents"]
    in_pairs = gold.filter(L.has_tag("context_control") | L.has_tag("context_distractor"))
    pairs = E.context_pairs(E.join_predictions(in_pairs, predictions, arms, pair_need))
    slices = (
        counts.withColumn("tag", F.explode("tagset"))
        .groupBy("arm", "tag", "decision", "pred_decision")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    )
    slice_table = E.slice_metrics_from(slices, gold, arms)
    slice_cells = E.slice_confusion_from(slices, arms).withColumn(
        "cell", F.concat_ws(">", "tag", "decision", "pred_decision")
    )
    overlap = (
        E.slice_overlap_from(counts.filter(F.col("arm") == arms[0]))
        .withColumn("arm", F.lit("-"))
        .withColumn("cell", F.concat_ws(">", "left_tag", "right_tag"))
    )
    report = E.union(
        [
            _tall(totals, None, plain),
            _tall(E.macro_f1(decision_tallies, ["arm"], "f"), None, {"decision_macro_f1": "f"}),
            _tall(E.macro_f1(intent_tallies, ["arm"], "f"), None, {"intent_macro_f1": "f"}),
            _tall(E.with_prf(decision_tallies), "label", {"precision": "precision", "recall": "recall", "f1": "f1"}),
            _tall(E.with_prf(intent_tallies), "label", {"intent_recall": "recall"}),
            _tall(confusion, "cell", {"confusion": "n"}),
            _tall(
                E.flip_rates(pairs),
                None,
                {"context_pairs": "pairs", "flip_rate": "flip_rate", "adverse_flip_rate": "adverse_rate"},
            ),
            _tall(
                slice_table,
                "tag",
                {c: c for c in ["case_count", "cluster_count", "hem", "decision_accuracy"]},
            ),
            _tall(slice_cells, "cell", {"slice_confusion": "n"}),
            _tall(overlap, "cell", {"slice_overlap": "n"}),
        ]
    )
    valid = ~F.array_contains(E.invalid_runs(validity), F.col("arm"))
    why = {"repeated_predictions": "repeated", "unknown_predictions": "unknown"}
    return report.withColumn("value", F.when(valid, F.round("value", 9))).unionByName(
        _tall(validity.filter(~F.col("valid")), None, why)
    )
