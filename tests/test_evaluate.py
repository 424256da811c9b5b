"""Boundary cases of the metrics on small literal tables."""

import pytest
from pyspark.sql import functions as F

import plumbline.catalog  # noqa: F401  (registers the queries)
from plumbline.catalog.registry import QUERIES
from plumbline.operators import evaluate as E
from plumbline.schemas import DECISIONS, SLICE_TAGS
from tests.harness import DATA

GOLD = """case_id bigint, decision string, target_intent string, tags array<string>, hard_negative_against array<string>,
 siblings array<string>, contrast_id bigint, cluster_id bigint, horizon string, desired_experience string, object_slot string"""
PREDICTION = """arm string, case_id bigint, status string, decision string, predicted_intent string,
 candidate_intents array<string>, horizon string, desired_experience string, object_slot string"""


def case(i, decision, target=None, tags=(), rivals=(), siblings=(), contrast=None, cluster=None, horizon="now", exp=None, obj=None):
    return (i, decision, target, list(tags), list(rivals), list(siblings), contrast or i, cluster or i, horizon, exp, obj)


def said(i, decision=None, target=None, status="success", candidates=None, horizon="now", exp=None, obj=None, arm="A"):
    candidates = [] if candidates is None and status == "success" else candidates
    return (arm, i, status, decision, target, candidates, horizon if status == "success" else None, exp, obj)


def labelled(spark, gold, predictions, arms=("A",)):
    return E.join_predictions(
        spark.createDataFrame(gold, GOLD), spark.createDataFrame(predictions, PREDICTION), list(arms)
    )


def one(df):
    return df.collect()[0].asDict()


def test_missing_and_failed_predictions_stay_in_and_are_wrong(spark):
    gold = [case(1, "in_scope", "x"), case(2, "oos"), case(3, "no_intent"), case(4, "ambiguous")]
    rows = labelled(spark, gold, [said(1, "in_scope", "x"), said(2, status="provider_failure"), said(3, status="schema_invalid")])
    counts = E.outcome_counts(rows, ["arm"])
    assert one(E.hit_rate(counts, ["arm"]))["hem"] == 0.25
    failures = {r["failure"]: r["n"] for r in E.failure_counts(rows, ["arm"]).collect()}
    assert failures == {"missing": 1, "provider_failure": 1, "schema_invalid": 1}
    cells = {(r["decision"], r["pred_decision"]): r["n"] for r in E.confusion(counts, ["arm"]).collect()}
    assert len(cells) == 20 and cells["oos", "invalid"] == 1 and cells["ambiguous", "invalid"] == 1


def test_right_decision_with_wrong_target_is_no_exact_match(spark):
    rows = labelled(spark, [case(1, "in_scope", "x"), case(2, "oos")], [said(1, "in_scope", "y"), said(2, "oos")])
    assert [r["hit"] for r in rows.orderBy("case_id").collect()] == [0, 1]


def test_macro_f1_keeps_absent_labels_as_zero(spark):
    rows = labelled(spark, [case(1, "in_scope", "x")], [said(1, "in_scope", "x")])
    counts = E.outcome_counts(rows, ["arm"])
    tallies = E.label_counts(counts, ["arm"], "decision", "pred_decision", DECISIONS)
    assert one(E.macro_f1(tallies, ["arm"], "f"))["f"] == 0.25
    intents = E.label_counts(E.in_scope(counts), ["arm"], "target_intent", "pred_intent", ["x", "y", "z"])
    assert one(E.macro_f1(intents, ["arm"], "f"))["f"] == pytest.approx(1 / 3)


def test_empty_slices_are_reported(spark):
    gold = spark.createDataFrame([case(1, "oos", tags=["far_oos"])], GOLD)
    rows = E.join_predictions(gold, spark.createDataFrame([said(1, "oos")], PREDICTION), ["A"])
    table = {r["tag"]: r for r in E.slice_metrics(rows, gold, ["A"]).collect()}
    assert set(table) == set(SLICE_TAGS)
    assert table["far_oos"]["hem"] == 1.0 and table["far_oos"]["cluster_count"] == 1
    assert table["quiet_control"]["case_count"] == 0 and table["quiet_control"]["hem"] == 0.0


def test_context_flip_and_adverse_flip(spark):
    gold = [
        case(1, "ambiguous", tags=["context_control"], contrast=7),
        case(2, "ambiguous", tags=["context_distractor"], contrast=7),
        case(3, "oos", tags=["context_control"], contrast=8),
        case(4, "oos", tags=["context_distractor"], contrast=8),
        case(5, "oos", tags=["context_control"], contrast=9),
        case(6, "oos", tags=["context_distractor"], contrast=9),
    ]
    predictions = [
        said(1, "ambiguous", candidates=["b", "a"]),
        said(2, "ambiguous", candidates=["a", "b"]),
        said(3, "oos"),
        said(5, "no_intent"),
        said(6, "no_intent"),
    ]
    got = one(E.flip_rates(E.context_pairs(labelled(spark, gold, predictions))))
    assert (got["pairs"], got["flips"], got["adverse_flips"]) == (3, 1, 1)


def test_badcases_order_errors_by_priority(spark):
    gold = [
        case(1, "no_intent", tags=["hard_negative"], rivals=["x"]),
        case(2, "in_scope", "x", tags=["slot_required"], exp="calm", obj="book", horizon="later"),
        case(3, "oos"),
        case(4, "no_intent"),
    ]
    predictions = [said(1, "in_scope", "x"), said(2, "in_scope", "y", horizon="now"), said(4, "ambiguous")]
    bad = {r["case_id"]: r["errors"] for r in E.badcases(labelled(spark, gold, predictions)).collect()}
    assert bad[1] == ["no_intent_overaction", "hard_negative_competitor_hit"]
    assert bad[2] == ["intent_misroute", "desired_experience_missing", "object_missing", "horizon_mismatch"]
    assert bad[3] == ["missing_prediction"]
    assert bad[4] == ["no_intent_overaction"]


def test_repeated_predictions_do_not_multiply_cases(spark):
    rows = labelled(spark, [case(1, "oos")], [said(1, "oos"), said(1, "no_intent"), said(1, "oos")])
    assert rows.count() == 1


def test_half_of_all_predictions_on_one_id(spark):
    gold = spark.range(1, 200).select(
        F.col("id").alias("case_id"), F.lit("oos").alias("decision"), F.lit(None).cast("string").alias("target_intent")
    )
    many = spark.range(20000).select(
        F.lit("A").alias("arm"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 199 + 1).cast("bigint").alias("case_id"),
        F.lit("success").alias("status"),
        F.lit("oos").alias("decision"),
        F.lit(None).cast("string").alias("predicted_intent"),
    )
    assert E.join_predictions(gold, many, ["A"]).agg(F.sum("hit")).first()[0] == 199


def test_badcases_make_the_joined_rows_twice(spark):
    """Once for the cases and once for the controls of their pairs; wrong distractors without a group, or whose control is wrong, flip nothing."""
    plan = QUERIES["a21_badcases"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4  # gold and predictions of each, both made from orders
    tags = lambda *names: list(names)
    rows = [
        (1, "oos", tags("context_control"), 7, 1),
        (2, "oos", tags("context_distractor"), 7, 0),
        (3, "oos", tags("context_distractor"), 7, 1),
        (4, "oos", tags("context_distractor"), None, 0),
        (5, "oos", tags("context_control"), None, 1),
        (6, "oos", tags("context_control"), 8, 1),
        (9, "oos", tags("context_control"), 8, 0),
        (8, "oos", tags("context_distractor"), 8, 0),
        (10, "oos", tags(), 7, 0),
    ]
    gold = spark.createDataFrame([r[:4] for r in rows], "case_id bigint, decision string, tags array<string>, contrast_id bigint")
    said = spark.createDataFrame([("A", r[0], "success", "oos" if r[4] else "no_intent", None) for r in rows], "arm string, case_id bigint, status string, decision string, predicted_intent string")
    gold = gold.selectExpr("*", "CAST(NULL AS STRING) AS target_intent")
    labelled = E.join_predictions(gold, said.selectExpr("*", "CAST(NULL AS ARRAY<STRING>) AS candidate_intents"), ["A"])
    got = {r["case_id"]: r["adverse"] for r in E.with_adverse(labelled).collect()}
    assert got == {r[0]: 1 if r[0] == 2 else None for r in rows}
