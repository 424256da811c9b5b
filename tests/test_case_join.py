"""Cases meet the predictions of all arms in one row, and filters of tags do not make the tags anew."""

from pyspark.sql import functions as F

from plumbline.operators import evaluate as E
from plumbline.sources.views import Tables
from tests.harness import DATA
from tests.test_evaluate import GOLD, PREDICTION, case, said


def test_a_case_is_shuffled_once_for_all_arms(spark):
    gold = spark.createDataFrame([case(1, "oos"), case(2, "oos")], GOLD)
    predictions = spark.createDataFrame([said(1, "oos"), said(1, "oos", arm="B"), said(2, "oos", arm="C")], PREDICTION)
    rows = E.join_predictions(gold, predictions, ["A", "B"])
    assert {(r["arm"], r["case_id"], r["status"], r["hit"]) for r in rows.collect()} == {
        ("A", 1, "success", 1), ("B", 1, "success", 1), ("A", 2, None, 0), ("B", 2, None, 0)
    }
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert any("Generate inline" in line for line in plan[:join])


def test_validity_comes_with_the_rows(spark):
    gold = spark.createDataFrame([case(1, "oos"), case(1, "oos"), case(2, "oos"), case(3, "oos")], GOLD)
    of_a = [said(1, "oos"), said(1, "oos"), said(9, "oos"), said(2, "oos")]
    of_b = [said(2, "oos", arm="B"), said(None, "oos", arm="B"), said(8, arm="B"), said(8, arm="B")]
    predictions = spark.createDataFrame([*of_a, *of_b, said(3, "oos", arm="C"), said(7, "oos", arm="X")], PREDICTION)
    arms = ["A", "B", "C", "D"]
    rows = E.join_all_predictions(gold, predictions, arms, ["status", "decision", "predicted_intent"])
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = rows.groupBy("arm", "known").agg(flag(F.col("times") > 1).alias("repeated"), flag(F.col("times") > 0).alias("predicted"))
    got = sorted(map(tuple, E.validity_from(counts, arms).collect()))
    assert got == [("A", 1, 1, False), ("B", 1, 2, False), ("C", 0, 0, True), ("D", 0, 0, True)]
    assert got == sorted(map(tuple, E.run_validity(gold, predictions, arms).collect()))
    assert rows.filter("known").count() == 4 * len(arms)


def test_filters_of_tags_stay_above_the_tags(spark):
    gold = Tables(spark, f"{DATA}/sf0.001").gold
    plan = gold.filter(F.array_contains("tags", "context_control"))._jdf.queryExecution().optimizedPlan().toString()
    assert next(line for line in plan.splitlines() if "context_control" in line).lstrip(" +-").startswith("Filter")
    assert "lambda" not in plan
