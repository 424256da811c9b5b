"""Bootstrap, quantiles, verdict boundaries."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plumbline.catalog  # noqa: F401  (registers the queries)
from plumbline.catalog.registry import QUERIES
from plumbline.functions.quantiles import exact_quantiles
from plumbline.operators import compare as C
from plumbline.operators import evaluate as E
from tests.harness import DATA

BASE = {
    "valid": True,
    "aligned": True,
    "estimable": True,
    "usage_complete": True,
    "cost_complete": True,
    "latency_complete": True,
    "hem": (0.1, 0.05, 0.2),
    "intent": (0.0, -0.03, 0.1),
    "near": (0.0, -0.05, 0.1),
    "quiet": (0.0, -0.05, 0.1),
    "left_context_errors": 3,
    "right_context_errors": 3,
    "left_schema_invalid": 1,
    "right_schema_invalid": 1,
    "left_tokens": 1000,
    "right_tokens": 1100,
}
INTERVAL = "struct<point:double,lower:double,upper:double>"
SCHEMA = ", ".join(
    f"{k} {'boolean' if isinstance(v, bool) else INTERVAL if isinstance(v, tuple) else 'bigint'}" for k, v in BASE.items()
)

CASES = [
    ({}, "promising", ["all_pre_registered_gates_passed"]),
    ({"right_tokens": 1101}, "inconclusive", ["budget_confounded"]),
    ({"right_tokens": None}, "inconclusive", ["missing_token_totals"]),
    ({"usage_complete": False, "cost_complete": False}, "inconclusive", ["incomplete_usage_metadata", "incomplete_cost"]),
    ({"estimable": False, "hem": (-1.0, -1.0, -1.0)}, "inconclusive", ["required_ci_unavailable"]),
    ({"aligned": False}, "inconclusive", ["comparison_contract_mismatch"]),
    ({"hem": (-0.1, -0.2, 0.0)}, "negative", ["hem_not_improved"]),
    ({"intent": (-0.1, -0.2, -0.0301)}, "negative", ["id_intent_regressed"]),
    ({"intent": (-0.1, -0.2, -0.03)}, "inconclusive", ["id_intent_noninferiority_unproven"]),
    ({"near": (-0.1, -0.2, -0.051)}, "negative", ["near_oos_regressed"]),
    ({"right_context_errors": 4, "right_schema_invalid": 2}, "negative", ["more_context_distractor_errors", "more_schema_invalid_predictions"]),
    ({"hem": (0.1, 0.0, 0.2)}, "inconclusive", ["hem_ci_crosses_zero"]),
    ({"near": (-0.01, -0.05, 0.1)}, "inconclusive", ["near_oos_point_regressed"]),
    ({"quiet": (0.0, -0.06, 0.1)}, "inconclusive", ["no_intent_noninferiority_unproven"]),
    ({"valid": False}, None, ["invalid_run"]),
]


def test_verdict_boundaries(spark):
    rows = [(i, *{**BASE, **change}.values()) for i, (change, _, _) in enumerate(CASES)]
    got = C.decide(spark.createDataFrame(rows, f"i int, {SCHEMA}")).orderBy("i").collect()
    for row, (change, verdict, reasons) in zip(got, CASES, strict=True):
        assert (row["verdict"], row["reasons"]) == (verdict, reasons), change


SHAPES = [
    [5.0],
    [1.0, 2.0],
    [-3.0, -3.0, 7.0, 7.0, 7.0, 1e9],
    [random.Random(3).gauss(0, 1) for _ in range(997)],
    [1e-300, -1e-300, 0.0, -0.0, 5e-324, -5e-324, 1e300, 1.7e308, -1.7e308],
    [1.0 + 2.0**-52 * k for k in range(50)] + [1e18] * 3,
]


@pytest.mark.parametrize("values", SHAPES)
def test_quantiles_of_any_shape(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    got = exact_quantiles(df, [], "v", [0.0, 0.025, 0.5, 0.95, 1.0], list("abcde")).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.0, 0.025, 0.5, 0.95, 1.0])), rel=1e-12)


def test_quantiles_of_groups_with_null_keys_and_infinities(spark):
    inf = float("inf")
    rows = [("a", 1.0), ("a", inf), ("a", -inf), (None, 2.0), (None, 4.0), ("b", None), ("c", inf), ("c", inf), ("d", 1.0), ("d", inf)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.5, 1.0], ["x", "y", "z"]).collect()
    assert {r["g"]: tuple(r)[1:] for r in got} == {"a": (-inf, 1.0, inf), None: (2.0, 3.0, 4.0), "c": (inf, inf, inf), "d": (1.0, inf, inf)}
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5], ["x"]).collect() == []


def test_quantiles_bring_no_group_into_one_task(spark):
    df = spark.range(50_000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 50_021).cast("double").alias("v"))
    got = exact_quantiles(df, ["g"], "v", [0.1, 0.5], ["x", "y"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    values = [i * 7919 % 50_021 for i in range(50_000)]
    assert list(got.first())[1:] == pytest.approx(list(np.quantile(values, [0.1, 0.5])))


def labelled(spark, clusters, per_cluster=3):
    rows, said = [], []
    for k, j in itertools.product(range(clusters), range(per_cluster)):
        i = k * 10 + j
        rows.append((i, "no_intent", None, ["quiet_control"], k))
        for arm in "AB":
            right = (i * 7 + (3 if arm == "B" else 0)) % 5 != 0
            said.append((arm, i, "success", "no_intent" if right else "oos", None))
    gold = spark.createDataFrame(rows, "case_id bigint, decision string, target_intent string, tags array<string>, cluster_id bigint")
    predictions = spark.createDataFrame(said, "arm string, case_id bigint, status string, decision string, predicted_intent string")
    return E.join_predictions(gold, predictions, ["A", "B"])


def intervals(rows, iterations=60, seed=5):
    got = C.compare_domains(rows, [("A", "B")], ["x"], iterations, seed).collect()
    return {r["domain"]: r for r in got}


def test_seven_clusters_give_a_point_only_eight_an_interval(spark):
    seven, eight = intervals(labelled(spark, 7)), intervals(labelled(spark, 8))
    assert seven["full_hem"]["estimable"] == 0 and seven["full_hem"]["lower"] is None
    assert seven["full_hem"]["unavailable_reason"] == "insufficient_clusters"
    assert eight["full_hem"]["estimable"] == 1
    assert eight["full_hem"]["lower"] <= eight["full_hem"]["upper"]


def test_bootstrap_does_not_depend_on_order_or_partitions(spark):
    rows = labelled(spark, 12)
    a = intervals(rows)
    b = intervals(rows.repartition(7).orderBy(F.desc("case_id")))
    assert {k: tuple(v) for k, v in a.items()} == {k: tuple(v) for k, v in b.items()}
    assert a["full_hem"]["point"] == pytest.approx(a["no_intent_recall"]["point"])


def drawn_slots(clusters, iterations, seed, name="full_hem"):
    """The draws again, in plain Python: 0-based slots of each iteration."""

    def mix(x):
        x = ((x ^ x >> 16) * 0x7FEB352D) % 2**32
        x = ((x ^ x >> 15) * 0x846CA68B) % 2**32
        return x ^ x >> 16

    return [[mix(mix(p) ^ mix(i) ^ mix(seed ^ C.SEED_SIDE)) * clusters >> 32 for p in range(1, clusters + 1)] for i in range(iterations)]


def test_draws_are_uniform_with_replacement():
    drawn = drawn_slots(40, 500, 11)
    counts = np.bincount(np.ravel(drawn), minlength=40)
    assert len(counts) == 40
    assert sum((c - 500) ** 2 / 500 for c in counts) < 80  # chi-square, 39 degrees of freedom
    # Multiplicities inside one resample spread like a multinomial: variance near 1 - 1/40.
    squares = sum(c**2 for d in drawn for c in np.bincount(d)) / (40 * 500) - 1
    assert squares == pytest.approx(1 - 1 / 40, abs=0.08)


def test_identical_arms_have_a_zero_interval(spark):
    rows = labelled(spark, 9).filter("arm = 'A'")
    both = rows.unionByName(rows.withColumn("arm", F.lit("B")))
    got = intervals(both)["full_hem"]
    assert (got["point"], got["lower"], got["upper"]) == (0.0, 0.0, 0.0)


def differences(clusters, iterations=70, seed=9):
    got = C.resampled_differences(clusters, ["A", "B"], [("A", "B")], ["x"], iterations, seed).collect()
    return sorted((r["domain"], r["iteration"], round(r["d"], 12)) for r in got)


SMALLER = [{"DRAWS_PER_TASK": 50}, {"POSITIONS_AT_ONCE": 5}, {"CLASSES_AT_ONCE": 2}, {"CELLS": 3}, {"DRAWS_AT_ONCE": 1}]


@pytest.mark.parametrize("limits", [{}, *SMALLER, {k: v for d in SMALLER for k, v in d.items()}])
def test_draws_do_not_depend_on_how_they_are_dealt(spark, monkeypatch, limits):
    clusters = C.cluster_rows(labelled(spark, 23, per_cluster=5), ["A", "B"], ["x"])
    for name, value in limits.items():
        monkeypatch.setattr(C, name, value)
    got = [(i, d) for domain, i, d in differences(clusters) if domain == "full_hem"]
    rows = sorted((r["n"], r["hits_A"], r["hits_B"]) for r in clusters.filter("domain = 'full_hem'").collect())
    want = []
    for i, slots in enumerate(drawn_slots(23, 70, 9)):
        taken = [rows[s] for s in slots]
        want.append((i, pytest.approx(sum(b - a for _, a, b in taken) / sum(n for n, _, _ in taken), abs=1e-9)))
    assert got == want


@pytest.mark.parametrize("in_row,at_once", [(1, 1 << 20), (2, 4), (1 << 16, 3)])
def test_a_block_of_classes_goes_to_a_bounded_number_of_tasks(spark, monkeypatch, in_row, at_once):
    """However many draws there are, and with counts that need one, two, four and eight bytes."""
    for name, value in {"DRAWS_PER_TASK": 5, "MOST_TASKS": 6, "CLASSES_IN_ROW": in_row, "CLASSES_AT_ONCE": at_once}.items():
        monkeypatch.setattr(C, name, value)
    counts = [(3, 1), (200, 0), (60_000, 7), (4_000_000_000, 2), (5_000_000_000, 1), (9, 9), (10, 1)]
    rows = [("d", *counts[i % 7]) for i in range(40)]
    classes = C.vector_classes(spark.createDataFrame(rows, "domain string, n bigint, h bigint"), ["n", "h"]).cache()
    packs = C.packed_classes(classes, ["n", "h"]).count()
    dealt = C.dealt_classes(classes, {"d": 40}, ["n", "h"], 30)
    assert dealt.count() == packs * 6 and dealt.rdd.getNumPartitions() == 6 * -(-7 // at_once)
    got = {r["iteration"]: (r["n"], r["h"]) for r in C.drawn_sums(classes, {"d": 40}, ["n", "h"], 30, 4).collect()}
    rows = sorted(rows)
    assert got == {i: tuple(sum(rows[s][k] for s in slots) for k in (1, 2)) for i, slots in enumerate(drawn_slots(40, 30, 4))}


def test_no_draw_is_a_row(spark):
    """What leaves the tasks is a row for each iteration, domain, range and block of classes, not one for each draw."""
    clusters = C.cluster_rows(labelled(spark, 400), ["A", "B"], ["x"])
    df = C.resampled_differences(clusters, ["A", "B"], [("A", "B")], ["x"], 200, 9)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    classes = C.vector_classes(clusters.select("domain", "n", "hits_A", "hits_B"), ["n", "hits_A", "hits_B"])
    assert classes.count() < 60 < clusters.count()
    assert {r["domain"]: r["n"] for r in classes.groupBy("domain").agg(F.sum("copies").alias("n")).collect()} == {
        r["domain"]: r["count"] for r in clusters.groupBy("domain").count().collect()
    }


@pytest.mark.parametrize("clusters,cells", [(7, 3), (1000, 64), (1000, 1000), (2**31 - 1, 5000)])
def test_classes_of_draws_are_those_of_their_slots(monkeypatch, clusters, cells):
    monkeypatch.setattr(C, "CELLS", cells)
    rng = np.random.default_rng(clusters)
    starts = np.unique(rng.integers(0, clusters, 5))
    draws = rng.integers(0, 2**32, 4000).astype(np.uint64)
    end = int(starts[-1]) + max(1, (clusters - int(starts[-1])) // 2)
    got = C.SlotClasses(starts, end, clusters)(draws)
    for h, k in zip(draws.tolist(), got.tolist()):
        slot = h * clusters >> 32
        inside = starts[0] <= slot < end
        assert k == (max(i for i, s in enumerate(starts) if s <= slot) if inside else len(starts))


def test_registered_bootstrap_makes_the_whole_number_of_draws(spark):
    got = QUERIES["t03_bootstrap_draws"](spark, f"{DATA}/sf0.001").groupBy("domain").agg(F.count_distinct("iteration").alias("n"))
    assert {r["n"] for r in got.collect()} == {10_000}
