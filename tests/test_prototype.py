"""Cosine scores in blocks: the same rows however queries and centroids are dealt."""

import numpy as np
import pytest

from plumbline.operators import prototype as P

SCORED = ["activity_score", "second_score", "no_intent_score", "oos_score"]


def brute(queries, centers):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = {}
    for key, v in queries:
        found = {label: round(float(unit(v) @ unit(e)), 9) + 0.0 for label, e in centers}
        rivals = sorted((-x, label) for label, x in found.items() if label not in ("oos", "no_intent"))
        out[key] = (rivals[0][1], rivals[1][1], -rivals[0][0], -rivals[1][0], found["no_intent"], found["oos"])
    return out


@pytest.mark.parametrize("numbers", [1 << 20, 64, 10, 1])
def test_scores_do_not_depend_on_blocks(spark, numbers):
    rng = np.random.default_rng(5)
    queries = [(i, rng.standard_normal(6).tolist()) for i in range(23)]
    centers = [(f"intent_{i}", rng.standard_normal(6).tolist()) for i in range(9)] + [("oos", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), ("no_intent", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    centers.append(("intent_00", centers[0][1]))  # a tie: the first name wins
    queries.append((99, centers[0][1]))
    q = spark.createDataFrame(queries, "vec_id bigint, embedding array<double>").repartition(3)
    c = spark.createDataFrame(centers, "proto string, embedding array<double>")
    got = {r["vec_id"]: (r["top_intent"], r["second_intent"], *[r[x] for x in SCORED]) for r in P.scores(q, c, "proto", numbers=numbers).collect()}
    want = brute(queries, centers)
    assert got[99][:2] == ("intent_0", "intent_00")
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][:2] == want[key][:2] and got[key][2:] == pytest.approx(want[key][2:], abs=2e-9)


def test_scores_of_many_labels_and_dimensions(spark):
    """More centroids than fit a block; their list is at no place whole."""
    rng = np.random.default_rng(6)
    labels = [(f"l{i:05d}", rng.standard_normal(300).tolist()) for i in range(700)] + [("oos", [1.0] * 300), ("no_intent", [-1.0] * 300)]
    queries = [(i, labels[i * 7][1]) for i in range(20)]
    q = spark.createDataFrame(queries, "vec_id bigint, embedding array<double>")
    c = spark.createDataFrame(labels, "proto string, embedding array<double>")
    scored = P.scores(q, c, "proto", numbers=60_000)
    assert {r["vec_id"]: r["top_intent"] for r in scored.collect()} == {i: f"l{i * 7:05d}" for i, _ in queries}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_without_queries_or_rivals(spark):
    c = spark.createDataFrame([("oos", [1.0, 0.0]), ("no_intent", [0.0, 1.0])], "proto string, embedding array<double>")
    q = spark.createDataFrame([(1, [3.0, 4.0])], "vec_id bigint, embedding array<double>")
    row = P.scores(q, c, "proto").first()
    assert (row["top_intent"], row["activity_score"], row["oos_score"], row["no_intent_score"]) == (None, None, 0.6, 0.8)
    assert P.scores(q.filter("false"), c, "proto").collect() == []
