"""The steps of a split freeze that order only the groups at the quota, and end their rounds without one more."""

import hashlib

from pyspark.sql import functions as F

from plumbline.operators import components as G
from plumbline.operators import split as S


def by_hand(groups, seed, share, whole):
    taken = set()
    for stratum in {g[1] for g in groups}:
        mine = [g for g in groups if g[1] == stratum]
        quota = (sum(g[2] for g in mine) * share + whole // 2) // whole
        running = 0
        for name, _, cases in sorted(mine, key=lambda g: hashlib.sha256(f"{seed}|{g[0]}".encode()).hexdigest()):
            if cases <= quota:
                running += cases
                if running <= quota:
                    taken.add(name)
    return taken


def test_only_groups_at_the_quota_are_put_in_order(spark):
    groups = [(i, "in" if i % 3 else "out", 1 + i * i % 5) for i in range(9000)]
    groups += [(9001, "out", 60000), (9002, "one", 1), (9003, "two", 3), (9004, "two", 1), (9005, "two", 1)]
    rows = spark.createDataFrame(groups, "group_id bigint, stratum string, cases bigint")
    found = S.candidate_splits(rows, 2, 3, 10)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 2 * len(groups)
    for seed in range(2):
        dev = {r["group_id"] for r in found.filter((F.col("seed") == seed) & (F.col("dev") == 1)).select("group_id").collect()}
        assert dev == by_hand(groups, seed, 3, 10)


def test_a_place_in_the_middle_of_a_bucket(spark):
    """Every group has one case, and the buckets have several groups, so the quota ends inside one."""
    groups = [(i, "s", 1) for i in range(40000)]
    rows = spark.createDataFrame(groups, "group_id bigint, stratum string, cases bigint")
    dev = {r["group_id"] for r in S.candidate_splits(rows, [5], 3, 10).filter("dev = 1").collect()}
    assert len(dev) == 12000 and dev == by_hand(groups, 5, 3, 10)


def test_settled_components_take_no_further_round(spark, monkeypatch):
    rounds = []
    step = G._large_star
    monkeypatch.setattr(G, "_large_star", lambda edges: rounds.append(1) or step(edges))
    stars = spark.createDataFrame([(i, i - i % 4) for i in range(16)], "case_id bigint, scenario_id bigint")
    assert {(r[0], r[1]) for r in G.components(stars, ["scenario_id"]).collect()} == {(i, i - i % 4) for i in range(16)}
    assert not rounds
    chain = spark.createDataFrame([(i, i // 2, (i + 1) // 2) for i in range(12)], "case_id bigint, scenario_id bigint, contrast_id bigint")
    assert {r["component"] for r in G.components(chain, ["scenario_id", "contrast_id"]).collect()} == {0}
    assert rounds
