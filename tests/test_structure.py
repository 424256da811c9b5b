"""Components, ranks, splits and samples against brute force; results that no partitioning changes."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from plumbline.functions import hashing as H
from plumbline.operators import components as G
from plumbline.operators import prototype as P
from plumbline.operators import split as S
from plumbline.sources import publish as Pub


def brute_components(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups = defaultdict(list)
    for case, *relations in rows:
        for kind, value in enumerate(relations):
            groups[kind, value].append(case)
    for members in groups.values():
        for other in members[1:]:
            a, b = sorted((find(members[0]), find(other)))
            parent[b] = a
    return {r[0]: find(r[0]) for r in rows}


def run_components(spark, rows):
    df = spark.createDataFrame(rows, "case_id bigint, scenario_id bigint, paraphrase_id bigint, contrast_id bigint")
    return {r["case_id"]: r["component"] for r in G.components(df).collect()}


def test_components_on_random_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(60), rng.randrange(1000), 10_000 + i) for i in range(300)]
    assert run_components(spark, rows) == brute_components(rows)


def test_components_on_a_long_chain(spark):
    rows = [(i, i // 2, 1000 + (i + 1) // 2, 5000 + i) for i in range(200)]
    random.Random(2).shuffle(rows)
    assert set(run_components(spark, rows).values()) == {0}


def test_components_with_one_giant_group(spark):
    rows = [(i, 0 if i % 3 == 0 else i, 10_000 + i, 20_000 + i) for i in range(600)]
    got = run_components(spark, rows)
    assert sum(v == 0 for v in got.values()) == 200 and got[1] == 1


def test_lonely_cases_are_their_own_component(spark):
    assert run_components(spark, [(5, 1, 2, 3), (6, 4, 5, 6)]) == {5: 5, 6: 6}


def test_hash_rank_is_the_sorted_order(spark):
    ids = list(range(500))
    df = spark.range(500).withColumnRenamed("id", "k").withColumn("key", H.stable_key("n", "k"))
    got = {r["k"]: r["rank"] for r in H.hash_rank(df, [], "key", "k", "rank").collect()}
    order = sorted(ids, key=lambda i: hashlib.sha256(f"n|{i}".encode()).hexdigest())
    assert got == {i: n for n, i in enumerate(order, 1)}


def test_number_rank_with_uneven_keys(spark):
    ids = sorted({i**3 for i in range(200)} | {10**9, 10**9 + 1})
    df = spark.createDataFrame([(i,) for i in ids], "k bigint")
    got = {r["k"]: r["rank"] for r in H.number_rank(df, [], "k", "rank").collect()}
    assert got == {i: n for n, i in enumerate(ids, 1)}


def test_running_total_restarts_per_group(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit(2).alias("v"))
    got = H.running_total(df, ["g"], "key", "id", "v", "t").groupBy("g").agg(F.max("t").alias("t")).collect()
    assert {r["g"]: r["t"] for r in got} == {0: 68, 1: 66, 2: 66}


def test_round_robin_takes_strata_in_turn(spark):
    rows = [(i, "oos", i, ["a"] if i < 5 else ["b"] if i < 7 else []) for i in range(10)]
    df = spark.createDataFrame(rows, "case_id bigint, decision string, cluster_id bigint, tags array<string>")
    got = P.stratified_round_robin(df, ["a", "b", "__other__"], 8).orderBy("position").collect()
    assert [r["case_id"] for r in got] == [0, 5, 7, 1, 6, 8, 2, 9]


def test_phased_sample_never_reuses_a_unit(spark):
    rows = [(i, i // 3, i % 2, f"{(i * 37) % 100:03d}") for i in range(60)]
    df = spark.createDataFrame(rows, "item bigint, unit bigint, odd int, key string")
    phases = [(F.col("odd") == 1, 4), (F.lit(True), 5), (F.col("odd") == 0, 4)]
    got = S.phased_sample(df, phases, ["key"], "unit", "item").orderBy("position").collect()
    taken, expected = set(), []
    for n, (test, quota) in enumerate([(lambda r: r[2] == 1, 4), (lambda r: True, 5), (lambda r: r[2] == 0, 4)]):
        chosen = 0
        for r in sorted(filter(test, rows), key=lambda r: r[3]):
            if chosen < quota and r[1] not in taken:
                taken.add(r[1])
                expected.append((n, r[0]))
                chosen += 1
    assert [(r["phase"], r["item"]) for r in got] == expected


def test_split_keeps_groups_whole(spark):
    rows = [(i, i // 4, "oos", None, "now", None, ["far_oos"]) for i in range(400)]
    df = spark.createDataFrame(
        rows, "case_id bigint, cluster_id bigint, decision string, target_intent string, horizon string, open_intent string, tags array<string>"
    )
    got = S.choose_split(df, "cluster_id")
    assert got.count() == 100
    dev = got.filter("split = 'dev'").agg(F.sum("cases")).first()[0]
    assert dev == 120


def test_fingerprint_sees_content_not_order(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 7 % 13).cast("string"))
    digest = lambda d: Pub.fingerprint(d).first()["digest"]
    assert digest(df) == digest(df.repartition(9).orderBy(F.desc("x")))
    assert digest(df) != digest(df.withColumn("x", F.when(F.col("id") == 5, None).otherwise(F.col("x"))))
    assert digest(df) != digest(df.union(df.limit(1)))


def test_grid_cells_score_like_rows(spark):
    rng = random.Random(4)
    names = ["in_scope", "oos", "no_intent", "ambiguous"]
    rows = [
        (rng.choice(names), rng.choice("xy"), rng.choice("xy"), *[round(rng.uniform(-0.2, 0.4), 2) for _ in range(4)])
        for _ in range(300)
    ]
    schema = "decision string, target_intent string, top_intent string, actionability double, oos_margin double, activity_score double, ambiguity_margin double"
    grid = {a: [-0.1, 0.0, 0.1] for a in P.AXES}
    got = {tuple(r[a] for a in P.AXES): r["hits"] for r in P.grid_scores(spark.createDataFrame(rows, schema), grid).collect()}
    assert len(got) == 81
    for (ta, to, tm, tb), hits in got.items():
        n = 0
        for d, target, top, act, oos, activity, amb in rows:
            p = "no_intent" if act < ta else "oos" if oos >= to or activity < tm else "ambiguous" if amb < tb else "in_scope"
            n += p == d and (d != "in_scope" or target == top)
        assert n == hits
