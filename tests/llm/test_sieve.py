"""The sieve of the set join loses no link and looks at a third of the tokens; ranked sets are flat arrays."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import op2_jaccard, setjoin


def linked_sets(rng):
    sets = []
    for n in [*range(4, 30), 47, 64, 100, 203]:
        base = rng.sample(range(1 << 40), n)
        sets += [base] + [base[: n - gone] + rng.sample(range(1 << 40), more) for gone, more in ((n // 5, 0), (n // 9, n // 9), (0, n // 4))]
    return [sorted(s) for s in sets] + [sorted(rng.sample(range(1 << 40), n)) for n in (4, 9, 40, 300)]


@pytest.mark.parametrize("seed", range(3))
def test_every_linked_set_passes(spark, seed):
    sets = linked_sets(random.Random(seed))
    linked = {i for p in itertools.permutations(range(len(sets)), 2) for i in p[:1] if 100 * len({*sets[p[0]]} & {*sets[p[1]]}) >= 80 * len({*sets[p[0]]} | {*sets[p[1]]})}
    rows = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "k long, n long")
    firsts = spark.createDataFrame([(i, t) for i, s in enumerate(sets) for t in s[: setjoin.first_tokens(len(s))]], "k long, token long")
    passed = rows.join(setjoin.unlinked(firsts), "k", "left").filter(setjoin.passes("n", "lone"))
    assert linked <= {r["k"] for r in passed.collect()} and linked
    assert not {len(sets) - 1 - i for i in range(4)} & {r["k"] for r in passed.collect()}


def test_the_sieve_looks_at_a_third(spark):
    text = " ".join(f"w{i}" for i in range(1004))
    tokens = spark.createDataFrame([(text,)], "text string").mapInArrow(op2_jaccard._first_tokens(5), "k long, token long")
    assert tokens.count() == 1000 // 5 + 1000 // 8 + 1 == spark.sql("SELECT 1000 AS n").select(setjoin.first_tokens("n")).first()[0]


def test_ranked_sets_are_flat(spark):
    sets = spark.createDataFrame([(1, 4, [1, 2, 3, 4]), (2, 4, [1, 2, 3, 4]), (3, 5, [2, 3, 4, 9, 8]), (4, 4, [2, 5, 6, 7])], "node long, n long, tokens array<long>")
    got = {r["node"]: (r["shared"], r["df"], r["u"]) for r in setjoin._ranked(sets).collect()}
    assert got == {1: ([1, 3, 4, 2], [2, 3, 3, 4], 0), 2: ([1, 3, 4, 2], [2, 3, 3, 4], 0)}
    labels = {r["node"]: r["component"] for r in setjoin.linked_components(sets.withColumn("tokens", F.shuffle("tokens"))).collect()}
    assert labels == {1: 1, 2: 1}
