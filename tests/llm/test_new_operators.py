"""Hard negatives, prefix trie and near copies of vectors against brute force: nulls, ties, repeats, long chains, no rows."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import op11_hard_negatives as O11
from plumbline.llm import op12_prefix_trie as O12
from plumbline.llm import op13_embedding_dedup as O13

# ---- op11 ------------------------------------------------------------------------------------------------------

VECTORS = "id long, label int, v array<long>, anchor boolean, uid string, score int"


def brute_negatives(rows, positives, negatives, low, high):
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in (r for r in good if r[3]):
        near = sorted(((-dot(a, b), b[0]) for b in good if b is not a and b[1] == a[1]))[:positives]
        for s, positive in near:
            fit = sorted((-dot(a, b), b[0]) for b in good if b[1] != a[1] and low * -s <= 100 * dot(a, b) <= high * -s)[:negatives]
            out += [(a[0], positive, i + 1, b, -s, -t) for i, (t, b) in enumerate(fit)]
    return sorted(out)


def vector_rows(rng, n, size, dims=9):
    rows = [[i, rng.randrange(3), [rng.randrange(-size, size + 1) for _ in range(dims)], i % 10 == 0, "x", 1] for i in range(n)]
    rows += [[5, 1, [size] * dims, None, "x", 1], [None, 1, [1] * dims, True, "x", 1], [900, None, [1], True, "x", 1], [910, 1, None, True, "x", 1]]
    rows += [[920, 1, [1, None], True, "x", 1], [930, 2, [], True, "x", 1], [940, 0, [size, -size], True, "x", 1]]
    return rows + [list(rows[10]), list(rows[10]), list(rows[3])]


@pytest.mark.parametrize("size,in_block", [(1, 64), (200, 40), (30_000_000, 1000)])
def test_op11_brute_force(spark, size, in_block):
    rows = vector_rows(random.Random(size), 150, size)
    df = spark.createDataFrame([tuple(r) for r in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in O11.hard_negatives(df, 3, 4, 30, 90, rows_in_block=in_block).collect())
    want = brute_negatives(rows, 3, 4, 30, 90)
    assert got == want and want


def test_op11_products_are_exact_and_signed():
    rng = np.random.default_rng(1)
    for size, dims in ((1, 1), (256, 64), (2**20, 3000)):
        a, b = (rng.integers(-size, size + 1, (6, dims)) for _ in range(2))
        a[0], b[0], b[1] = size, size, -size
        primes = O11.primes_for(dims * size * size)
        got = O11.exact_products(O11.remainders(a, primes), O11.remainders(b, primes), primes)
        assert got.tolist() == [[int(np.dot(x.astype(object), y.astype(object))) for y in b] for x in a]


def test_op11_no_rows_and_too_large(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert O11.hard_negatives(empty).collect() == []
    assert O11.hard_negatives(spark.createDataFrame([(1, 1, [3], False, "", 1)], VECTORS)).collect() == []
    with pytest.raises(ValueError, match="do not fit"):
        O11.hard_negatives(spark.createDataFrame([(0, 1, [2**40], True, "", 1)], VECTORS))


def test_op11_many_blocks_and_anchor_blocks(spark, monkeypatch):
    monkeypatch.setattr(O11, "ANCHORS", 4)
    rows = vector_rows(random.Random(4), 120, 3)
    df = spark.createDataFrame([tuple(r) for r in rows], VECTORS)
    got = sorted(tuple(r) for r in O11.hard_negatives(df, 2, 3, 30, 90, rows_in_block=7).collect())
    assert got == brute_negatives(rows, 2, 3, 30, 90)


# ---- op12 ------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, pos int, node string"


def brute_trie(rows, group=5, spread=9):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0), digest, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h, rest = zlib.crc32(str(c).encode()) % spread, abs(c) % group
        base = c - rest if c >= 0 else c + rest
        built[c] = turns.get(base, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        leaves[node] = sum(leaves[k] for k in kids) or 1
        saved[node] = sum(saved[k] for k in kids) + (len(node) and (len(members[node]) - 1) * len(node[-1][1].encode()))
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        above = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), above, len(members[node]), len(kids), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def turn_rows(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hé", "no", "", None, "yes " * 5]), 1, "x"))
    rows += [(10, t, "user", "again" if t % 7 else "other", 1, "x") for t in range(100, 100 + longest)]
    rows += [(11, t, "user", "again" if t % 7 else "other", 1, "x") for t in range(100, 100 + longest // 2)]
    rows += [(c, None, "user", "first", 1, "x") for c in (1, 2, 7, -4, -11)] + [(None, 1, "user", "lost", 1, "x"), (None, None, None, None, 1, "x")]
    rows += [(convs + 3, 0, "user", "one", 1, "x"), (3, 2, "z", "tie", 1, "x"), (3, 2, "a", "tie", 1, "x"), (3, 2, "a", "tie", 1, "x")]
    return rows


@pytest.mark.parametrize("convs,longest", [(12, 0), (60, 70), (6, 300)])
def test_op12_brute_force(spark, convs, longest):
    rows = turn_rows(random.Random(convs), convs, longest)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = sorted((tuple(r) for r in O12.prefix_trie(df).collect()), key=str)
    assert got == brute_trie(rows)


def test_op12_no_rows(spark):
    assert O12.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    lost = spark.createDataFrame([(None, 1, "user", "a", 1, "x")], TURNS)
    assert O12.prefix_trie(lost).collect() == []


def test_op12_lists_of_any_length_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(O12, "PIECE", 7)
    ends = spark.range(1000).select((F.col("id") % 3).alias("node"), (F.col("id") * 7 % 1000).alias("conv_id"))
    got = {r["node"]: r["ends"] for r in O12.listed_digests(ends.repartition(6)).collect()}
    for node in range(3):
        ids = sorted(i * 7 % 1000 for i in range(1000) if i % 3 == node)
        assert got[node] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_op12_rounds_do_not_grow_with_depth(spark, monkeypatch):
    """A chain of 255 nodes takes 8 splits, not 255."""
    chain = spark.range(255).select(
        F.col("id").alias("node"), F.col("id").alias("depth"), F.lit(0).cast("long").alias("rep"), (255 - F.col("id")).alias("weight"), F.lit(1).cast("long").alias("one")
    )
    paths = spark.range(1, 255).select(F.lit(0).cast("long").alias("conv"), F.col("id").alias("depth"), F.col("id").alias("node"), (F.col("id") - 1).alias("above"))
    calls = []
    kept = O12.cut
    monkeypatch.setattr(O12, "cut", lambda df: calls.append(1) or kept(df))
    got = {r["node"]: r["one"] for r in O12.rollup(chain, paths, ["one"]).collect()}
    assert got == {i: 255 - i for i in range(255)}
    assert len(calls) <= 2 * 8


# ---- op13 ------------------------------------------------------------------------------------------------------

EMBEDDED = "vec_id long, v array<float>, node string, size int"


def brute_links(rows, cosine=0.95):
    def unit(v):
        if v is None or None in v or not np.isfinite(v).all() or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.linalg.norm(x)

    units = [unit(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    good = [i for i, u in enumerate(units) if u is not None]
    dims = max((len(units[i]) for i in good), default=0)
    packed = np.array([np.pad(units[i], (0, dims - len(units[i]))) for i in good]).reshape(len(good), dims)
    pairs = np.argwhere(np.triu(packed @ packed.T >= cosine, 1))
    for a, b in pairs:
        i, j = good[a], good[b]
        links[i] += 1
        links[j] += 1
        parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((r[0], links[i], least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows)), key=str)


def embedded(seed, n, dims, groups=12, size=15):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dims) for _ in range(n)]
    for g in range(groups):
        base = rng.standard_normal(dims)
        spread = (0.02, 0.15, 0.2, 0.22)[g % 4]
        out += [base + spread * rng.standard_normal(dims) for _ in range(size)]
    rows = [(int(i), [float(np.float32(x)) for x in v], "x", 1) for i, v in enumerate(out)]
    rng.shuffle(rows)
    rows = [(int(r[0]), r[1], "x", 1) for r in rows]
    rows += [(9000, None, "x", 1), (9001, [0.0] * dims, "x", 1), (9002, [float("nan")] * dims, "x", 1), (9003, [None, 1.0], "x", 1), (9004, [float("inf")], "x", 1), (9005, [], "x", 1)]
    rows += [(9006, rows[0][1], "x", 1), (9006, rows[0][1], "x", 1), (None, rows[1][1], "x", 1), (rows[2][0], rows[3][1], "x", 1), (9007, [2 * x for x in rows[4][1]], "x", 1)]
    return rows + [(9008, [1.0, 2.0], "x", 1), (9009, [1.0, 2.0, -0.0], "x", 1), (9010, [1e-30, 2e-30], "x", 1)]


@pytest.mark.parametrize("seed,n,dims,block", [(1, 300, 64, 1024), (2, 100, 64, 20), (3, 50, 300, 1024), (4, 0, 20, 30)])
def test_op13_brute_force(spark, seed, n, dims, block):
    rows = embedded(seed, n, dims)
    df = spark.createDataFrame(rows, EMBEDDED).repartition(4)
    got = sorted((tuple(r) for r in O13.near_copies(df, block=block).collect()), key=str)
    assert got == brute_links(rows)
    assert any(r[1] > 5 for r in got)


def test_op13_no_rows_and_nothing_usable(spark):
    assert O13.near_copies(spark.createDataFrame([], EMBEDDED)).collect() == []
    got = O13.near_copies(spark.createDataFrame([(3, None, "x", 1), (None, [0.0], "x", 1)], EMBEDDED)).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(3, 0, 3, True), (None, 0, None, True)]


def test_op13_filters_are_all_that_exceed():
    rng = np.random.default_rng(0)
    code = O13.ProductCode(16, 5)
    units = rng.standard_normal((40, 16))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    turned = code.turned(units)
    assert np.allclose(turned @ turned.T, units @ units.T)
    words = [np.concatenate(w) for w in itertools.product(*code.code)]
    sums = turned @ np.array(words).T
    threshold = code.threshold(units, 20) + 1e-6  # apart from the sum that it was set by
    assert (sums >= threshold).sum(axis=1).mean() == pytest.approx(20, abs=0.1)
    for x, got in zip(sums, code.filters(units, threshold, 8), strict=True):
        assert got.tolist() == np.flatnonzero(x >= min(threshold, np.sort(x)[-8]) - 1e-9).tolist()
