"""Repeated runs of words: what goes back to the documents, rows that share an id, and repeats inside first copies."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.llm import fm_index
from plumbline.llm import op7_substring_dedup as O7


def brute(rows, window=20):
    """Windows by (doc_id, start); rows that share an id and a start are equally early."""
    first, out = {}, []
    for doc, text in rows:
        w = (text or "").split()
        for j in range(len(w) - window + 1):
            v = tuple(w[j : j + window])
            first[v] = min(first.get(v, (doc, j)), (doc, j))
    for doc, text in rows:
        w = (text or "").split()
        gone = {i for j in range(len(w) - window + 1) if (doc, j) > first[tuple(w[j : j + window])] for i in range(j, j + window)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def overlapping(rng):
    base = [f"w{rng.randrange(60)}" for _ in range(900)]
    rows = []
    for i in range(60):
        a, n = rng.randrange(850), rng.randrange(5, 90)
        b, m = rng.randrange(850), rng.randrange(5, 90)
        rows.append((i, " ".join(base[a : a + n] + [f"z{i}"] * rng.randrange(2) + base[b : b + m])))
    return [*rows, (70, "a " * 90), (71, "a  a\n" * 40), (72, ""), (73, None)]


def test_overlaps_and_rows_that_share_an_id(spark, monkeypatch):
    rows = overlapping(random.Random(5))
    rows += [(80, rows[3][1] + " q"), (80, rows[3][1] + " r"), (80, rows[3][1] + " r"), (5, rows[9][1])]
    run = " ".join(f"new{i}" for i in range(50))
    rows += [(81, f"{run} x"), (81, f"{run} y"), (82, run)]
    for hot in (O7.HOT, 3):
        monkeypatch.setattr(O7, "HOT", hot)
        got = O7.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_only_first_copies_go_back(spark):
    run = " ".join(f"v{i}" for i in range(200))
    docs = spark.createDataFrame([(i, run) for i in range(50)], "doc_id long, text string").coalesce(1)
    marks = docs.withColumn("h", F.hash("text")).mapInArrow(O7._anchors(20, np.empty(0, np.int64)), O7.ANCHORS)
    marked = marks.groupBy("doc_id", "h").agg(F.collect_set("mark").alias("marks")).join(docs, "doc_id")
    pieces = marked.coalesce(1).mapInArrow(O7._pieces(20), O7.PIECES).toPandas()
    assert set(pieces["doc_id"]) == {0} and len(pieces) == marks.filter("doc_id = 0").count()
    pieces = pd.concat([pieces.assign(doc_id=i) for i in (4, 0, 9)])
    firsts = O7._firsts(20)(pieces)
    assert set(firsts["doc_id"]) == {0} and (firsts["code"] % 16 == 0).all()


def test_pieces_without_another_of_their_anchor_are_not_indexed(monkeypatch):
    monkeypatch.setattr(O7, "FMIndex", lambda *a: 1 / 0)
    words = [" ".join(f"{c}{i}" for i in range(24)) for c in "abc"]
    shard = pd.DataFrame({"route": [1, 2, 3, 1], "doc_id": [0, 0, 1, 5], "start": np.int32([0, 30, 7, 2]), "h": np.int32([6, 6, 6, 6]), "words": [*words, words[0]]})
    assert sorted(zip(*O7._firsts(20)(shard).to_numpy().T.tolist())) == [(0, 6, 0), (0, 6, 480), (1, 6, 112)]


def test_index_of_bounded_depth_finds_the_same_windows():
    text = np.append(np.random.default_rng(2).integers(1, 3, 400), 0)
    for a, b in zip(fm_index.FMIndex(text).search(text, np.arange(380), 8), fm_index.FMIndex(text, 8).search(text, np.arange(380), 8)):
        assert (a == b).all()


def test_frequent_anchors_are_spread(spark, monkeypatch):
    run = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{run} x{i}") for i in range(300)], "doc_id long, text string")
    named = docs.withColumn("h", F.hash("text"))
    monkeypatch.setattr(O7, "HOT", 128)
    frequent = O7._frequent(named, 20)
    anchors = named.mapInArrow(O7._anchors(20, frequent), O7.ANCHORS)
    assert len(frequent) and anchors.groupBy("anchor").count().agg(F.max("count")).first()[0] <= 128
    got = O7.remove_repeats(docs).agg(F.sum("n_removed"), F.min(F.when(F.col("doc_id") == 0, F.col("kept_text")))).first()
    assert tuple(got) == (299 * 40, f"{run} x0")
