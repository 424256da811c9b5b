"""Each stage of the pipeline against what the operators say on brute force, and the run as a whole."""

from pyspark.sql import functions as F

import corpus_pipeline as p
from tests import harness
from tests.llm.test_operators import brute_components, make, shingle_set

SF = f"{harness.DATA}/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    texts = [None, "1 2 3", "the quick brown fox jumps over the lazy dog and runs", "the quick brown fox jumps over the lazy dog and runs", "another text of words entirely on its own here"]
    docs = make(spark, texts, lang=None)
    labelled = docs.unionByName(make(spark, ["the of and to in is that it was for " * 3] * 8, range(100, 108), "en"))
    kept = p.language(spark, labelled, SF)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, *range(100, 108)]
    alone = p.near_duplicates(spark, docs.unionByName(docs.filter("doc_id = 4")), SF)
    assert sorted(r["doc_id"] for r in alone.collect()) == [0, 1, 2, 4]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = p.decontaminate(spark, docs.unionByName(make(spark, [f"before {item} after"], [50])), SF)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [0, 1, 2, 3, 4]
    assert p.mixture(spark, docs, SF).columns == docs.columns


def test_stages_pass_clashing_columns_and_decide_by_row(spark):
    """Own columns named like those of a stage, ids that rows share, rows without an id."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    texts = [" ".join(words), near, "a clean text that shares the id of a near copy", "without an id here", "without an id here", near + " more"]
    docs = make(spark, texts, [1, 2, 2, None, None, None])
    names = ["key", "_key", "_copies", "_source", "row", "stays", "component", "copies", "n"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names) if c not in docs.columns])
    kept = p.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", texts[0]), ("2", texts[2]), ("None", texts[3])])
    clean = p.decontaminate(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == 6
    taken = p.mixture(spark, docs, SF)
    assert taken.columns == docs.columns and {r["_key"] for r in taken.collect()} <= {r["_key"] for r in docs.collect()}
    tagged = p.language(spark, docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))), SF)
    assert tagged.columns == docs.columns


def test_stages_take_no_rows(spark):
    docs = make(spark, [])
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_duplicates_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    roots = brute_components([shingle_set(t) for _, t in rows])
    want = [rows[i][0] for i, r in enumerate(roots) if r == i]
    assert sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, SF).collect()) == want


def test_run(spark):
    rows = p.run(spark, SF).toPandas()
    each = rows.groupby("shard")["size"].sum()
    assert len(each) == 8 and each.max() < 1.6 * each.mean()
