"""From raw documents to shards: language, near duplicates, benchmark passages, source weights, shards.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. Internal columns are made apart from those of
the documents, which pass through as they are.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.llm.common import if_small, row_key, shared_folder, table
from plumbline.llm.op2_jaccard import join_documents
from plumbline.llm.op3_decontamination import contamination
from plumbline.llm.op6_sharding import document_dims, kd_shards
from plumbline.llm.op8_mixing import mix, word_count
from plumbline.llm.op10_language_id import fit, held_out, identify

#: Below this share of words in any one language a text is in none.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that no language has a fair share of."""
    tagger = fit(docs.filter(~held_out(F.col("doc_id"))))
    return identify(packed(docs, "text"), tagger, ["row"]).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("row.*")


def packed(docs: DataFrame, *columns) -> DataFrame:
    """(row, key, ...): each row whole, apart from the columns that a stage adds."""
    return docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key"), *columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents one stays, that with the smallest doc_id (of rows that share it, with the least key; rows without
    an id come last). Rows that repeat id and text are copies. Rows that only share an id, and texts without words, stay."""
    found = cut(join_documents(docs).filter("component IS NOT NULL").select("doc_id", "key", "component"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    stays = found.groupBy("component").agg(F.min(order)["key"].alias("stays"))
    gone = cut(skew_join(found, stays, ["component"]).filter("key <> stays").select("key").distinct())
    left = packed(docs).join(if_small(gone), "key", "left_anti")
    again = cut(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key").join(gone, "key", "left_anti"))
    if not again.isEmpty():
        again = if_small(again)
        left = left.join(again, "key", "left_anti").unionByName(left.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return left.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("key").distinct()
    return packed(docs).join(if_small(hit), "key", "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the target weights of the sources ask for; texts without words are not taken."""
    copies = mix(docs, word_count()).filter("copies > 0").groupBy(F.col("_key").alias("key"), "source").agg(F.max("copies").alias("copies"))
    mine, theirs = packed(docs, "source").alias("d"), if_small(copies).alias("c")
    taken = mine.join(theirs, (F.col("d.key") == F.col("c.key")) & F.col("d.source").eqNullSafe(F.col("c.source")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): eight shards of near equal bytes."""
    return kd_shards(docs, document_dims(), shards=8).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mixture),
    ("sharding", shards),
]

#: The language stage is a trained model, which SQL cannot express; tests/llm holds the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
