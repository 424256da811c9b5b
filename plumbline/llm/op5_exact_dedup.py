"""Exact deduplication of a stream by keyed state on disk."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.skew import skew_join
from plumbline.llm.common import LOWER, UPPER, ascii_lower, query, shared_folder, table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Without it each partition's state takes several MB of disk before it holds a row.
ALLOCATE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
#: So many digests (about 100 bytes each) are broadcast at most.
BROADCAST_ROWS = 250_000


def normal_text():
    return ascii_lower(F.coalesce(F.col("text"), F.lit("")))


def text_digest():
    return F.sha2(normal_text().cast("binary"), 256)


def keep_largest(stream: DataFrame, folder: str, digest=None) -> DataFrame:
    """Reads ``stream`` (doc_id, text) to its present end; (digest, keep_id, locator, group_size) of every text so far.

    The state holds, for each digest and without expiry, the identifier that stays, where its row was read and how many
    rows came; RocksDB keeps it on disk, and the checkpoint in ``folder`` restores it. A micro-batch is reduced to one
    row for each digest in the map tasks, so copies of one text never meet in one task. Each batch writes the digests
    it changed to a folder of its own, which a repeated batch overwrites. Starting again on the same folder reads only
    what came since.
    """
    spark = stream.sparkSession
    digest = text_digest() if digest is None else digest
    rows = stream.select(
        digest.alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("locator")
    )
    state = rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.max_by("locator", "doc_id").alias("locator"), F.count("*").alias("group_size")
    )
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, ALLOCATE)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(ALLOCATE, "false")
    try:
        run = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={n}"))
            .start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changed = spark.read.parquet(f"{folder}/changed")
    return changed.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max_by("locator", "batch").alias("locator"), F.max("group_size").alias("group_size")
    )


def deduplicate(docs: DataFrame, stream: DataFrame, folder: str, digest=None) -> DataFrame:
    """Every row of ``docs`` with the row that stays of its text; ``stream`` reads the same rows as a stream.

    Null texts count as empty and equal each other. Rows that repeat the largest doc_id of their group all stay; if
    no row of a group has an id, all its rows stay. Digests that came more than once are checked on the full bytes:
    where texts under one digest differ, the rows are grouped by their whole texts instead. Other columns are ignored.
    """
    digest = text_digest() if digest is None else digest
    keepers = keep_largest(stream, folder, digest)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), normal_text().alias("text"))
    hit = keepers.filter("group_size > 1").select("digest")
    if hit.count() <= BROADCAST_ROWS:  # then whole texts move only where their digest came twice
        hits = rows.join(F.broadcast(hit), "digest", "left_semi")
    else:
        hits = skew_join(rows, hit, ["digest"], "left_semi")
    mixed = hits.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest")
    mixed = mixed.persist()
    small = rows.select("doc_id", "digest", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    if mixed.isEmpty():
        found = skew_join(small, keepers.drop("locator"), ["digest"])
    else:
        true = skew_join(rows, mixed, ["digest"], "left_semi").withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        groups = true.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = skew_join(true, groups, ["digest", "text"]).drop("text")
        alike = skew_join(skew_join(small, mixed, ["digest"], "left_anti"), keepers.drop("locator"), ["digest"])
        found = alike.unionByName(apart)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


@query(
    "op5_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # as a pattern: the file source takes a plain path for a folder, and small tables are one file
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")
    return deduplicate(docs, stream, shared_folder(spark))
