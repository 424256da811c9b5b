"""Benchmark decontamination: windows of benchmark items found in documents by their rarest shingle."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.llm.common import LOWER, UPPER, query, row_key, table
from plumbline.llm.words import rolling_hashes, texts

#: Bits of the sieve that goes to every task: half a megabyte, whatever the size of the benchmark.
SIEVE_BITS = 1 << 22
#: Lower-cases A-Z and blanks every ASCII character that is neither a letter nor a digit.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

WINDOWS = "item string, words string, m int, tokens array<long>"
FOUND = "doc_id long, key string, n_words long, hits array<struct<pos:int,token:long,before:int,context:string>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _windows(window: int, k: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), texts(batch)):
                words = words_of(text)
                m = min(window, len(words))
                if not m:
                    continue
                tokens = rolling_hashes(words, min(k, m)).view(np.int64)
                for i in range(len(words) - m + 1):
                    out.append((item, b" ".join(words[i : i + m]).decode("utf-8", "replace"), m, tokens[i : i + m - min(k, m) + 1].tolist()))
            names = ["item", "words", "m", "tokens"]
            yield pa.RecordBatch.from_pydict({n: [r[j] for r in out] for j, n in enumerate(names)}, schema=pa.schema([("item", pa.string()), ("words", pa.string()), ("m", pa.int32()), ("tokens", pa.list_(pa.int64()))]))

    return windows


def _sieve(sieve: bytes, lengths: list[int], window: int):
    hit_type = pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.int64()), ("before", pa.int32()), ("context", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n_words", pa.int64()), ("hits", hit_type)])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sieve, np.uint8)
        for batch in batches:
            counts, hits = [], []
            for text in texts(batch):
                words = words_of(text)
                own = []
                for k in lengths:
                    tokens = rolling_hashes(words, k)
                    at = (tokens % np.uint64(SIEVE_BITS)).astype(np.int64)
                    for pos in np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                        low = max(0, pos + k - window)
                        context = b" ".join(words[low : pos + window]).decode("utf-8", "replace")
                        own.append({"pos": pos, "token": int(tokens[pos].view(np.int64)), "before": pos - low, "context": context})
                counts.append(len(words))
                hits.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("key").cast(pa.string()), pa.array(counts, pa.int64()), pa.array(hits, hit_type)], schema=schema)

    return found


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items (sorted ids), hit intervals ``spans``.

    Items give windows of ``window`` words (a shorter item is one). A window that occurs holds all its shingles of
    ``k`` words, so the one that is rarest in the documents is a prefix that suffices. A sieve of fixed size leaves of
    the documents' shingles those that may be of the benchmark, with the words around them; these are counted, the
    rarest of each window is joined with them, its place in the window must leave room on both sides, and the words
    themselves must be equal. A full sieve lets more pass, but changes no result.

    Null and empty texts have no words; items without words have no window; items without an id are one item, "null".
    Rows that repeat id and text get the same result each.
    """
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    windows = cut(items.select(item.alias("item"), "text").mapInArrow(_windows(window, k), WINDOWS))
    distinct = windows.dropDuplicates(["words"]).select("words", "m", "tokens")
    lengths = sorted({min(k, r["m"]) for r in windows.select("m").distinct().collect()})
    token = distinct.select(F.explode("tokens").alias("token"))
    marked = token.select(F.col("token").bitwiseAND(F.lit(SIEVE_BITS - 1)).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    sieve = np.zeros(SIEVE_BITS // 8, np.uint8)
    np.bitwise_or.at(sieve, marked >> 3, np.left_shift(1, marked & 7).astype(np.uint8))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    found = cut(rows.mapInArrow(_sieve(sieve.tobytes(), lengths, window), FOUND))
    hits = found.select("key", F.inline("hits"))
    counts = hits.groupBy("token").agg(F.count("*").alias("n"))
    shingles = distinct.select("words", "m", F.posexplode("tokens").alias("offset", "token"))
    rarest = shingles.join(counts, "token").groupBy("words", "m").agg(F.min(F.struct("n", "offset", "token")).alias("c"))
    rarest = rarest.select("words", "m", "c.offset", "c.token")
    met = skew_join(hits, rarest, ["token"]).filter(F.col("before") >= F.col("offset"))
    inside = F.slice(F.split("context", " "), F.col("before") - F.col("offset") + 1, F.col("m"))
    met = met.filter(F.array_join(inside, " ") == F.col("words"))
    start = (F.col("pos") - F.col("offset")).alias("start")
    met = cut(met.select("key", "words", start, (start + F.col("m")).cast("int").alias("stop")))
    spans = met.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    owners = windows.select("words", "item").distinct()
    named = skew_join(met.select("key", "words").distinct(), owners, ["words"]).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def cover(state, x):
        new = F.greatest(x["stop"] - F.greatest(x["start"], state["reach"]), F.lit(0))
        return F.struct((state["n"] + new).alias("n"), F.greatest(state["reach"], x["stop"]).alias("reach"))

    result = found.select("doc_id", "key", "n_words").join(spans, "key", "left").join(named, "key", "left")
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate("spans", none, cover)["n"]
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return result.select(
        "doc_id", "key", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"), items_found.alias("items"), "spans",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(UPPER, LOWER)
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE len({_WORDS}) > 0),
iw AS (SELECT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) AS win FROM i),
dw AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw))),
j AS (SELECT DISTINCT dw.doc_id, dw.p, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM j) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM j) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(g.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""


@query("op3_decontamination", SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
