"""N-gram Jaccard join: which documents are linked by nearly equal sets of word shingles."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.llm import setjoin
from plumbline.llm.common import LOWER, UPPER, query, row_key, table
from plumbline.llm.words import rolling_hashes, texts


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes; bytes fold A-Z only and split at ASCII blanks only."""
    words = (text or b"").lower().split()
    return np.unique(rolling_hashes(words, min(k, len(words)) or 1))


def _key(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return tuple(np.frombuffer(digest, np.int64).tolist())


def _keys(k: int, keep: list[str]):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, k) for t in texts(batch)]
            both = [_key(s) for s in sets]
            columns = [pa.array([b[i] for b in both], pa.int64()) for i in (0, 1)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *columns, sizes], names=[*keep, "k", "k2", "n"])

    return keys


def _first_tokens(k: int):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [s for s in (shingles(t, k) for t in texts(batch.slice(at, 1000))) if len(s) > 3]
                firsts = [s[: setjoin.first_tokens(len(s))].view(np.int64) for s in sets]
                keys = [np.full(len(f), _key(s)[0]) for s, f in zip(sets, firsts)]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(firsts))], names=["k", "token"])

    return tokens


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [shingles(t, k).view(np.int64) for t in texts(part)]
                sizes = pa.array([len(r) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("node"), sizes, pa.array(rows, pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    return sets


def join_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, key, n_shingles, class_id, component, component_id) of every row of ``docs`` (doc_id, text).

    Rows of equal sets are a class, named by its smallest doc_id; the join runs over classes (see ``setjoin``), and
    component_id is the smallest doc_id that links lead to. Sets decide and not ids: rows that repeat a doc_id with other
    texts are linked by their own texts, and rows without an id take part like others; a component of such rows only has no
    component_id, but a name in ``component``. ``key`` is the ``row_key``. Null and empty texts have no shingle, no component
    name, and link with nothing, themselves aside. Within the join a set goes by 64 bits of its digest. Texts are read three
    times, but only hashes are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    keyed = cut(rows.mapInArrow(_keys(k, ["doc_id", "key"]), "doc_id long, key string, k long, k2 long, n long"))
    classes = keyed.filter("n > 0").groupBy("k", "k2", "n").agg(F.min("doc_id").alias("class_id"), F.min("key").alias("key"))
    lone = setjoin.unlinked(rows.select("text").mapInArrow(_first_tokens(k), "k long, token long"))
    open_sets = classes.filter("n > 3").join(lone, "k", "left").filter(setjoin.passes("n", "lone"))
    chosen = cut(open_sets.select("key", F.col("k").alias("node")))
    if chosen.count() <= setjoin.BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    first = rows.select("key", "text").join(chosen, "key").select("node", "text")
    sets = cut(first.mapInArrow(_sets(k), "node long, n long, tokens array<long>").dropDuplicates(["node"]))
    found = setjoin.linked_components(sets, percent).select(F.col("node").alias("k"), "component")
    named = skew_join(classes.drop("key"), found, ["k"], "left").withColumn("component", F.coalesce("component", "k"))
    named = cut(named)
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = skew_join(named, least, ["component"])
    full = skew_join(keyed.filter("n > 0"), named, ["k", "k2", "n"])
    columns = ["doc_id", "key", F.col("n").alias("n_shingles"), "class_id", "component", "component_id"]
    own = F.col("doc_id")
    none = keyed.filter("n = 0").select("*", own.alias("class_id"), F.lit(None).cast("long").alias("component"), own.alias("component_id"))
    return full.select(columns).unionByName(none.select(columns))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n x ON a.doc_id = x.doc_id JOIN n y ON b.doc_id = y.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id),
k AS (SELECT doc_id, md5(string_agg(t, '|' ORDER BY t)) AS k FROM s GROUP BY doc_id),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM k)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.class_id, w.doc_id) AS class_id, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op2_jaccard", SQL)
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "class_id", "component_id")
