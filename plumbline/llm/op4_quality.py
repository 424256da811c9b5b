"""Quality classifier: labelled neighbours in a latent-semantic space vote on every document."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import query, table

#: Terms of a text: hashed trigrams of bytes, then bins of how it is built.
GRAMS, BINS = 1024, 16
SHAPES = 10
TERMS = GRAMS + SHAPES * BINS
#: Documents whose products with the labelled vectors are made at once.
BLOCK = 512
LETTER = np.array([chr(c).isalpha() or c >= 128 for c in range(256)])
UPPER = np.array([65 <= c <= 90 for c in range(256)])
MARK = np.array([c < 128 and chr(c).isprintable() and not chr(c).isalnum() and c != 32 for c in range(256)])
STOP = np.array([chr(c) in ".,;:'\"-?" if c < 128 else False for c in range(256)])


def _shapes(text: bytes, counts: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 on how a text is built; they do not depend on its language."""
    n = max(1, len(text))
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    letters = counts[LETTER].sum()
    return np.array(
        [
            len(set(words)) / w,
            1 - len(set(lines)) / max(1, len(lines)),
            counts[UPPER].sum() / max(1, letters),
            letters / n,
            counts[MARK & ~STOP].sum() / n,
            counts[STOP].sum() / n,
            counts[ord("|")] / n * 4,
            counts[48:58].sum() / n,
            min(1.0, n / w / 24),
            min(1.0, np.log2(1 + w) / 16),
        ]
    ).clip(0, 1)


def terms(text: bytes | None) -> np.ndarray:
    """Term weights of a whole text: damped counts of trigrams, and each shape spread over its two nearest bins."""
    text = text or b""
    out = np.zeros(TERMS, np.float32)
    a = np.frombuffer(text, np.uint8)
    if len(a) > 2:
        b = a.astype(np.uint32)
        grams = ((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA77 + b[2:] * 0xC2B2AE3D) >> np.uint32(15)) % GRAMS
        out[:GRAMS] = np.log1p(np.bincount(grams, minlength=GRAMS))
    place = _shapes(text, np.bincount(a, minlength=256)) * (BINS - 1)
    low = np.minimum(place.astype(int), BINS - 2)
    at = GRAMS + np.arange(SHAPES) * BINS + low
    out[at] = 1 - (place - low)
    out[at + 1] = place - low
    return out


def _matrix(texts: list) -> np.ndarray:
    return np.stack([terms(t) for t in texts]) if texts else np.zeros((0, TERMS), np.float32)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    total, n = np.zeros(TERMS), 0
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            total += terms(text) > 0
            n += 1
    rows = {"term": np.arange(TERMS + 1), "n": np.append(total, n)}
    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("term", pa.int64()), ("n", pa.float64())]))


class Space:
    """Term weights, latent directions, and the labelled vectors with their labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, idf: np.ndarray, rank: int):
        self.idf = idf
        z = self._weigh(x)
        values, vectors = np.linalg.eigh(z.T @ z)
        self.directions = np.ascontiguousarray(vectors[:, ::-1][:, :rank], np.float32)
        self.vectors, self.labels = self._latent(z), labels.astype(np.float32)
        self.prior = float(labels.mean())

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        """Both kinds of terms have the same length in the end, whatever their numbers."""
        z = x * self.idf
        for part, share in ((slice(0, GRAMS), 0.6), (slice(GRAMS, TERMS), 0.8)):
            z[:, part] *= share / np.maximum(np.linalg.norm(z[:, part], axis=1, keepdims=True), 1e-9)
        return z

    def _latent(self, z: np.ndarray) -> np.ndarray:
        v = z @ self.directions
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray, k: int, sharpness: float) -> np.ndarray:
        """The labels of the ``k`` nearest by cosine, weighted by a power of it; every labelled vector is compared."""
        cosines = self._latent(self._weigh(x)) @ self.vectors.T
        k = min(k, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosines, near, 1), 1e-3) ** sharpness
        return ((w * self.labels[near]).sum(1) / w.sum(1)).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, rank: int = 64) -> Space | None:
    """The space of ``docs`` (doc_id, text) with the labelled rows of ``labels`` (doc_id, label 0 or 1).

    At most ``most`` labelled documents are used, the first by a hash of their ids; only they come to the driver. How
    many documents a term occurs in is counted over all of ``docs``. Several labels of a document count as their mean;
    null labels are left out.
    """
    each = labels.filter("label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label"))
    some = F.broadcast(each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # a doc_id can repeat in the documents: then its first text by hash is taken
    rows = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("text").cast(pa.binary()).to_pylist())
            packed = [row.astype(np.float32).tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.float64()), pa.array(packed, pa.binary())], names=["doc_id", "label", "x"])

    found = rows.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label double, x binary").toPandas().sort_values("doc_id")
    if not len(found):
        return None
    counts = docs.select("text").mapInArrow(_document_counts, "term long, n double").groupBy("term").agg(F.sum("n").alias("n"))
    n = counts.toPandas().set_index("term")["n"].reindex(range(TERMS + 1), fill_value=0.0).to_numpy()
    idf = (np.log((1 + n[-1]) / (1 + n[:-1])) + 0.3).astype(np.float32)
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, TERMS)
    return Space(x, found["label"].to_numpy(), idf, min(rank, TERMS))


def score(docs: DataFrame, space: Space | None, keep: list[str], k: int = 40, sharpness: float = 8.0) -> DataFrame:
    """The columns ``keep`` of each row and ``score``; the space goes to the tasks (about a megabyte, see ``fit``).

    Null texts are empty; empty texts are scored by their shape like all others. Without any label all score 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            parts = [np.zeros(0)]
            for i in range(0, len(texts), BLOCK):
                x = _matrix(texts[i : i + BLOCK])
                parts.append(space.scores(x, k, sharpness) if space else np.full(len(x), 0.5))
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(parts), pa.float64())], names=[*keep, "score"])

    rows = docs.select(*keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(vote, f"{kinds}, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    found = score(docs, fit(docs, labels), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
