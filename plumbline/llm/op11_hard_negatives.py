"""Hard negatives by exact integer products, computed as matrix products modulo small primes.

Vectors of whole numbers are written as balanced remainders modulo primes below 256. The product of two remainder matrices is
exact in float32 as long as no sum reaches 2**24, so long vectors are multiplied in pieces of ``TERMS`` components. As
many primes are taken as the largest possible score needs; the remainders of a score modulo all of them give back the signed score
(Chinese remainders, digit by digit in the mixed radix of the primes, balanced, so that negative scores need no case).

Anchors and rows are dealt to blocks by a hash of their number and meet block by block. A meeting returns the best few of an
anchor only, and a window picks the best over all blocks. Positives come first, as their scores set the limits of the negatives.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.llm.common import query, table
from plumbline.llm.vectors import finite, matrix

#: Remainders are at most 127 in size, so that so many products of two add up below 2**24.
TERMS = 1024
#: Anchors in a block, rows in a block (at least, at most, and the number of blocks aimed at between), scores at once in a task.
ANCHORS, ROWS, MOST_ROWS, BLOCKS, SCORES = 32_768, 8_192, 1 << 20, 1_024, 1 << 21
#: A hundred times a score must fit a BIGINT.
LIMIT = 1 << 56
NONE = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """The largest primes below 256 whose product tells all whole numbers from -bound to bound apart."""
    primes = []
    for p in range(255, 2, -2):
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            primes.append(p)
            if math.prod(primes) > 2 * bound + 1:
                return primes
    raise ValueError("scores are too large")


def balanced(values: np.ndarray, p: int) -> np.ndarray:
    """Remainders from -(p // 2) to p // 2, for an odd p."""
    return (values + p // 2) % p - p // 2


def remainders(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [balanced(vectors, p).astype(np.float32) for p in primes]


def exact_products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """All inner products of two sets of vectors, as whole numbers, from their remainders."""
    scores, weight = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for p, a, b in zip(primes, left, right, strict=True):
        rest = np.zeros(scores.shape, np.int64)
        for start in range(0, a.shape[1], TERMS):
            rest += (a[:, start : start + TERMS] @ b[:, start : start + TERMS].T).astype(np.int64)
        digit = balanced((rest - scores) % p * pow(weight, -1, p), p)
        scores += digit * weight
        weight *= p
    return scores


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest of each row, of equal ones the first; ``NONE`` is no score."""
    k = min(k, scores.shape[1])
    last = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above, level = scores > last, scores == last
    taken = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(taken & (scores != NONE))


def _sides(anchors: pa.Table, rows: pa.Table, dims: int, primes: list[int]):
    rows = rows.take(np.lexsort((rows["uid"].to_numpy(), rows["id"].to_numpy())))
    left, right = (remainders(matrix(t["v"], dims, np.int64), primes) for t in (anchors, rows))
    return left, right, rows


def _positives(dims: int, primes: list[int], k: int):
    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = {"uid": [], "id": [], "score": []}
        if len(anchors) and len(rows):
            left, right, rows = _sides(anchors, rows, dims, primes)
            labels, theirs = anchors["label"].to_numpy(), rows["label"].to_numpy()
            uid, other, ids = anchors["uid"].to_numpy(), rows["uid"].to_numpy(), rows["id"].to_numpy()
            for label in np.unique(labels):
                mine, same = np.flatnonzero(labels == label), np.flatnonzero(theirs == label)
                step = max(1, SCORES // max(1, len(same)))
                for start in range(0, len(mine) if len(same) else 0, step):
                    part = mine[start : start + step]
                    scores = exact_products([m[part] for m in left], [m[same] for m in right], primes)
                    scores[uid[part][:, None] == other[same][None, :]] = NONE
                    a, b = best(scores, k)
                    for name, values in (("uid", uid[part][a]), ("id", ids[same][b]), ("score", scores[a, b])):
                        found[name].append(values)
        return pa.table({n: pa.array(np.concatenate(v) if v else [], pa.int64()) for n, v in found.items()})

    return meet


def _negatives(dims: int, primes: list[int], k: int, low: int, high: int):
    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = {"uid": [], "place": [], "negative_id": [], "score": []}
        if len(anchors) and len(rows):
            left, right, rows = _sides(anchors, rows, dims, primes)
            labels, theirs, uid, ids = (t.to_numpy() for t in (anchors["label"], rows["label"], anchors["uid"], rows["id"]))
            places = max(len(s) for s in anchors["scores"].to_pylist())
            given = np.full((len(anchors), places), NONE)
            for i, scores in enumerate(anchors["scores"].to_pylist()):
                given[i, : len(scores)] = scores
            step = max(1, SCORES // len(rows))
            for start in range(0, len(anchors), step):
                part = slice(start, start + step)
                scores = exact_products([m[part] for m in left], right, primes)
                scores[labels[part][:, None] == theirs[None, :]] = NONE
                for place in range(places):
                    positive = given[part, place][:, None]
                    known = positive != NONE
                    positive = np.where(known, positive, 0)
                    fits = known & (scores >= -(-low * positive // 100)) & (scores <= high * positive // 100)
                    fitting = np.where(fits, scores, NONE)
                    a, b = best(fitting, k)
                    values = (uid[part][a], np.full(len(a), place), ids[b], fitting[a, b])
                    for name, value in zip(found, values, strict=True):
                        found[name].append(value)
        return pa.table({n: pa.array(np.concatenate(v) if v else [], pa.int64()) for n, v in found.items()})

    return meet


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, rows_in_block: int | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors in ``vectors``.

    ``vectors`` has id and label (long), v (an array of whole numbers) and anchor (boolean); more columns are left out. An
    anchor's positives are the ``positives`` other rows of its label with the highest inner product, its negatives those
    ``negatives`` rows of other labels with the highest among scores between ``low`` and ``high`` per cent of the positive's.
    Ties go to the smaller id. Rows with a null id, label or vector, or a null component, take no part. A shorter vector counts as
    filled up with zeros, so empty ones score 0. Rows that repeat an id, or all of it, are rows of their own: each can be
    an anchor and be chosen, and a copy of the anchor is a positive like any other. An anchor without positives, and a positive
    without negatives, has no row. Scores that do not fit 56 bits raise ValueError before any product is made.
    """
    schema = "uid long, id long, label long, v array<long>, anchor boolean"
    whole = vectors.select(
        F.monotonically_increasing_id().alias("uid"), F.col("id").cast("long"), F.col("label").cast("long"),
        F.col("v").cast("array<long>"), F.coalesce("anchor", F.lit(False)).alias("anchor"),
    )
    whole = whole.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")
    rows = cut(whole)
    largest = F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -x))))
    n, anchors, dims, size = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v")), largest).first()
    if not anchors:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims, bound = max(dims, 1), max(dims, 1) * (size or 0) ** 2
    if bound >= LIMIT:
        raise ValueError(f"scores of up to {bound} do not fit {LIMIT}")
    primes = primes_for(bound)
    in_block = rows_in_block or min(max(ROWS, -(-n // BLOCKS)), MOST_ROWS)
    wide, long = -(-n // in_block), -(-anchors // ANCHORS)
    deal = lambda salt, parts: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    others = rows.select("uid", "id", "label", "v", deal(1, wide).alias("j"), every(long).alias("i")).groupBy("i", "j")

    def met(left: DataFrame, function, returns: str) -> DataFrame:
        sides = left.withColumn("i", deal(2, long)).withColumn("j", every(wide))
        sides = sides.toDF(*sides.columns).groupBy("i", "j")
        return sides.cogroup(others).applyInArrow(function, returns)

    own = rows.filter("anchor").select("uid", F.col("id").alias("anchor_id"), "label", "v")
    near = met(own.drop("anchor_id"), _positives(dims, primes, positives), "uid long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "id"))
    near = cut(near.withColumn("place", rank - 1).filter(F.col("place") < positives))
    lists = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("scores"))
    limits = own.drop("anchor_id").join(lists.select("uid", F.col("scores.score").alias("scores")), "uid")
    found = met(limits, _negatives(dims, primes, negatives, low, high), "uid long, place long, negative_id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid", "place").orderBy(F.desc("score"), "negative_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= negatives).withColumnRenamed("score", "negative_score")
    named = near.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).join(own.select("uid", "anchor_id"), "uid")
    return found.join(named, ["uid", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
     FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
     FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
     QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
   vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor")))
