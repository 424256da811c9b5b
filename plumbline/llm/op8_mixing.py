"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.llm.common import WORD, query, row_key, table

NEAR = 1e-9
UNITS = "sid int, key string, level int, mass long, p double"


def pivot(mass: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probability between neighbours until at most one is left fractional; the sum of mass * p stays.

    A pair gives or takes the same mass, and the side is drawn so that neither probability changes on average.
    """
    p = p.copy()
    draws = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not NEAR < p[i] < 1 - NEAR:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = mass[held], mass[i]
        up = min(1 - p[held], b * p[i] / a)
        down = min(p[held], b * (1 - p[i]) / a)
        change = up if draws[i] * (up + down) < down else -down
        p[held] += change
        p[i] -= change * a / b
        for k in (held, i):
            if not NEAR < p[k] < 1 - NEAR:
                p[k] = round(p[k])
        held = next((k for k in (held, i) if 0 < p[k] < 1), -1)
    return p


def _settle(seed: int):
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", ignore_index=True)
        first = group.iloc[0]
        rng = np.random.default_rng([seed, int(first["sid"]), int(first["level"]), int(first["chunk"])])
        group["p"] = pivot(group["mass"].to_numpy(float), group["p"].to_numpy(float), rng)
        return group[["sid", "key", "level", "mass", "p"]]

    return settle


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(source, sid, source_size, target) of ``sizes`` (source, size).

    Sources by code point, null last, weigh 1, 2, 3 in turn. The share of a weight, ``level``, is raised until all
    sizes are dealt out; sources stop at ``cap`` times their size. Taken by rising cap a weight, the first
    source that its share leaves below its cap tells the level for all. The windows run over sources, not documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("sid", F.row_number().over(order)).withColumn("w", (F.col("sid") - 1) % 3 + 1)
    sources = sources.withColumn("most", F.col("source_size") * cap).withColumn("reach", F.col("most") / F.col("w"))
    up = Window.orderBy("reach", "sid")
    all_rows = Window.orderBy("reach", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("share", (F.sum("source_size").over(all_rows) - capped) / left)
    level = F.first(F.when(F.col("share") <= F.col("reach"), F.col("share")), ignorenulls=True).over(all_rows)
    return sources.select("source", "sid", "source_size", F.least(F.col("most").cast("double"), level * F.col("w")).alias("target"))


def mix(docs: DataFrame, size: Column, seed: int = 11, fanout: int = 512) -> DataFrame:
    """(doc_id, _key, source, copies, size, source_size, target) of each row of ``docs`` (doc_id, source, text).

    A source of S words and target T takes each document floor(T / S) times and once more with the probability left
    over. Those probabilities are settled in chunks of about ``fanout`` documents by pairs; each chunk leaves at most one
    undecided, and these meet in the next level of the tree, until one a source is left, which is drawn. So the words
    a source gives miss its target by less than one document. Everything follows from seed, ids and texts: reruns
    agree. Rows that repeat id and text (and source) share one decision. Null and empty texts have size 0 and are not taken.
    """
    rows = docs.select("doc_id", "source", row_key(F.col("doc_id"), F.col("text")).alias("_key"), size.cast("long").alias("size"))
    rows = cut(rows)
    targets = cut(source_targets(rows))
    tagged = skew_join(rows.withColumn("_null", F.col("source").isNull()).fillna("", "source"), targets.withColumn("_null", F.col("source").isNull()).fillna("", "source"), ["source", "_null"])
    tagged = tagged.withColumn("source", F.when(~F.col("_null"), F.col("source"))).drop("_null")
    tagged = tagged.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    tagged = tagged.withColumn("whole", F.floor(F.col("ratio") + NEAR)).withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    units = tagged.filter("size > 0 AND p > 0").groupBy("sid", F.col("_key").alias("key")).agg(F.sum("size").alias("mass"), F.first("p").alias("p"))
    largest = tagged.groupBy("sid").count().agg(F.max("count")).first()[0] or 0
    chunks = math.ceil(largest / fanout)
    settled, level = [], 0
    while largest:
        at = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(max(1, chunks)))
        chunked = units.withColumn("level", F.lit(level)).withColumn("chunk", at)
        done = cut(chunked.groupBy("sid", "chunk").applyInPandas(_settle(seed + level), UNITS))
        settled.append(done.filter("p = 0 OR p = 1"))
        units = done.filter("p > 0 AND p < 1").drop("level")
        if chunks <= 1:
            drawn = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) < F.col("p")
            settled.append(units.withColumn("level", F.lit(level)).withColumn("p", drawn.cast("double")).select("sid", "key", "level", "mass", "p"))
            break
        chunks, level = math.ceil(chunks / fanout), level + 1
    if not settled:
        return tagged.select("doc_id", "_key", "source", F.lit(0).cast("long").alias("copies"), "size", "source_size", "target")
    more = settled[0]
    for s in settled[1:]:
        more = more.unionByName(s)
    more = more.select("sid", F.col("key").alias("_key"), F.col("p").cast("long").alias("more"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("more", F.lit(0))).otherwise(F.lit(0))
    return tagged.join(more, ["sid", "_key"], "left").select("doc_id", "_key", "source", copies.cast("long").alias("copies"), "size", "source_size", "target")


def word_count() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0))


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), word_count())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
