"""Exact type-7 quantiles of groups of any size and shape, by radix selection.

A double's bits, with the lower ones turned round where it is negative, are a whole number of the same order. Four passes settle 16 bits
each: they count the next 16 bits of the values that still agree with a wanted rank's bits (combined before the shuffle), and keep
the count that holds the rank. Neither many equal values nor outliers or infinities make a difference, and no task sees a group's values.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.lineage import cut

BITS, PASSES = 16, 4
#: Wanted ranks that are broadcast at most.
BROADCAST_RANKS = 100_000
LOWER = np.int64(2**63 - 1)


@F.pandas_udf(T.LongType())
def ordered_bits(values: pd.Series) -> pd.Series:
    """A whole number that orders like the double; all zeros are one, and NaN is the largest."""
    numbers = values.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(numbers), np.float64("nan"), numbers).view(np.int64)
    bits = np.where(np.isnan(numbers), np.int64(0x7FF8 << 48), bits)
    return pd.Series(np.where(bits < 0, bits ^ LOWER, bits))


@F.pandas_udf(T.DoubleType())
def from_bits(bits: pd.Series) -> pd.Series:
    whole = bits.to_numpy(np.int64)
    return pd.Series(np.where(whole < 0, whole ^ LOWER, whole).view(np.float64))


def _held(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The count that holds ``rank``, with what is left of the rank inside it."""
    up_to = F.sum("n").over(Window.partitionBy(*keys).orderBy("bits").rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("up_to") - F.col("n")
    here = counted.withColumn("up_to", up_to).filter((before <= F.col("rank")) & (F.col("rank") < F.col("up_to")))
    return here.select("_g", "t", (F.col("rank") - before).alias("rank"), "part", "bits")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], names: list[str]) -> DataFrame:
    """``by`` and one column for each probability: the value at (n - 1) q of a group's values in order, between two of them in proportion.

    Null values are left out, and a group of nothing else has no row. Null keys are a group like any other. Between a finite value and an
    infinite one the quantile is infinite; NaN counts as larger than all.
    """
    group = F.struct(*by, F.lit(0).alias("_one")).alias("_g")
    rows = df.select(group, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    rows = cut(rows.select("_g", ordered_bits("v").alias("bits")))
    first = rows.groupBy("_g", F.shiftright("bits", 64 - BITS).alias("bits")).agg(F.count("*").alias("n"))
    total = first.groupBy("_g").agg(F.sum("n").alias("all"))
    ranks = []
    for i, q in enumerate(probabilities):
        place = (F.col("all") - 1) * F.lit(float(q))
        for j, edge in enumerate((F.floor(place), F.ceil(place))):
            ranks.append(F.struct(F.lit(2 * i + j).alias("t"), edge.cast("long").alias("rank"), (place - F.floor(place)).alias("part")))
    wanted = total.select("_g", F.inline(F.array(*ranks)))
    held = cut(_held(wanted.join(first, "_g"), ["_g", "t"]))
    # as many rows in every pass; where they are few, the values need no shuffle to meet them
    few = held.count() <= BROADCAST_RANKS
    for level in range(1, PASSES):
        shift = 64 - BITS * (level + 1)
        open_rows = rows.withColumn("prefix", F.shiftright("bits", shift + BITS))
        wanted = held.withColumnRenamed("bits", "prefix")
        wanted = F.broadcast(wanted) if few else wanted
        open_rows = open_rows.join(wanted.select("_g", "prefix"), ["_g", "prefix"], "left_semi")
        counted = open_rows.groupBy("_g", "prefix", F.shiftright("bits", shift).alias("bits")).agg(F.count("*").alias("n"))
        held = cut(_held(counted.join(wanted, ["_g", "prefix"]), ["_g", "t"]))
    found = held.select("_g", "t", "part", from_bits("bits").alias("v"))
    at = lambda t, c: F.max(F.when(F.col("t") == t, F.col(c)))
    columns = []
    for i, name in enumerate(names):
        low, high, part = at(2 * i, "v"), at(2 * i + 1, "v"), at(2 * i, "part")
        columns.append(F.when((part == 0) | (low == high), low).otherwise(low + part * (high - low)).alias(name))
    return found.groupBy("_g").agg(*columns).select(*[F.col("_g")[c].alias(c) for c in by], *names)
