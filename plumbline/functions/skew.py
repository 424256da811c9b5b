"""Joining rows with one value per key when a key may hold a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_join(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values``, which has at most one row per key.

    Values that were just grouped by the key would be joined where they are, below an aggregation, and adaptive
    execution splits a hot partition only between two plain shuffles. An extra key, equal whenever the keys are, asks
    for such a shuffle of the (small) values; the hot partition of ``rows`` is then read by many tasks. One bit is
    enough for that, and hardly adds to what is shuffled.
    """
    mark = F.xxhash64(*keys).bitwiseAND(F.lit(1))
    return (
        rows.withColumn("_mark", mark).join(values.withColumn("_mark", mark), [*keys, "_mark"], how).drop("_mark")
    )
