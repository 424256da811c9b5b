"""Ranks and running sums in the order of any columns, over ranges that a sample of the rows makes even."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut


def range_totals(df: DataFrame, by: list[str], order: list, values: dict[str, Column]) -> DataFrame:
    """Adds the running sum of each of ``values`` in ``order`` inside each ``by`` group, the row's own value included.

    Rows are dealt to sorted ranges of (by, order), whose ends Spark takes from a sample, so ranges are even however the keys lie, and a
    large group has many. Only one sum for each group and range is put in one line. ``by`` holds no nulls, and ``order`` tells the
    rows of a group apart. The rows are written once, so select slim ones.
    """
    names = list(values)
    keys = ["_all", *by]
    placed = df.withColumns({"_all": F.lit(0), **{f"_v_{n}": c for n, c in values.items()}})
    placed = cut(placed.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in names}).join(before, [*keys, "_part"])
    return summed.select(*df.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in names])


def range_rank(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """1-based rank in ``order`` inside each ``by`` group."""
    return range_totals(df, by, order, {name: F.lit(1).cast("bigint")})
