"""Hash keys that any engine with SHA-256 can reproduce."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ranges import range_rank


def stable_key(namespace: str, value) -> Column:
    return F.sha2(F.concat(F.lit(namespace + "|"), F.col(value).cast("string") if isinstance(value, str) else value.cast("string")), 256)


def hex_int(text: Column, digits: int = 8) -> Column:
    """The first hex digits of a SHA-256 as a BIGINT."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("bigint")


def bucket(text: Column, modulus: int) -> Column:
    return hex_int(text) % F.lit(modulus).cast("bigint")


# The multipliers of a well-known 32-bit integer mixer; the second is written less 2**32, so that
# products stay inside a BIGINT and only their low 32 bits are kept.
MIX_1, MIX_2, LOW_32 = 0x7FEB352D, 0x846CA68B - 2**32, 0xFFFFFFFF


def mixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``name``: 32 well-mixed bits of a whole number in [0, 2**32), by integer steps that stay in codegen."""

    def fold(shift):
        return F.col(name).bitwiseXOR(F.shiftright(F.col(name), shift))

    return (
        df.withColumn(name, value)
        .withColumn(name, (fold(16) * F.lit(MIX_1)).bitwiseAND(F.lit(LOW_32)))
        .withColumn(name, (fold(15) * F.lit(MIX_2)).bitwiseAND(F.lit(LOW_32)))
        .withColumn(name, fold(16))
    )


def running_total(
    df: DataFrame, by: list[str], key: str, tie: str, value: str, name: str, bucket_of: Column | None = None
) -> DataFrame:
    """Running sum of ``value`` in (key, tie) order inside each ``by`` group.

    ``key`` is a uniform hex hash, so its first three digits are an order-preserving bucket: a group of any size is
    summed in 4096 parts, and only the bucket totals are put in one line. ``bucket_of`` replaces that bucket for
    keys that are not hashes; it must rise with the key.
    """
    slots = df.withColumn("_bucket", F.substring(F.col(key), 1, 3) if bucket_of is None else bucket_of)
    totals = slots.groupBy(*by, "_bucket").agg(F.sum(value).alias("_total"))
    before = totals.withColumn(
        "_before",
        F.sum("_total").over(
            Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        - F.col("_total"),
    ).drop("_total")
    inside = F.sum(value).over(
        Window.partitionBy(*by, "_bucket")
        .orderBy(key, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        slots.withColumn("_inside", inside)
        .join(before, [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_before", "_inside")
    )


def hash_rank(df: DataFrame, by: list[str], key: str, tie: str, name: str) -> DataFrame:
    """1-based rank in (key, tie) order inside each group; no single-task window over the rows."""
    whole = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    out = running_total(base.withColumn("_one", F.lit(1).cast("bigint")), whole, key, tie, "_one", name)
    return out.drop("_one", "_all")


def number_rank(df: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """1-based rank by a unique key, in ranges that are even however the keys lie; only the keys are written and sorted."""
    ranked = range_rank(df.select(*by, key), by, [key], name)
    return df.join(ranked, [*by, key]) if set(df.columns) != {*by, key} else ranked
