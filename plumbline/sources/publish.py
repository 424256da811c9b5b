"""Writing results once: fingerprints, digest checks and idempotent publishing."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_NULL = "\\N"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all executors can reach; a local one only when Spark itself is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="plumbline-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def canonical_row(columns: list[str]):
    """Text of a row with its columns by name; null is told apart from the empty string."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(columns)])


def fingerprint(df: DataFrame, by: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """A digest of a set of rows (with repeats) that no order or partitioning changes.

    Row hashes are added up in four 60-bit parts, so it is one aggregation with map-side combine: no sort, and no
    bucket whose hashes must be gathered.
    """
    named = columns or [c for c in df.columns if c not in by]
    hashed = df.select(*by, F.sha2(canonical_row(named), 256).alias("h"))

    def part(start):
        return F.sum(F.conv(F.substring("h", start, 15), 16, 10).cast("decimal(20,0)")).cast("string")

    parts = F.concat_ws("-", F.count("*").cast("string"), part(1), part(16), part(31), part(46))
    return hashed.groupBy(*by).agg(F.count("*").alias("rows"), F.sha2(parts, 256).alias("digest"))


def check_digests(manifest: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Recorded digests against recomputed ones."""
    joined = manifest.join(actual.select(key, F.col("digest").alias("actual")), key, "left")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("digest"), "mismatch").otherwise("ok")
    return joined.select(key, state.alias("state"))


def write(df: DataFrame, path: str, kind: str, partitions: list[str] = (), mode: str = "errorifexists") -> None:
    """S06-S08, S12. CSV gets a header; JSON keeps nulls so that every row has the same fields."""
    writer = df.write.mode(mode)
    if partitions:
        writer = writer.partitionBy(*partitions)
    if kind == "csv":
        writer.csv(path, header=True, nullValue=CSV_NULL)
    elif kind == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)


def read(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    if kind == "csv":
        return spark.read.csv(path, header=True, schema=schema, nullValue=CSV_NULL, multiLine=True)
    if kind == "json":
        return spark.read.schema(schema).json(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def publish(df: DataFrame, path: str, kind: str = "parquet", replace_incomplete: bool = False) -> str:
    """``created`` the first time, ``unchanged`` when the same rows come again, ``conflict`` when they differ.

    A folder without the mark of a finished write is ``incomplete``: it is left as it is, or written anew and ``created``
    with ``replace_incomplete``.
    """
    spark = df.sparkSession
    if not _exists(spark, path):
        write(df, path, kind)
        return "created"
    if not _exists(spark, f"{path}/_SUCCESS"):
        if not replace_incomplete:
            return "incomplete"
        write(df, path, kind, mode="overwrite")
        return "created"
    old = fingerprint(read(spark, path, kind, df.schema)).first()["digest"]
    return "unchanged" if old == fingerprint(df).first()["digest"] else "conflict"
