"""What the operators of this subpackage share: registration, texts and words."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import checkpoint_folder

QUERIES = {}
ORACLES = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word between ASCII blanks, as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only. ``lower`` is far cheaper and the same on texts without other letters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart by id and text, nulls included; rows that repeat both share it, and share decisions."""
    return F.concat_ws(
        ":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.coalesce(F.crc32(text), F.lit(-1))
    )


#: Rows of keys that are broadcast at most.
SMALL = 400_000


def if_small(keys: DataFrame) -> DataFrame:
    """Marks ``keys`` for broadcast where a count shows that they are few; else texts are shuffled to them."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder of the session."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
