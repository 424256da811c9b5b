"""Context pairs from seed texts, and W01/S12: blind review batches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import hashing as H


def shuffled(df: DataFrame, key: str, namespace: str) -> DataFrame:
    """Rank in hash order; another namespace is another order."""
    return H.hash_rank(df.withColumn("order_key", H.stable_key(namespace, key)), [], "order_key", key, "rank")


def review_batches(df: DataFrame, key: str, namespace: str, size: int) -> DataFrame:
    """Fixed-size batches of the shuffled items. Only what a blind reviewer may see should be selected from it."""
    return shuffled(df, key, namespace).withColumn("batch", F.floor((F.col("rank") - 1) / size) + 1)


def context_pairs(seeds: DataFrame, perturbations: list[tuple[str, str, str]], frames: list[str]) -> DataFrame:
    """A control and a distractor case per seed, alike but for a registered background change.

    ``seeds``: seed_id and text; perturbations are (id, state prefix, added activity). The variant and the dialogue
    frame follow the seed's number, and both cases share their relation ids.
    """
    number = H.number_rank(seeds, [], "seed_id", "number")
    entries = F.array(
        *[F.struct(F.lit(i).alias("id"), F.lit(p).alias("prefix"), F.lit(a).alias("activity")) for i, p, a in perturbations]
    )
    variant = F.get(entries, ((F.col("number") - 1) % len(perturbations)).cast("int"))
    frame = F.get(F.array(*[F.lit(f) for f in frames]), ((F.col("number") - 1) % len(frames)).cast("int"))
    pair = number.withColumns({"variant": variant, "frame": frame}).withColumn(
        "role", F.explode(F.array(F.lit("control"), F.lit("distractor")))
    )
    far = F.col("role") == "distractor"
    return pair.select(
        F.concat(F.lit("candidate-"), F.lpad((F.col("number") * 2 - F.when(far, 0).otherwise(1)).cast("string"), 9, "0")).alias("case_id"),
        "seed_id",
        "role",
        F.concat(F.when(far, F.col("variant.prefix")).otherwise(""), "text").alias("state_summary"),
        F.when(far, F.col("variant.activity")).alias("recent_activity"),
        F.col("frame").alias("dialogue"),
        F.concat(F.lit("context_"), "role").alias("tag"),
        F.col("variant.id").alias("perturbation"),
        F.concat(F.lit("pair-"), F.col("number").cast("string")).alias("contrast_id"),
    )
