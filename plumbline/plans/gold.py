"""Reviewed drafts to gold: join, final labels, truth table, counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.operators import quality as Q
from plumbline.operators import review as R


def materialised(drafts: DataFrame, reviews: DataFrame, resolutions: DataFrame, policies: DataFrame) -> DataFrame:
    return R.final_labels(R.lineage_join(drafts, reviews, resolutions, policies))


def materialise_gold(drafts: DataFrame, reviews: DataFrame, resolutions: DataFrame, policies: DataFrame) -> DataFrame:
    """Counts of the gold rows by source and decision, of what could not be labelled, and of broken labels."""
    labelled = cut(materialised(drafts, reviews, resolutions, policies))
    gold = labelled.filter("label_source IS NOT NULL").withColumns(
        {"case_id": F.col("item_id"), "siblings": F.array().cast("array<string>")}
    )
    broken = Q.gold_truth_table(gold)

    def counted(df, kind, name, value):
        return df.select(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value")).groupBy(
            "kind", "name", "value"
        ).agg(F.count("*").alias("n"))

    return (
        counted(gold, "gold", F.col("label_source"), F.col("decision"))
        .unionByName(counted(labelled.filter("problem IS NOT NULL"), "problem", F.col("problem"), F.lit("")))
        .unionByName(counted(broken, "violation", F.col("rule"), F.col("detail")))
    )
