"""Components, group-safe split, leakage check, statistics, audit sample and digest of a gold table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.operators import components as G
from plumbline.operators import quality as Q
from plumbline.operators import split as S
from plumbline.operators.evaluate import union
from plumbline.sources.publish import fingerprint


def freeze(gold: DataFrame, intents: list[str], split=S.choose_split) -> tuple[DataFrame, DataFrame]:
    """(cases with cluster and split, tall summary of the freeze); ``split`` gives group_id and split of the cases' groups."""
    found = G.components(gold)
    cases = gold.drop("cluster_id").join(found.withColumnRenamed("component", "cluster_id"), "case_id")
    chosen = split(cases, "cluster_id").select(F.col("group_id").alias("cluster_id"), "split")
    frozen = cut(cases.join(chosen, "cluster_id"))
    leaks = Q.split_leakage(frozen, found)
    sample = S.audit_sample(frozen.filter("split = 'test'"), intents, "audit-v1")
    digest = fingerprint(frozen.select("case_id", "decision", "target_intent", "cluster_id", "split"), ["split"])

    def tall(df, part, name, value):
        return df.select(F.lit(part).alias("part"), name.alias("name"), value.cast("string").alias("value"))

    statistics = S.split_statistics(frozen).withColumn(
        "name", F.concat_ws("/", "split", "dimension", "value")
    )
    return frozen, union(
        [
            tall(statistics, "cases", F.col("name"), F.col("cases")),
            tall(statistics, "clusters", F.col("name"), F.col("clusters")),
            tall(leaks.groupBy("rule").agg(F.count("*").alias("n")), "leaks", F.col("rule"), F.col("n")),
            tall(sample, "audit", F.col("case_id").cast("string"), F.col("phase")),
            tall(digest, "digest", F.col("split"), F.col("digest")),
        ]
    )
