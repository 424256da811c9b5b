"""Connected components of cases that share a scenario, paraphrase or contrast group."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join

RELATIONS = ["scenario_id", "paraphrase_id", "contrast_id"]


def star_edges(cases: DataFrame, relations: list[str]) -> DataFrame:
    """Each case tied to the smallest case of each of its groups: one edge per membership, however large the group."""
    edges = None
    for relation in relations:
        least = cases.groupBy(relation).agg(F.min("case_id").alias("v"))
        tied = (
            skew_join(cases.select("case_id", relation), least, [relation])
            .filter("case_id <> v")
            .select(F.col("case_id").alias("u"), "v")
        )
        edges = tied if edges is None else edges.unionByName(tied)
    return edges.distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return skew_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, moves to the smallest one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = skew_join(edges, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node points to two others, or to one that points on. A further round would change nothing."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    nodes = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.filter("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(cases: DataFrame, relations: list[str] = RELATIONS, max_rounds: int = 60) -> DataFrame:
    """(case_id, component): the smallest case id that can be reached.

    Alternating large- and small-star steps; every step is a grouped minimum and a join with it that a hot node can be
    split in. The rounds grow slowly with the longest chain, and each is written before the next one starts.
    """
    nodes = cases.select("case_id", *relations)
    edges = cut(star_edges(nodes, relations))
    for _ in range(max_rounds):
        if _settled(edges):
            break
        edges = cut(_small_star(_large_star(edges)))
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("case_id"), F.col("v").alias("component"))
    return cases.select("case_id").join(roots, "case_id", "left").withColumn(
        "component", F.coalesce("component", "case_id")
    )


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count("*").alias("size"))


def relationship_audit(cases: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row of distinct families, components, the largest one, and pair counts."""
    facts = cases.agg(
        F.count_distinct("scenario_id").alias("scenario_families"),
        F.count_distinct("contrast_id").alias("contrast_groups"),
        F.count_distinct("paraphrase_id").alias("paraphrase_clusters"),
        F.sum(F.when(F.array_contains("tags", "near_oos"), 1).otherwise(0)).alias("near_oos_pairs"),
        F.sum(F.when(F.array_contains("tags", "context_control"), 1).otherwise(0)).alias("context_pairs"),
    )
    sizes = component_sizes(labelled).agg(F.count("*").alias("components"), F.max("size").alias("largest_component"))
    return facts.select(
        "*",
        sizes.select("components").scalar().alias("components"),
        sizes.select("largest_component").scalar().alias("largest_component"),
    )
