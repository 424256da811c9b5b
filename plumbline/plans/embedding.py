"""The embedding baseline from prototypes to evaluated predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions import labels as L
from plumbline.operators import evaluate as E
from plumbline.operators import prototype as P
from plumbline.schemas import DECISIONS


def prototype_vectors(activity: DataFrame, development: DataFrame, strata: list[str], maximum: int) -> DataFrame:
    """Canonical examples of the activities, and selected development cases for the two rejection labels."""
    rejected = development.filter(F.col("decision").isin("oos", "no_intent"))
    picked = P.stratified_round_robin(rejected, strata, maximum)
    return activity.select(F.col("target_intent").alias("proto"), "embedding").unionByName(
        picked.select(F.col("decision").alias("proto"), "embedding")
    )


def embedding_baseline(
    activity: DataFrame, development: DataFrame, test: DataFrame, strata: list[str], maximum: int, grid: dict
) -> tuple[DataFrame, DataFrame]:
    """(test predictions, chosen thresholds). Thresholds come from development rows only."""
    centers = cut(P.centroids(prototype_vectors(activity, development, strata, maximum), "proto"))
    chosen = cut(P.best_point(P.grid_scores(P.scores(development, centers, "proto"), grid)))
    return P.route(P.scores(test, centers, "proto"), chosen), chosen


def embedding_report(predictions: DataFrame, chosen: DataFrame) -> DataFrame:
    rows = predictions.withColumns(
        {"arm": F.lit("embedding"), "status": F.lit("success"), "pred_decision": F.col("p_decision")}
    ).withColumn("hit", L.exact_match())
    counts = rows.groupBy("arm", "decision", "pred_decision").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    hem = E.hit_rate(counts, ["arm"]).select(
        F.inline(
            F.array(
                F.struct(F.lit("cases").alias("metric"), F.col("n").cast("double").alias("value")),
                F.struct(F.lit("hem").alias("metric"), F.col("hem").alias("value")),
            )
        )
    )
    f1 = E.macro_f1(E.label_counts(counts, ["arm"], "decision", "pred_decision", DECISIONS), ["arm"], "value").select(
        F.lit("decision_macro_f1").alias("metric"), "value"
    )
    taus = chosen.select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("metric"), F.col(a).alias("value")) for a in P.AXES]))
    )
    return E.union([hem, f1, taus]).withColumn("value", F.round("value", 9))
