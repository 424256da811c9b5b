"""Lexical open-set routing by registered patterns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(patterns: list[str], text: Column) -> Column:
    """One alternation per gate, so each text is read once per gate inside the JVM."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def lexical_router(contexts: DataFrame, rules: dict, text: str = "context_json", current: str = "decision_text") -> DataFrame:
    """Gates in order: no current action, outside the catalog, unresolved choice, single activity; else no action.

    ``rules``: no_intent, oos, ambiguity and future pattern lists, and in_scope as intent -> pattern list.
    """
    body = F.col(text)
    gates = contexts.withColumns(
        {
            "_quiet": matches(rules["no_intent"], body),
            "_oos": matches(rules["oos"], body),
            "_unsure": matches(rules["ambiguity"], body),
            "_hits": F.array_compact(
                F.array(*[F.when(matches(rules["in_scope"][i], body), i) for i in sorted(rules["in_scope"])])
            ),
            "horizon": F.when(matches(rules["future"], F.col(current)), "later").otherwise("now"),
        }
    )
    count = F.size("_hits")
    outside = F.col("_oos") & ~F.col("_unsure")
    none = F.array().cast("array<string>")
    decision = (
        F.when(F.col("_quiet"), "no_intent")
        .when(outside, "oos")
        .when(F.col("_unsure") | (count > 1), "ambiguous")
        .when(count == 1, "in_scope")
        .when(F.col("_oos"), "oos")
        .otherwise("no_intent")
    )
    routed = gates.withColumn("decision", decision)
    return routed.withColumns(
        {
            "predicted_intent": F.when(F.col("decision") == "in_scope", F.col("_hits")[0]),
            "candidate_intents": F.when((F.col("decision") == "ambiguous") & (count >= 2), F.col("_hits")).otherwise(none),
        }
    ).drop("_quiet", "_oos", "_unsure", "_hits")
