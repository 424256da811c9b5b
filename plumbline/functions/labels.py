"""Row-level labels: what was predicted, whether it was right, and which features a case has."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.schemas import INVALID


def ok(status="status") -> Column:
    """True only for a prediction that exists and succeeded."""
    return F.coalesce(F.col(status) == "success", F.lit(False))


def predicted_decision(status="status", decision="p_decision") -> Column:
    return F.when(ok(status), F.col(decision)).otherwise(INVALID)


def predicted_intent(status="status", decision="p_decision", intent="p_intent") -> Column:
    in_scope = ok(status) & (F.col(decision) == "in_scope") & F.col(intent).isNotNull()
    return F.when(in_scope, F.col(intent)).otherwise(INVALID)


def exact_match(status="status", decision="p_decision", intent="p_intent") -> Column:
    """1 when the decision is right and, for in-scope gold, the target too; 0 for anything missing or failed."""
    same = F.col("decision").eqNullSafe(F.col(decision))
    target = (F.col("decision") != "in_scope") | F.col("target_intent").eqNullSafe(F.col(intent))
    return F.when(ok(status) & same & target, 1).otherwise(0)


def as_flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def has_tag(tag: str) -> Column:
    return F.array_contains("tags", tag)


def feature_flags(tags: list[str]) -> dict[str, Column]:
    flags = {tag: as_flag(has_tag(tag)) for tag in tags}
    flags["open_intent_candidate"] = as_flag(F.col("open_intent").isNotNull())
    flags["horizon_later"] = as_flag(F.col("horizon") == "later")
    flags["horizon_unspecified"] = as_flag(F.col("horizon") == "unspecified")
    return flags


def audit_risk() -> Column:
    diagnostic = F.size(F.array_except(F.array_distinct("tags"), F.array(F.lit("single_turn"), F.lit("multi_turn"))))
    return (
        diagnostic
        + as_flag(F.col("desired_experience").isNotNull())
        + as_flag(F.col("object_slot").isNotNull())
        + 2 * as_flag(has_tag("multi_turn"))
        + 3 * as_flag(F.col("horizon") != "now")
        + 8 * as_flag(F.col("open_intent").isNotNull())
    ).cast("bigint")


def token_cost(input_rate, output_rate) -> Column:
    """Cost with retries, from rates per million tokens."""
    tokens_in = F.col("input_tokens") + F.coalesce("retry_input_tokens", F.lit(0))
    tokens_out = F.col("output_tokens") + F.coalesce("retry_output_tokens", F.lit(0))
    return (tokens_in * input_rate + tokens_out * output_rate) / F.lit(1000000)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))
