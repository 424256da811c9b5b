"""Tokens, cost and latency: totals, distributions, attribution by stage, and gaps between arms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions.lineage import cut
from plumbline.functions.quantiles import exact_quantiles

TOKEN_FIELDS = ["input_tokens", "output_tokens", "retry_input_tokens", "retry_output_tokens", "total_tokens"]


def complete(column="total_tokens") -> Column:
    return F.bool_and(F.col(column).isNotNull())


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Sums of what is known, and a total that is null unless every call reported its usage."""
    summed = calls.groupBy(*by).agg(
        F.count("*").alias("calls"),
        complete().alias("_complete"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKEN_FIELDS],
    )
    return summed.select(
        *by,
        "calls",
        *TOKEN_FIELDS[:4],
        F.col("total_tokens").alias("known_tokens"),
        F.when(F.col("_complete"), F.col("total_tokens")).alias("total_tokens"),
        L.as_flag(F.col("_complete")).alias("usage_complete"),
    )


def latency_summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Exact P50 and P95, or null when any latency is missing."""
    known = predictions.groupBy(*by).agg(L.as_flag(complete("latency_ms")).alias("latency_complete"))
    q = exact_quantiles(predictions, by, "latency_ms", [0.5, 0.95], ["p50", "p95"])
    whole = F.col("latency_complete") == 1
    return known.join(q, by, "left").select(
        *by, "latency_complete", F.when(whole, F.col("p50")).alias("p50"), F.when(whole, F.col("p95")).alias("p95")
    )


def distribution(df: DataFrame, by: list[str], value: str, name: str, digits: int = 6) -> DataFrame:
    """Count, minimum, mean, P50, P95 and maximum; works for signed values too."""
    basic = df.groupBy(*by).agg(
        F.count(value).alias(f"{name}_count"),
        F.min(F.col(value).cast("double")).alias(f"{name}_min"),
        F.round(F.avg(value), digits).alias(f"{name}_mean"),
        F.max(F.col(value).cast("double")).alias(f"{name}_max"),
    )
    q = exact_quantiles(df, by, value, [0.5, 0.95], ["_p50", "_p95"])
    if by:
        both = basic.join(q, by, "left")
    else:
        both = basic.withColumn("_q", q.select(F.struct("_p50", "_p95").alias("q")).scalar()).select("*", "_q.*").drop("_q")
    rounded = {f"{name}_p50": F.round("_p50", digits), f"{name}_p95": F.round("_p95", digits)}
    return both.withColumns(rounded).drop("_p50", "_p95")


def distributions(df: DataFrame, by: list[str], values: dict[str, str], digits: int = 6) -> DataFrame:
    """A25 for several values of the same groups (name to column), whose quantiles are found together."""
    basic = []
    for name, value in values.items():
        basic += [
            F.count(value).alias(f"{name}_count"),
            F.min(F.col(value).cast("double")).alias(f"{name}_min"),
            F.round(F.avg(value), digits).alias(f"{name}_mean"),
            F.max(F.col(value).cast("double")).alias(f"{name}_max"),
        ]
    each = F.array(*[F.struct(F.lit(name).alias("_name"), F.col(value).cast("double").alias("_v")) for name, value in values.items()])
    found = exact_quantiles(df.select(*by, F.inline(each)), [*by, "_name"], "_v", [0.5, 0.95], ["p50", "p95"])
    wide = [F.round(F.max(F.when(F.col("_name") == name, F.col(q))), digits).alias(f"{name}_{q}") for name in values for q in ("p50", "p95")]
    return df.groupBy(*by).agg(*basic).join(found.groupBy(*by).agg(*wide), by, "left")


def priced(calls: DataFrame, pricing: DataFrame, model: str = "requested_model") -> DataFrame:
    """Calls with ``nano``, their cost in billionths of a dollar, retries included; null without a price or a known usage.

    ``pricing`` has one row for each model: ``input_nano`` and ``output_nano`` for a token. Whole numbers add up alike in any order.
    ``unpriced`` is 1 where the model has no price.
    """
    joined = calls.join(pricing.select(model, "input_nano", "output_nano"), model, "left")
    tokens_in = F.col("input_tokens") + F.coalesce("retry_input_tokens", F.lit(0))
    tokens_out = F.col("output_tokens") + F.coalesce("retry_output_tokens", F.lit(0))
    nano = tokens_in * F.col("input_nano") + tokens_out * F.col("output_nano")
    return joined.withColumns({"nano": nano, "unpriced": L.as_flag(F.col("input_nano").isNull())}).drop("input_nano", "output_nano")


def dollars(nano: Column) -> Column:
    return F.round(nano / F.lit(1e9), 9)


def _cost() -> list[Column]:
    """The sum of ``nano``, and how many calls it leaves out for want of a price."""
    return [F.sum("nano").alias("nano"), F.sum("unpriced").alias("unpriced")]


def _with_cost(df: DataFrame) -> DataFrame:
    """A cost in dollars that is null where any call has no price."""
    return df.withColumn("cost", F.when(F.col("unpriced") == 0, dollars(F.col("nano")))).drop("nano", "unpriced")


def _case_sums(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    return priced(calls, pricing).groupBy("arm", "case_id").agg(
        F.count("*").alias("calls"),
        *[F.sum(c).alias(c) for c in TOKEN_FIELDS],
        F.round(F.sum("latency_ms"), 6).alias("latency_ms"),
        *_cost(),
    )


def case_budgets(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Usage, cost and end-to-end latency of each case in each arm."""
    return _with_cost(_case_sums(calls, pricing))


def stage_summary(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Outcomes, totals and cost of each stage, and how tokens and latency spread over its calls."""
    won = F.sum(L.as_flag(F.col("status") == "success"))
    totals = priced(calls, pricing).groupBy("arm", "stage").agg(
        won.alias("success_count"),
        (F.count("*") - won).alias("failure_count"),
        *[F.sum(c).alias(c) for c in TOKEN_FIELDS],
        *_cost(),
    )
    spread = distributions(calls, ["arm", "stage"], {"tokens": "total_tokens", "latency": "latency_ms"})
    return _with_cost(totals).join(spread, ["arm", "stage"])


def arm_summary(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Totals of calls beside distributions over cases. A call is incremental in the first arm that has its key."""
    cases = cut(_case_sums(calls, pricing))
    won = F.sum(L.as_flag(F.col("status") == "success"))
    per_call = calls.groupBy("arm").agg(won.alias("success_calls"), (F.count("*") - won).alias("failed_calls"))
    incremental = (
        calls.groupBy("cache_key").agg(F.min("arm").alias("arm")).groupBy("arm").agg(F.count("*").alias("incremental_calls"))
    )
    per_case = _with_cost(cases.groupBy("arm").agg(*[F.sum(c).alias(c) for c in TOKEN_FIELDS], *_cost()))
    return (
        per_case.join(distributions(cases, ["arm"], {"case_tokens": "total_tokens", "case_latency": "latency_ms"}), "arm")
        .join(per_call, "arm")
        .join(incremental, "arm", "left")
        .fillna(0, ["incremental_calls"])
    )


def stage_gaps(calls: DataFrame, left: str, right: str, pricing: DataFrame) -> DataFrame:
    """Right minus left, by position of the call."""
    def gap(column):
        side = lambda arm: F.sum(F.when(F.col("arm") == arm, F.col(column)).otherwise(0))
        return (side(right) - side(left)).alias(column)

    return _with_cost(
        priced(calls.filter(F.col("arm").isin(left, right)), pricing).groupBy("call_index").agg(
            *[gap(c) for c in [*TOKEN_FIELDS, "nano"]], F.sum("unpriced").alias("unpriced")
        )
    )


def latency_gap(calls: DataFrame, left: str, right: str) -> DataFrame:
    """Signed distribution of the latency difference of cases that both arms have."""
    side = lambda arm: F.sum(F.when(F.col("arm") == arm, F.col("latency_ms")))
    paired = calls.filter(F.col("arm").isin(left, right)).groupBy("case_id").agg(
        F.round(side(right) - side(left), 6).alias("gap")
    )
    return distribution(paired.filter("gap IS NOT NULL"), [], "gap", "gap")


def fairness(totals: DataFrame, maximum: float) -> DataFrame:
    """A30 over rows with left/right totals and a usage_complete flag (1 or 0)."""
    a, b = F.col("left_tokens"), F.col("right_tokens")
    rate = F.abs(b - a) / F.greatest(a, F.lit(1))
    return totals.withColumn("rate", rate).withColumn(
        "status",
        F.when(F.col("usage_complete") == 0, "usage-incomplete")
        .when(F.col("rate") > maximum, "budget-confounded")
        .otherwise("valid"),
    )


def cap_pressure(calls: DataFrame, cap: int) -> DataFrame:
    """Calls that broke off as incomplete, and those of them whose output came within one token of the cap."""
    cut_off = F.coalesce(F.col("error_type") == "incomplete", F.lit(False))
    near = cut_off & F.coalesce(F.col("output_tokens") >= cap - 1, F.lit(False))
    return calls.groupBy("arm").agg(
        F.sum(L.as_flag(cut_off)).alias("incomplete_calls"), F.sum(L.as_flag(near)).alias("within_one_of_cap")
    )


def merged_predictions(calls: DataFrame) -> DataFrame:
    """The two calls of a case as one prediction.

    Each usage field is known only if every call's usage is. A case that fails at its first call is a provider failure of ``stage_a``.
    The identity of the response is a digest of the calls' own, in order; a call without a response goes by its contract and error.
    """
    failed = F.col("status") != "success"
    own = F.coalesce("raw_response_sha256", F.concat_ws(":", "call_contract_sha256", "error_type"))
    at = lambda index: F.max(F.when(F.col("call_index") == index, own))
    merged = calls.groupBy("arm", "case_id").agg(
        F.count("*").alias("calls"),
        complete().alias("_complete"),
        *[F.sum(c).alias(f"_{c}") for c in TOKEN_FIELDS],
        F.round(F.sum("latency_ms"), 6).alias("latency_ms"),
        F.min_by(F.struct("call_index", "status", "error_type"), F.when(failed, F.col("call_index"))).alias("_bad"),
        F.array_compact(F.array(at(1), at(2))).alias("_ids"),
    )
    first = F.col("_bad.call_index") == 1
    error = F.when(first, F.concat(F.lit("stage_a:"), "_bad.error_type")).otherwise(F.col("_bad.error_type"))
    return merged.select(
        "arm",
        "case_id",
        "calls",
        F.when(F.col("_bad").isNull(), "success").when(first, "provider_failure").otherwise(F.col("_bad.status")).alias("status"),
        F.when(F.col("_bad").isNotNull(), error).alias("error_type"),
        *[F.when(F.col("_complete"), F.col(f"_{c}")).alias(c) for c in TOKEN_FIELDS],
        "latency_ms",
        F.sha2(F.to_json("_ids"), 256).alias("raw_response_sha256"),
    )


def run_deltas(runs: DataFrame, role: str, reference: str, fields: list[str]) -> DataFrame:
    """Each run of a role beside the reference role's run of the same arm."""
    base = runs.filter(F.col("role") == reference).select("arm", *[F.col(f).alias(f"reference_{f}") for f in fields])
    return runs.filter(F.col("role") == role).join(base, "arm").select(
        "arm", *fields, *[(F.col(f) - F.col(f"reference_{f}")).alias(f"{f}_delta") for f in fields]
    )
