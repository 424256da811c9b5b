"""Requests and responses: prompts, identities, lookups, normalised outcomes and accounting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions.skew import skew_join
from plumbline.operators.quality import violation

# The fields of a request's identity, in the order of its canonical JSON.
IDENTITY = [
    "adapter",
    "adapter_revision",
    "few_shot_payload_sha256",
    "generation_parameters_sha256",
    "max_output_tokens",
    "model",
    "normalized_context_sha256",
    "prompt_instance_sha256",
    "prompt_template_sha256",
    "response_schema_sha256",
    "schema_version",
    "structured_output_mode",
    "taxonomy_sha256",
]


#: The forms of a few shot: what a request shows of a case, and what it should answer. ``routing`` is that of one call; a case that is routed
#: in two goes through ``stage_a``, which forms the intention from the context, and ``stage_b``, which routes it without the context.
FORMS = {"routing": ("context", "routed"), "stage_a": ("context", "formed"), "stage_b": ("formed", "routed")}


def few_shot_lines(shots: DataFrame, form: str = "routing") -> DataFrame:
    """The few shots (at most a dozen rows) as JSON lines in order, one value.

    ``shots`` has position, text, decision, target_intent, reason_short and the slots; for the two stages ``formed`` as well, a formed
    intention. Gold evidence, review fields and relations have no place in any form.
    """
    routed = F.struct(
        F.array().cast("array<string>").alias("candidate_intents"),
        "decision",
        F.col("target_intent").alias("predicted_intent"),
        "reason_short",
        F.struct("desired_experience", "horizon", F.col("object_slot").alias("object")).alias("slots"),
    )
    parts = {"context": F.struct(F.col("text").alias("state_summary")), "routed": routed}
    shown, answer = FORMS[form]
    if "formed" in (shown, answer):
        names = ["action", "alternative_actions", "desired_experience", "evidence_status", "horizon", "object", "qualifiers", "reason_short"]
        parts["formed"] = F.struct(*[F.col(f"formed.{n}").alias(n) for n in names])
    given = "context" if shown == "context" else "formed_intention"
    shot = F.to_json(F.struct(parts[shown].alias(given), parts[answer].alias("output")), {"ignoreNullFields": "false"})
    ordered = F.array_sort(F.collect_list(F.struct("position", shot.alias("line"))))
    return shots.agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("few_shots"))


def prompts(contexts: DataFrame, template: str, taxonomy_json: str, shots: DataFrame, context: str, form: str = "routing") -> DataFrame:
    """One rendered request per case, from its context alone (its formed intention in ``stage_b``)."""
    filled = F.replace(F.lit(template), F.lit("{{TAXONOMY_JSON}}"), F.lit(taxonomy_json))
    filled = F.replace(filled, F.lit("{{FEW_SHOTS_JSONL}}"), F.col("_shots"))
    return contexts.withColumn("_shots", few_shot_lines(shots, form).scalar()).withColumn(
        "prompt", F.replace(filled, F.lit("{{CONTEXT_JSON}}"), F.col(context))
    ).drop("_shots")


def request_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of the identity fields."""
    return F.sha2(F.to_json(F.struct(*[fields[name].alias(name) for name in IDENTITY])), 256)


def normalised_responses(
    responses: DataFrame, model: str, mode: str, usage_fields: list[str], local_contract: Column
) -> DataFrame:
    """What each stored response amounts to. ``local_contract`` is true where the value keeps its own rules."""
    c = F.col
    answered = c("value").isNotNull()
    identity = F.regexp_replace(F.coalesce("reported_model", F.lit("")), "^models/", "") != model
    wrong_mode = c("structured_output_mode") != mode
    wanted = F.array(*[F.lit(f) for f in usage_fields])
    lacking = F.size(F.array_except(wanted, F.coalesce("usage_fields", F.array().cast("array<string>")))) > 0
    broken = ~F.coalesce(local_contract, F.lit(False))
    status = (
        F.when(~answered & (c("error_type") == "schema_invalid"), "schema_invalid")
        .when(~answered, "provider_failure")
        .when(identity, "provider_failure")
        .when(wrong_mode, "schema_invalid")
        .when(lacking, "provider_failure")
        .when(broken, "schema_invalid")
        .otherwise("success")
    )
    error = (
        F.when(~answered, F.coalesce("error_type", F.lit("provider_failure")))
        .when(identity, "model_identity_mismatch")
        .when(wrong_mode, "structured_output_mode_mismatch")
        .when(lacking, "usage_contract_mismatch")
        .when(broken, "local_contract")
    )
    return responses.withColumns({"status": status, "normal_error": error})


def lookup(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each request with whether its key is stored."""
    stored = responses.groupBy("cache_key").agg(F.min("status").alias("stored_status"))
    return skew_join(requests, stored, ["cache_key"], "left").withColumn("cached", L.as_flag(F.col("stored_status").isNotNull()))


def misses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """What has to be asked, once per distinct key."""
    return requests.join(responses.select("cache_key"), "cache_key", "left_anti").groupBy("cache_key").agg(
        F.min("request_id").alias("first_request"), F.count("*").alias("requests")
    )


def offline_violations(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return violation(misses(requests, responses), "J11", "first_request", "required_response_absent")


def import_plan(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Records to append, records already there, and keys whose payloads differ."""
    known = stored.select("cache_key", F.col("payload").alias("stored_payload"))
    joined = incoming.join(known, "cache_key", "left")
    state = (
        F.when(F.col("stored_payload").isNull(), "append")
        .when(F.col("payload") == F.col("stored_payload"), "unchanged")
        .otherwise("conflict")
    )
    return joined.withColumn("state", state)


def request_accounting(looked_up: DataFrame) -> DataFrame:
    """The first request of an uncached key is a provider call, its repeats are hits."""
    keyed = looked_up.groupBy("arm", "cache_key").agg(
        F.count("*").alias("n"), F.max("cached").alias("cached"), F.sum(L.as_flag(F.col("stored_status") == "success")).alias("won")
    )
    return keyed.groupBy("arm").agg(
        F.sum("n").alias("cases"),
        F.sum("won").alias("successes"),
        F.sum(F.when(F.col("cached") == 1, F.col("n")).otherwise(F.col("n") - 1)).alias("cache_hits"),
        F.sum(1 - F.col("cached")).alias("provider_calls"),
    )
