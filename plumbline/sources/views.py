"""Evaluation tables derived from the driver's tables, in Spark and as SQL text."""

import functools
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.schemas import ACCEPT, CONFIRM, KEEP, REWRITE, RULE_CHANGE

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ARMS = ["A", "B", "C"]
#: Rows of a piece at most, on average, where little is read and much is made of each: files of keys are small for their rows.
PIECE_ROWS = {"orders": 250_000}
INTENTS = [f"intent_{i}" for i in range(5)]


def _spark_bucket(text, modulus):
    return f"(CAST(conv(substr(sha2({text},256),1,8),16,10) AS BIGINT) % {modulus})"


def _duck_bucket(text, modulus):
    return f"(CAST('0x' || substr(sha256({text}),1,8) AS BIGINT) % {modulus})"


def _str(x):
    return f"CAST({x} AS STRING)"


def _gold(b, arms):
    return f"""
SELECT case_id,
       CASE WHEN kind = 'near' THEN CASE WHEN case_id % 2 = 0 THEN 'in_scope' ELSE 'oos' END
            WHEN kind IN ('ctx_in', 'plain_in') THEN 'in_scope'
            WHEN kind IN ('far', 'ctx_oos') THEN 'oos'
            WHEN kind IN ('ctx_none', 'quiet') THEN 'no_intent'
            ELSE 'ambiguous' END AS decision,
       CASE WHEN kind IN ('ctx_in', 'plain_in') OR (kind = 'near' AND case_id % 2 = 0) THEN intent END AS target_intent,
       CASE WHEN kind = 'near' AND case_id % 2 = 1 THEN intent END AS sibling_intent,
       CASE WHEN kind = 'near' AND case_id % 2 = 1 THEN intent WHEN kind = 'ctx_none' THEN 'intent_0' END AS competitor,
       CASE {b("'h|' || " + _str("j"), 3)} WHEN 0 THEN 'now' WHEN 1 THEN 'later' ELSE 'unspecified' END AS horizon,
       CASE WHEN j % 5 <> 0 THEN 'calm' END AS desired_experience,
       CASE WHEN j % 7 = 0 THEN 'book' END AS object_slot,
       CASE WHEN j % 16 = 5 THEN 'idea' END AS open_intent,
       CASE WHEN kind LIKE 'ctx%' THEN intent END AS perturbation,
       'state ' || {_str("j")} AS base_state,
       CASE WHEN kind LIKE 'ctx%' AND case_id % 2 = 1 THEN 'then ' ELSE '' END || 'state ' || {_str("j")} AS state_summary,
       CASE WHEN kind LIKE 'ctx%' AND case_id % 2 = 1 THEN intent END AS recent_activity,
       'turn ' || {_str("j")} AS dialogue,
       kind AS pair_kind,
       CAST(floor(case_id / 4) AS BIGINT) AS scenario_id,
       j AS contrast_id,
       CASE WHEN case_id % 24 IN (3, 4) THEN -1 - CAST(floor(case_id / 24) AS BIGINT) ELSE case_id END AS paraphrase_id,
       CASE WHEN case_id % 24 < 8 THEN case_id - case_id % 24 ELSE case_id - case_id % 4 END AS cluster_id
FROM (SELECT o_orderkey AS case_id, j, 'intent_' || {_str(b("'t|' || " + _str("j"), 5))} AS intent,
             CASE WHEN j % 20 < 8 THEN 'ctx_in' WHEN j % 20 < 10 THEN 'plain_in' WHEN j % 20 < 13 THEN 'near'
                  WHEN j % 20 < 15 THEN 'far' WHEN j % 20 = 15 THEN 'ctx_oos' WHEN j % 20 = 16 THEN 'ctx_none'
                  WHEN j % 20 = 17 THEN 'quiet' WHEN j % 20 = 18 THEN 'ctx_amb' ELSE 'amb' END AS kind
      FROM (SELECT o_orderkey, CAST(floor(o_orderkey / 2) AS BIGINT) AS j FROM {{orders}}) a) b"""


def _tags(b, arms):
    return """
SELECT case_id, 'near_oos' AS tag FROM {gold} WHERE sibling_intent IS NOT NULL
UNION ALL SELECT case_id, 'hard_negative' FROM {gold} WHERE sibling_intent IS NOT NULL OR pair_kind = 'ctx_none'
UNION ALL SELECT case_id, 'far_oos' FROM {gold} WHERE pair_kind IN ('far', 'ctx_oos')
UNION ALL SELECT case_id, 'context_control' FROM {gold} WHERE pair_kind LIKE 'ctx%' AND case_id % 2 = 0
UNION ALL SELECT case_id, 'context_distractor' FROM {gold} WHERE pair_kind LIKE 'ctx%' AND case_id % 2 = 1
UNION ALL SELECT case_id, 'quiet_control' FROM {gold} WHERE decision = 'no_intent'
UNION ALL SELECT case_id, 'slot_required' FROM {gold} WHERE decision = 'in_scope'
UNION ALL SELECT case_id, 'single_turn' FROM {gold} WHERE case_id % 3 <> 0
UNION ALL SELECT case_id, 'multi_turn' FROM {gold} WHERE case_id % 3 = 0"""


def _predictions(b, arms):
    return f"""
SELECT arm, case_id, status, decision, predicted_intent, horizon, desired_experience, object_slot,
       CASE WHEN status <> 'success' THEN NULL
            WHEN decision = 'ambiguous' AND b % 2 = 0 THEN 'intent_0|intent_1' ELSE '' END AS candidates,
       CASE WHEN status = 'success' THEN 'ok' END AS reason_short,
       CASE WHEN status <> 'success' THEN status END AS error_type,
       latency_ms,
       CASE WHEN b <> 1 THEN 100 + case_id % 50 END AS input_tokens,
       CASE WHEN b <> 1 THEN 20 + b % 17 END AS output_tokens,
       CASE WHEN b <> 1 THEN b % 3 END AS retry_input_tokens,
       CASE WHEN b <> 1 THEN b % 2 END AS retry_output_tokens,
       CASE WHEN b <> 1 THEN 120 + case_id % 50 + b % 17 + b % 3 + b % 2 END AS total_tokens
FROM (
SELECT arm, case_id, b,
       CASE WHEN b = 1 THEN 'provider_failure' WHEN b = 2 THEN 'schema_invalid' ELSE 'success' END AS status,
       CASE WHEN b < 3 THEN NULL WHEN b >= thr THEN decision
            WHEN decision = 'in_scope' THEN CASE WHEN b % 3 = 0 THEN 'in_scope' WHEN b % 3 = 1 THEN 'oos' ELSE 'ambiguous' END
            WHEN b % 2 = 0 THEN 'in_scope'
            WHEN decision = 'oos' THEN 'no_intent' ELSE 'oos' END AS decision,
       CASE WHEN b < 3 THEN NULL
            WHEN decision = 'in_scope' AND b >= thr THEN target_intent
            WHEN decision = 'in_scope' AND b % 3 = 0 THEN 'intent_' || {_str(b("'w|' || " + _str("case_id"), 5))}
            WHEN decision <> 'in_scope' AND b < thr AND b % 2 = 0 THEN coalesce(sibling_intent, 'intent_0') END AS predicted_intent,
       CASE WHEN b < 3 THEN NULL WHEN b % 10 = 3 THEN 'now' ELSE horizon END AS horizon,
       CASE WHEN b >= 3 AND b % 10 <> 4 THEN desired_experience END AS desired_experience,
       CASE WHEN b >= 3 AND b % 10 <> 5 THEN object_slot END AS object_slot,
       CAST(200 + b * 7 + case_id % 13 AS DOUBLE) AS latency_ms
FROM (SELECT g.*, a.arm, a.thr, {b("a.arm || '|' || " + _str("case_id"), 100)} AS b
      FROM {{gold}} g {arms}) x
WHERE b > 0) y"""


def _calls(b, arms):
    return """
SELECT event_id, user_id AS case_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'B' ELSE 'C' END AS arm,
       event_type AS stage,
       CAST(row_number() OVER (PARTITION BY user_id, CASE WHEN event_type IN ('click', 'view') THEN 'B' ELSE 'C' END
                          ORDER BY ts, event_id) AS BIGINT) AS call_index,
       CASE WHEN event_type = 'error' THEN 'provider_failure' ELSE 'success' END AS status,
       CASE WHEN event_id % 97 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 10 END AS input_tokens,
       CASE WHEN event_id % 97 <> 0 THEN CAST(floor(value) AS BIGINT) END AS output_tokens,
       CASE WHEN event_id % 97 <> 0 THEN event_id % 4 END AS retry_input_tokens,
       CASE WHEN event_id % 97 <> 0 THEN event_id % 2 END AS retry_output_tokens,
       CASE WHEN event_id % 97 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 10
            + CAST(floor(value) AS BIGINT) + event_id % 4 + event_id % 2 END AS total_tokens,
       value AS latency_ms,
       CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'incomplete' END END AS error_type,
       'key-' || CAST(event_id AS STRING) AS cache_key,
       'contract-' || CAST(user_id AS STRING) AS call_contract_sha256,
       'model-' || CAST(user_id % 25 AS STRING) AS requested_model,
       CASE WHEN event_type <> 'error' THEN 'model-' || CAST(user_id % 25 AS STRING) END AS reported_model,
       CASE WHEN event_type <> 'error' THEN 'raw-' || CAST(event_id AS STRING) END AS raw_response_sha256,
       CASE WHEN event_id % 10 = 0 THEN 'validated_contract_migration' ELSE 'provider_call' END AS cache_origin,
       CASE WHEN event_id % 10 = 0 THEN 'source-' || CAST(event_id AS STRING) END AS source_cache_key
FROM {events}"""


def _pricing(b, arms):
    """Whole billionths of a dollar for a token, by model."""
    return """
SELECT 'model-' || CAST(n_nationkey AS STRING) AS requested_model,
       CAST(100 + n_nationkey * 17 AS BIGINT) AS input_nano, CAST(1000 + n_regionkey * 750 + n_nationkey AS BIGINT) AS output_nano
FROM {nation}"""


def _reviews(b, arms):
    return f"""
SELECT item_id, human_label, human_flag, draft_label, draft_flag,
       CASE {b("'hh|' || " + _str("item_id"), 3)} WHEN 0 THEN 'now' WHEN 1 THEN 'later' ELSE 'unspecified' END AS human_horizon,
       CASE {b("'hh|' || " + _str("item_id"), 3)} WHEN 0 THEN 'now' WHEN 1 THEN 'later'
            ELSE CASE WHEN item_id % 7 = 0 THEN 'later' ELSE 'unspecified' END END AS draft_horizon,
       CASE WHEN human_label = 1 THEN 'in_scope' WHEN human_flag = 1 THEN 'oos' ELSE 'no_intent' END AS human_decision,
       CASE WHEN human_label = 1 THEN 'intent_' || {_str("human_flag")} END AS human_target,
       CASE WHEN draft_label = 1 THEN 'in_scope' WHEN draft_flag = 1 THEN 'oos' ELSE 'no_intent' END AS draft_decision,
       CASE WHEN draft_label = 1 THEN 'intent_' || {_str("draft_flag")} END AS draft_target,
       'quote ' || {_str("item_id")} AS human_quote,
       'quote ' || {_str("item_id")} || CASE WHEN {b("'q|' || " + _str("item_id"), 6)} = 0 THEN '!' ELSE '' END AS draft_quote,
       CASE WHEN item_id % 4 <> 0 THEN 'calm' END AS human_experience,
       CASE WHEN item_id % 5 <> 0 THEN 'calm' END AS draft_experience,
       CASE WHEN item_id % 2 = 0 THEN 'book' END AS human_object,
       CASE WHEN item_id % 2 = 0 THEN CASE WHEN item_id % 7 = 0 THEN 'film' ELSE 'book' END END AS draft_object,
       CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS near_oos
FROM (SELECT doc_id AS item_id, quality AS human_label, toxic AS human_flag,
             CASE WHEN {b("'d|' || " + _str("doc_id"), 10)} < 8 THEN quality ELSE 1 - quality END AS draft_label,
             CASE WHEN {b("'f|' || " + _str("doc_id"), 10)} < 9 THEN toxic ELSE 1 - toxic END AS draft_flag
      FROM {{labels}}) r"""


def _vectors(b, arms):
    return """
SELECT vec_id, label,
       CASE WHEN label = 8 THEN 'oos' WHEN label = 9 THEN 'no_intent' ELSE 'in_scope' END AS decision,
       CASE WHEN label < 8 THEN 'intent_' || CAST(label AS STRING) END AS target_intent,
       CASE vec_id % 3 WHEN 0 THEN 'prototype' WHEN 1 THEN 'dev' ELSE 'test' END AS part,
       embedding
FROM {embeddings}"""


def _gp(b, arms):
    """SQL side only: gold x arms with labels, for the oracles."""
    return f"""
SELECT a.arm, g.*, p.status, p.decision AS p_decision, p.predicted_intent AS p_intent, p.horizon AS p_horizon,
       p.desired_experience AS p_experience, p.object_slot AS p_object, p.candidates, p.latency_ms,
       p.input_tokens, p.output_tokens, p.total_tokens,
       CASE WHEN p.status = 'success' THEN p.decision ELSE 'invalid' END AS pred_decision,
       CASE WHEN p.status = 'success' AND p.decision = 'in_scope' AND p.predicted_intent IS NOT NULL
            THEN p.predicted_intent ELSE 'invalid' END AS pred_intent,
       CASE WHEN p.status = 'success' AND p.decision = g.decision
                 AND (g.decision <> 'in_scope' OR p.predicted_intent = g.target_intent) THEN 1 ELSE 0 END AS hit
FROM {{gold}} g {arms}
LEFT JOIN {{predictions}} p ON p.arm = a.arm AND p.case_id = g.case_id"""


def _resolutions(b, arms):
    """One resolution per hierarchical disagreement, and for a sample of the agreements."""
    act = b("'act|' || " + _str("item_id"), 10)
    human = f"action IN ('{CONFIRM}', '{ACCEPT}')"
    return f"""
SELECT item_id, action, recommendation, near_oos, same,
       CASE WHEN {human} THEN human_decision WHEN action = '{KEEP}' THEN draft_decision
            WHEN action = '{RULE_CHANGE}' THEN 'oos' END AS final_decision,
       CASE WHEN {human} THEN human_target WHEN action = '{KEEP}' THEN draft_target END AS final_target,
       CASE WHEN {human} THEN human_horizon WHEN action = '{KEEP}' THEN draft_horizon
            WHEN action = '{RULE_CHANGE}' THEN 'now' END AS final_horizon,
       CASE WHEN action = '{RULE_CHANGE}' THEN 'note' END AS note
FROM (SELECT r.*,
        CASE WHEN same = 1 THEN '{CONFIRM}' WHEN {act} < 5 THEN '{ACCEPT}' WHEN {act} < 8 THEN '{KEEP}'
             WHEN {act} < 9 THEN '{REWRITE}' ELSE '{RULE_CHANGE}' END AS action,
        CASE WHEN same = 1 THEN 'confirm_agreement'
             WHEN near_oos = 1 THEN 'grounding_evidence_required'
             WHEN human_decision = draft_decision THEN 'likely_reviewer_input_error'
             ELSE 'current_rule_lean_keep_draft' END AS recommendation
      FROM (SELECT v.*, CASE WHEN human_decision = draft_decision AND (draft_decision <> 'in_scope' OR human_target = draft_target)
                             THEN 1 ELSE 0 END AS same FROM {{reviews}} v) r
      WHERE same = 0 OR {b("'smp|' || " + _str("item_id"), 11)} = 0) x"""


_BUILDERS = {
    "gold": (_gold, []),
    "tags": (_tags, ["gold"]),
    "predictions": (_predictions, ["gold"]),
    "gp": (_gp, ["gold", "predictions"]),
    "calls": (_calls, []),
    "pricing": (_pricing, []),
    "reviews": (_reviews, []),
    "resolutions": (_resolutions, ["reviews"]),
    "vectors": (_vectors, []),
}
_SPARK_ARMS = (
    "LATERAL VIEW inline(array(named_struct('arm','A','thr',12), named_struct('arm','B','thr',20), "
    "named_struct('arm','C','thr',35))) a AS arm, thr"
)
_DUCK_ARMS = "CROSS JOIN (VALUES ('A', 12), ('B', 20), ('C', 35)) a(arm, thr)"


def duck_bucket(text: str, modulus: int) -> str:
    return _duck_bucket(text, modulus)


def _names(text):
    return {name: name for name in re.findall(r"\{(\w+)\}", text)}


def with_views(uses: list[str], sql: str) -> str:
    """SQL with the named views (and what they read) in front as common table expressions."""
    order = []

    def visit(name):
        for dependency in _BUILDERS[name][1]:
            visit(dependency)
        if name not in order:
            order.append(name)

    for name in uses:
        visit(name)
    parts = []
    for name in order:
        text = _BUILDERS[name][0](_duck_bucket, _DUCK_ARMS)
        parts.append(f"{name} AS ({text.format(**_names(text))})")
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _one_or_none(rule: Column, value: Column) -> Column:
    """An array of the value where the rule holds. ``array_compact`` is a lambda: filters and projections with one are not compiled whole."""
    return F.when(rule, F.array(value)).otherwise(F.array().cast("array<string>"))


class Tables:
    """Lazy access to the given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def _spread(self, name: str) -> DataFrame:
        """A table in fewer pieces than there are cores, or than its rows need, is dealt out before its columns are derived; others are not."""
        df = self.base(name)
        pieces = self.spark.sparkContext.defaultParallelism
        if name in PIECE_ROWS:
            pieces = max(pieces, -(-df.count() // PIECE_ROWS[name]))
        return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df

    def _view(self, name: str) -> DataFrame:
        text = _BUILDERS[name][0](_spark_bucket, _SPARK_ARMS)
        inputs = {n: self._spread(n) if n in BASE else self._cases if n == "gold" else getattr(self, n) for n in _names(text)}
        return self.spark.sql(text, **inputs)

    @functools.cached_property
    def _cases(self) -> DataFrame:
        return self._view("gold")

    @functools.cached_property
    def gold(self) -> DataFrame:
        """Cases with tags, competitors and siblings as arrays."""
        kind, even = F.col("pair_kind"), F.col("case_id") % 2 == 0
        rules = [
            ("near_oos", F.col("sibling_intent").isNotNull()),
            ("hard_negative", F.col("competitor").isNotNull()),
            ("far_oos", kind.isin("far", "ctx_oos")),
            ("context_control", kind.startswith("ctx") & even),
            ("context_distractor", kind.startswith("ctx") & ~even),
            ("quiet_control", F.col("decision") == "no_intent"),
            ("slot_required", F.col("decision") == "in_scope"),
            ("single_turn", F.col("case_id") % 3 != 0),
            ("multi_turn", F.col("case_id") % 3 == 0),
        ]
        lists = F.struct(
            F.concat(*[_one_or_none(rule, F.lit(tag)) for tag, rule in rules]).alias("tags"),
            _one_or_none(F.col("competitor").isNotNull(), F.col("competitor")).alias("hard_negative_against"),
            _one_or_none(F.col("sibling_intent").isNotNull(), F.col("sibling_intent")).alias("siblings"),
        )
        # as a generator's output: filters of tags stay above it, where the lists are made already, in place of making them once more below
        return self._cases.select("*", F.inline(F.array(lists)))

    @functools.cached_property
    def predictions(self) -> DataFrame:
        listed = F.when(F.col("candidates") == "", F.array().cast("array<string>")).otherwise(
            F.split("candidates", "\\|")
        )
        return self._view("predictions").withColumn(
            "candidate_intents", F.when(F.col("candidates").isNotNull(), listed)
        )

    @functools.cached_property
    def calls(self) -> DataFrame:
        return self._view("calls")

    @functools.cached_property
    def reviews(self) -> DataFrame:
        return self._view("reviews")

    @functools.cached_property
    def pricing(self) -> DataFrame:
        return self._view("pricing")

    @functools.cached_property
    def resolutions(self) -> DataFrame:
        return self._view("resolutions")

    @functools.cached_property
    def vectors(self) -> DataFrame:
        return self._view("vectors").withColumn("embedding", F.col("embedding").cast("array<double>"))

    def __getattr__(self, name):
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)
