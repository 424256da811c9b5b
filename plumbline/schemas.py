"""Fixed label dimensions and the Spark types of the stored tables."""

from pyspark.sql import types as T

# Labels, tags and error names that results are reported under.
DECISIONS = ["in_scope", "oos", "no_intent", "ambiguous"]
INVALID = "invalid"
PREDICTED_DECISIONS = DECISIONS + [INVALID]
HORIZONS = ["now", "later", "unspecified"]
STATUSES = ["success", "provider_failure", "schema_invalid"]
SLICE_TAGS = [
    "single_turn",
    "multi_turn",
    "multi_turn_override",
    "multi_turn_recency",
    "multi_turn_resolution",
    "multi_turn_reconsideration",
    "near_oos",
    "far_oos",
    "hard_negative",
    "hypothesized_weak_model_probe",
    "context_distractor",
    "context_control",
    "brandless_xhs",
    "rest_eat_confusion",
    "slot_required",
    "quiet_control",
]
PATTERN_TAGS = [
    "multi_turn_override",
    "multi_turn_recency",
    "multi_turn_resolution",
    "multi_turn_reconsideration",
]
PROBE_TAGS = ["near_oos", "brandless_xhs", "rest_eat_confusion"]
ERROR_PRIORITY = [
    "missing_prediction",
    "provider_failure",
    "schema_invalid",
    "known_intent_false_reject",
    "oos_false_accept",
    "no_intent_overaction",
    "ambiguity_forced_choice",
    "decision_mismatch",
    "intent_misroute",
    "hard_negative_competitor_hit",
    "context_adverse_flip",
    "desired_experience_missing",
    "object_missing",
    "horizon_mismatch",
]
AUDIT_SAMPLE_TAGS = [
    "brandless_xhs",
    "rest_eat_confusion",
    "near_oos",
    "far_oos",
    "context_control",
    "context_distractor",
    "hard_negative",
    "quiet_control",
    "multi_turn",
    "single_turn",
    "slot_required",
]
# The stored names of adjudication actions.
CONFIRM = "确认一致标签"
ACCEPT = "接受人工标签"
KEEP = "保留草稿标签"
RULE_CHANGE = "修改分类规则"
REWRITE = "重写或删除样本"
MIN_CLUSTERS = 8
CONFIDENCE = 0.95


def _field(name, kind, nullable=True, **rules):
    """A stored field. ``rules`` say which values it may hold (see ``sources/scan.py``) and its ``default`` where it is absent."""
    return T.StructField(name, kind, nullable, rules)


def _text(name, nullable=True, **rules):
    return _field(name, T.StringType(), nullable, **rules)


def _texts(name, **rules):
    return _field(name, T.ArrayType(T.StringType()), **rules)


def _count(name, nullable=False, **rules):
    return _field(name, T.LongType(), nullable, least=0, **rules)


# The names of stored fields, the values they may hold, and the forms of identifiers and digests.
SPLITS = ["dev", "test"]
CASE_ID = r"^[a-z0-9][a-z0-9-]{2,79}\z"
DIGEST = r"^[0-9a-f]{64}\z"
REVIEW_ID = r"^review-(initial|blind-retest)-[0-9]{4}\z"
PACKET_ID = r"^adjudication-[0-9]{4}\z"
POLICY_ID = r"^policy-[0-9]{4}\z"
CANDIDATE_NAME = r"^[a-z][a-z0-9_]{2,63}\z"
#: A date and time with its zone.
MOMENT = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d(:\d\d(\.\d+)?)?([Zz]|[+-]\d\d:?\d\d)\z"
STAGES = ["call_1_one_stage", "call_2_verifier", "stage_a", "stage_b"]

SLOTS = T.StructType([_text("desired_experience"), _text("object"), _text("horizon", False, values=HORIZONS)])
TURN = T.StructType([_text("role", False, values=["user", "assistant"]), _text("content", False, shortest=1)])
CONTEXT = T.StructType(
    [
        _text("state_summary", False, shortest=1),
        _field("conversation", T.ArrayType(TURN), default=[]),
        _texts("recent_activities", default=[]),
    ]
)
PERTURBATION = T.StructType(
    [_text("id", False, pattern=CASE_ID), _text("state_summary_prefix", False, shortest=1), _texts("recent_activities_added", default=[])]
)
OPEN_CANDIDATE = T.StructType(
    [
        _text("name", False, pattern=CANDIDATE_NAME),
        _text("evidence_quote", False, shortest=1),
        _text("horizon", False, values=HORIZONS),
        _text("catalog_status", False, values=["not_in_catalog", "underspecified_for_catalog"]),
        _text("routing_effect", values=["none"], default="none"),
        _text("observability", values=["log_candidate"], default="log_candidate"),
    ]
)
PROVENANCE = T.StructType(
    [
        _text("review_item_id", False, pattern=REVIEW_ID),
        _text("reviewer_id", False, shortest=1),
        _text("reviewed_at", False, pattern=MOMENT),
        _text(
            "routing_label_source",
            False,
            values=["blind_human_review", "adjudicated_human", "adjudicated_draft", "policy_dual_channel_draft"],
        ),
        _text("supporting_fields_source", values=["llm_assisted_draft"], default="llm_assisted_draft"),
        _text("adjudication_packet_item_id", pattern=PACKET_ID),
        _text("adjudication_action", shortest=1),
        _text("adjudicator_id", shortest=1),
        _text("adjudicated_at", pattern=MOMENT),
        _text("policy_resolution_id", pattern=POLICY_ID),
    ]
)
LABEL = T.StructType(
    [
        _text("decision", False, values=DECISIONS),
        _text("target_intent"),
        _text("evidence_quote", False, shortest=1),
        _field("slots", SLOTS, False),
    ]
)
GOLD = T.StructType([*LABEL.fields[:3], _texts("near_oos_sibling_intents", default=[]), LABEL["slots"]])
USAGE = T.StructType(
    [
        _count("input_tokens"),
        _count("output_tokens"),
        _count("total_tokens"),
        _count("retry_input_tokens", True, default=0),
        _count("retry_output_tokens", True, default=0),
    ]
)
CASE = T.StructType(
    [
        _text("id", False, pattern=CASE_ID),
        _text("split", False, values=SPLITS),
        _field("context", CONTEXT, False),
        _field("gold", GOLD, False),
        _texts("tags", default=[]),
        _texts("hard_negative_against", default=[]),
        _field("context_perturbation", PERTURBATION),
        _text("scenario_family_id", False, shortest=1),
        _text("contrast_group_id", False, shortest=1),
        _text("paraphrase_cluster_id", False, shortest=1),
        _text("split_group_id"),
        _text("bootstrap_cluster_id"),
        _field("open_intent_candidate", OPEN_CANDIDATE),
        _field("review_provenance", PROVENANCE),
        _text("source", False, values=["human_authored", "llm_assisted_human_reviewed", "synthetic_fixture"]),
        _text("annotator_id", False, shortest=1),
        _text("adjudication_status", False, values=["draft", "reviewed", "adjudicated"]),
        _text("annotation_note", False, shortest=1),
    ]
)
PREDICTION = T.StructType(
    [
        _text("case_id", False, pattern=CASE_ID),
        _text("status", values=STATUSES, default="success"),
        _text("decision", values=DECISIONS),
        _text("predicted_intent"),
        _texts("candidate_intents"),
        _field("slots", SLOTS),
        _text("reason_short", shortest=1, longest=200),
        _text("error_type"),
        _field("latency_ms", T.DoubleType(), least=0),
        _field("usage", USAGE),
        _text("raw_response_sha256", pattern=DIGEST),
    ]
)
CALL = T.StructType(
    [
        _field("schema_version", T.IntegerType(), values=[1], default=1),
        _text("case_id", False),
        _text("arm", False, values=["B2b", "B3"]),
        _text("stage", False, values=STAGES),
        _field("call_index", T.IntegerType(), False, values=[1, 2]),
        _text("cache_key", False, pattern=DIGEST),
        _text("call_contract_sha256", False, pattern=DIGEST),
        _text("requested_model", False),
        _text("reported_model"),
        _text("status", False, values=STATUSES),
        _field("usage", USAGE),
        _field("latency_ms", T.DoubleType(), False, least=0),
        _text("raw_response_sha256", pattern=DIGEST),
        _text("error_type"),
        _text("cache_origin", False, values=["provider_call", "validated_contract_migration"]),
        _text("source_cache_key", pattern=DIGEST),
        _field("one_stage_cache_compatible", T.BooleanType(), default=False),
    ]
)
REVIEW = T.StructType(
    [
        _field("schema_version", T.IntegerType(), values=[1], default=1),
        _text("review_item_id", False, pattern=REVIEW_ID),
        _text("review_pass", False, values=["initial", "blind_retest"]),
        _text("reviewer_id", shortest=1),
        _text("reviewed_at", pattern=MOMENT),
        _field("label", LABEL),
        _text("review_note", shortest=1),
    ]
)
# The names, values and forms of the fields of drafts, packet items, resolutions and formed intentions.
DRAFT_ID = r"^draft-[a-z0-9-]{3,73}\z"
REVIEWED = "llm_assisted_human_reviewed"
ACTIONS = [CONFIRM, ACCEPT, KEEP, RULE_CHANGE, REWRITE]
DRAFT = T.StructType(
    [
        _text("id", False, pattern=DRAFT_ID),
        *[CASE[name] for name in ["context", "gold", "tags", "hard_negative_against", "context_perturbation"]],
        *[CASE[name] for name in ["scenario_family_id", "contrast_group_id", "paraphrase_cluster_id"]],
        _text("source", False, values=["human_authored", "llm_assisted_pending_human_review", REVIEWED]),
        *[CASE[name] for name in ["annotator_id", "adjudication_status", "annotation_note"]],
    ]
)
ADJUDICATED = T.StructType(
    [
        *DRAFT.fields[:9],
        _text("source", False, values=[REVIEWED]),
        CASE["annotator_id"],
        _text("adjudication_status", False, values=["adjudicated"]),
        CASE["annotation_note"],
        CASE["open_intent_candidate"],
        _field("review_provenance", PROVENANCE, False),
    ]
)
PACKET_ITEM = T.StructType(
    [
        _field("schema_version", T.IntegerType(), values=[1], default=1),
        _text("packet_item_id", False, pattern=PACKET_ID),
        _text("sample_kind", False, values=["hierarchical_disagreement", "agreement_audit"]),
        _text("review_item_id", False, pattern=REVIEW_ID),
        _text("candidate_id", False),
        _field("context", CONTEXT, False),
        _field("human_label", LABEL, False),
        _text("human_review_note"),
        _field("draft_label", GOLD, False),
        _text("draft_annotation_note", False),
        _texts("tags", nullable=False),
        _texts("hard_negative_against", nullable=False),
        _text("scenario_family_id", False),
        _text("contrast_group_id", False),
        *[_field(f"{name}_matches", T.BooleanType(), False) for name in ["decision", "target", "horizon", "hierarchical"]],
        _text(
            "review_focus",
            False,
            values=["near_oos_grounding_boundary", "target_selection", "decision_rule_boundary", "agreement_audit"],
        ),
        _text(
            "recommendation",
            False,
            values=["grounding_evidence_required", "likely_reviewer_input_error", "current_rule_lean_keep_draft", "confirm_agreement"],
        ),
        _text("recommendation_reason", False),
        _field("requires_user_decision", T.BooleanType(), False),
    ]
)
RESOLUTION = T.StructType(
    [
        _field("schema_version", T.IntegerType(), values=[1], default=1),
        _text("packet_item_id", False, pattern=PACKET_ID),
        _text("candidate_id", False),
        _text("action", False, values=ACTIONS),
        _text("final_decision", values=DECISIONS),
        _text("final_target_intent"),
        _text("final_horizon", values=HORIZONS),
        _text("rationale", False, shortest=1),
        _text("taxonomy_change_note", shortest=1),
        _text("adjudicator_id", False, shortest=1),
        _text("adjudicated_at", False, pattern=MOMENT),
        _text("source_workbook_sha256", False, pattern=DIGEST),
        _text("policy_impact", values=["none", "taxonomy_or_decision_rule_review_required"], default="none"),
        _text("policy_impact_reason", shortest=1),
    ]
)
INTENTION = T.StructType(
    [
        _text("evidence_status", False, values=["clear", "ambiguous", "deferred", "none"]),
        _text("action", longest=120),
        _text("object", longest=120),
        _text("desired_experience", longest=160),
        _texts("qualifiers", nullable=False, most=6),
        _texts("alternative_actions", default=[], most=4),
        _text("horizon", False, values=HORIZONS),
        _text("reason_short", False, shortest=1, longest=200),
    ]
)
FORMED = T.StructType(
    [
        _field("schema_version", T.IntegerType(), values=[1], default=1),
        _text("case_id", False),
        _text("status", False, values=STATUSES),
        _field("formed_intention", INTENTION),
        _text("error_type"),
        _field("usage", USAGE),
        _field("latency_ms", T.DoubleType(), False, least=0),
        _text("raw_response_sha256", pattern=DIGEST),
    ]
)
