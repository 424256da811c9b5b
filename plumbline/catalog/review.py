"""Queries for reviews, adjudication, materialised gold and semantic audits."""

from pyspark.sql import functions as F

from plumbline.catalog.comparison import greedy_sql
from plumbline.catalog.quality import clauses, field_diff_sql, hit, mut
from plumbline.catalog.registry import query
from plumbline.functions import hashing as H
from plumbline.functions import labels as L
from plumbline.operators import quality as Q
from plumbline.operators import review as R
from plumbline.schemas import ACCEPT, AUDIT_SAMPLE_TAGS, CONFIRM, DECISIONS, KEEP, REWRITE, RULE_CHANGE

HUMAN = ["human_decision", "human_target", "human_horizon"]
DRAFT = ["draft_decision", "draft_target", "draft_horizon"]


def reviews(t):
    return t.reviews.select("item_id", *HUMAN)


def drafts(t):
    tags = F.array_compact(
        F.array(
            F.when(F.col("near_oos") == 1, "near_oos"),
            F.when(F.col("draft_decision") == "in_scope", "slot_required"),
            F.when(F.col("draft_decision") == "no_intent", "quiet_control"),
            F.when(F.col("item_id") % 2 == 0, "multi_turn").otherwise("single_turn"),
        )
    )
    return t.reviews.select("item_id", *DRAFT, tags.alias("tags"), "draft_quote", "draft_experience", "draft_object")


def compared(t):
    return R.compare_reviews(reviews(t), drafts(t))


COMPARED_SQL = """cm AS (SELECT *, CASE WHEN human_decision = draft_decision THEN 1 ELSE 0 END AS decision_matches,
    CASE WHEN human_target IS NOT DISTINCT FROM draft_target THEN 1 ELSE 0 END AS target_matches,
    CASE WHEN human_horizon = draft_horizon THEN 1 ELSE 0 END AS horizon_matches,
    CASE WHEN human_decision = draft_decision AND (draft_decision <> 'in_scope' OR human_target = draft_target) THEN 1 ELSE 0 END
      AS hierarchical_matches FROM reviews)"""
FLAGS = "decision_matches, target_matches, horizon_matches, hierarchical_matches"


@query("j06_review_comparison", f"WITH {COMPARED_SQL} SELECT item_id, {FLAGS} FROM cm", "reviews")
def j06(t):
    return compared(t).select("item_id", *FLAGS.split(", "))


PACKET_SQL = """pk AS (SELECT *, CASE WHEN hierarchical_matches = 1 THEN 'agreement_audit' ELSE 'hierarchical_disagreement' END AS sample_kind,
    CASE WHEN hierarchical_matches = 1 THEN 'agreement_audit' WHEN near_oos = 1 THEN 'near_oos_grounding_boundary'
      WHEN decision_matches = 1 AND target_matches = 0 THEN 'target_selection' ELSE 'decision_rule_boundary' END AS review_focus,
    CASE WHEN hierarchical_matches = 1 THEN 'confirm_agreement' WHEN near_oos = 1 THEN 'grounding_evidence_required'
      WHEN decision_matches = 1 AND target_matches = 0 THEN 'likely_reviewer_input_error' ELSE 'current_rule_lean_keep_draft' END
      AS recommendation FROM cm)"""


@query(
    "p15_packet_fields",
    f"WITH {COMPARED_SQL}, {PACKET_SQL} SELECT item_id, sample_kind, review_focus, recommendation FROM pk",
    "reviews",
)
def p15(t):
    return R.packet_fields(compared(t)).select("item_id", "sample_kind", "review_focus", "recommendation")


SAMPLE = 15
_TAG_TEST = {
    "near_oos": "near_oos = 1",
    "slot_required": "draft_decision = 'in_scope'",
    "quiet_control": "draft_decision = 'no_intent'",
    "multi_turn": "item_id % 2 = 0",
    "single_turn": "item_id % 2 = 1",
}
_PHASES = [(f"human_decision = '{d}'", 1) for d in DECISIONS]
_PHASES += [(_TAG_TEST.get(tag, "FALSE"), 1) for tag in AUDIT_SAMPLE_TAGS]
_PHASES += [("TRUE", SAMPLE)]
_SAMPLE = greedy_sql(_PHASES, "ag", "key", "item_id", "item_id")
SAMPLE_SQL = f"""{COMPARED_SQL}, ag AS (SELECT *, sha256('adjudication-audit-v1|' || CAST(item_id AS VARCHAR)) AS key FROM cm
      WHERE hierarchical_matches = 1), {_SAMPLE[0]},
    smp AS (SELECT phase, x.item_id, row_number() OVER (ORDER BY phase, sha256('adjudication-audit-v1|' || CAST(x.item_id AS VARCHAR))) - 1 AS position
      FROM ({_SAMPLE[1]}) x QUALIFY position < {SAMPLE})"""


@query(
    "w06_agreement_sample",
    f"WITH {SAMPLE_SQL} SELECT CAST(position AS INTEGER) AS position, phase, item_id FROM smp",
    "reviews",
)
def w06(t):
    return R.agreement_sample(compared(t), SAMPLE)


@query(
    "w07_packet_order",
    f"""WITH {SAMPLE_SQL}, p AS (SELECT item_id, CASE WHEN near_oos = 1 THEN 0 ELSE 1 END AS section, item_id AS k FROM cm WHERE hierarchical_matches = 0
       UNION ALL SELECT item_id, 2, position FROM smp)
    SELECT item_id, CASE WHEN section = 2 THEN 'agreement_audit' ELSE 'hierarchical_disagreement' END AS sample_kind,
      row_number() OVER (ORDER BY section, k) AS packet_number FROM p""",
    "reviews",
)
def w07(t):
    return R.adjudication_packet(compared(t), SAMPLE)


POLICY_FLAG = (
    f"action = '{ACCEPT}' AND recommendation IN ('grounding_evidence_required', 'current_rule_lean_keep_draft')"
)


@query(
    "p14_policy_impact",
    f"""SELECT item_id, CASE WHEN {POLICY_FLAG} THEN 'taxonomy_or_decision_rule_review_required' ELSE 'none' END AS policy_impact
    FROM resolutions""",
    "resolutions",
)
def p14(t):
    return t.resolutions.select("item_id", R.policy_impact().alias("policy_impact"))


def policies(t):
    flagged = t.resolutions.filter(R.policy_impact() != "none")
    return flagged.select("item_id", F.concat(F.lit("policy-"), F.col("item_id").cast("string")).alias("policy_id"))


JOINED_SQL = f"""po AS (SELECT item_id, 'policy-' || item_id AS policy_id FROM resolutions WHERE {POLICY_FLAG}),
 jn AS (SELECT r.*, s.action, s.final_decision, s.final_target, s.final_horizon, po.policy_id FROM reviews r
   LEFT JOIN resolutions s ON s.item_id = r.item_id LEFT JOIN po ON po.item_id = r.item_id)"""
FINAL_SQL = f"""{JOINED_SQL},
 eq AS (SELECT *, human_decision = draft_decision AND human_target IS NOT DISTINCT FROM draft_target
     AND human_horizon = draft_horizon AS same3 FROM jn),
 fl AS (SELECT item_id, policy_id, action,
   CASE WHEN action IS NULL THEN CASE WHEN same3 THEN 'blind_human_review' END
     WHEN policy_id IS NOT NULL THEN 'policy_dual_channel_draft' WHEN action = '{KEEP}' THEN 'adjudicated_draft'
     WHEN action = '{CONFIRM}' THEN 'blind_human_review' WHEN action = '{ACCEPT}' THEN 'adjudicated_human' END AS label_source,
   CASE WHEN action IS NULL THEN CASE WHEN same3 THEN human_decision END
     WHEN policy_id IS NOT NULL OR action = '{KEEP}' THEN draft_decision WHEN action IN ('{CONFIRM}', '{ACCEPT}') THEN final_decision END AS decision,
   CASE WHEN action IS NULL THEN CASE WHEN same3 THEN human_target END
     WHEN policy_id IS NOT NULL OR action = '{KEEP}' THEN draft_target WHEN action IN ('{CONFIRM}', '{ACCEPT}') THEN final_target END AS target_intent,
   CASE WHEN action IS NULL THEN CASE WHEN same3 THEN human_horizon END
     WHEN policy_id IS NOT NULL OR action = '{KEEP}' THEN draft_horizon WHEN action IN ('{CONFIRM}', '{ACCEPT}') THEN final_horizon END AS horizon,
   CASE WHEN action IS NULL AND NOT same3 THEN 'unresolved_disagreement'
     WHEN action IN ('{REWRITE}', '{RULE_CHANGE}') AND policy_id IS NULL THEN 'action_not_materialised' END AS problem FROM eq)"""


def joined(t):
    return R.lineage_join(drafts(t), reviews(t), t.resolutions, policies(t))


@query(
    "j07_lineage_join",
    f"WITH {JOINED_SQL} SELECT item_id, human_decision, draft_decision, action, final_decision, policy_id FROM jn",
    "reviews resolutions",
)
def j07(t):
    return joined(t).select("item_id", "human_decision", "draft_decision", "action", "final_decision", "policy_id")


FINAL = ["item_id", "label_source", "decision", "target_intent", "horizon", "problem"]


@query("p13_final_labels", f"WITH {FINAL_SQL} SELECT {', '.join(FINAL)} FROM fl", "reviews resolutions")
def p13(t):
    return R.final_labels(joined(t)).select(*FINAL)


@query(
    "a35_label_sources",
    f"WITH {FINAL_SQL} SELECT label_source, decision, count(*) AS n FROM fl WHERE label_source IS NOT NULL GROUP BY 1, 2",
    "reviews resolutions",
)
def a35(t):
    return R.label_source_counts(R.final_labels(joined(t)))


@query(
    "t14_materialise_gold",
    f"""WITH {FINAL_SQL} SELECT 'gold' AS kind, label_source AS name, decision AS value, count(*) AS n FROM fl WHERE label_source IS NOT NULL GROUP BY 2, 3
    UNION ALL SELECT 'problem', problem, '', count(*) FROM fl WHERE problem IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'violation', 'V03', CASE WHEN decision = 'in_scope' THEN 'target_missing' ELSE 'target_unexpected' END, count(*) FROM fl
      WHERE label_source IS NOT NULL AND (decision = 'in_scope') <> (target_intent IS NOT NULL) GROUP BY 3""",
    "reviews resolutions",
)
def t14(t):
    from plumbline.plans.gold import materialise_gold

    return materialise_gold(drafts(t), reviews(t), t.resolutions, policies(t))


# ---- review workspaces -----------------------------------------------------------------------------------------

ENTRY_SQL = f"""en AS (SELECT * REPLACE (CASE WHEN pending THEN NULL ELSE human_decision END AS human_decision,
      CASE WHEN pending THEN NULL ELSE human_target END AS human_target, CASE WHEN pending THEN NULL ELSE human_horizon END AS human_horizon),
      CASE WHEN pending OR {mut('V25b', 'item_id', 20)} THEN NULL ELSE 'r1' END AS reviewer_id,
      CASE WHEN pending THEN NULL ELSE 'at' END AS reviewed_at,
      CASE WHEN {mut('V25c', 'item_id', 2)} THEN 'note' END AS review_note,
      CASE WHEN pending THEN 0 ELSE 1 END AS complete,
      CAST(floor(item_id / 50) AS BIGINT) AS batch
   FROM (SELECT *, {mut('V25', 'item_id', 40)} AS pending FROM reviews) z)"""


def entries(t):
    pending = hit("V25", "item_id", 40)
    shown = {c: F.when(~pending, F.col(c)) for c in HUMAN}
    return t.reviews.select(
        "item_id",
        *[c.alias(k) for k, c in shown.items()],
        *["human_quote", "human_experience", "human_object"],
        F.when(~pending & ~hit("V25b", "item_id", 20), "r1").alias("reviewer_id"),
        F.when(~pending, "at").alias("reviewed_at"),
        F.when(hit("V25c", "item_id", 2), "note").alias("review_note"),
        L.as_flag(~pending).alias("complete"),
        F.floor(F.col("item_id") / 50).cast("bigint").alias("batch"),
    )


@query(
    "v25_review_completeness",
    f"WITH {ENTRY_SQL} "
    + clauses(
        "en",
        "V25",
        "item_id",
        {
            "pending_with_note": "human_decision IS NULL AND reviewer_id IS NULL AND reviewed_at IS NULL AND review_note IS NOT NULL",
            "partial_attribution": """(human_decision IS NULL OR reviewer_id IS NULL OR reviewed_at IS NULL)
              AND coalesce(human_decision, reviewer_id, reviewed_at) IS NOT NULL""",
        },
    ),
    "reviews",
)
def v25(t):
    return R.review_completeness(entries(t))


@query(
    "v25_pending_by_batch",
    f"WITH {ENTRY_SQL} SELECT batch, count(*) AS items, count(*) - count(human_decision) AS pending FROM en GROUP BY 1",
    "reviews",
)
def v25b(t):
    return R.pending_by_batch(entries(t))


@query(
    "a36_agreement",
    f"""WITH {ENTRY_SQL}, c AS (SELECT *, human_decision = draft_decision AS d, human_target IS NOT DISTINCT FROM draft_target AS t,
       human_horizon = draft_horizon AS h FROM en),
     s AS (SELECT batch, count(*) AS item_count, CAST(sum(complete) AS BIGINT) AS completed_count, count(*) FILTER (d) AS dm,
       count(*) FILTER (t AND complete = 1) AS tm, count(*) FILTER (h) AS hm, count(*) FILTER (d AND (draft_decision <> 'in_scope' OR t)) AS xm,
       count(*) FILTER (human_quote = draft_quote AND complete = 1) AS em,
       count(*) FILTER (human_experience IS NOT DISTINCT FROM draft_experience AND complete = 1) AS pm,
       count(*) FILTER (human_object IS NOT DISTINCT FROM draft_object AND complete = 1) AS om
       FROM c GROUP BY 1)
    SELECT batch, item_count, completed_count,
      CASE WHEN item_count = completed_count THEN 'revealed_after_pass_complete' ELSE 'locked_until_pass_complete' END AS agreement_status,
      CASE WHEN item_count = completed_count THEN dm END AS decision_matches, CASE WHEN item_count = completed_count THEN tm END AS target_matches,
      CASE WHEN item_count = completed_count THEN hm END AS horizon_matches, CASE WHEN item_count = completed_count THEN xm END AS hierarchical_matches,
      CASE WHEN item_count = completed_count THEN em END AS evidence_matches, CASE WHEN item_count = completed_count THEN pm END AS experience_matches,
      CASE WHEN item_count = completed_count THEN om END AS object_matches
    FROM s""",
    "reviews",
)
def a36(t):
    return R.agreement_report(entries(t), drafts(t), "batch")


@query(
    "a36_disagreements",
    f"WITH {COMPARED_SQL} SELECT item_id FROM cm WHERE hierarchical_matches = 0",
    "reviews",
)
def a36b(t):
    return compared(t).filter("hierarchical_matches = 0").select("item_id")


V26_SQL = f"""{COMPARED_SQL}, {PACKET_SQL},
 rs AS (SELECT item_id, action, CASE WHEN {mut('V26b', 'item_id', 10)} THEN 'oos' ELSE final_decision END AS final_decision, final_target,
    CASE WHEN {mut('V26c', 'item_id', 10)} THEN NULL ELSE final_horizon END AS final_horizon,
    CASE WHEN {mut('V26d', 'item_id', 10)} THEN NULL ELSE note END AS note
   FROM resolutions WHERE NOT {mut('V26', 'item_id', 10)}),
 pr AS (SELECT * FROM pk WHERE item_id IN (SELECT item_id FROM resolutions) AND NOT {mut('V26e', 'item_id', 10)}),
 j AS (SELECT coalesce(p.item_id, r.item_id) AS item_id, p.item_id AS pid, r.item_id AS rid, p.* EXCLUDE (item_id), r.* EXCLUDE (item_id),
    p.item_id IS NOT NULL AND r.item_id IS NOT NULL AS both_,
    final_decision IS NOT DISTINCT FROM human_decision AND final_target IS NOT DISTINCT FROM human_target
      AND final_horizon IS NOT DISTINCT FROM human_horizon AS same_h,
    final_decision IS NOT DISTINCT FROM draft_decision AND final_target IS NOT DISTINCT FROM draft_target
      AND final_horizon IS NOT DISTINCT FROM draft_horizon AS same_d
   FROM pr p FULL OUTER JOIN rs r ON p.item_id = r.item_id) """


@query(
    "v26_resolution_rules",
    f"WITH {V26_SQL} "
    + clauses(
        "j",
        "V26",
        "item_id",
        {
            "unresolved": "rid IS NULL",
            "not_in_packet": "pid IS NULL",
            "rewrite_with_label": f"both_ AND action = '{REWRITE}' AND coalesce(final_decision, final_target, final_horizon) IS NOT NULL",
            "label_incomplete": f"both_ AND action <> '{REWRITE}' AND (final_decision IS NULL OR final_horizon IS NULL)",
            "target_missing": f"both_ AND action <> '{REWRITE}' AND final_decision = 'in_scope' AND final_target IS NULL",
            "target_unexpected": f"both_ AND action <> '{REWRITE}' AND final_decision <> 'in_scope' AND final_target IS NOT NULL",
            "confirm_on_disagreement": f"both_ AND action = '{CONFIRM}' AND hierarchical_matches = 0",
            "confirm_unequal": f"""both_ AND action = '{CONFIRM}' AND hierarchical_matches = 1
               AND (decision_matches = 0 OR target_matches = 0 OR horizon_matches = 0)""",
            "confirm_differs": f"both_ AND action = '{CONFIRM}' AND NOT same_h",
            "audit_not_confirmed": f"both_ AND hierarchical_matches = 1 AND action <> '{CONFIRM}'",
            "accept_differs": f"both_ AND action = '{ACCEPT}' AND NOT same_h",
            "keep_differs": f"both_ AND action = '{KEEP}' AND NOT same_d",
            "change_without_note": f"both_ AND action = '{RULE_CHANGE}' AND note IS NULL",
        },
    ),
    "reviews resolutions",
)
def v26(t):
    c = F.col
    stored = t.resolutions.filter(~hit("V26", "item_id", 10)).select(
        "item_id",
        "action",
        F.when(hit("V26b", "item_id", 10), "oos").otherwise(c("final_decision")).alias("final_decision"),
        "final_target",
        F.when(~hit("V26c", "item_id", 10), c("final_horizon")).alias("final_horizon"),
        F.when(~hit("V26d", "item_id", 10), c("note")).alias("note"),
    )
    resolved = t.resolutions.select("item_id")
    packet = R.packet_fields(compared(t)).join(resolved, "item_id", "left_semi").filter(~hit("V26e", "item_id", 10))
    return R.resolution_rules(packet.select("item_id", *HUMAN, *DRAFT, "sample_kind"), stored)


@query(
    "v27_policy_alignment",
    f"""WITH fg AS (SELECT item_id, 'adjudication-' || item_id AS packet_id FROM resolutions WHERE {POLICY_FLAG}),
     pl AS (SELECT s.item_id, 'policy-' || s.item_id AS policy_id,
        CASE WHEN {mut('V27b', 's.item_id', 5)} THEN 'adjudication-x' ELSE 'adjudication-' || s.item_id END AS packet_id,
        CASE WHEN {mut('V27c', 's.item_id', 5)} THEN '#' ELSE '' END || substr(d.text, 5, 20) AS quote
       FROM resolutions s JOIN documents d ON d.doc_id = s.item_id
       WHERE (({POLICY_FLAG}) OR {mut('V27d', 's.item_id', 20)}) AND NOT {mut('V27', 's.item_id', 5)}),
     j AS (SELECT coalesce(f.item_id, p.item_id) AS item_id, f.packet_id AS a, p.packet_id AS b, p.policy_id, p.quote FROM fg f
       FULL OUTER JOIN pl p ON f.item_id = p.item_id) """
    + clauses(
        "j",
        "V27",
        "item_id",
        {
            "policy_missing": "policy_id IS NULL",
            "policy_not_flagged": "a IS NULL",
            "packet_differs": "a <> b",
            "quote_not_in_context": """a IS NOT NULL AND policy_id IS NOT NULL
              AND NOT contains((SELECT text FROM documents d WHERE d.doc_id = item_id), quote)""",
        },
    ),
    "resolutions",
)
def v27(t):
    flag = R.policy_impact() != "none"
    key = F.col("item_id").cast("string")
    flagged = t.resolutions.filter(flag).select("item_id", F.concat(F.lit("adjudication-"), key).alias("packet_id"))
    contexts = t.documents.select(F.col("doc_id").alias("item_id"), "text")
    stored = (
        t.resolutions.filter((flag | hit("V27d", "item_id", 20)) & ~hit("V27", "item_id", 5))
        .join(contexts, "item_id")
        .select(
            "item_id",
            F.concat(F.lit("policy-"), key).alias("policy_id"),
            F.concat(F.lit("adjudication-"), F.when(hit("V27b", "item_id", 5), "x").otherwise(key)).alias("packet_id"),
            F.concat(F.when(hit("V27c", "item_id", 5), "#").otherwise(""), F.substring("text", 5, 20)).alias("quote"),
        )
    )
    return R.policy_alignment(flagged, stored, contexts)


@query(
    "v28_provenance",
    f"""WITH {FINAL_SQL}, p AS (SELECT item_id, coalesce(label_source, 'blind_human_review') AS label_source, action,
       CASE WHEN action IS NOT NULL AND NOT {mut('V28', 'item_id', 10)} THEN 'adjudication-' || item_id END AS packet_id,
       CASE WHEN action IS NOT NULL THEN 'a1' END AS adjudicator_id,
       CASE WHEN action IS NOT NULL AND NOT {mut('V28b', 'item_id', 10)} THEN 'at' END AS adjudicated_at,
       CASE WHEN {mut('V28c', 'item_id', 10)} THEN NULL WHEN {mut('V28d', 'item_id', 10)} THEN 'policy-x' ELSE policy_id END AS policy_id FROM fl),
     k AS (SELECT *, (action IS NOT NULL)::INT + (packet_id IS NOT NULL)::INT + (adjudicator_id IS NOT NULL)::INT + (adjudicated_at IS NOT NULL)::INT AS n FROM p) """
    + clauses(
        "k",
        "V28",
        "item_id",
        {
            "adjudication_partial": "n BETWEEN 1 AND 3",
            "source_needs_adjudication": "n = 0 AND label_source <> 'blind_human_review'",
            "dual_without_policy": "label_source = 'policy_dual_channel_draft' AND policy_id IS NULL",
            "policy_without_dual": "label_source <> 'policy_dual_channel_draft' AND policy_id IS NOT NULL",
        },
    ),
    "reviews resolutions",
)
def v28(t):
    acted = F.col("action").isNotNull()
    rows = R.final_labels(joined(t)).select(
        "item_id",
        F.coalesce("label_source", F.lit("blind_human_review")).alias("label_source"),
        "action",
        F.when(acted & ~hit("V28", "item_id", 10), F.concat(F.lit("adjudication-"), F.col("item_id").cast("string"))).alias(
            "packet_id"
        ),
        F.when(acted, "a1").alias("adjudicator_id"),
        F.when(acted & ~hit("V28b", "item_id", 10), "at").alias("adjudicated_at"),
        F.when(hit("V28c", "item_id", 10), None)
        .when(hit("V28d", "item_id", 10), "policy-x")
        .otherwise(F.col("policy_id"))
        .alias("policy_id"),
    )
    return R.provenance_lineage(rows)


# ---- semantic audit --------------------------------------------------------------------------------------------

ROLES = ["primary", "weak"]
AUDIT_SQL = f"""fm AS (SELECT event_id AS item_id, CASE WHEN event_type IN ('click', 'view') THEN 'primary' ELSE 'weak' END AS role,
     CASE WHEN event_type = 'error' THEN 'provider_failure' ELSE 'success' END AS stage_status,
     CASE WHEN event_type <> 'error' THEN event_type END AS formed_action FROM events),
 au AS (SELECT r.item_id, r.draft_decision, x.role, coalesce(fm.stage_status, 'missing') AS stage_status, fm.formed_action
   FROM reviews r CROSS JOIN (VALUES ('primary'), ('weak')) x(role) LEFT JOIN fm ON fm.item_id = r.item_id AND fm.role = x.role),
 ra AS (SELECT *, {", ".join(f"CASE WHEN stage_status <> 'success' AND NOT {mut('V32' + f, 'item_id', 10)} THEN 'lost' ELSE ['preserved', 'partial', 'lost'][1 + CAST('0x' || substr(sha256('{f}|' || CAST(item_id AS VARCHAR)), 1, 8) AS BIGINT) % 3] END AS {f}_rating" for f in ["action", "object", "horizon"])},
     CASE WHEN {mut('V32', 'item_id', 10)} THEN NULL WHEN stage_status <> 'success' THEN 'stage_a_provider_failure' ELSE 'note' END AS note FROM au)"""


def audit(t):
    first = F.col("event_type").isin("click", "view")
    failed = F.col("event_type") == "error"
    formed = t.events.select(
        F.col("event_id").alias("item_id"),
        F.when(first, "primary").otherwise("weak").alias("role"),
        F.when(failed, "provider_failure").otherwise("success").alias("stage_status"),
        F.when(~failed, F.col("event_type")).alias("formed_action"),
    )
    return R.audit_rows(t.reviews.select("item_id", "draft_decision"), ROLES, formed)


def rated(t):
    bad = F.col("stage_status") != "success"
    names = F.array(*[F.lit(x) for x in R.RATINGS])

    def rating(field):
        place = H.bucket(F.concat(F.lit(f"{field}|"), F.col("item_id").cast("string")), 3) + 1
        return F.when(bad & ~hit("V32" + field, "item_id", 10), "lost").otherwise(F.element_at(names, place.cast("int")))

    note = F.when(hit("V32", "item_id", 10), None).when(bad, "stage_a_provider_failure").otherwise("note")
    return audit(t).withColumns({f"{f}_rating": rating(f) for f in ["action", "object", "horizon"]} | {"note": note})


@query("j10_audit_rows", f"WITH {AUDIT_SQL} SELECT item_id, role, draft_decision, stage_status, formed_action FROM au", "reviews")
def j10(t):
    return audit(t).select("item_id", "role", "draft_decision", "stage_status", "formed_action")


@query(
    "a37_rating_counts",
    f"""WITH {AUDIT_SQL}, lg AS (SELECT role, 'action' AS field, action_rating AS rating FROM ra UNION ALL SELECT role, 'object', object_rating FROM ra
       UNION ALL SELECT role, 'horizon', horizon_rating FROM ra
       UNION ALL SELECT role, 'all', 'preserved' FROM ra WHERE action_rating = 'preserved' AND object_rating = 'preserved' AND horizon_rating = 'preserved'
       UNION ALL SELECT role, 'stage', 'failed' FROM ra WHERE stage_status <> 'success')
    SELECT x.role, y.field, y.rating, count(lg.role) AS n FROM (VALUES ('primary'), ('weak')) x(role)
     CROSS JOIN (VALUES ('action', 'preserved'), ('action', 'partial'), ('action', 'lost'), ('object', 'preserved'), ('object', 'partial'),
       ('object', 'lost'), ('horizon', 'preserved'), ('horizon', 'partial'), ('horizon', 'lost'), ('all', 'preserved'), ('stage', 'failed')) y(field, rating)
     LEFT JOIN lg ON lg.role = x.role AND lg.field = y.field AND lg.rating = y.rating GROUP BY 1, 2, 3""",
    "reviews",
)
def a37(t):
    return R.rating_counts(rated(t), ROLES)


AUDIT_FIELDS = ["draft_decision", "stage_status", "formed_action"]


@query(
    "v32_audit_rows",
    f"WITH {AUDIT_SQL}, k AS (SELECT *, item_id || '|' || role AS k FROM ra), st AS (SELECT * REPLACE (CASE WHEN {mut('V32x', 'item_id', 20)} THEN 'edited' ELSE formed_action END AS formed_action) FROM au) "
    + clauses(
        "k",
        "V32",
        "k",
        {
            "note_missing": "NOT (action_rating = 'preserved' AND object_rating = 'preserved' AND horizon_rating = 'preserved') AND note IS NULL",
            "failed_not_lost": "stage_status <> 'success' AND NOT (action_rating = 'lost' AND object_rating = 'lost' AND horizon_rating = 'lost')",
            "failed_note": "stage_status <> 'success' AND note IS DISTINCT FROM 'stage_a_provider_failure'",
        },
    )
    + " UNION ALL "
    + field_diff_sql("V32", "au", "st", ["item_id", "role"], AUDIT_FIELDS),
    "reviews",
)
def v32(t):
    source = audit(t)
    stored = source.withColumn(
        "formed_action", F.when(hit("V32x", "item_id", 20), "edited").otherwise(F.col("formed_action"))
    )
    same = Q.differing_fields(source, stored, ["item_id", "role"], AUDIT_FIELDS, "V32")
    return R.audit_row_rules(rated(t)).unionByName(same)


# ---- carrying labels between versions --------------------------------------------------------------------------

FINGER = """SELECT {id} AS item_id, count(*) || '-' || CAST(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS VARCHAR) || '-'
      || CAST(sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS VARCHAR) AS fingerprint
    FROM (SELECT conv_id, sha256(turn || '|' || role || '|' || {text}) AS h FROM conversations) z GROUP BY 1"""


@query(
    "j08_carried_labels",
    f"""WITH o AS ({FINGER.format(id='conv_id', text='text')}),
     n AS ({FINGER.format(id='conv_id + 1000000', text=f"CASE WHEN {mut('J08', 'conv_id', 4)} THEN text || '!' ELSE text END")}),
     lab AS (SELECT conv_id AS item_id, CASE WHEN conv_id % 5 < 3 THEN 'in_scope' ELSE 'oos' END AS label FROM conversations GROUP BY 1),
     k AS (SELECT fingerprint, min(o.item_id) AS item_id, count(*) AS sources FROM o JOIN lab ON lab.item_id = o.item_id GROUP BY 1)
    SELECT n.item_id, lab.label, k.item_id AS source_item, coalesce(sources, 0) AS sources,
      CASE WHEN k.item_id IS NULL THEN 'pending' ELSE 'carried' END AS state
    FROM n LEFT JOIN k ON k.fingerprint = n.fingerprint LEFT JOIN lab ON lab.item_id = k.item_id""",
)
def j08(t):
    c = t.conversations
    old = R.context_fingerprint(c, "conv_id").withColumnRenamed("conv_id", "item_id")
    edited = F.when(hit("J08", "conv_id", 4), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = R.context_fingerprint(c.withColumn("text", edited), "conv_id").select(
        (F.col("conv_id") + 1000000).alias("item_id"), "fingerprint"
    )
    labels = c.select(
        F.col("conv_id").alias("item_id"), F.when(F.col("conv_id") % 5 < 3, "in_scope").otherwise("oos").alias("label")
    ).distinct()
    return R.carried_labels(new, old, labels)
