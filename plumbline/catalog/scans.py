"""Queries for strict scans, publishing, batches, prompts, caches and whole pipelines."""

import re

from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.catalog.budget import CELLS, RATES, ROLE_SQL, SUMMARY_SQL, role_labelled
from plumbline.catalog.comparison import GROUP_SQL, RISK, SPLIT_SQL, STATISTICS_SQL, greedy_sql  # noqa: F401
from plumbline.catalog.evaluation import BAD_SQL, NORMAL_SQL, SLOTS, bad, counted
from plumbline.catalog.quality import hit, mut
from plumbline.catalog.registry import query
from plumbline.catalog.review import AUDIT_SQL, ROLES, audit
from plumbline.functions import hashing as H
from plumbline.functions import labels as L
from plumbline.functions.lineage import cut
from plumbline.operators import budget as B
from plumbline.operators import cache as K
from plumbline.operators import evaluate as E
from plumbline.operators import expand as X
from plumbline.plans import matrix as M
from plumbline.plans.freeze import freeze
from plumbline.schemas import DECISIONS
from plumbline.sources import publish as P
from plumbline.sources import scan as S
from plumbline.sources.views import ARMS, INTENTS, duck_bucket

# ---- strict scans ----------------------------------------------------------------------------------------------


def broken_lines(df, rule, key, row, required, wrong, absent):
    """One JSON line per row, with known slices blank, cut, with an extra field, with a null required field, with a value
    that its field may not hold (``wrong``: two fields and such values), or without a field that has a default."""
    text = lambda r: F.to_json(r, {"ignoreNullFields": "false"})
    whole = text(row)
    extra = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(',"extra":1}'))
    (one, bad_one), (two, bad_two) = wrong.items()
    return df.withColumn(
        "value",
        F.when(hit(f"{rule}a", key), "  ")
        .when(hit(f"{rule}b", key), F.substring(whole, F.lit(1), F.length(whole) - 7))
        .when(hit(f"{rule}c", key), extra)
        .when(hit(f"{rule}d", key), text(row.withField(required, F.lit(None).cast("string"))))
        .when(hit(f"{rule}e", key), text(row.withField(one, F.lit(bad_one))))
        .when(hit(f"{rule}f", key), text(row.withField(two, F.lit(bad_two))))
        .when(hit(f"{rule}g", key), text(row.dropFields(absent)))
        .otherwise(whole),
    )


def reason_sql(rule, key):
    return f"""CASE WHEN {mut(rule + 'a', key)} THEN 'blank_line' WHEN {mut(rule + 'b', key)} THEN 'invalid_json'
      WHEN {mut(rule + 'c', key)} THEN 'unknown_field' WHEN {mut(rule + 'd', key)} THEN 'missing_field'
      WHEN {mut(rule + 'e', key)} OR {mut(rule + 'f', key)} THEN 'bad_value' END"""


def digest(*parts):
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


@query(
    "s01_gold_scan",
    f"""WITH r AS (SELECT *, {reason_sql('S01', 'case_id')} AS reason FROM gold)
    SELECT case_id, reason, CASE WHEN reason IS NULL THEN decision END AS decision, CASE WHEN reason IS NULL THEN target_intent END AS target_intent,
      CASE WHEN reason IS NULL THEN horizon END AS horizon, CASE WHEN reason IS NULL THEN state_summary END AS state_summary,
      CASE WHEN reason IS NULL THEN CASE WHEN {mut('S01g', 'case_id')} OR recent_activity IS NULL THEN 0 ELSE 1 END END AS n_activities FROM r""",
    "gold",
)
def s01(t):
    text = lambda c: F.col(c).cast("string")
    turn = F.struct(F.lit("assistant").alias("role"), F.col("dialogue").alias("content"))
    case = F.concat(F.lit("case-"), text("case_id"))
    perturbation = F.struct(case.alias("id"), F.lit("before").alias("state_summary_prefix"), F.array(F.lit("walk")).alias("recent_activities_added"))
    candidate = F.struct(
        F.lit("fly_kite").alias("name"),
        F.col("base_state").alias("evidence_quote"),
        "horizon",
        F.lit("not_in_catalog").alias("catalog_status"),
    )
    provenance = F.struct(
        F.lit("review-initial-0001").alias("review_item_id"),
        F.lit("r1").alias("reviewer_id"),
        F.lit("2026-01-01T00:00:00+08:00").alias("reviewed_at"),
        F.lit("blind_human_review").alias("routing_label_source"),
    )
    row = F.struct(
        case.alias("id"),
        F.lit("dev").alias("split"),
        F.struct(
            "state_summary",
            F.array(turn).alias("conversation"),
            F.array_compact(F.array("recent_activity")).alias("recent_activities"),
        ).alias("context"),
        F.struct(
            "decision",
            "target_intent",
            F.col("base_state").alias("evidence_quote"),
            F.col("siblings").alias("near_oos_sibling_intents"),
            F.struct("desired_experience", F.col("object_slot").alias("object"), "horizon").alias("slots"),
        ).alias("gold"),
        "tags",
        "hard_negative_against",
        F.when(F.col("case_id") % 3 == 0, perturbation).alias("context_perturbation"),
        text("scenario_id").alias("scenario_family_id"),
        text("contrast_id").alias("contrast_group_id"),
        text("paraphrase_id").alias("paraphrase_cluster_id"),
        text("cluster_id").alias("split_group_id"),
        text("cluster_id").alias("bootstrap_cluster_id"),
        F.when(F.col("case_id") % 5 == 0, candidate).alias("open_intent_candidate"),
        provenance.alias("review_provenance"),
        F.lit("llm_assisted_human_reviewed").alias("source"),
        F.lit("a1").alias("annotator_id"),
        F.lit("reviewed").alias("adjudication_status"),
        F.lit("note").alias("annotation_note"),
    )
    wrong = {"gold.decision": "maybe", "id": "Case 1"}
    lines = broken_lines(t.gold, "S01", "case_id", row, "gold.decision", wrong, "context.recent_activities").select("case_id", "value")
    judged = S.judge_lines(lines, schemas.CASE)
    good = F.col("reason").isNull()
    return judged.select(
        "case_id",
        "reason",
        *[
            F.when(good, F.col(f"row.{path}")).alias(path.split(".")[-1])
            for path in ["gold.decision", "gold.target_intent", "gold.slots.horizon", "context.state_summary"]
        ],
        F.when(good, F.size("row.context.recent_activities").cast("bigint")).alias("n_activities"),
    )


@query(
    "s02_prediction_scan",
    f"""WITH r AS (SELECT *, {reason_sql('S02', 'case_id')} AS reason FROM predictions)
    SELECT arm AS run_id, case_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN {mut('S02g', 'case_id')} THEN 'success' ELSE status END END AS status,
      CASE WHEN reason IS NULL THEN decision END AS decision,
      CASE WHEN reason IS NULL THEN latency_ms END AS latency_ms, CASE WHEN reason IS NULL THEN total_tokens END AS total_tokens FROM r""",
    "predictions",
)
def s02(t):
    usage = F.struct("input_tokens", "output_tokens", "total_tokens", "retry_input_tokens", "retry_output_tokens")
    slots = F.struct("desired_experience", F.col("object_slot").alias("object"), "horizon")
    row = F.struct(
        F.concat(F.lit("case-"), F.col("case_id").cast("string")).alias("case_id"),
        "status",
        "decision",
        "predicted_intent",
        "candidate_intents",
        F.when(F.col("horizon").isNotNull(), slots).alias("slots"),
        "reason_short",
        "error_type",
        "latency_ms",
        F.when(F.col("total_tokens").isNotNull(), usage).alias("usage"),
        digest("arm", "case_id").alias("raw_response_sha256"),
    )
    wrong = {"latency_ms": -1.0, "raw_response_sha256": "abc"}
    lines = broken_lines(t.predictions, "S02", "case_id", row, "case_id", wrong, "status")
    judged = S.judge_lines(lines.select(F.col("arm").alias("run_id"), "case_id", "value"), schemas.PREDICTION)
    good = F.col("reason").isNull()
    paths = ["status", "decision", "latency_ms", "usage.total_tokens"]
    return judged.select(
        "run_id", "case_id", "reason", *[F.when(good, F.col(f"row.{p}")).alias(p.split(".")[-1]) for p in paths]
    )


@query(
    "s03_call_scan",
    f"""WITH r AS (SELECT *, {reason_sql('S03', 'event_id')} AS reason FROM calls)
    SELECT event_id, reason, CASE WHEN reason IS NULL THEN CASE event_id % 4 WHEN 0 THEN 'call_1_one_stage' WHEN 1 THEN 'call_2_verifier' WHEN 2 THEN 'stage_a' ELSE 'stage_b' END END AS stage,
      CASE WHEN reason IS NULL THEN event_id % 2 + 1 END AS call_index, CASE WHEN reason IS NULL THEN latency_ms END AS latency_ms,
      CASE WHEN reason IS NULL THEN total_tokens END AS total_tokens,
      CASE WHEN reason IS NULL AND total_tokens IS NOT NULL THEN CASE WHEN {mut('S03g', 'event_id')} THEN 0 ELSE retry_input_tokens END END AS retry_input_tokens FROM r""",
    "calls",
)
def s03(t):
    usage = F.struct("input_tokens", "output_tokens", "total_tokens", "retry_input_tokens", "retry_output_tokens")
    nothing = F.lit(None).cast("string")
    kind = F.pmod("event_id", F.lit(4)).cast("int")
    row = F.struct(
        F.lit(1).alias("schema_version"),
        F.col("case_id").cast("string").alias("case_id"),
        F.when(kind < 2, "B2b").otherwise("B3").alias("arm"),
        F.get(F.array(*[F.lit(x) for x in schemas.STAGES]), kind).alias("stage"),
        (kind % 2 + 1).alias("call_index"),
        digest("event_id").alias("cache_key"),
        digest("case_id").alias("call_contract_sha256"),
        F.lit("m").alias("requested_model"),
        nothing.alias("reported_model"),
        "status",
        F.when(F.col("total_tokens").isNotNull(), usage).alias("usage"),
        "latency_ms",
        nothing.alias("raw_response_sha256"),
        nothing.alias("error_type"),
        F.lit("provider_call").alias("cache_origin"),
        nothing.alias("source_cache_key"),
        (kind == 0).alias("one_stage_cache_compatible"),
    )
    wrong = {"cache_origin": "elsewhere", "call_index": 3}
    lines = broken_lines(t.calls, "S03", "event_id", row, "status", wrong, "usage.retry_input_tokens")
    judged = S.judge_lines(lines.select("event_id", "value"), schemas.CALL)
    good = F.col("reason").isNull()
    return judged.select(
        "event_id",
        "reason",
        F.when(good, F.col("row.stage")).alias("stage"),
        F.when(good, F.col("row.call_index").cast("bigint")).alias("call_index"),
        F.when(good, F.col("row.latency_ms")).alias("latency_ms"),
        F.when(good, F.col("row.usage.total_tokens")).alias("total_tokens"),
        F.when(good, F.col("row.usage.retry_input_tokens")).alias("retry_input_tokens"),
    )


@query(
    "s04_review_scan",
    f"""WITH r AS (SELECT *, {reason_sql('S04', 'item_id')} AS reason FROM reviews)
    SELECT coalesce(reason, 'good') AS outcome, count(*) AS lines FROM r GROUP BY 1""",
    "reviews",
)
def s04(t):
    label = F.struct(
        F.col("human_decision").alias("decision"),
        F.col("human_target").alias("target_intent"),
        F.lit("quote").alias("evidence_quote"),
        F.struct(
            F.lit(None).cast("string").alias("desired_experience"),
            F.lit(None).cast("string").alias("object"),
            F.col("human_horizon").alias("horizon"),
        ).alias("slots"),
    )
    number = F.lpad(F.pmod("item_id", F.lit(10000)).cast("string"), 4, "0")
    row = F.struct(
        F.lit(1).alias("schema_version"),
        F.concat(F.lit("review-initial-"), number).alias("review_item_id"),
        F.lit("initial").alias("review_pass"),
        F.lit("r1").alias("reviewer_id"),
        F.lit("2026-01-01T00:00:00Z").alias("reviewed_at"),
        label.alias("label"),
        F.lit(None).cast("string").alias("review_note"),
    )
    wrong = {"review_pass": "third", "reviewed_at": "2026-01-01T00:00:00"}
    lines = broken_lines(t.reviews, "S04", "item_id", row, "review_item_id", wrong, "schema_version")
    return S.scan_summary(S.judge_lines(lines.select("value"), schemas.REVIEW))


def file_scan(t, lines, schema, kind):
    """The lines written to text files and scanned there: how many of each outcome, good rows by ``kind``."""
    path = P.scratch_folder(t.spark)
    lines.select("value").write.text(path)
    judged = S.scan_files(t.spark, path, schema)
    good = F.col("reason").isNull()
    named = judged.select(F.coalesce("reason", F.lit("good")).alias("outcome"), F.when(good, F.col(f"row.{kind}")).alias("kind"))
    return named.groupBy("outcome", "kind").agg(F.count("*").alias("lines"))


def file_scan_sql(rule, key, table, kind):
    return f"""WITH r AS (SELECT *, {reason_sql(rule, key)} AS reason FROM {table})
    SELECT coalesce(reason, 'good') AS outcome, CASE WHEN reason IS NULL THEN {kind} END AS kind, count(*) AS lines FROM r GROUP BY 1, 2"""


def draft_fields(t):
    text = lambda c: F.col(c).cast("string")
    turn = F.struct(F.lit("user").alias("role"), F.col("dialogue").alias("content"))
    perturbation = F.struct(F.lit("walk-1").alias("id"), F.lit("before").alias("state_summary_prefix"), F.array(F.lit("walk")).alias("recent_activities_added"))
    return [
        F.concat(F.lit("draft-"), F.lpad(text("case_id"), 6, "0")).alias("id"),
        F.struct("state_summary", F.array(turn).alias("conversation"), F.array_compact(F.array("recent_activity")).alias("recent_activities")).alias("context"),
        F.struct(
            "decision",
            "target_intent",
            F.col("base_state").alias("evidence_quote"),
            F.col("siblings").alias("near_oos_sibling_intents"),
            F.struct("desired_experience", F.col("object_slot").alias("object"), "horizon").alias("slots"),
        ).alias("gold"),
        "tags",
        "hard_negative_against",
        F.when(F.col("case_id") % 3 == 0, perturbation).alias("context_perturbation"),
        text("scenario_id").alias("scenario_family_id"),
        text("contrast_id").alias("contrast_group_id"),
        text("paraphrase_id").alias("paraphrase_cluster_id"),
        F.lit(schemas.REVIEWED).alias("source"),
        F.lit("a1").alias("annotator_id"),
        F.lit("adjudicated").alias("adjudication_status"),
        F.lit("note").alias("annotation_note"),
    ]


@query("s04_draft_scan", file_scan_sql("S4D", "case_id", "gold", "decision"), "gold")
def s04_drafts(t):
    wrong = {"id": "case-1", "adjudication_status": "done"}
    lines = broken_lines(t.gold, "S4D", "case_id", F.struct(*draft_fields(t)), "annotator_id", wrong, "context.recent_activities")
    return file_scan(t, lines, schemas.DRAFT, "gold.decision")


ROUTING_SOURCE = "CASE WHEN case_id % 4 = 0 THEN 'blind_human_review' ELSE 'adjudicated_human' END"


@query("s04_adjudicated_scan", file_scan_sql("S4A", "case_id", "gold", ROUTING_SOURCE), "gold")
def s04_adjudicated(t):
    blind = F.col("case_id") % 4 == 0
    unless = lambda v: F.when(~blind, v)
    provenance = F.struct(
        F.lit("review-initial-0001").alias("review_item_id"),
        F.lit("r1").alias("reviewer_id"),
        F.lit("2026-01-01T00:00:00Z").alias("reviewed_at"),
        F.expr(ROUTING_SOURCE).alias("routing_label_source"),
        F.lit("llm_assisted_draft").alias("supporting_fields_source"),
        unless("adjudication-0001").alias("adjudication_packet_item_id"),
        unless(schemas.ACCEPT).alias("adjudication_action"),
        unless("j1").alias("adjudicator_id"),
        unless("2026-01-02T00:00:00+08:00").alias("adjudicated_at"),
    )
    row = F.struct(*draft_fields(t), provenance.alias("review_provenance"))
    wrong = {"source": "human_authored", "review_provenance.adjudication_packet_item_id": "packet-1"}
    lines = broken_lines(t.gold, "S4A", "case_id", row, "review_provenance.reviewer_id", wrong, "review_provenance.supporting_fields_source")
    return file_scan(t, lines, schemas.ADJUDICATED, "review_provenance.routing_label_source")


def numbered(prefix):
    return F.concat(F.lit(prefix), F.lpad(F.pmod("item_id", F.lit(10000)).cast("string"), 4, "0"))


SAMPLE_KIND = "CASE WHEN human_decision = draft_decision AND (draft_decision <> 'in_scope' OR human_target = draft_target) THEN 'agreement_audit' ELSE 'hierarchical_disagreement' END"


@query("s04_packet_scan", file_scan_sql("S4P", "item_id", "reviews", SAMPLE_KIND), "reviews")
def s04_packet(t):
    side = lambda who, *more: F.struct(
        F.col(f"{who}_decision").alias("decision"),
        F.col(f"{who}_target").alias("target_intent"),
        F.col(f"{who}_quote").alias("evidence_quote"),
        *more,
        F.struct(F.col(f"{who}_experience").alias("desired_experience"), F.col(f"{who}_object").alias("object"), F.col(f"{who}_horizon").alias("horizon")).alias("slots"),
    )
    none = F.array().cast("array<string>")
    agrees = F.expr(SAMPLE_KIND) == "agreement_audit"
    row = F.struct(
        F.lit(1).alias("schema_version"),
        numbered("adjudication-").alias("packet_item_id"),
        F.expr(SAMPLE_KIND).alias("sample_kind"),
        numbered("review-initial-").alias("review_item_id"),
        F.col("item_id").cast("string").alias("candidate_id"),
        F.struct(F.col("human_quote").alias("state_summary"), F.array(F.struct(F.lit("user").alias("role"), F.col("draft_quote").alias("content"))).alias("conversation")).alias("context"),
        side("human").alias("human_label"),
        F.lit(None).cast("string").alias("human_review_note"),
        side("draft", none.alias("near_oos_sibling_intents")).alias("draft_label"),
        F.lit("note").alias("draft_annotation_note"),
        F.array(F.lit("single_turn")).alias("tags"),
        none.alias("hard_negative_against"),
        F.lit("f").alias("scenario_family_id"),
        F.lit("c").alias("contrast_group_id"),
        (F.col("human_decision") == F.col("draft_decision")).alias("decision_matches"),
        F.col("human_target").eqNullSafe(F.col("draft_target")).alias("target_matches"),
        (F.col("human_horizon") == F.col("draft_horizon")).alias("horizon_matches"),
        agrees.alias("hierarchical_matches"),
        F.lit("decision_rule_boundary").alias("review_focus"),
        F.lit("confirm_agreement").alias("recommendation"),
        F.lit("why").alias("recommendation_reason"),
        (~agrees).alias("requires_user_decision"),
    )
    wrong = {"review_focus": "other", "human_label.slots.horizon": "soon"}
    lines = broken_lines(t.reviews, "S4P", "item_id", row, "draft_label.evidence_quote", wrong, "schema_version")
    return file_scan(t, lines, schemas.PACKET_ITEM, "sample_kind")


@query("s04_resolution_scan", file_scan_sql("S4R", "item_id", "resolutions", "action"), "resolutions")
def s04_resolutions(t):
    row = F.struct(
        F.lit(1).alias("schema_version"),
        numbered("adjudication-").alias("packet_item_id"),
        F.col("item_id").cast("string").alias("candidate_id"),
        "action",
        "final_decision",
        F.col("final_target").alias("final_target_intent"),
        "final_horizon",
        F.lit("why").alias("rationale"),
        F.col("note").alias("taxonomy_change_note"),
        F.lit("j1").alias("adjudicator_id"),
        F.lit("2026-01-02T03:04:05.678+08:00").alias("adjudicated_at"),
        digest("item_id").alias("source_workbook_sha256"),
        F.lit("none").alias("policy_impact"),
    )
    wrong = {"action": "accept", "adjudicated_at": "2026-01-02"}
    lines = broken_lines(t.resolutions, "S4R", "item_id", row, "rationale", wrong, "policy_impact")
    return file_scan(t, lines, schemas.RESOLUTION, "action")


@query("s04_formed_scan", file_scan_sql("S4F", "event_id", "calls", "status"), "calls")
def s04_formed(t):
    many = F.transform(F.sequence(F.lit(1), (F.pmod("event_id", F.lit(6)) + 1).cast("int")), lambda i: F.concat(F.lit("q"), i.cast("string")))
    intention = F.struct(
        F.lit("clear").alias("evidence_status"),
        F.lit("walk").alias("action"),
        F.lit(None).cast("string").alias("object"),
        F.lit("calm").alias("desired_experience"),
        many.alias("qualifiers"),
        F.array().cast("array<string>").alias("alternative_actions"),
        F.lit("now").alias("horizon"),
        F.lit("said so").alias("reason_short"),
    )
    success = F.col("status") == "success"
    usage = F.struct("input_tokens", "output_tokens", "total_tokens", "retry_input_tokens", "retry_output_tokens")
    row = F.struct(
        F.lit(1).alias("schema_version"),
        F.col("case_id").cast("string").alias("case_id"),
        "status",
        F.when(success, intention).alias("formed_intention"),
        F.when(~success, "timeout").alias("error_type"),
        F.when(F.col("total_tokens").isNotNull(), usage).alias("usage"),
        "latency_ms",
        digest("event_id").alias("raw_response_sha256"),
    )
    wrong = {"latency_ms": -0.5, "raw_response_sha256": "ABC"}
    lines = broken_lines(t.calls, "S4F", "event_id", row, "case_id", wrong, "schema_version")
    return file_scan(t, lines, schemas.FORMED, "status")


@query(
    "s05_taxonomy_order",
    f"""WITH n AS (SELECT p_partkey AS position, CASE WHEN {mut('S05', 'p_partkey')} THEN 'part-0' ELSE 'part-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS name FROM part)
    SELECT 'S05' AS rule, CAST(a.position AS VARCHAR) AS key, a.name || '>=' || b.name AS detail FROM n a JOIN n b ON b.position = a.position + 1
    WHERE b.name <= a.name""",
)
def s05(t):
    name = F.concat(F.lit("part-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return S.taxonomy_order(
        t.part.select(
            F.col("p_partkey").alias("position"), F.when(hit("S05", "p_partkey"), "part-0").otherwise(name).alias("name")
        )
    )


# ---- sinks -----------------------------------------------------------------------------------------------------


def written(t, df, kind):
    path = P.scratch_folder(t.spark)
    P.write(df, path, kind)
    return P.read(t.spark, path, kind, df.schema)


@query("s06_badcase_json_sink", BAD_SQL + "SELECT arm, case_id, prediction_status, error_types FROM bad", "gp")
def s06(t):
    rows = bad(t).select(
        "arm",
        "case_id",
        F.coalesce("status", F.lit("missing")).alias("prediction_status"),
        F.array_join("errors", ",").alias("error_types"),
    )
    return written(t, rows.orderBy("arm", "case_id"), "json")


CSV_SQL = NORMAL_SQL.replace(
    "SELECT arm, decision, pred_decision, n, CAST(sum(n) OVER w AS BIGINT) AS gold_count,",
    "SELECT arm, decision AS gold_label, pred_decision AS predicted_label, n AS count, CAST(sum(n) OVER w AS BIGINT) AS gold_count,",
)


@query("s07_confusion_csv_sink", CSV_SQL.replace("round(CASE", "printf('%.6f', CASE").replace(" END, 6) AS row_fraction", " END) AS row_fraction"), "gp")
def s07(t):
    table = E.normalised_confusion(counted(t), ["arm"]).select(
        "arm",
        F.col("decision").alias("gold_label"),
        F.col("pred_decision").alias("predicted_label"),
        F.col("n").alias("count"),
        "gold_count",
        F.format_string("%.6f", "row_fraction").alias("row_fraction"),
    )
    return written(t, table.orderBy("arm", "gold_label", "predicted_label"), "csv")


@query(
    "s08_audit_csv_sink",
    f"WITH {AUDIT_SQL} SELECT item_id, role, draft_decision, stage_status, formed_action FROM au",
    "reviews",
)
def s08(t):
    return written(t, audit(t).select("item_id", "role", "draft_decision", "stage_status", "formed_action"), "csv")


@query(
    "s09_idempotent_publish",
    """SELECT * FROM (VALUES ('first', 'created'), ('again', 'unchanged'), ('reordered', 'unchanged'), ('edited', 'conflict')) v(step, state)
    WHERE EXISTS (SELECT 1 FROM gp)""",
    "gp",
)
def s09(t):
    table = cut(E.confusion(counted(t), ["arm"]))  # every try reads all of it
    path = P.scratch_folder(t.spark)
    edited = table.withColumn("n", F.col("n") + F.when((F.col("arm") == "A") & (F.col("decision") == "oos"), 1).otherwise(0))
    tries = [("first", table), ("again", table), ("reordered", table.orderBy(F.desc("n"))), ("edited", edited)]
    states = [F.struct(F.lit(step).alias("step"), F.lit(P.publish(df, path)).alias("state")) for step, df in tries]
    return t.spark.range(1).select(F.inline(F.array(*states)))


PRINT_SQL = """fp AS (SELECT {by}, count(*) AS rows, sha256(count(*) || '-' || {parts}) AS digest
    FROM (SELECT {by}, sha256(concat_ws(chr(31), {cells})) AS h FROM {source}) z GROUP BY {by})"""


def print_sql(source, by, columns):
    cells = ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in sorted(columns))
    parts = " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(h, {s}, 15) AS HUGEINT)) AS VARCHAR)" for s in (1, 16, 31, 46))
    return PRINT_SQL.format(by=by, parts=parts, cells=cells, source=source)


DOC_COLUMNS = ["doc_id", "text", "lang", "n_chars"]
DOC_PRINT = print_sql("documents", "source", DOC_COLUMNS)


@query("s10_fingerprint", f"WITH {DOC_PRINT} SELECT * FROM fp")
def s10(t):
    return P.fingerprint(t.documents, ["source"], DOC_COLUMNS)


@query(
    "s11_digest_check",
    f"""WITH {print_sql('orders', 'o_custkey', ['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'])},
     m AS (SELECT CASE WHEN {mut('S11', 'o_custkey')} THEN -1 - o_custkey ELSE o_custkey END AS o_custkey,
       CASE WHEN {mut('S11b', 'o_custkey')} THEN 'x' ELSE digest END AS digest FROM fp)
    SELECT m.o_custkey, CASE WHEN fp.digest IS NULL THEN 'missing' WHEN fp.digest <> m.digest THEN 'mismatch' ELSE 'ok' END AS state
    FROM m LEFT JOIN fp ON fp.o_custkey = m.o_custkey""",
)
def s11(t):
    actual = P.fingerprint(t.orders, ["o_custkey"])
    manifest = actual.select(
        F.when(hit("S11", "o_custkey"), -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(hit("S11b", "o_custkey"), "x").otherwise(F.col("digest")).alias("digest"),
    )
    return P.check_digests(manifest, actual, "o_custkey")


@query(
    "s12_review_batches",
    """SELECT CAST(floor((row_number() OVER (ORDER BY sha256('initial|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) / 25) + 1 AS BIGINT) AS batch,
      doc_id, sha256(text) AS context_hash FROM documents""",
)
def s12(t):
    # only the hash of a text goes through the shuffle of the ranks
    seen = t.documents.select("doc_id", F.sha2("text", 256).alias("context_hash"))
    return X.review_batches(seen, "doc_id", "initial", 25).select("batch", "doc_id", "context_hash")


@query(
    "w01_hash_shuffle",
    """SELECT p.pass, case_id, row_number() OVER (PARTITION BY p.pass ORDER BY sha256(p.pass || '|' || CAST(case_id AS VARCHAR)), case_id) AS rank
    FROM gold CROSS JOIN (VALUES ('initial'), ('blind-retest')) p(pass)""",
    "gold",
)
def w01(t):
    parts = [
        X.shuffled(t.gold.select("case_id"), "case_id", name).select(F.lit(name).alias("pass"), "case_id", "rank")
        for name in ["initial", "blind-retest"]
    ]
    return E.union(parts)


PERTURBATIONS = [("weather", "It rains. ", "intent_0"), ("noise", "Music plays. ", "intent_1"), ("late", "It is late. ", "intent_2")]
FRAMES = ["plain", "question"]


@query(
    "w11_context_pairs",
    """WITH n AS (SELECT doc_id AS seed_id, text, row_number() OVER (ORDER BY doc_id) AS number FROM documents),
     v(i, id, prefix, activity) AS (VALUES (0, 'weather', 'It rains. ', 'intent_0'), (1, 'noise', 'Music plays. ', 'intent_1'), (2, 'late', 'It is late. ', 'intent_2'))
    SELECT 'candidate-' || lpad(CAST(number * 2 - CASE WHEN role = 'distractor' THEN 0 ELSE 1 END AS VARCHAR), 9, '0') AS case_id, seed_id, role,
      sha256(CASE WHEN role = 'distractor' THEN prefix ELSE '' END || text) AS state_hash, CASE WHEN role = 'distractor' THEN activity END AS recent_activity,
      CASE (number - 1) % 2 WHEN 0 THEN 'plain' ELSE 'question' END AS dialogue, 'context_' || role AS tag, v.id AS perturbation, 'pair-' || number AS contrast_id
    FROM n JOIN v ON v.i = (number - 1) % 3 CROSS JOIN (VALUES ('control'), ('distractor')) r(role)""",
)
def w11(t):
    pairs = X.context_pairs(t.documents.select(F.col("doc_id").alias("seed_id"), "text"), PERTURBATIONS, FRAMES)
    return pairs.withColumn("state_hash", F.sha2("state_summary", 256)).drop("state_summary")


# ---- prompts and caches ----------------------------------------------------------------------------------------

TEMPLATE = "Labels: {{TAXONOMY_JSON}}\nExamples:\n{{FEW_SHOTS_JSONL}}\nCase: {{CONTEXT_JSON}}\n"
TAXONOMY = '{"intents":["intent_0","intent_1"],"taxonomy_version":"demo-v1"}'
def _quoted(c):
    return f"""CASE WHEN {c} IS NULL THEN 'null' ELSE '"' || {c} || '"' END"""


SHOT_JSON = f"""'{{"context":{{"state_summary":' || CAST(to_json(base_state) AS VARCHAR) || '}},"output":{{"candidate_intents":[],"decision":"' || decision
   || '","predicted_intent":' || {_quoted('target_intent')} || ',"reason_short":"first of ' || decision || '","slots":{{"desired_experience":'
   || {_quoted('desired_experience')} || ',"horizon":"' || horizon || '","object":' || {_quoted('object_slot')} || '}}}}}}'"""
PROMPT_SQL = f"""sh AS (SELECT string_agg(line, chr(10) ORDER BY decision, case_id) AS shots FROM (SELECT decision, min(case_id) AS case_id,
     arg_min({SHOT_JSON}, case_id) AS line FROM gold GROUP BY decision) z),
 px AS (SELECT doc_id, 'Labels: ' || '{TAXONOMY}' || chr(10) || 'Examples:' || chr(10) || shots || chr(10) || 'Case: ' || text || chr(10) AS prompt
   FROM documents CROSS JOIN sh)"""


def shots(t):
    first = t.gold.groupBy("decision").agg(
        F.min_by(
            F.struct(
                "case_id", "target_intent", "horizon", "desired_experience", "object_slot", F.col("base_state").alias("text")
            ),
            "case_id",
        ).alias("s")
    )
    return first.select(
        "decision",
        "s.target_intent",
        "s.text",
        "s.horizon",
        "s.desired_experience",
        "s.object_slot",
        F.concat(F.lit("first of "), "decision").alias("reason_short"),
        F.concat_ws("|", "decision", F.lpad(F.col("s.case_id").cast("string"), 12, "0")).alias("position"),
    )


def prompted(t):
    return K.prompts(t.documents, TEMPLATE, TAXONOMY, shots(t), "text")


@query("p16_prompts", f"WITH {PROMPT_SQL} SELECT doc_id, sha256(prompt) AS prompt_hash, length(prompt) AS characters FROM px", "gold")
def p16(t):
    return prompted(t).select(
        "doc_id", F.sha2("prompt", 256).alias("prompt_hash"), F.char_length("prompt").cast("bigint").alias("characters")
    )


FORMED_JSON = """'{"action":"walk","alternative_actions":[],"desired_experience":' || ex || ',"evidence_status":"clear","horizon":"' || horizon
   || '","object":null,"qualifiers":["' || decision || '"],"reason_short":"formed"}'"""
ROUTED_JSON = f"""'{{"candidate_intents":[],"decision":"' || decision || '","predicted_intent":' || {_quoted('target_intent')} || ',"reason_short":"first of ' || decision
   || '","slots":{{"desired_experience":' || ex || ',"horizon":"' || horizon || '","object":' || {_quoted('object_slot')} || '}}}}'"""
CONTEXT_TEXT = """'{"state_summary":' || CAST(to_json(base_state) AS VARCHAR) || '}'"""
STAGE_SQL = f"""fs AS (SELECT decision, case_id, {CONTEXT_TEXT} AS context, {FORMED_JSON} AS formed, {ROUTED_JSON} AS routed
     FROM (SELECT *, {_quoted('desired_experience')} AS ex FROM gold) g WHERE case_id IN (SELECT min(case_id) FROM gold GROUP BY decision)),
 sl AS (SELECT 'stage_a' AS form, string_agg('{{"context":' || context || ',"output":' || formed || '}}', chr(10) ORDER BY decision) AS shots FROM fs
   UNION ALL SELECT 'stage_b', string_agg('{{"formed_intention":' || formed || ',"output":' || routed || '}}', chr(10) ORDER BY decision) FROM fs),
 px AS (SELECT form, doc_id, 'Labels: ' || '{TAXONOMY}' || chr(10) || 'Examples:' || chr(10) || shots || chr(10) || 'Case: ' || text || chr(10) AS prompt
   FROM documents CROSS JOIN sl)"""


@query("p16_stage_prompts", f"WITH {STAGE_SQL} SELECT form, doc_id, sha256(prompt) AS prompt_hash, length(prompt) AS characters FROM px", "gold")
def p16_stages(t):
    """The requests of both stages, with few shots that carry formed intentions."""
    formed = F.struct(
        F.lit("clear").alias("evidence_status"), F.lit("walk").alias("action"), F.lit(None).cast("string").alias("object"), "desired_experience",
        F.array("decision").alias("qualifiers"), F.array().cast("array<string>").alias("alternative_actions"), "horizon", F.lit("formed").alias("reason_short"),
    )
    examples = shots(t).withColumn("formed", formed)
    parts = [
        K.prompts(t.documents, TEMPLATE, TAXONOMY, examples, "text", form).select(
            F.lit(form).alias("form"), "doc_id", F.sha2("prompt", 256).alias("prompt_hash"), F.char_length("prompt").cast("bigint").alias("characters")
        )
        for form in ("stage_a", "stage_b")
    ]
    return E.union(parts)


IDENTITY_TEXT = {
    "adapter": "'\"adapter_v1beta\"'",
    "adapter_revision": "'\"v1\"'",
    "few_shot_payload_sha256": "'\"' || sha256('shots') || '\"'",
    "generation_parameters_sha256": "'\"' || sha256('{}') || '\"'",
    "max_output_tokens": "'512'",
    "model": "'\"model-' || source || '\"'",
    "normalized_context_sha256": "'\"' || sha256(text) || '\"'",
    "prompt_instance_sha256": "'\"' || sha256('Case: ' || text) || '\"'",
    "prompt_template_sha256": "'\"' || sha256('Case: ') || '\"'",
    "response_schema_sha256": "'\"' || sha256('schema') || '\"'",
    "schema_version": "'2'",
    "structured_output_mode": "'\"json_schema\"'",
    "taxonomy_sha256": "'\"' || sha256('taxonomy') || '\"'",
}
KEY_SQL = "sha256('{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in IDENTITY_TEXT.items()) + " || '}')"


def request_fields():
    fixed = lambda x: F.sha2(F.lit(x), 256)
    return {
        "adapter": F.lit("adapter_v1beta"),
        "adapter_revision": F.lit("v1"),
        "few_shot_payload_sha256": fixed("shots"),
        "generation_parameters_sha256": fixed("{}"),
        "max_output_tokens": F.lit(512),
        "model": F.concat(F.lit("model-"), "source"),
        "normalized_context_sha256": F.sha2("text", 256),
        "prompt_instance_sha256": F.sha2(F.concat(F.lit("Case: "), "text"), 256),
        "prompt_template_sha256": fixed("Case: "),
        "response_schema_sha256": fixed("schema"),
        "schema_version": F.lit(2),
        "structured_output_mode": F.lit("json_schema"),
        "taxonomy_sha256": fixed("taxonomy"),
    }


@query("p17_request_keys", f"SELECT doc_id, {KEY_SQL} AS cache_key FROM documents")
def p17(t):
    return t.documents.select("doc_id", K.request_key(request_fields()).alias("cache_key"))


@query(
    "p18_normalised_responses",
    """WITH r AS (SELECT event_id, event_type <> 'error' AS answered,
       CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'schema_invalid' WHEN 1 THEN 'timeout' END END AS error_type,
       CASE WHEN event_id % 17 = 0 THEN 'models/other' WHEN event_id % 2 = 0 THEN 'models/main' ELSE 'main' END AS reported_model,
       CASE WHEN event_id % 19 = 0 THEN 'text' ELSE 'json_schema' END AS mode, event_id % 23 = 0 AS lacking,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
    SELECT event_id,
      CASE WHEN NOT answered THEN CASE WHEN error_type = 'schema_invalid' THEN 'schema_invalid' ELSE 'provider_failure' END
        WHEN reported_model = 'models/other' THEN 'provider_failure' WHEN mode = 'text' THEN 'schema_invalid' WHEN lacking THEN 'provider_failure'
        WHEN k > 80 THEN 'schema_invalid' ELSE 'success' END AS status,
      CASE WHEN NOT answered THEN coalesce(error_type, 'provider_failure') WHEN reported_model = 'models/other' THEN 'model_identity_mismatch'
        WHEN mode = 'text' THEN 'structured_output_mode_mismatch' WHEN lacking THEN 'usage_contract_mismatch' WHEN k > 80 THEN 'local_contract' END AS error
    FROM r""",
)
def p18(t):
    e = F.col("event_id")
    failed = F.col("event_type") == "error"
    fields = F.array(F.lit("input_tokens"), F.lit("output_tokens"), F.lit("total_tokens"))
    responses = t.events.select(
        "event_id",
        F.when(~failed, F.col("props")).alias("value"),
        F.when(failed & (e % 3 == 0), "schema_invalid").when(failed & (e % 3 == 1), "timeout").alias("error_type"),
        F.when(e % 17 == 0, "models/other").when(e % 2 == 0, "models/main").otherwise("main").alias("reported_model"),
        F.when(e % 19 == 0, "text").otherwise("json_schema").alias("structured_output_mode"),
        F.when(e % 23 == 0, F.slice(fields, 1, 2)).otherwise(fields).alias("usage_fields"),
    )
    value = F.from_json("value", "k BIGINT")
    return K.normalised_responses(
        responses, "main", "json_schema", ["input_tokens", "output_tokens", "total_tokens"], value["k"] <= 80
    ).select("event_id", "status", F.col("normal_error").alias("error"))


REQUEST_SQL = f"""rq AS (SELECT doc_id AS request_id, lang AS arm, sha256(text) AS cache_key FROM documents),
 rs AS (SELECT cache_key, min(CASE WHEN {duck_bucket("'st|' || cache_key", 9)} = 0 THEN 'provider_failure' ELSE 'success' END) AS status
   FROM rq WHERE {duck_bucket("'hit|' || cache_key", 3)} > 0 GROUP BY 1)"""


def requests(t):
    return t.documents.select(F.col("doc_id").alias("request_id"), F.col("lang").alias("arm"), F.sha2("text", 256).alias("cache_key"))


def responses(t):
    keys = requests(t).select("cache_key").distinct()
    kept = keys.filter(H.bucket(F.concat(F.lit("hit|"), "cache_key"), 3) > 0)
    failed = H.bucket(F.concat(F.lit("st|"), "cache_key"), 9) == 0
    return kept.withColumn("status", F.when(failed, "provider_failure").otherwise("success"))


@query(
    "j11_cache_lookup",
    f"""WITH {REQUEST_SQL} SELECT request_id, CASE WHEN rs.cache_key IS NULL THEN 0 ELSE 1 END AS cached, rs.status AS stored_status
    FROM rq LEFT JOIN rs ON rs.cache_key = rq.cache_key""",
)
def j11(t):
    return K.lookup(requests(t), responses(t)).select("request_id", "cached", "stored_status")


@query(
    "j11_cache_misses",
    f"""WITH {REQUEST_SQL} SELECT 'J11' AS rule, CAST(min(request_id) AS VARCHAR) AS key, 'required_response_absent' AS detail FROM rq
    WHERE cache_key NOT IN (SELECT cache_key FROM rs) GROUP BY cache_key""",
)
def j11b(t):
    return K.offline_violations(requests(t), responses(t))


@query(
    "j11_cache_import",
    f"""WITH {REQUEST_SQL}, inc AS (SELECT DISTINCT cache_key, CASE WHEN {duck_bucket("'imp|' || cache_key", 10)} = 0 THEN 'other' ELSE 'success' END AS payload FROM rq)
    SELECT inc.cache_key, CASE WHEN rs.cache_key IS NULL THEN 'append' WHEN rs.status = inc.payload THEN 'unchanged' ELSE 'conflict' END AS state
    FROM inc LEFT JOIN rs ON rs.cache_key = inc.cache_key""",
)
def j11c(t):
    other = H.bucket(F.concat(F.lit("imp|"), "cache_key"), 10) == 0
    incoming = requests(t).select("cache_key").distinct().withColumn("payload", F.when(other, "other").otherwise("success"))
    stored = responses(t).withColumnRenamed("status", "payload")
    return K.import_plan(incoming, stored).select("cache_key", "state")


@query(
    "a39_request_accounting",
    f"""WITH {REQUEST_SQL}, x AS (SELECT rq.arm, rs.status, rs.cache_key AS k, row_number() OVER (PARTITION BY rq.arm, rq.cache_key ORDER BY request_id) AS rn
       FROM rq LEFT JOIN rs ON rs.cache_key = rq.cache_key)
    SELECT arm, count(*) AS cases, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (k IS NOT NULL OR rn > 1) AS cache_hits,
      count(*) FILTER (k IS NULL AND rn = 1) AS provider_calls FROM x GROUP BY 1""",
)
def a39(t):
    return K.request_accounting(K.lookup(requests(t), responses(t)))


# ---- pipelines -------------------------------------------------------------------------------------------------


_SUMMARY = re.sub(r"\bgp\b", "gw", (BAD_SQL + SUMMARY_SQL).removeprefix("WITH "))
_METRICS = " ".join(f"UNION ALL SELECT 'summary', arm, '{m}', round({m}::DOUBLE, 9) FROM sm" for m in M.SUMMARY_METRICS)


@query(
    "t13_robustness",
    f"""WITH gw AS (SELECT * FROM gp WHERE cluster_id % 16 >= 8), {_SUMMARY.rstrip()}, {ROLE_SQL}, {AUDIT_SQL}
    SELECT 'delta' AS part, a.arm AS name, 'hem' AS metric, round(a.hem - b.hem, 9) AS value FROM rs a JOIN rs b ON a.arm = b.arm AND a.role = 'weak' AND b.role = 'primary'
    UNION ALL SELECT 'delta', a.arm, 'success_count', a.success - b.success FROM rs a JOIN rs b ON a.arm = b.arm AND a.role = 'weak' AND b.role = 'primary'
    UNION ALL SELECT 'cap', arm, 'incomplete_calls', count(*) FILTER (error_type = 'incomplete') FROM calls GROUP BY 2
    UNION ALL SELECT 'cap', arm, 'within_one_of_cap', count(*) FILTER (error_type = 'incomplete' AND output_tokens >= 39) FROM calls GROUP BY 2
    UNION ALL SELECT 'audit', role, stage_status, count(*) FROM au GROUP BY 2, 3 {_METRICS}
    UNION ALL SELECT 'summary', arm, 'incomplete_prediction_count', count(*) FILTER (status <> 'success' AND {mut('T13', 'case_id', 5)}) FROM gw GROUP BY 2
    UNION ALL SELECT 'formed', arm, 'formed_success_count', count(*) FILTER (status = 'success') FROM calls WHERE case_id % 2 = 0 GROUP BY 2
    UNION ALL SELECT 'formed', arm, 'formed_failure_count', count(*) FILTER (status <> 'success') FROM calls WHERE case_id % 2 = 0 GROUP BY 2""",
    "gp predictions calls reviews",
)
def t13(t):
    """The weak role's runs; some of its failed predictions broke off, and half of the users' calls formed an intention."""
    broken = (F.col("status") != "success") & hit("T13", "case_id", 5)
    said = t.predictions.withColumn("error_type", F.when(broken, F.concat(F.lit("stage_a:"), F.lit("incomplete"))).otherwise(F.col("error_type")))
    weak = t.gold.filter(F.col("cluster_id") % 16 >= 8)
    rows = E.join_predictions(weak, said, ARMS, [*SLOTS, "latency_ms", "total_tokens"])
    matrix = M.run_matrix(role_labelled(t), CELLS, RATES)
    formed = t.calls.filter("case_id % 2 = 0").select("arm", "status")
    return M.robustness_report(matrix, "weak", "primary", t.calls, 40, audit(t), rows, said.join(weak, "case_id", "left_semi"), formed, ARMS, INTENTS)


_FREEZE_PHASES = [(f"target_intent = '{i}'", 1) for i in INTENTS] + [(f"decision = '{d}'", 4) for d in DECISIONS]
_FREEZE_AUDIT = greedy_sql(_FREEZE_PHASES, "tk", "neg_risk, key", "cluster_id", "case_id")
FREEZE_PRINT = print_sql("sg", "split", ["case_id", "decision", "target_intent", "cluster_id"])


@query(
    "t15_split_freeze",
    f"""WITH {SPLIT_SQL}, sg AS (SELECT gold.*, split FROM gold JOIN sp ON sp.group_id = gold.cluster_id), {STATISTICS_SQL}, {RISK},
     tk AS (SELECT rk.* FROM rk JOIN sg ON sg.case_id = rk.case_id WHERE split = 'test'), {_FREEZE_AUDIT[0]}, {FREEZE_PRINT}
    SELECT 'cases' AS part, split || '/' || dimension || '/' || value AS name, CAST(cases AS VARCHAR) AS value FROM stats
    UNION ALL SELECT 'clusters', split || '/' || dimension || '/' || value, CAST(clusters AS VARCHAR) FROM stats
    UNION ALL SELECT 'audit', CAST(case_id AS VARCHAR), CAST(phase AS VARCHAR) FROM ({_FREEZE_AUDIT[1]}) z
    UNION ALL SELECT 'digest', split, digest FROM fp""",
    "gold tags",
)
def t15(t):
    return freeze(t.gold, INTENTS)[1]
