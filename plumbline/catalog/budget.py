"""Queries over calls and runs: budgets, attribution, matrices and reports."""

from pyspark.sql import functions as F

from plumbline.catalog.comparison import INTERVAL_SQL, ITERATIONS, PAIRS, SEED, boot_sql
from plumbline.catalog.evaluation import BAD_SQL, BASIC, SLOTS, VALIDITY_SQL, broken_runs, labelled
from plumbline.catalog.quality import PAIRED_SQL, field_diff_sql, hit, mut, paired_calls
from plumbline.catalog.registry import query
from plumbline.operators import budget as B
from plumbline.operators import compare as C
from plumbline.operators import evaluate as E
from plumbline.operators.quality import differing_fields
from plumbline.plans import matrix as M
from plumbline.functions import labels as L
from plumbline.schemas import DECISIONS
from plumbline.sources.views import ARMS, INTENTS

RATES = (0.3, 2.5)
COST_SQL = "round(((input_tokens + coalesce(retry_input_tokens, 0)) * 0.3::DOUBLE + (output_tokens + coalesce(retry_output_tokens, 0)) * 2.5::DOUBLE) / 1000000, 9)"
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in B.TOKEN_FIELDS)
TOKENS = ", ".join(B.TOKEN_FIELDS)


def dist(value, name):
    return f"""count({value}) AS {name}_count, min({value})::DOUBLE AS {name}_min, round(avg({value}), 6) AS {name}_mean,
      round(quantile_cont({value}::DOUBLE, 0.5), 6) AS {name}_p50, round(quantile_cont({value}::DOUBLE, 0.95), 6) AS {name}_p95,
      max({value})::DOUBLE AS {name}_max"""


NANO_SQL = "(input_tokens + coalesce(retry_input_tokens, 0)) * input_nano + (output_tokens + coalesce(retry_output_tokens, 0)) * output_nano"
#: Calls beside their cost in billionths of a dollar.
PRICED_SQL = f"pc AS (SELECT calls.*, {NANO_SQL} AS nano FROM calls LEFT JOIN pricing ON pricing.requested_model = calls.requested_model)"
COST_SUM = "round(sum(nano)::DOUBLE / 1e9, 9) AS cost"


@query("p12_token_cost", f"WITH {PRICED_SQL} SELECT event_id, round(nano::DOUBLE / 1e9, 9) AS cost FROM pc", "calls pricing")
def p12(t):
    return B.priced(t.calls, t.pricing).select("event_id", B.dollars(F.col("nano")).alias("cost"))


KNOWN_SUMS = ", ".join(f"CASE WHEN count(total_tokens) = count(*) THEN CAST(sum({c}) AS BIGINT) END AS {c}" for c in B.TOKEN_FIELDS)
MERGED_SQL = f"""{PAIRED_SQL}, mg AS (SELECT arm, case_id, count(*) AS calls,
     CASE WHEN bool_or(status <> 'success' AND call_index = 1) THEN 'provider_failure'
          WHEN bool_or(status <> 'success') THEN max(CASE WHEN status <> 'success' THEN status END) ELSE 'success' END AS status,
     CASE WHEN bool_or(status <> 'success' AND call_index = 1) THEN 'stage_a:' || max(CASE WHEN status <> 'success' AND call_index = 1 THEN error_type END)
          WHEN bool_or(status <> 'success') THEN max(CASE WHEN status <> 'success' THEN error_type END) END AS error_type,
     {KNOWN_SUMS}, round(sum(latency_ms), 6) AS latency_ms,
     sha256('["' || string_agg(coalesce(raw_response_sha256, call_contract_sha256 || ':' || error_type), '","' ORDER BY call_index) || '"]') AS raw_response_sha256
   FROM fc GROUP BY 1, 2)"""


@query("p19_merged_predictions", f"WITH {MERGED_SQL} SELECT * FROM mg", "calls")
def p19(t):
    return B.merged_predictions(paired_calls(t))


FIELDS = ["status", "error_type", *B.TOKEN_FIELDS, "raw_response_sha256"]


@query(
    "v21_call_reconciliation",
    f"""WITH {MERGED_SQL}, pr AS (SELECT * REPLACE (
        CASE WHEN {mut('V21', 'case_id')} THEN 'schema_invalid' ELSE status END AS status,
        CASE WHEN {mut('V21b', 'case_id')} THEN NULL ELSE total_tokens END AS total_tokens)
      FROM mg WHERE NOT {mut('V21c', 'case_id')}) """
    + field_diff_sql("V21", "mg", "pr", ["arm", "case_id"], FIELDS),
    "calls",
)
def v21(t):
    merged = B.merged_predictions(paired_calls(t))
    stored = merged.filter(~hit("V21c", "case_id")).withColumns(
        {
            "status": F.when(hit("V21", "case_id"), "schema_invalid").otherwise(F.col("status")),
            "total_tokens": F.when(hit("V21b", "case_id"), None).otherwise(F.col("total_tokens")),
        }
    )
    return differing_fields(merged, stored, ["arm", "case_id"], FIELDS, "V21")


TOTAL_FIELDS = ["calls", "input_tokens", "output_tokens", "total_tokens"]
TOTAL_SQL = """tot AS (SELECT CAST(case_id AS VARCHAR) AS run, count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
     CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
     CASE WHEN count(total_tokens) = count(*) THEN CAST(sum(total_tokens) AS BIGINT) END AS total_tokens FROM calls GROUP BY 1)"""


@query(
    "v22_run_totals",
    f"""WITH {TOTAL_SQL}, man AS (SELECT * REPLACE (calls + CASE WHEN {mut('V22', 'run', 7)} THEN 1 ELSE 0 END AS calls,
        CASE WHEN {mut('V22b', 'run', 7)} THEN coalesce(total_tokens, 0) + 5 ELSE total_tokens END AS total_tokens)
      FROM tot WHERE NOT {mut('V22c', 'run', 20)}) """
    + field_diff_sql("V22", "tot", "man", ["run"], TOTAL_FIELDS),
    "calls",
)
def v22(t):
    totals = B.usage_totals(t.calls.withColumn("run", F.col("case_id").cast("string")), ["run"]).select("run", *TOTAL_FIELDS)
    manifest = totals.filter(~hit("V22c", "run", 20)).withColumns(
        {
            "calls": F.col("calls") + F.when(hit("V22", "run", 7), 1).otherwise(0),
            "total_tokens": F.when(hit("V22b", "run", 7), F.coalesce("total_tokens", F.lit(0)) + 5).otherwise(
                F.col("total_tokens")
            ),
        }
    )
    return differing_fields(totals, manifest, ["run"], TOTAL_FIELDS, "V22")


@query(
    "a23_usage_totals",
    f"""SELECT arm, case_id, count(*) AS calls, {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in B.TOKEN_FIELDS[:4])},
      CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS known_tokens,
      CASE WHEN count(total_tokens) = count(*) THEN CAST(sum(total_tokens) AS BIGINT) END AS total_tokens,
      CASE WHEN count(total_tokens) = count(*) THEN 1 ELSE 0 END AS usage_complete FROM calls GROUP BY 1, 2""",
    "calls",
)
def a23(t):
    return B.usage_totals(t.calls, ["arm", "case_id"])


@query(
    "a24_latency_summary",
    f"""WITH p AS (SELECT arm, status, CASE WHEN arm = 'C' AND {mut('A24', 'case_id')} AND status = 'schema_invalid' THEN NULL ELSE latency_ms END AS v
      FROM predictions)
    SELECT arm, status, CASE WHEN count(v) = count(*) THEN 1 ELSE 0 END AS latency_complete,
      CASE WHEN count(v) = count(*) THEN quantile_cont(v, 0.5) END AS p50,
      CASE WHEN count(v) = count(*) THEN quantile_cont(v, 0.95) END AS p95 FROM p GROUP BY 1, 2""",
    "predictions",
)
def a24(t):
    gone = (F.col("arm") == "C") & hit("A24", "case_id") & (F.col("status") == "schema_invalid")
    return B.latency_summary(
        t.predictions.withColumn("latency_ms", F.when(~gone, F.col("latency_ms"))), ["arm", "status"]
    )


@query("a25_distributions", f"SELECT arm, stage, {dist('total_tokens', 'tokens')} FROM calls GROUP BY 1, 2", "calls")
def a25(t):
    return B.distribution(t.calls, ["arm", "stage"], "total_tokens", "tokens")


CASE_SQL = f"""{PRICED_SQL}, cb AS (SELECT arm, case_id, count(*) AS calls, {SUMS}, round(sum(latency_ms), 6) AS latency_ms, sum(nano) AS nano
   FROM pc GROUP BY 1, 2)"""


@query("a26_case_budgets", f"WITH {CASE_SQL} SELECT * EXCLUDE (nano), round(nano::DOUBLE / 1e9, 9) AS cost FROM cb", "calls pricing")
def a26(t):
    return B.case_budgets(t.calls, t.pricing)


@query(
    "a27_stage_summary",
    f"""WITH {PRICED_SQL} SELECT arm, stage, count(*) FILTER (status = 'success') AS success_count,
        count(*) FILTER (status <> 'success') AS failure_count, {SUMS}, {dist('latency_ms', 'latency')}, {dist('total_tokens', 'tokens')}, {COST_SUM}
    FROM pc GROUP BY 1, 2""",
    "calls pricing",
)
def a27(t):
    return B.stage_summary(t.calls, t.pricing)


def keyed_calls(t):
    key = F.concat_ws("|", F.col("case_id").cast("string"), F.coalesce("input_tokens", F.lit(-1)).cast("string"))
    return t.calls.withColumn("cache_key", F.sha2(key, 256))


@query(
    "a28_arm_summary",
    f"""WITH {CASE_SQL},
     s AS (SELECT arm, {SUMS}, {dist('total_tokens', 'case_tokens')}, {dist('latency_ms', 'case_latency')}, {COST_SUM} FROM cb GROUP BY 1),
     c AS (SELECT arm, count(*) FILTER (status = 'success') AS success_calls, count(*) FILTER (status <> 'success') AS failed_calls
       FROM calls GROUP BY 1),
     i AS (SELECT first_arm AS arm, count(*) AS incremental_calls FROM (SELECT case_id, coalesce(input_tokens, -1) AS k, min(arm) AS first_arm
       FROM calls GROUP BY 1, 2) z GROUP BY 1)
    SELECT s.*, success_calls, failed_calls, coalesce(incremental_calls, 0) AS incremental_calls
    FROM s JOIN c ON s.arm = c.arm LEFT JOIN i ON i.arm = s.arm""",
    "calls pricing",
)
def a28(t):
    return B.arm_summary(keyed_calls(t), t.pricing)


GAP = ", ".join(
    f"CAST(sum(CASE WHEN arm = 'C' THEN coalesce({c}, 0) ELSE -coalesce({c}, 0) END) AS BIGINT) AS {c}" for c in B.TOKEN_FIELDS
)


@query(
    "a29_stage_gaps",
    f"""WITH {PAIRED_SQL} SELECT call_index, {GAP}, round(sum(CASE WHEN arm = 'C' THEN {NANO_SQL} ELSE -({NANO_SQL}) END)::DOUBLE / 1e9, 9) AS cost
    FROM fc LEFT JOIN pricing ON pricing.requested_model = fc.requested_model GROUP BY 1""",
    "calls pricing",
)
def a29(t):
    return B.stage_gaps(paired_calls(t), "B", "C", t.pricing)


@query(
    "a29_latency_gap",
    f"""WITH {PAIRED_SQL}, s AS (SELECT case_id, round(sum(CASE WHEN arm = 'C' THEN latency_ms END)
        - sum(CASE WHEN arm = 'B' THEN latency_ms END), 6) AS gap FROM fc GROUP BY 1)
    SELECT {dist('gap', 'gap')} FROM s WHERE gap IS NOT NULL""",
    "calls",
)
def a29b(t):
    return B.latency_gap(paired_calls(t), "B", "C")


@query(
    "a30_budget_fairness",
    """WITH s AS (SELECT case_id, CAST(coalesce(sum(CASE WHEN arm = 'B' THEN total_tokens END), 0) AS BIGINT) AS left_tokens,
       CAST(coalesce(sum(CASE WHEN arm = 'C' THEN total_tokens END), 0) AS BIGINT) AS right_tokens,
       CASE WHEN count(total_tokens) = count(*) THEN 1 ELSE 0 END AS usage_complete FROM calls GROUP BY 1)
    SELECT *, abs(right_tokens - left_tokens) / greatest(left_tokens, 1) AS rate,
      CASE WHEN usage_complete = 0 THEN 'usage-incomplete' WHEN abs(right_tokens - left_tokens) / greatest(left_tokens, 1) > 0.1
        THEN 'budget-confounded' ELSE 'valid' END AS status FROM s""",
    "calls",
)
def a30(t):
    side = lambda arm: F.coalesce(F.sum(F.when(F.col("arm") == arm, F.col("total_tokens"))), F.lit(0))
    totals = t.calls.groupBy("case_id").agg(
        side("B").alias("left_tokens"), side("C").alias("right_tokens"), L.as_flag(B.complete()).alias("usage_complete")
    )
    return B.fairness(totals, 0.10)


@query(
    "a31_cap_pressure",
    """SELECT arm, count(*) FILTER (error_type = 'incomplete') AS incomplete_calls,
      count(*) FILTER (error_type = 'incomplete' AND output_tokens >= 39) AS within_one_of_cap FROM calls GROUP BY 1""",
    "calls",
)
def a31(t):
    return B.cap_pressure(t.calls, 40)


CELLS = [("primary", "A"), ("primary", "B"), ("primary", "C"), ("weak", "A"), ("weak", "B"), ("weak", "C"), ("cross", "B")]
CELL_ROWS = ", ".join(f"('{r}', '{a}')" for r, a in CELLS)
LABEL_ROWS = ", ".join(f"('{d}')" for d in DECISIONS)
USED = ["status", "decision", "predicted_intent", "total_tokens"]
ROLE_SQL = f"""gr AS (SELECT CASE WHEN cluster_id % 16 < 8 THEN 'primary' ELSE 'weak' END AS role, gp.*,
     p.retry_input_tokens, p.retry_output_tokens
   FROM gp LEFT JOIN predictions p ON p.arm = gp.arm AND p.case_id = gp.case_id),
 tl AS (SELECT role, arm, label, count(*) FILTER (decision = label AND pred_decision = label) AS tp,
     count(*) FILTER (pred_decision = label) AS np, count(*) FILTER (decision = label) AS ng
   FROM gr CROSS JOIN (VALUES {LABEL_ROWS}) l(label) GROUP BY 1, 2, 3),
 mf AS (SELECT role, arm, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END), 9) AS f FROM tl GROUP BY 1, 2),
 rs AS (SELECT role, arm, count(status) AS predictions, count(*) FILTER (status = 'success') AS success, avg(hit) AS hem,
     count(*) FILTER (status IS NOT NULL AND total_tokens IS NULL) AS unknown, {SUMS} FROM gr GROUP BY 1, 2)"""


def with_roles(t):
    """Runs of two roles: half of the clusters each."""
    role = F.when(F.col("cluster_id") % 16 < 8, "primary").otherwise("weak")
    return t.gold.withColumn("role", role)


def role_labelled(t):
    predictions = t.predictions
    extra = predictions.select("arm", "case_id", "input_tokens", "output_tokens", "retry_input_tokens", "retry_output_tokens")
    return E.join_predictions(with_roles(t), predictions, ["A", "B", "C"], USED).join(extra, ["arm", "case_id"], "left")


@query(
    "a32_run_matrix",
    f"""WITH {ROLE_SQL} SELECT c.role, c.arm, CASE WHEN rs.role IS NULL THEN 0 ELSE 1 END AS present,
      coalesce(predictions, 0) AS prediction_count, coalesce(success, 0) AS success_count,
      coalesce(predictions - success, 0) AS failed_count, coalesce(hem, 0.0::DOUBLE) AS hem, coalesce(f, 0.0::DOUBLE) AS decision_macro_f1,
      CASE WHEN unknown = 0 THEN 1 ELSE 0 END AS usage_complete, coalesce(total_tokens, 0) AS total_tokens,
      coalesce({COST_SQL}, 0.0::DOUBLE) AS cost
    FROM (VALUES {CELL_ROWS}) c(role, arm) LEFT JOIN rs ON rs.role = c.role AND rs.arm = c.arm
    LEFT JOIN mf ON mf.role = c.role AND mf.arm = c.arm""",
    "gp predictions",
)
def a32(t):
    return M.run_matrix(role_labelled(t), CELLS, RATES)


@query(
    "j09_run_deltas",
    f"""WITH {ROLE_SQL} SELECT a.arm, a.hem, a.success AS success_count, a.hem - b.hem AS hem_delta,
      a.success - b.success AS success_count_delta
    FROM rs a JOIN rs b ON a.arm = b.arm AND a.role = 'weak' AND b.role = 'primary'""",
    "gp predictions",
)
def j09(t):
    return B.run_deltas(M.run_matrix(role_labelled(t), CELLS, RATES), "weak", "primary", ["hem", "success_count"])


INTENT_LABELS = ", ".join(f"('{i}')" for i in INTENTS)
SUMMARY_SQL = f""", dt AS (SELECT arm, label, count(*) FILTER (decision = label AND pred_decision = label) AS tp,
     count(*) FILTER (pred_decision = label) AS np, count(*) FILTER (decision = label) AS ng
   FROM gp CROSS JOIN (VALUES {LABEL_ROWS}) l(label) GROUP BY 1, 2),
 it AS (SELECT arm, label, count(*) FILTER (target_intent = label AND pred_intent = label) AS tp,
     count(*) FILTER (pred_intent = label) AS np, count(*) FILTER (target_intent = label) AS ng
   FROM gp CROSS JOIN (VALUES {INTENT_LABELS}) l(label) WHERE decision = 'in_scope' GROUP BY 1, 2),
 df AS (SELECT arm, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END), 9) AS f FROM dt GROUP BY 1),
 jf AS (SELECT arm, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END), 9) AS f FROM it GROUP BY 1),
 bc AS (SELECT arm, count(*) AS n FROM bad GROUP BY 1),
 lat AS (SELECT arm, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95 FROM gp WHERE status IS NOT NULL GROUP BY 1),
 sm AS (SELECT gp.arm, CASE WHEN gp.arm = 'B' THEN 1 ELSE 0 END AS verdict_authority, count(status) AS prediction_count,
     count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status <> 'success') AS failure_count, avg(hit) AS hem,
     any_value(df.f) AS decision_macro_f1, any_value(jf.f) AS intent_macro_f1,
     avg(CASE WHEN sibling_intent IS NULL THEN NULL WHEN pred_decision = 'oos' THEN 1 ELSE 0 END) AS near_oos_recall,
     avg(CASE WHEN decision <> 'no_intent' THEN NULL WHEN pred_decision = 'no_intent' THEN 1 ELSE 0 END) AS no_intent_recall,
     count(*) FILTER (pair_kind LIKE 'ctx%' AND gp.case_id % 2 = 1 AND hit = 0) AS context_distractor_errors,
     count(*) FILTER (status = 'schema_invalid') AS schema_invalid, 1 AS latency_complete, any_value(p50) AS p50, any_value(p95) AS p95,
     CASE WHEN count(*) FILTER (status IS NOT NULL AND total_tokens IS NULL) = 0 THEN 1 ELSE 0 END AS usage_complete,
     CASE WHEN count(*) FILTER (status IS NOT NULL AND total_tokens IS NULL) = 0 THEN CAST(sum(total_tokens) AS BIGINT) END AS total_tokens,
     any_value(bc.n) AS badcase_count
   FROM gp JOIN df ON df.arm = gp.arm JOIN jf ON jf.arm = gp.arm JOIN bc ON bc.arm = gp.arm JOIN lat ON lat.arm = gp.arm GROUP BY gp.arm)
"""


def known_usage(predictions):
    """Arms A and C have usage for every call; arm B stays incomplete."""
    kept = F.when((F.col("arm") != "B") & F.col("total_tokens").isNull(), 0).otherwise(F.col("total_tokens"))
    return predictions.withColumn("total_tokens", kept)


def summaries(t, predictions):
    rows = E.join_predictions(t.gold, known_usage(predictions), ["A", "B", "C"], [*SLOTS, "latency_ms", "total_tokens"])
    return M.run_summaries(rows, ["A", "B", "C"], INTENTS, "B")


KNOWN = """SELECT * REPLACE (CASE WHEN arm <> 'B' AND status IS NOT NULL AND total_tokens IS NULL THEN 0 ELSE total_tokens END AS total_tokens) FROM """
SUMMARY_BODY = (BAD_SQL + SUMMARY_SQL).replace("FROM gp JOIN df", f"FROM ({KNOWN} gp) gp JOIN df")


@query("t12_run_summaries", SUMMARY_BODY + "SELECT * FROM sm", "gp")
def t12(t):
    return summaries(t, t.predictions)


PILOT_SQL = """, s2 AS (SELECT arm, count(*) FILTER (pair_kind LIKE 'ctx%' AND case_id % 2 = 1 AND hit = 0) AS ctx,
       count(*) FILTER (status = 'schema_invalid') AS sch,
       CASE WHEN arm <> 'B' OR count(*) FILTER (status IS NOT NULL AND total_tokens IS NULL) = 0 THEN sum(total_tokens) END AS tok
     FROM gp GROUP BY 1),
   w2 AS (SELECT left_arm, right_arm, min(cluster_count) AS k,
       any_value(coalesce(lower, point)) FILTER (domain = 'full_hem') AS hl, any_value(coalesce(upper, point)) FILTER (domain = 'full_hem') AS hu,
       any_value(coalesce(lower, point)) FILTER (domain LIKE '%f1') AS il, any_value(coalesce(upper, point)) FILTER (domain LIKE '%f1') AS iu,
       any_value(coalesce(lower, point)) FILTER (domain LIKE 'near%') AS nl, any_value(coalesce(upper, point)) FILTER (domain LIKE 'near%') AS nu,
       any_value(point) FILTER (domain LIKE 'near%') AS np,
       any_value(coalesce(lower, point)) FILTER (domain LIKE 'no%') AS ql, any_value(coalesce(upper, point)) FILTER (domain LIKE 'no%') AS qu
     FROM iv GROUP BY 1, 2),
   x AS (SELECT w2.*, concat_ws(',',
       CASE WHEN a.tok IS NULL OR b.tok IS NULL THEN 'missing_token_totals,incomplete_usage_metadata,incomplete_cost'
            WHEN abs(b.tok - a.tok) / greatest(a.tok, 1) > 0.1 THEN 'budget_confounded' END,
       CASE WHEN k < 8 THEN 'required_ci_unavailable' END) AS blocked,
     concat_ws(',', CASE WHEN hu <= 0 THEN 'hem_not_improved' END, CASE WHEN iu < -0.03 THEN 'id_intent_regressed' END,
       CASE WHEN nu < -0.05 THEN 'near_oos_regressed' END, CASE WHEN qu < -0.05 THEN 'no_intent_regressed' END,
       CASE WHEN b.ctx > a.ctx THEN 'more_context_distractor_errors' END,
       CASE WHEN b.sch > a.sch THEN 'more_schema_invalid_predictions' END) AS worse,
     concat_ws(',', CASE WHEN hl <= 0 THEN 'hem_ci_crosses_zero' END, CASE WHEN il < -0.03 THEN 'id_intent_noninferiority_unproven' END,
       CASE WHEN nl < -0.05 THEN 'near_oos_noninferiority_unproven' END,
       CASE WHEN ql < -0.05 THEN 'no_intent_noninferiority_unproven' END, CASE WHEN np < 0 THEN 'near_oos_point_regressed' END) AS unsure
     FROM w2 JOIN s2 a ON a.arm = left_arm JOIN s2 b ON b.arm = right_arm)
"""
PILOT_TAIL = """   SELECT left_arm, right_arm, CASE WHEN blocked <> '' THEN 'inconclusive' WHEN worse <> '' THEN 'negative'
       WHEN unsure <> '' THEN 'inconclusive' ELSE 'promising' END AS verdict,
     CASE WHEN blocked <> '' THEN blocked WHEN worse <> '' THEN worse WHEN unsure <> '' THEN unsure
       ELSE 'all_pre_registered_gates_passed' END AS reasons FROM x"""


@query("t12_pilot_verdicts", boot_sql(ITERATIONS, SEED, INTERVAL_SQL + PILOT_SQL + PILOT_TAIL), "gold gp")
def t12b(t):
    return verdicts(t, t.predictions)


@query(
    "t12_invalid_runs",
    boot_sql(
        ITERATIONS,
        SEED,
        INTERVAL_SQL
        + PILOT_SQL.rstrip()
        + f""", {VALIDITY_SQL}, vd AS ({PILOT_TAIL}),
   jd AS (SELECT *, left_arm IN (SELECT arm FROM refused) OR right_arm IN (SELECT arm FROM refused) AS bad FROM vd)
   SELECT left_arm, right_arm, CASE WHEN NOT bad THEN verdict END AS verdict, CASE WHEN bad THEN 'invalid_run' ELSE reasons END AS reasons
   FROM jd""",
    ),
    "gold gp",
)
def t12_invalid(t):
    return verdicts(t, broken_runs(t.predictions))


def verdicts(t, predictions):
    rows = E.join_predictions(t.gold, predictions, ARMS, BASIC)
    validity = E.run_validity(t.gold, predictions, ARMS)
    intervals = C.compare_domains(rows, PAIRS, INTENTS, ITERATIONS, SEED, validity=validity)
    return M.pilot_verdicts(intervals, summaries(t, predictions), validity).select(
        "left_arm", "right_arm", "verdict", F.array_join("reasons", ",").alias("reasons")
    )
