"""Queries for comparing runs: pairing, domains, bootstrap, intervals, verdicts, splits and samples."""

from pyspark.sql import functions as F

from plumbline.catalog.evaluation import BASIC, VALIDITY_SQL, broken_runs, labelled
from plumbline.catalog.registry import query
from plumbline.functions import hashing as H
from plumbline.functions import labels as L
from plumbline.operators import compare as C
from plumbline.operators import components as G
from plumbline.operators import evaluate as E
from plumbline.operators import exact_split as X
from plumbline.operators import split as S
from plumbline.schemas import DECISIONS
from plumbline.sources.views import ARMS, INTENTS

PAIRS = [("A", "B"), ("A", "C"), ("B", "C")]
ITERATIONS, SEED = 10_000, 20260820


@query(
    "j04_paired_arms",
    """SELECT a.case_id, a.hit AS left_hit, b.hit AS right_hit, a.pred_decision AS left_decision, b.pred_decision AS right_decision
    FROM gp a JOIN gp b ON a.case_id = b.case_id AND a.arm = 'A' AND b.arm = 'B'""",
    "gp",
)
def j04(t):
    return C.paired(labelled(t), "A", "B")


DOMAIN_SQL = """dom AS (SELECT 'full_hem' AS domain, case_id, cluster_id FROM gold
   UNION ALL SELECT 'gold_in_scope_intent_macro_f1', case_id, cluster_id FROM gold WHERE decision = 'in_scope'
   UNION ALL SELECT 'near_oos_recall', case_id, cluster_id FROM gold WHERE sibling_intent IS NOT NULL
   UNION ALL SELECT 'no_intent_recall', case_id, cluster_id FROM gold WHERE decision = 'no_intent')"""


@query(
    "j05_domains",
    f"WITH {DOMAIN_SQL} SELECT domain, count(*) AS cases, count(DISTINCT cluster_id) AS clusters FROM dom GROUP BY 1",
    "gold",
)
def j05(t):
    return (
        t.gold.select("cluster_id", F.explode(C.domains()).alias("domain"))
        .groupBy("domain")
        .agg(F.count("*").alias("cases"), F.count_distinct("cluster_id").alias("clusters"))
    )


@query("t01_components", "SELECT case_id, cluster_id AS component FROM gold", "gold")
def t01(t):
    return G.components(t.gold)


@query(
    "t02_quantiles",
    """SELECT arm, quantile_cont(latency_ms, 0.025) AS q025, quantile_cont(latency_ms, 0.5) AS q500,
     quantile_cont(latency_ms, 0.95) AS q950 FROM predictions GROUP BY 1""",
    "predictions",
)
def t02(t):
    return C.type7_quantiles(t.predictions, ["arm"], "latency_ms", [0.025, 0.5, 0.95])


def duck_mix(x):
    """The 32-bit mixer in SQL."""
    a = f"(((xor({x}, ({x}) >> 16)) * {H.MIX_1}) & {H.LOW_32})"
    b = f"(((xor({a}, {a} >> 15)) * {H.MIX_2}) & {H.LOW_32})"
    return f"xor({b}, {b} >> 16)"


def boot_sql(iterations, seed, final):
    """Clusters as lists of counts; a draw is counted by the list that it falls on, and only then multiplied."""
    arms = ", ".join(f"('{a}')" for a in ARMS)
    intents = ", ".join(f"('{i}')" for i in INTENTS)
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
    return f"""WITH {DOMAIN_SQL},
 r AS (SELECT dom.domain, x.cluster_id, x.arm,
     count(*) FILTER (dom.domain = 'full_hem' OR dom.domain = 'near_oos_recall' AND decision = 'oos' OR dom.domain = 'no_intent_recall') AS n,
     count(*) FILTER (dom.domain = 'full_hem' AND hit = 1 OR dom.domain = 'near_oos_recall' AND decision = 'oos' AND pred_decision = 'oos'
        OR dom.domain = 'no_intent_recall' AND pred_decision = 'no_intent') AS h
   FROM gp x JOIN dom ON dom.case_id = x.case_id WHERE dom.domain <> 'gold_in_scope_intent_macro_f1' GROUP BY 1, 2, 3),
 il AS (SELECT x.cluster_id, x.arm, l.label, count(*) FILTER (target_intent = label AND pred_intent = label) AS tp,
     count(*) FILTER (pred_intent = label) AS np, count(*) FILTER (target_intent = label) AS ng
   FROM gp x CROSS JOIN (VALUES {intents}) l(label) WHERE decision = 'in_scope' GROUP BY 1, 2, 3),
 il2 AS (SELECT cluster_id, label, arm, 'p' AS kind, np AS x FROM il UNION ALL SELECT cluster_id, label, arm, 't', tp FROM il
   UNION ALL SELECT cluster_id, label, arm, 'g', ng FROM il WHERE arm = 'A'),
 cl AS (SELECT domain, cluster_id, list_concat([min(n)], list(h ORDER BY arm)) AS v FROM r GROUP BY 1, 2
   UNION ALL SELECT 'gold_in_scope_intent_macro_f1', cluster_id, list(x ORDER BY kind <> 'g', label, kind, arm) FROM il2 GROUP BY 2),
 vk AS (SELECT domain, v, count(*) AS copies, sum(count(*)) OVER (PARTITION BY domain ORDER BY v) AS upto, sum(count(*)) OVER (PARTITION BY domain) AS clusters,
     row_number() OVER (PARTITION BY domain ORDER BY v) AS k FROM cl GROUP BY 1, 2),
 sl AS (SELECT domain, k, clusters, CAST(upto - copies + i.range AS BIGINT) AS slot FROM vk, range(0, copies) i),
 dr AS (SELECT s.domain, i.range AS iteration,
     (({duck_mix(f"xor(xor({duck_mix('((s.slot + 1) & 4294967295)')}, {duck_mix('i.range')}), {duck_mix(f'({(seed & H.LOW_32) ^ C.SEED_SIDE}::BIGINT)')})")}) * CAST(clusters AS BIGINT)) >> 32 AS slot
   FROM sl s, range({iterations}) i),
 w AS (SELECT d.domain, d.iteration, s.k, count(*) AS m FROM dr d JOIN sl s ON s.domain = d.domain AND s.slot = d.slot GROUP BY 1, 2, 3
   UNION ALL SELECT domain, -1, k, copies FROM vk),
 wv AS (SELECT w.domain, iteration, m, v FROM w JOIN vk ON vk.domain = w.domain AND vk.k = w.k),
 am AS (SELECT arm, row_number() OVER (ORDER BY arm) AS i FROM (VALUES {arms}) z(arm)),
 lb AS (SELECT label, row_number() OVER (ORDER BY label) AS i FROM (VALUES {intents}) z(label)),
 rate AS (SELECT domain, iteration, arm, CASE WHEN sum(v[1] * m) > 0 THEN sum(v[1 + i] * m) / sum(v[1] * m) ELSE 0 END AS v
   FROM wv CROSS JOIN am WHERE domain <> 'gold_in_scope_intent_macro_f1' GROUP BY 1, 2, 3),
 iw AS (SELECT iteration, arm, label, sum(m * v[{len(INTENTS)} + (lb.i - 1) * {2 * len(ARMS)} + {len(ARMS)} + am.i]) AS tp,
     sum(m * v[{len(INTENTS)} + (lb.i - 1) * {2 * len(ARMS)} + am.i]) AS np, sum(m * v[lb.i]) AS ng
   FROM wv CROSS JOIN am CROSS JOIN lb WHERE domain = 'gold_in_scope_intent_macro_f1' GROUP BY 1, 2, 3),
 f AS (SELECT iteration, arm, avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END) AS v
   FROM iw GROUP BY 1, 2),
 m AS (SELECT domain, iteration, arm, v FROM rate UNION ALL SELECT 'gold_in_scope_intent_macro_f1', iteration, arm, v FROM f),
 d AS (SELECT a.domain, a.iteration, p.l AS left_arm, p.r AS right_arm, b.v - a.v AS d
   FROM (VALUES {pairs}) p(l, r) JOIN m a ON a.arm = p.l JOIN m b ON b.arm = p.r AND b.domain = a.domain AND b.iteration = a.iteration)
 {final}"""


@query(
    "t03_bootstrap_draws",
    boot_sql(
        ITERATIONS,
        SEED,
        "SELECT domain, CAST(iteration AS INTEGER) AS iteration, left_arm, right_arm, round(d, 9) AS difference FROM d WHERE iteration >= 0",
    ),
    "gold gp",
)
def t03(t):
    return C.iteration_differences(labelled(t), PAIRS, INTENTS, ITERATIONS, SEED).select(
        "domain", "iteration", "left_arm", "right_arm", F.round("d", 9).alias("difference")
    )


INTERVAL_SQL = """, k AS (SELECT domain, count(*) AS case_count, count(DISTINCT cluster_id) AS cluster_count FROM dom GROUP BY 1),
 iv AS (SELECT d.domain, left_arm, right_arm, any_value(case_count) AS case_count, any_value(cluster_count) AS cluster_count,
    round(any_value(d) FILTER (iteration = -1), 9) AS point,
    round(quantile_cont(d, 0.025) FILTER (iteration >= 0), 9) AS lower,
    round(quantile_cont(d, 0.975) FILTER (iteration >= 0), 9) AS upper
  FROM d JOIN k ON k.domain = d.domain GROUP BY 1, 2, 3)"""


@query(
    "t04_domain_intervals",
    boot_sql(
        ITERATIONS,
        SEED,
        INTERVAL_SQL
        + """ SELECT domain, left_arm, right_arm, case_count, cluster_count, CASE WHEN cluster_count >= 8 THEN 1 ELSE 0 END AS estimable,
      point, CASE WHEN cluster_count >= 8 THEN lower END AS lower, CASE WHEN cluster_count >= 8 THEN upper END AS upper,
      CASE WHEN cluster_count < 8 THEN 'insufficient_clusters' END AS unavailable_reason FROM iv""",
    ),
    "gold gp",
)
def t04(t):
    validity = E.run_validity(t.gold, t.predictions, ARMS)
    return C.compare_domains(labelled(t), PAIRS, INTENTS, ITERATIONS, SEED, validity=validity)


@query(
    "t04_invalid_runs",
    boot_sql(
        ITERATIONS,
        SEED,
        INTERVAL_SQL
        + f""", {VALIDITY_SQL}, jd AS (SELECT *, left_arm IN (SELECT arm FROM refused) OR right_arm IN (SELECT arm FROM refused) AS bad FROM iv)
    SELECT domain, left_arm, right_arm, case_count, cluster_count, CASE WHEN cluster_count >= 8 AND NOT bad THEN 1 ELSE 0 END AS estimable,
      CASE WHEN NOT bad THEN point END AS point, CASE WHEN cluster_count >= 8 AND NOT bad THEN lower END AS lower,
      CASE WHEN cluster_count >= 8 AND NOT bad THEN upper END AS upper,
      CASE WHEN bad THEN 'invalid_run' WHEN cluster_count < 8 THEN 'insufficient_clusters' END AS unavailable_reason FROM jd""",
    ),
    "gold gp",
)
def t04_invalid(t):
    predictions = broken_runs(t.predictions)
    rows = E.join_predictions(t.gold, predictions, ARMS, BASIC)
    validity = E.run_validity(t.gold, predictions, ARMS)
    return C.compare_domains(rows, PAIRS, INTENTS, ITERATIONS, SEED, validity=validity)


EVIDENCE_SQL = """ev AS (SELECT CAST('0x' || substr(sha256('seg|' || CAST(cluster_id AS VARCHAR)), 1, 8) AS BIGINT) % 300 AS segment,
     avg(CASE WHEN arm = 'A' THEN hit END) - avg(CASE WHEN arm = 'C' THEN hit END) AS hem,
     avg(CASE WHEN arm = 'A' AND decision = 'in_scope' THEN hit END) - avg(CASE WHEN arm = 'B' AND decision = 'in_scope' THEN hit END) AS intent,
     avg(CASE WHEN arm = 'A' AND decision = 'oos' THEN hit END) - avg(CASE WHEN arm = 'C' AND decision = 'oos' THEN hit END) AS near,
     avg(CASE WHEN arm = 'A' AND decision = 'no_intent' THEN hit END)
        - avg(CASE WHEN arm = 'C' AND decision = 'no_intent' THEN hit END) AS quiet,
     count(*) FILTER (arm = 'C' AND hit = 0 AND pair_kind LIKE 'ctx%' AND case_id % 2 = 1) AS lc,
     count(*) FILTER (arm = 'A' AND hit = 0 AND pair_kind LIKE 'ctx%' AND case_id % 2 = 1) AS rc,
     count(*) FILTER (arm = 'C' AND status = 'schema_invalid') AS ls, count(*) FILTER (arm = 'A' AND status = 'schema_invalid') AS rs,
     CAST(sum(CASE WHEN arm = 'C' THEN total_tokens END) AS BIGINT) AS lt,
     CASE WHEN count(*) FILTER (arm = 'A' AND status = 'provider_failure') <= 2 THEN
       CAST(sum(CASE WHEN arm = 'A' THEN total_tokens END) AS BIGINT) END AS rt,
     count(*) FILTER (arm = 'C' AND status IS NULL) < 4 AS usage_ok,
     count(DISTINCT cluster_id) >= 8 AS estimable,
     count(*) FILTER (arm = 'A' AND status IS NULL) < 3 AS valid
   FROM gp GROUP BY 1)"""


def evidence(t):
    """Segments of clusters, with a fixed margin around each point, as comparisons to decide."""
    arm = lambda a, more=None: (F.col("arm") == a) if more is None else ((F.col("arm") == a) & more)
    decision = lambda d: F.col("decision") == d
    mean = lambda c: F.avg(F.when(c, F.col("hit")))
    count = lambda c: F.sum(L.as_flag(c))
    wrong_context = (F.col("hit") == 0) & L.has_tag("context_distractor")
    segment = H.bucket(F.concat(F.lit("seg|"), F.col("cluster_id").cast("string")), 300)
    points = labelled(t, [*BASIC, "total_tokens"]).groupBy(segment.alias("segment")).agg(
        (mean(arm("A")) - mean(arm("C"))).alias("hem_d"),
        (mean(arm("A", decision("in_scope"))) - mean(arm("B", decision("in_scope")))).alias("intent_d"),
        (mean(arm("A", decision("oos"))) - mean(arm("C", decision("oos")))).alias("near_d"),
        (mean(arm("A", decision("no_intent"))) - mean(arm("C", decision("no_intent")))).alias("quiet_d"),
        count(arm("C", wrong_context)).alias("left_context_errors"),
        count(arm("A", wrong_context)).alias("right_context_errors"),
        count(arm("C", F.col("status") == "schema_invalid")).alias("left_schema_invalid"),
        count(arm("A", F.col("status") == "schema_invalid")).alias("right_schema_invalid"),
        F.sum(F.when(arm("C"), F.col("total_tokens"))).alias("left_tokens"),
        F.when(
            count(arm("A", F.col("status") == "provider_failure")) <= 2, F.sum(F.when(arm("A"), F.col("total_tokens")))
        ).alias("right_tokens"),
        (count(arm("C", F.col("status").isNull())) < 4).alias("usage_complete"),
        (F.count_distinct("cluster_id") >= 8).alias("estimable"),
        (count(arm("A", F.col("status").isNull())) < 3).alias("valid"),
    )
    interval = lambda p, w: F.struct(p.alias("point"), (p - w).alias("lower"), (p + w).alias("upper"))
    return points.withColumns(
        {
            "hem": interval(F.round("hem_d", 9), 0.25),
            "intent": interval(F.round("intent_d", 9), 0.125),
            "near": interval(F.round("near_d", 9), 0.125),
            "quiet": interval(F.round("quiet_d", 9), 0.125),
            "aligned": F.lit(True),
            "cost_complete": F.col("usage_complete"),
            "latency_complete": F.lit(True),
        }
    )


@query(
    "t05_verdicts",
    f"""WITH {EVIDENCE_SQL},
   e AS (SELECT *, round(hem, 9) AS h, round(intent, 9) AS i, round(near, 9) AS n, round(quiet, 9) AS q,
      abs(rt - lt) / greatest(lt, 1) AS rate FROM ev),
   x AS (SELECT *,
     concat_ws(',', CASE WHEN lt IS NULL OR rt IS NULL THEN 'missing_token_totals' WHEN rate > 0.1 THEN 'budget_confounded' END,
       CASE WHEN NOT usage_ok THEN 'incomplete_usage_metadata,incomplete_cost' END,
       CASE WHEN NOT estimable OR h IS NULL OR i IS NULL OR n IS NULL OR q IS NULL THEN 'required_ci_unavailable' END) AS blocked,
     concat_ws(',', CASE WHEN h + 0.25 <= 0 THEN 'hem_not_improved' END, CASE WHEN i + 0.125 < -0.03 THEN 'id_intent_regressed' END,
       CASE WHEN n + 0.125 < -0.05 THEN 'near_oos_regressed' END, CASE WHEN q + 0.125 < -0.05 THEN 'no_intent_regressed' END,
       CASE WHEN rc > lc THEN 'more_context_distractor_errors' END, CASE WHEN rs > ls THEN 'more_schema_invalid_predictions' END) AS worse,
     concat_ws(',', CASE WHEN h - 0.25 <= 0 THEN 'hem_ci_crosses_zero' END,
       CASE WHEN i - 0.125 < -0.03 THEN 'id_intent_noninferiority_unproven' END,
       CASE WHEN n - 0.125 < -0.05 THEN 'near_oos_noninferiority_unproven' END,
       CASE WHEN q - 0.125 < -0.05 THEN 'no_intent_noninferiority_unproven' END,
       CASE WHEN n < 0 THEN 'near_oos_point_regressed' END) AS unsure FROM e)
   SELECT segment, CASE WHEN NOT valid THEN NULL WHEN blocked <> '' THEN 'inconclusive' WHEN worse <> '' THEN 'negative'
       WHEN unsure <> '' THEN 'inconclusive' ELSE 'promising' END AS verdict,
     CASE WHEN NOT valid THEN 'invalid_run' WHEN blocked <> '' THEN blocked WHEN worse <> '' THEN worse
       WHEN unsure <> '' THEN unsure ELSE 'all_pre_registered_gates_passed' END AS reasons,
     CASE WHEN valid THEN rate END AS token_difference_rate FROM x""",
    "gp",
)
def t05(t):
    return C.decide(evidence(t)).select(
        "segment", "verdict", F.array_join("reasons", ",").alias("reasons"), "token_difference_rate"
    )


# ---- splits ----------------------------------------------------------------------------------------------------

_FLAG_SQL = {f: f"count(*) FILTER (tag = '{f}')" for f in S.FEATURES}
GROUP_SQL = f"""tc AS (SELECT cluster_id, {", ".join(f"{v} AS f_{k}" for k, v in _FLAG_SQL.items())}
     FROM gold g JOIN tags t ON g.case_id = t.case_id GROUP BY 1),
 gr AS (SELECT g.cluster_id AS group_id, count(*) AS cases,
     CASE WHEN min(target_intent) IS NOT NULL THEN 'intent:' || min(target_intent) ELSE 'decision:' || min(decision) END AS stratum,
     count(open_intent) AS f_open_intent_candidate, count(*) FILTER (horizon = 'later') AS f_horizon_later,
     count(*) FILTER (horizon = 'unspecified') AS f_horizon_unspecified, {", ".join(f"any_value(f_{k}) AS f_{k}" for k in S.FEATURES)}
   FROM gold g JOIN tc ON tc.cluster_id = g.cluster_id GROUP BY 1)"""
_TARGET = "floor((sum(f_{0}) * 3 + 5) / 10)"
_ERROR = " + ".join(
    f"pow((sum(dev * f_{f}) - {_TARGET.format(f)}) / greatest({_TARGET.format(f)}, 1), 2)" for f in S.ALL_FEATURES
)
SPLIT_SQL = f"""{GROUP_SQL},
 qu AS (SELECT stratum, CAST(floor((sum(cases) * 3 + 5) / 10) AS BIGINT) AS quota FROM gr GROUP BY 1),
 cand AS (SELECT s.range AS seed, gr.*, quota, CASE WHEN cases <= quota AND sum(CASE WHEN cases <= quota THEN cases ELSE 0 END) OVER (PARTITION BY s.range, gr.stratum
      ORDER BY sha256(s.range || '|' || group_id), group_id ROWS UNBOUNDED PRECEDING) <= quota THEN 1 ELSE 0 END AS dev
    FROM gr JOIN qu ON qu.stratum = gr.stratum CROSS JOIN range(8) s),
 taken AS (SELECT seed, CAST(sum(u) AS BIGINT) AS unfilled FROM (SELECT seed, stratum, any_value(quota) - sum(dev * cases) AS u
      FROM cand GROUP BY 1, 2) z GROUP BY 1),
 sc AS (SELECT cand.seed, any_value(unfilled) AS unfilled, round({_ERROR}, 9) AS objective
    FROM cand JOIN taken ON taken.seed = cand.seed GROUP BY 1),
 best AS (SELECT seed FROM sc ORDER BY unfilled, objective, seed LIMIT 1),
 sp AS (SELECT group_id, CASE WHEN dev = 1 THEN 'dev' ELSE 'test' END AS split, stratum, cases FROM cand
    WHERE seed = (SELECT seed FROM best))"""


@query(
    "w10_seed_scores",
    f"WITH {SPLIT_SQL} SELECT CAST(seed AS INTEGER) AS seed, unfilled, objective FROM sc",
    "gold tags",
)
def w10_scores(t):
    candidates = S.candidate_splits(S.group_table(t.gold, "cluster_id"), 8, 3, 10)
    return S.score_seeds(candidates, S.ALL_FEATURES, 3, 10)


@query("w10_group_split", f"WITH {SPLIT_SQL} SELECT group_id, split, stratum, cases FROM sp", "gold tags")
def w10(t):
    return S.choose_split(t.gold, "cluster_id")


REACHED_SQL = f"""{GROUP_SQL},
 sz AS (SELECT stratum, cases, count(*) AS n, row_number() OVER (PARTITION BY stratum ORDER BY cases) AS place FROM gr GROUP BY 1, 2),
 qu AS (SELECT stratum, CAST(floor((sum(cases) * 3 + 5) / 10) AS BIGINT) AS quota FROM gr GROUP BY 1),
 reached AS (SELECT stratum, 0 AS place, CAST(0 AS BIGINT) AS total FROM qu
   UNION SELECT r.stratum, s.place, r.total + k.range * s.cases FROM reached r JOIN qu USING (stratum)
     JOIN sz s ON s.stratum = r.stratum AND s.place = r.place + 1, range(0, s.n + 1) k WHERE r.total + k.range * s.cases <= qu.quota)"""


@query(
    "w10_exact_split",
    f"""WITH RECURSIVE {REACHED_SQL} SELECT stratum, any_value(quota) AS quota, max(total) AS dev_cases, any_value(quota) - max(total) AS unfilled
    FROM reached JOIN qu USING (stratum) GROUP BY 1""",
    "gold tags",
)
def w10_quotas(t):
    dev = F.sum(F.when(F.col("split") == "dev", F.col("cases")).otherwise(0)).cast("bigint")
    rows = X.exact_split(t.gold, "cluster_id").groupBy("stratum", "quota", "unfilled").agg(dev.alias("dev_cases"))
    return rows.select("stratum", "quota", "dev_cases", "unfilled")


STATISTICS_SQL = """facts AS (SELECT split, cluster_id, 'all' AS dimension, 'cases' AS value FROM sg
   UNION ALL SELECT split, cluster_id, 'decision', decision FROM sg
   UNION ALL SELECT split, cluster_id, 'intent', target_intent FROM sg WHERE target_intent IS NOT NULL
   UNION ALL SELECT split, cluster_id, 'horizon', horizon FROM sg
   UNION ALL SELECT split, cluster_id, 'open_intent', 'present' FROM sg WHERE open_intent IS NOT NULL
   UNION ALL SELECT split, cluster_id, 'tag', tag FROM sg JOIN tags ON sg.case_id = tags.case_id),
 stats AS (SELECT split, dimension, value, count(*) AS cases, count(DISTINCT cluster_id) AS clusters FROM facts GROUP BY 1, 2, 3)"""


def split_cases(t):
    chosen = S.choose_split(t.gold, "cluster_id").select(F.col("group_id").alias("cluster_id"), "split")
    return t.gold.join(chosen, "cluster_id")


@query(
    "a33_split_statistics",
    f"""WITH {SPLIT_SQL}, sg AS (SELECT gold.*, split FROM gold JOIN sp ON sp.group_id = gold.cluster_id),
    {STATISTICS_SQL} SELECT * FROM stats""",
    "gold tags",
)
def a33(t):
    return S.split_statistics(split_cases(t))


@query(
    "a34_relationship_audit",
    """SELECT count(DISTINCT scenario_id) AS scenario_families, count(DISTINCT contrast_id) AS contrast_groups,
      count(DISTINCT paraphrase_id) AS paraphrase_clusters, count(sibling_intent) AS near_oos_pairs,
      count(*) FILTER (pair_kind LIKE 'ctx%' AND case_id % 2 = 0) AS context_pairs, count(DISTINCT cluster_id) AS components,
      (SELECT max(n) FROM (SELECT count(*) AS n FROM gold GROUP BY cluster_id) z) AS largest_component FROM gold""",
    "gold",
)
def a34(t):
    return G.relationship_audit(t.gold, G.components(t.gold))


@query(
    "a38_coverage",
    """SELECT 'tag' AS dimension, tag AS value, count(*) AS n FROM tags GROUP BY 2
    UNION ALL SELECT 'intent', target_intent, count(*) FROM gold WHERE target_intent IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'decision', decision, count(*) FROM gold GROUP BY 2
    UNION ALL SELECT 'overlap', 'near_oos+multi_turn', count(*) FROM gold WHERE sibling_intent IS NOT NULL AND case_id % 3 = 0""",
    "gold tags",
)
def a38(t):
    fact = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    both = F.when(L.has_tag("near_oos") & L.has_tag("multi_turn"), "near_oos+multi_turn")
    tags = F.transform("tags", lambda x: F.struct(F.lit("tag").alias("dimension"), x.alias("value")))
    facts = [fact("intent", F.col("target_intent")), fact("decision", F.col("decision")), fact("overlap", both)]
    return (
        t.gold.select(F.inline(F.concat(F.array(*facts), tags)))
        .filter("value IS NOT NULL")
        .groupBy("dimension", "value")
        .agg(F.count("*").alias("n"))
    )


def greedy_sql(phases, source, order, unit, item):
    """Phase by phase, each one looking only at what earlier phases took."""
    parts, taken = [], []
    for i, (where, quota) in enumerate(phases):
        before = " UNION ALL ".join(f"SELECT {unit} FROM ph{j}" for j in range(i)) or f"SELECT {unit} FROM {source} WHERE FALSE"
        parts.append(
            f"""ph{i} AS MATERIALIZED (SELECT {item}, {unit} FROM (SELECT *, row_number() OVER (PARTITION BY {unit} ORDER BY {order}) AS rn
         FROM {source} WHERE {where} AND {unit} NOT IN ({before})) z WHERE rn = 1 ORDER BY {order} LIMIT {quota})"""
        )
        taken.append(f"SELECT CAST({i} AS INTEGER) AS phase, {item} FROM ph{i}")
    return ", ".join(parts), " UNION ALL ".join(taken)


_AUDIT_PHASES = [(f"target_intent = '{i}'", 1) for i in INTENTS] + [(f"decision = '{d}'", 4) for d in DECISIONS]
_AUDIT = greedy_sql(_AUDIT_PHASES, "rk", "neg_risk, key", "cluster_id", "case_id")
RISK = """rk AS (SELECT g.case_id, any_value(cluster_id) AS cluster_id, any_value(decision) AS decision, any_value(target_intent) AS target_intent,
       -(count(DISTINCT CASE WHEN tag NOT IN ('single_turn', 'multi_turn') THEN tag END)
       + count(DISTINCT desired_experience) + count(DISTINCT object_slot)
       + 2 * count(DISTINCT CASE WHEN tag = 'multi_turn' THEN 1 END)
       + CASE WHEN min(horizon) <> 'now' THEN 3 ELSE 0 END + 8 * count(DISTINCT open_intent)) AS neg_risk,
       sha256('audit-v1|' || CAST(g.case_id AS VARCHAR)) AS key
     FROM gold g LEFT JOIN tags t ON g.case_id = t.case_id GROUP BY 1)"""


@query("w05_audit_sample", f"WITH {RISK}, {_AUDIT[0]} {_AUDIT[1]}", "gold tags")
def w05(t):
    return S.audit_sample(t.gold, INTENTS, "audit-v1")
