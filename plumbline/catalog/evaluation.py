"""Queries over gold and predictions: labels, joins, metrics, badcases and the run report."""

from pyspark.sql import functions as F

from plumbline.catalog.registry import query
from plumbline.functions import hashing as H
from plumbline.functions import labels as L
from plumbline.operators import evaluate as E
from plumbline.plans.run_report import run_report
from plumbline.schemas import DECISIONS, ERROR_PRIORITY, PREDICTED_DECISIONS, SLICE_TAGS
from plumbline.sources.views import ARMS, INTENTS


def values(name, items):
    rows = ", ".join(f"('{i}')" for i in items)
    return f"(VALUES {rows}) {name}_t({name})"


ARM_ROWS, TAG_ROWS = values("arm", ARMS), values("tag", SLICE_TAGS)
GOLD_ROWS, PRED_ROWS = values("decision", DECISIONS), values("pred_decision", PREDICTED_DECISIONS)
INTENT_ROWS = values("label", INTENTS)

BASIC = ["status", "decision", "predicted_intent"]


def labelled(t, need=BASIC):
    return E.join_predictions(t.gold, t.predictions, ARMS, need)


def counted(t):
    return E.outcome_counts(labelled(t), ["arm"])


@query("p01_decision_label", "SELECT arm, pred_decision, count(*) AS n FROM gp GROUP BY 1, 2", "gp")
def p01(t):
    return labelled(t).groupBy("arm", "pred_decision").agg(F.count("*").alias("n"))


@query("p02_intent_label", "SELECT arm, pred_intent, count(*) AS n FROM gp GROUP BY 1, 2", "gp")
def p02(t):
    return labelled(t).groupBy("arm", "pred_intent").agg(F.count("*").alias("n"))


@query("p03_exact_match", "SELECT arm, case_id, hit FROM gp", "gp")
def p03(t):
    return labelled(t).select("arm", "case_id", "hit")


@query(
    "p08_feature_flags",
    """SELECT g.case_id,
       max(CASE WHEN tag = 'near_oos' THEN 1 ELSE 0 END) AS near_oos,
       max(CASE WHEN tag = 'quiet_control' THEN 1 ELSE 0 END) AS quiet_control,
       max(CASE WHEN open_intent IS NOT NULL THEN 1 ELSE 0 END) AS open_intent_candidate,
       max(CASE WHEN horizon = 'later' THEN 1 ELSE 0 END) AS horizon_later,
       max(CASE WHEN horizon = 'unspecified' THEN 1 ELSE 0 END) AS horizon_unspecified
     FROM gold g LEFT JOIN tags t ON g.case_id = t.case_id GROUP BY 1""",
    "gold tags",
)
def p08(t):
    flags = L.feature_flags(["near_oos", "quiet_control"])
    return t.gold.select("case_id", *[c.alias(k) for k, c in flags.items()])


RISK_SQL = """SELECT g.case_id,
       CAST(count(DISTINCT CASE WHEN tag NOT IN ('single_turn', 'multi_turn') THEN tag END)
       + count(DISTINCT desired_experience) + count(DISTINCT object_slot)
       + 2 * count(DISTINCT CASE WHEN tag = 'multi_turn' THEN 1 END)
       + CASE WHEN min(horizon) <> 'now' THEN 3 ELSE 0 END + 8 * count(DISTINCT open_intent) AS BIGINT) AS risk
     FROM gold g LEFT JOIN tags t ON g.case_id = t.case_id GROUP BY 1"""


@query("p09_audit_risk", RISK_SQL, "gold tags")
def p09(t):
    return t.gold.select("case_id", L.audit_risk().alias("risk"))


@query("p10_stable_key", "SELECT case_id, sha256('audit-v1|' || CAST(case_id AS VARCHAR)) AS key FROM gold", "gold")
def p10(t):
    return t.gold.select("case_id", H.stable_key("audit-v1", "case_id").alias("key"))


@query(
    "p11_formal_ids",
    """SELECT case_id, 'case-' || lpad(CAST(case_id AS VARCHAR), 9, '0') AS formal_id,
       CASE WHEN CAST('0x' || substr(sha256('split|' || CAST(cluster_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 3
            THEN 'dev' ELSE 'test' END AS split FROM gold""",
    "gold",
)
def p11(t):
    groups = t.gold.select("cluster_id").distinct()
    assigned = groups.withColumn(
        "split",
        F.when(H.bucket(F.concat(F.lit("split|"), F.col("cluster_id").cast("string")), 10) < 3, "dev").otherwise("test"),
    )
    candidate = F.concat(F.lit("draft-"), F.lpad(F.col("case_id").cast("string"), 9, "0"))
    return t.gold.join(assigned, "cluster_id").select(
        "case_id", F.regexp_replace(candidate, "^draft-", "case-").alias("formal_id"), "split"
    )


@query(
    "j01_gold_left_predictions",
    "SELECT arm, case_id, coalesce(status, 'missing') AS status, pred_decision, pred_intent FROM gp",
    "gp",
)
def j01(t):
    return labelled(t).select(
        "arm", "case_id", F.coalesce("status", F.lit("missing")).alias("status"), "pred_decision", "pred_intent"
    )


PAIR_SQL = """WITH sig AS (SELECT gp.*, CASE WHEN status IS NULL THEN 'missing' ELSE status || '/' || coalesce(p_decision, '-')
        || '/' || coalesce(p_intent, '-') || '/' || coalesce(replace(candidates, '|', ','), '') END AS signature FROM gp),
 c AS (SELECT * FROM sig WHERE pair_kind LIKE 'ctx%' AND case_id % 2 = 0),
 d AS (SELECT * FROM sig WHERE pair_kind LIKE 'ctx%' AND case_id % 2 = 1),
 pairs AS (SELECT d.arm, d.contrast_id, d.case_id, c.case_id AS control_id,
        CASE WHEN c.signature <> d.signature THEN 1 ELSE 0 END AS flip,
        CASE WHEN c.hit = 1 AND d.hit = 0 THEN 1 ELSE 0 END AS adverse
   FROM d JOIN c ON c.arm = d.arm AND c.contrast_id = d.contrast_id) """


def pairs(t):
    tagged = t.gold.filter(L.has_tag("context_control") | L.has_tag("context_distractor"))
    return E.context_pairs(E.join_predictions(tagged, t.predictions, ARMS, [*BASIC, "candidate_intents"]))


@query("j02_context_pairs", PAIR_SQL + "SELECT arm, contrast_id, case_id, control_id FROM pairs", "gp")
def j02(t):
    return pairs(t).select("arm", "contrast_id", "case_id", "control_id")


SIBLINGS = """SELECT g.case_id, g.contrast_id, g.target_intent FROM gold g WHERE decision = 'in_scope' AND EXISTS
   (SELECT 1 FROM gold n WHERE n.sibling_intent = g.target_intent AND n.contrast_id = g.contrast_id)"""


@query("j03_near_siblings", SIBLINGS, "gold")
def j03(t):
    return E.near_siblings(t.gold).select("case_id", "contrast_id", "target_intent")


@query("a01_hem", "SELECT arm, count(*) AS n, avg(hit) AS hem FROM gp GROUP BY 1", "gp")
def a01(t):
    return E.hit_rate(counted(t), ["arm"]).select("arm", "n", "hem")


def prf_sql(rows, gold, pred, where="TRUE", extra=""):
    return f"""WITH tally AS (SELECT a.arm, l.label,
      count(*) FILTER ({gold} = label AND {pred} = label) AS tp,
      count(*) FILTER ({gold} IS DISTINCT FROM label AND {pred} = label) AS fp,
      count(*) FILTER ({gold} = label AND {pred} <> label) AS fn
    FROM {ARM_ROWS.replace('arm_t', 'a')} CROSS JOIN {rows.replace('label_t', 'l')}
    LEFT JOIN (SELECT * FROM gp WHERE {where}) x ON x.arm = a.arm GROUP BY 1, 2),
   rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM tally),
   prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
      ELSE 0.0::DOUBLE END AS f1 FROM rates) {extra}"""


DECISION_PRF = prf_sql(values("label", DECISIONS), "decision", "pred_decision")
INTENT_PRF = prf_sql(INTENT_ROWS, "target_intent", "pred_intent", "decision = 'in_scope'")


def decision_tallies(t):
    return E.label_counts(counted(t), ["arm"], "decision", "pred_decision", DECISIONS)


def intent_tallies(t):
    return E.label_counts(E.in_scope(counted(t)), ["arm"], "target_intent", "pred_intent", INTENTS)


@query(
    "a02_decision_prf",
    DECISION_PRF + "SELECT arm, label, tp, fp, fn, precision, recall, f1 FROM prf",
    "gp",
)
def a02(t):
    return E.with_prf(decision_tallies(t))


@query(
    "a03_decision_macro_f1",
    DECISION_PRF + "SELECT arm, round(avg(f1), 9) AS macro_f1 FROM prf GROUP BY 1",
    "gp",
)
def a03(t):
    return E.macro_f1(decision_tallies(t), ["arm"], "macro_f1")


@query("a04_intent_macro_f1", INTENT_PRF + "SELECT arm, round(avg(f1), 9) AS macro_f1 FROM prf GROUP BY 1", "gp")
def a04(t):
    return E.macro_f1(intent_tallies(t), ["arm"], "macro_f1")


@query("a05_intent_recall", INTENT_PRF + "SELECT arm, label, recall FROM prf", "gp")
def a05(t):
    return E.with_prf(intent_tallies(t)).select("arm", "label", "recall")


CONFUSION_SQL = f"""WITH grid AS (SELECT * FROM {ARM_ROWS} CROSS JOIN {GOLD_ROWS} CROSS JOIN {PRED_ROWS}),
 cells AS (SELECT g.arm, g.decision, g.pred_decision, count(x.case_id) AS n FROM grid g
   LEFT JOIN gp x ON x.arm = g.arm AND x.decision = g.decision AND x.pred_decision = g.pred_decision GROUP BY 1, 2, 3) """


@query("a06_confusion", CONFUSION_SQL + "SELECT * FROM cells", "gp")
def a06(t):
    return E.confusion(counted(t), ["arm"])


NORMAL_SQL = (
    CONFUSION_SQL
    + """SELECT arm, decision, pred_decision, n, CAST(sum(n) OVER w AS BIGINT) AS gold_count,
   round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0.0::DOUBLE END, 6) AS row_fraction
   FROM cells WINDOW w AS (PARTITION BY arm, decision)"""
)


@query("a07_normalised_confusion", NORMAL_SQL, "gp")
def a07(t):
    return E.normalised_confusion(counted(t), ["arm"])


@query(
    "a08_failures",
    f"""SELECT a.arm, f.failure, count(x.case_id) AS n FROM {ARM_ROWS.replace('arm_t', 'a')}
    CROSS JOIN (VALUES ('missing'), ('provider_failure'), ('schema_invalid')) f(failure)
    LEFT JOIN gp x ON x.arm = a.arm AND coalesce(x.status, 'missing') = f.failure GROUP BY 1, 2""",
    "gp",
)
def a08(t):
    return E.failure_counts(labelled(t), ["arm"])


@query(
    "a09_near_oos_recall",
    """SELECT arm, count(*) AS n, count(*) FILTER (pred_decision = 'oos') AS hits,
     avg(CASE WHEN pred_decision = 'oos' THEN 1 ELSE 0 END) AS recall
     FROM gp WHERE sibling_intent IS NOT NULL GROUP BY 1""",
    "gp",
)
def a09(t):
    return E.tagged_recall(labelled(t), "near_oos", "oos")


@query(
    "a10_sibling_false_reject",
    f"""WITH s AS ({SIBLINGS}) SELECT arm, count(*) AS n, count(*) FILTER (pred_decision = 'oos') AS false_rejects,
     avg(CASE WHEN pred_decision = 'oos' THEN 1 ELSE 0 END) AS rate FROM gp WHERE case_id IN (SELECT case_id FROM s) GROUP BY 1""",
    "gold gp",
)
def a10(t):
    return E.sibling_false_rejects(E.join_predictions(E.near_siblings(t.gold), t.predictions, ARMS, BASIC))


@query(
    "a11_context_errors",
    """SELECT arm, count(*) FILTER (case_id % 2 = 1 AND hit = 0) AS distractor_errors,
     count(*) FILTER (case_id % 2 = 0 AND hit = 0) AS control_errors,
     count(*) FILTER (case_id % 2 = 1 AND hit = 0) - count(*) FILTER (case_id % 2 = 0 AND hit = 0) AS delta
     FROM gp WHERE pair_kind LIKE 'ctx%' GROUP BY 1""",
    "gp",
)
def a11(t):
    return E.context_errors(labelled(t))


@query(
    "a12_flip_rate",
    PAIR_SQL
    + "SELECT arm, count(*) AS pairs, CAST(sum(flip) AS BIGINT) AS flips, avg(flip) AS flip_rate FROM pairs GROUP BY 1",
    "gp",
)
def a12(t):
    return E.flip_rates(pairs(t)).select("arm", "pairs", "flips", "flip_rate")


@query(
    "a13_adverse_flip_rate",
    PAIR_SQL
    + """SELECT arm, count(*) AS pairs, CAST(sum(adverse) AS BIGINT) AS adverse_flips, avg(adverse) AS adverse_rate
     FROM pairs GROUP BY 1""",
    "gp",
)
def a13(t):
    return E.flip_rates(pairs(t)).select("arm", "pairs", "adverse_flips", "adverse_rate")


SLICE_SQL = f"""SELECT a.arm, k.tag, count(x.case_id) AS case_count, count(DISTINCT x.cluster_id) AS cluster_count,
     coalesce(avg(x.hit), 0.0::DOUBLE) AS hem,
     coalesce(avg(CASE WHEN x.case_id IS NULL THEN NULL WHEN x.pred_decision = x.decision THEN 1 ELSE 0 END), 0.0::DOUBLE)
       AS decision_accuracy
   FROM {ARM_ROWS.replace('arm_t', 'a')} CROSS JOIN {TAG_ROWS.replace('tag_t', 'k')}
   LEFT JOIN (SELECT gp.*, tags.tag FROM gp JOIN tags ON gp.case_id = tags.case_id) x
     ON x.arm = a.arm AND x.tag = k.tag GROUP BY 1, 2"""


@query("a14_slice_metrics", SLICE_SQL, "gp tags")
def a14(t):
    return E.slice_metrics(labelled(t), t.gold, ARMS)


SLICE_CONFUSION_SQL = f"""SELECT a.arm, k.tag, g.decision, p.pred_decision, count(x.case_id) AS n
   FROM {ARM_ROWS.replace('arm_t', 'a')} CROSS JOIN {TAG_ROWS.replace('tag_t', 'k')}
   CROSS JOIN {GOLD_ROWS.replace('decision_t', 'g')} CROSS JOIN {PRED_ROWS.replace('pred_decision_t', 'p')}
   LEFT JOIN (SELECT gp.*, tags.tag FROM gp JOIN tags ON gp.case_id = tags.case_id) x
     ON x.arm = a.arm AND x.tag = k.tag AND x.decision = g.decision AND x.pred_decision = p.pred_decision
   GROUP BY 1, 2, 3, 4"""


@query("a15_slice_confusion", SLICE_CONFUSION_SQL, "gp tags")
def a15(t):
    return E.slice_confusion(labelled(t), ARMS)


OVERLAP_SQL = f"""SELECT l.tag AS left_tag, r.tag AS right_tag, count(x.case_id) AS n
   FROM {TAG_ROWS.replace('tag_t', 'l')} CROSS JOIN {TAG_ROWS.replace('tag_t', 'r')}
   LEFT JOIN (SELECT a.tag AS lt, b.tag AS rt, a.case_id FROM tags a JOIN tags b ON a.case_id = b.case_id) x
     ON x.lt = l.tag AND x.rt = r.tag GROUP BY 1, 2"""


@query("a16_slice_overlap", OVERLAP_SQL, "tags")
def a16(t):
    return E.slice_overlap(t.gold)


@query(
    "a17_competitor_hits",
    """SELECT arm, count(*) AS n, count(*) FILTER (pred_intent = competitor) AS hits,
     avg(CASE WHEN pred_intent = competitor THEN 1 ELSE 0 END) AS rate FROM gp WHERE competitor IS NOT NULL GROUP BY 1""",
    "gp",
)
def a17(t):
    return E.competitor_hits(labelled(t))


@query(
    "a18_slots",
    """WITH s AS (SELECT arm,
       CASE WHEN status = 'success' AND (desired_experience IS NULL OR p_experience IS NOT NULL)
                 AND (object_slot IS NULL OR p_object IS NOT NULL) THEN 1 ELSE 0 END AS c,
       CASE WHEN status = 'success' AND p_horizon = horizon THEN 1 ELSE 0 END AS h FROM gp WHERE decision = 'in_scope')
     SELECT arm, count(*) AS n, CAST(sum(c) AS BIGINT) AS complete, CAST(sum(h) AS BIGINT) AS horizon_right,
       avg(c) AS completeness, avg(h) AS horizon_accuracy FROM s GROUP BY 1""",
    "gp",
)
def a18(t):
    return E.slot_metrics(labelled(t, [*BASIC, "horizon", "desired_experience", "object_slot"]))


@query(
    "a19_quiet_recall",
    """SELECT arm, count(*) AS n, count(*) FILTER (pred_decision = 'no_intent') AS hits,
     avg(CASE WHEN pred_decision = 'no_intent' THEN 1 ELSE 0 END) AS recall
     FROM gp WHERE decision = 'no_intent' GROUP BY 1""",
    "gp",
)
def a19(t):
    return E.tagged_recall(labelled(t), "quiet_control", "no_intent")


REPORT_SQL = (
    PAIR_SQL
    + f""", s AS ({SIBLINGS}),
 dtally AS (SELECT arm, label, count(*) FILTER (decision = label AND pred_decision = label) AS tp,
     count(*) FILTER (decision <> label AND pred_decision = label) AS fp,
     count(*) FILTER (decision = label AND pred_decision <> label) AS fn
   FROM gp CROSS JOIN {values("label", DECISIONS)} GROUP BY 1, 2),
 itally AS (SELECT arm, label, count(*) FILTER (target_intent = label AND pred_intent = label) AS tp,
     count(*) FILTER (target_intent <> label AND pred_intent = label) AS fp,
     count(*) FILTER (target_intent = label AND pred_intent <> label) AS fn
   FROM gp CROSS JOIN {INTENT_ROWS} WHERE decision = 'in_scope' GROUP BY 1, 2),
 drate AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
     CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM dtally),
 irate AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
     CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM itally),
 dprf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM drate),
 iprf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM irate),
 slot AS (SELECT arm,
       CASE WHEN status = 'success' AND (desired_experience IS NULL OR p_experience IS NOT NULL)
                 AND (object_slot IS NULL OR p_object IS NOT NULL) THEN 1 ELSE 0 END AS c,
       CASE WHEN status = 'success' AND p_horizon = horizon THEN 1 ELSE 0 END AS h FROM gp WHERE decision = 'in_scope'),
 slices AS ({SLICE_SQL}), scells AS ({SLICE_CONFUSION_SQL}), overlap AS ({OVERLAP_SQL}),
 grid AS (SELECT * FROM {ARM_ROWS} CROSS JOIN {GOLD_ROWS} CROSS JOIN {PRED_ROWS}),
 cells AS (SELECT g.arm, g.decision, g.pred_decision, count(x.case_id) AS n FROM grid g
   LEFT JOIN gp x ON x.arm = g.arm AND x.decision = g.decision AND x.pred_decision = g.pred_decision GROUP BY 1, 2, 3),
 tall AS (
  SELECT arm, 'all' AS slice, 'gold_case_count' AS metric, count(*)::DOUBLE AS value FROM gp GROUP BY 1
  UNION ALL SELECT arm, 'all', 'prediction_count', count(status) FROM gp GROUP BY 1
  UNION ALL SELECT arm, 'all', 'hierarchical_exact_match', avg(hit) FROM gp GROUP BY 1
  UNION ALL SELECT arm, 'all', 'near_oos_recall', avg(CASE WHEN pred_decision = 'oos' THEN 1 ELSE 0 END)
    FROM gp WHERE sibling_intent IS NOT NULL GROUP BY 1
  UNION ALL SELECT arm, 'all', 'sibling_false_reject_rate', avg(CASE WHEN pred_decision = 'oos' THEN 1 ELSE 0 END)
    FROM gp WHERE case_id IN (SELECT case_id FROM s) GROUP BY 1
  UNION ALL SELECT arm, 'all', 'context_distractor_errors', count(*) FROM gp
    WHERE pair_kind LIKE 'ctx%' AND case_id % 2 = 1 AND hit = 0 GROUP BY 1
  UNION ALL SELECT arm, 'all', 'context_control_errors', count(*) FROM gp
    WHERE pair_kind LIKE 'ctx%' AND case_id % 2 = 0 AND hit = 0 GROUP BY 1
  UNION ALL SELECT arm, 'all', 'context_error_delta', sum(CASE WHEN case_id % 2 = 1 THEN 1 ELSE -1 END) FROM gp
    WHERE pair_kind LIKE 'ctx%' AND hit = 0 GROUP BY 1
  UNION ALL SELECT arm, 'all', 'hard_negative_hits', count(*) FILTER (pred_intent = competitor) FROM gp
    WHERE competitor IS NOT NULL GROUP BY 1
  UNION ALL SELECT arm, 'all', 'hard_negative_hit_rate', avg(CASE WHEN pred_intent = competitor THEN 1 ELSE 0 END) FROM gp
    WHERE competitor IS NOT NULL GROUP BY 1
  UNION ALL SELECT arm, 'all', 'slot_completeness', avg(c) FROM slot GROUP BY 1
  UNION ALL SELECT arm, 'all', 'horizon_accuracy', avg(h) FROM slot GROUP BY 1
  UNION ALL SELECT arm, 'all', 'quiet_control_recall', avg(CASE WHEN pred_decision = 'no_intent' THEN 1 ELSE 0 END)
    FROM gp WHERE decision = 'no_intent' GROUP BY 1
  UNION ALL SELECT arm, 'all', 'failures_missing', count(*) FILTER (status IS NULL) FROM gp GROUP BY 1
  UNION ALL SELECT arm, 'all', 'failures_provider_failure', count(*) FILTER (status = 'provider_failure') FROM gp GROUP BY 1
  UNION ALL SELECT arm, 'all', 'failures_schema_invalid', count(*) FILTER (status = 'schema_invalid') FROM gp GROUP BY 1
  UNION ALL SELECT arm, 'all', 'decision_macro_f1', avg(f) FROM dprf GROUP BY 1
  UNION ALL SELECT arm, 'all', 'intent_macro_f1', avg(f) FROM iprf GROUP BY 1
  UNION ALL SELECT arm, label, 'precision', p FROM dprf UNION ALL SELECT arm, label, 'recall', r FROM dprf
  UNION ALL SELECT arm, label, 'f1', f FROM dprf UNION ALL SELECT arm, label, 'intent_recall', r FROM iprf
  UNION ALL SELECT arm, decision || '>' || pred_decision, 'confusion', n FROM cells
  UNION ALL SELECT arm, 'all', 'context_pairs', count(*) FROM pairs GROUP BY 1
  UNION ALL SELECT arm, 'all', 'flip_rate', avg(flip) FROM pairs GROUP BY 1
  UNION ALL SELECT arm, 'all', 'adverse_flip_rate', avg(adverse) FROM pairs GROUP BY 1
  UNION ALL SELECT arm, tag, 'case_count', case_count FROM slices
  UNION ALL SELECT arm, tag, 'cluster_count', cluster_count FROM slices
  UNION ALL SELECT arm, tag, 'hem', hem FROM slices
  UNION ALL SELECT arm, tag, 'decision_accuracy', decision_accuracy FROM slices
  UNION ALL SELECT arm, tag || '>' || decision || '>' || pred_decision, 'slice_confusion', n FROM scells
  UNION ALL SELECT '-', left_tag || '>' || right_tag, 'slice_overlap', n FROM overlap)
SELECT arm, slice, metric, round(value, 9) AS value FROM tall"""
)


@query("a20_run_report", REPORT_SQL, "gold tags gp")
def a20(t):
    return run_report(t.gold, t.predictions, ARMS, INTENTS)


#: Arm B says the same of some cases twice, and has cases that gold does not have.
VALIDITY_SQL = """broken AS (SELECT arm, case_id FROM predictions
   UNION ALL SELECT arm, case_id FROM predictions WHERE arm = 'B' AND case_id % 50 = 7
   UNION ALL SELECT arm, case_id + 10000000 FROM predictions WHERE arm = 'B' AND case_id % 50 = 9),
 refused AS (SELECT arm, CAST(count(*) FILTER (n > 1) AS DOUBLE) AS repeated,
     CAST(count(*) FILTER (case_id NOT IN (SELECT case_id FROM gold)) AS DOUBLE) AS strange
   FROM (SELECT arm, case_id, count(*) AS n FROM broken GROUP BY 1, 2) z GROUP BY 1 HAVING repeated > 0 OR strange > 0)"""


def broken_runs(predictions):
    of_b = predictions.filter("arm = 'B'")
    again = of_b.filter("case_id % 50 = 7")
    strange = of_b.filter("case_id % 50 = 9").withColumn("case_id", F.col("case_id") + 10000000)
    return predictions.unionByName(again).unionByName(strange)


@query(
    "a20_invalid_runs",
    REPORT_SQL.removesuffix("SELECT arm, slice, metric, round(value, 9) AS value FROM tall")
    + f""", {VALIDITY_SQL}
   SELECT arm, slice, metric, CASE WHEN arm NOT IN (SELECT arm FROM refused) THEN round(value, 9) END AS value FROM tall
   UNION ALL SELECT arm, 'all', 'repeated_predictions', repeated FROM refused
   UNION ALL SELECT arm, 'all', 'unknown_predictions', strange FROM refused""",
    "gold tags gp",
)
def a20_invalid(t):
    return run_report(t.gold, broken_runs(t.predictions), ARMS, INTENTS)


BAD_SQL = (
    PAIR_SQL
    + """, e AS (SELECT gp.arm, gp.case_id, status,
     CASE WHEN status IS NULL THEN 'missing_prediction' WHEN status <> 'success' THEN status
          WHEN gp.decision <> p_decision THEN
            CASE WHEN decision = 'in_scope' AND p_decision = 'oos' THEN 'known_intent_false_reject'
                 WHEN decision = 'oos' AND p_decision = 'in_scope' THEN 'oos_false_accept'
                 WHEN decision = 'no_intent' THEN 'no_intent_overaction'
                 WHEN decision = 'ambiguous' AND p_decision = 'in_scope' THEN 'ambiguity_forced_choice'
                 ELSE 'decision_mismatch' END
          WHEN gp.hit = 0 THEN 'intent_misroute' END AS route,
     CASE WHEN pred_intent = competitor THEN 'hard_negative_competitor_hit' END AS comp,
     CASE WHEN pairs.adverse = 1 THEN 'context_adverse_flip' END AS adv,
     CASE WHEN status = 'success' AND decision = 'in_scope' AND desired_experience IS NOT NULL AND p_experience IS NULL
          THEN 'desired_experience_missing' END AS exp_,
     CASE WHEN status = 'success' AND decision = 'in_scope' AND object_slot IS NOT NULL AND p_object IS NULL
          THEN 'object_missing' END AS obj,
     CASE WHEN status = 'success' AND decision = 'in_scope' AND p_horizon IS DISTINCT FROM horizon
          THEN 'horizon_mismatch' END AS hor
   FROM gp LEFT JOIN pairs ON pairs.arm = gp.arm AND pairs.case_id = gp.case_id),
 bad AS (SELECT arm, case_id, coalesce(status, 'missing') AS prediction_status, route, comp, adv, exp_, obj, hor,
     concat_ws(',', route, comp, adv, exp_, obj, hor) AS error_types,
     coalesce(route, comp, adv, exp_, obj, hor) AS first_error FROM e WHERE coalesce(route, comp, adv, exp_, obj, hor) IS NOT NULL) """
)
SLOTS = [*BASIC, "candidate_intents", "horizon", "desired_experience", "object_slot"]


def bad(t):
    return E.badcases(labelled(t, SLOTS))


@query("a21_badcases", BAD_SQL + "SELECT arm, case_id, prediction_status, error_types FROM bad", "gp")
def a21(t):
    return bad(t).select(
        "arm",
        "case_id",
        F.coalesce("status", F.lit("missing")).alias("prediction_status"),
        F.array_join("errors", ",").alias("error_types"),
    )


@query(
    "a22_badcase_error_counts",
    BAD_SQL
    + f""", one AS (SELECT arm, unnest([route, comp, adv, exp_, obj, hor]) AS error FROM bad)
    SELECT a.arm, k.error, count(o.error) AS n FROM {ARM_ROWS.replace('arm_t', 'a')}
    CROSS JOIN {values("error", ERROR_PRIORITY).replace('error_t', 'k')}
    LEFT JOIN one o ON o.arm = a.arm AND o.error = k.error GROUP BY 1, 2""",
    "gp",
)
def a22(t):
    return E.badcase_error_counts(bad(t), ARMS)


_PRIORITY = " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(ERROR_PRIORITY, 1))


@query(
    "w02_badcase_order",
    BAD_SQL
    + f"""SELECT arm, case_id, first_error, CAST(CASE first_error {_PRIORITY} END AS BIGINT) AS priority
    FROM bad ORDER BY arm, priority, case_id""",
    "gp",
)
def w02(t):
    return E.ordered_badcases(bad(t)).select("arm", "case_id", F.col("errors")[0].alias("first_error"), "priority")
