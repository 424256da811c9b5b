"""Queries for the data-quality rules. Each runs on a clean view with a known slice of broken rows put in."""

from pyspark.sql import functions as F

from plumbline.catalog.registry import query
from plumbline.functions import hashing as H
from plumbline.functions import labels as L
from plumbline.functions import text as X
from plumbline.operators import quality as Q
from plumbline.operators.budget import TOKEN_FIELDS, merged_predictions
from plumbline.operators.components import components
from plumbline.schemas import DECISIONS, PATTERN_TAGS, SLICE_TAGS
from plumbline.sources.views import ARMS, INTENTS


def hit(rule, column, modulus=50):
    return H.bucket(F.concat(F.lit(f"m|{rule}|"), F.col(column).cast("string")), modulus) == 0


def mut(rule, column, modulus=50):
    return f"(CAST('0x' || substr(sha256('m|{rule}|' || CAST({column} AS VARCHAR)), 1, 8) AS BIGINT) % {modulus} = 0)"


def clauses(source, rule, key, parts):
    """Independent SQL form of a clause list: one SELECT per clause."""
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, CAST({key} AS VARCHAR) AS key, '{name}' AS detail FROM {source} WHERE {condition}"
        for name, condition in parts.items()
    )


@query(
    "v01_duplicate_ids",
    f"""WITH p AS (SELECT arm, case_id FROM predictions UNION ALL
        SELECT arm, case_id FROM predictions WHERE {mut('V01', 'case_id')})
    SELECT 'V01' AS rule, arm || '|' || case_id AS key, CAST(count(*) AS VARCHAR) AS detail
    FROM p GROUP BY arm, case_id HAVING count(*) > 1""",
    "predictions",
)
def v01(t):
    p = t.predictions.select("arm", "case_id")
    return Q.duplicate_ids(p.unionByName(p.filter(hit("V01", "case_id"))), ["arm", "case_id"])


@query(
    "v02_extra_predictions",
    f"""WITH p AS (SELECT arm, case_id + CASE WHEN {mut('V02', 'case_id')} THEN 10000000 ELSE 0 END AS case_id FROM predictions)
    SELECT 'V02' AS rule, arm || '|' || case_id AS key, 'not_in_gold' AS detail FROM p
    WHERE case_id NOT IN (SELECT case_id FROM gold)""",
    "gold predictions",
)
def v02(t):
    shifted = F.col("case_id") + F.when(hit("V02", "case_id"), 10000000).otherwise(0)
    return Q.extra_predictions(t.predictions.select("arm", shifted.alias("case_id")), t.gold)


@query(
    "v03_gold_truth_table",
    f"""WITH g AS (SELECT case_id, decision, CASE WHEN {mut('V03', 'case_id')} AND decision = 'in_scope' THEN NULL
          WHEN {mut('V03b', 'case_id')} AND decision <> 'in_scope' THEN 'intent_0' ELSE target_intent END AS target,
          {mut('V03c', 'case_id')} AND sibling_intent IS NOT NULL AS twice FROM gold)
    """
    + clauses(
        "g",
        "V03",
        "case_id",
        {
            "target_missing": "decision = 'in_scope' AND target IS NULL",
            "target_unexpected": "decision <> 'in_scope' AND target IS NOT NULL",
            "siblings_repeated": "twice",
        },
    ),
    "gold",
)
def v03(t):
    inside = F.col("decision") == "in_scope"
    broken = (
        F.when(hit("V03", "case_id") & inside, None)
        .when(hit("V03b", "case_id") & ~inside, "intent_0")
        .otherwise(F.col("target_intent"))
    )
    twice = F.when(hit("V03c", "case_id"), F.concat("siblings", "siblings")).otherwise(F.col("siblings"))
    return Q.gold_truth_table(t.gold.withColumns({"target_intent": broken, "siblings": twice}))


V04_SQL = f"""WITH p AS (SELECT arm, case_id, status, decision, horizon,
     CASE WHEN {mut('V04a', 'case_id')} THEN 'intent_0' ELSE predicted_intent END AS target,
     CASE WHEN {mut('V04b', 'case_id')} THEN CASE WHEN error_type IS NULL THEN 'x' END ELSE error_type END AS err,
     CASE WHEN {mut('V04c', 'case_id')} THEN 'intent_1' WHEN {mut('V04e', 'case_id')} THEN 'intent_0|intent_0'
          ELSE candidates END AS cand,
     CASE WHEN {mut('V04d', 'case_id')} THEN NULL WHEN {mut('V04f', 'case_id')} THEN repeat('long', 51) ELSE reason_short END AS reason
   FROM predictions),
 q AS (SELECT *, arm || '|' || case_id AS k,
     CASE WHEN cand = '' THEN 0 ELSE len(string_split(cand, '|')) END AS nc,
     CASE WHEN cand = '' THEN 0 ELSE len(list_distinct(string_split(cand, '|'))) END AS dc FROM p) """ + clauses(
    "q",
    "V04",
    "k",
    {
        "failed_with_semantics": "status <> 'success' AND coalesce(decision, target, horizon, reason, cand) IS NOT NULL",
        "failed_without_error": "status <> 'success' AND err IS NULL",
        "success_with_error": "status = 'success' AND err IS NOT NULL",
        "success_without_decision": "status = 'success' AND (decision IS NULL OR cand IS NULL)",
        "success_without_slots": "status = 'success' AND (horizon IS NULL OR reason IS NULL)",
        "reason_too_long": "status = 'success' AND length(reason) > 200",
        "candidates_repeated": "status = 'success' AND nc <> dc",
        "in_scope_contract": "status = 'success' AND decision = 'in_scope' AND (target IS NULL OR nc > 0)",
        "rejection_with_target": "status = 'success' AND decision <> 'in_scope' AND target IS NOT NULL",
        "ambiguous_with_one": "status = 'success' AND decision = 'ambiguous' AND nc = 1",
        "candidates_not_allowed": "status = 'success' AND decision IN ('oos', 'no_intent') AND nc > 0",
    },
)


@query("v04_prediction_truth_table", V04_SQL, "predictions")
def v04(t):
    c = F.col
    one, two = F.array(F.lit("intent_1")), F.array(F.lit("intent_0"), F.lit("intent_0"))
    return Q.prediction_truth_table(
        t.predictions.withColumns(
            {
                "predicted_intent": F.when(hit("V04a", "case_id"), "intent_0").otherwise(c("predicted_intent")),
                "error_type": F.when(hit("V04b", "case_id"), F.when(c("error_type").isNull(), "x")).otherwise(
                    c("error_type")
                ),
                "candidate_intents": F.when(hit("V04c", "case_id"), one)
                .when(hit("V04e", "case_id"), two)
                .otherwise(c("candidate_intents")),
                "reason_short": F.when(hit("V04d", "case_id"), None)
                .when(hit("V04f", "case_id"), F.repeat(F.lit("long"), 51))
                .otherwise(c("reason_short")),
            }
        )
    )


@query(
    "v05_usage_totals",
    f"""SELECT 'V05' AS rule, CAST(event_id AS VARCHAR) AS key, '1' AS detail FROM calls
    WHERE total_tokens IS NOT NULL AND {mut('V05', 'event_id')}""",
    "calls",
)
def v05(t):
    off = F.col("total_tokens") + F.when(hit("V05", "event_id"), 1).otherwise(0)
    return Q.usage_totals(t.calls.withColumn("total_tokens", off), F.col("event_id"))


@query(
    "v06_unknown_labels",
    f"""WITH r AS (
      SELECT 'case|' || case_id AS key, 'target' AS kind,
        CASE WHEN {mut('V06', 'case_id')} AND target_intent IS NOT NULL THEN 'intent_9' ELSE target_intent END AS label FROM gold
      UNION ALL SELECT 'case|' || case_id, 'sibling', CASE WHEN {mut('V06b', 'case_id')} AND sibling_intent IS NOT NULL
        THEN 'intent_8' ELSE sibling_intent END FROM gold
      UNION ALL SELECT 'case|' || case_id, 'competitor', competitor FROM gold
      UNION ALL SELECT arm || '|' || case_id, 'predicted', CASE WHEN {mut('V06c', 'case_id')} THEN 'intent_7' ELSE predicted_intent END
        FROM predictions WHERE predicted_intent IS NOT NULL)
    SELECT 'V06' AS rule, key, kind || ':' || label AS detail FROM r WHERE label IN ('intent_7', 'intent_8', 'intent_9')""",
    "gold predictions",
)
def v06(t):
    c = F.col
    gold = t.gold.withColumns(
        {
            "target_intent": F.when(hit("V06", "case_id") & c("target_intent").isNotNull(), "intent_9").otherwise(
                c("target_intent")
            ),
            "siblings": F.when(
                hit("V06b", "case_id"), F.transform("siblings", lambda s: F.lit("intent_8"))
            ).otherwise(c("siblings")),
        }
    )
    named = Q.label_references(gold).withColumn("key", F.concat(F.lit("case|"), "key"))
    changed = F.when(hit("V06c", "case_id") & c("predicted_intent").isNotNull(), "intent_7").otherwise(c("predicted_intent"))
    predicted = Q.prediction_references(t.predictions.withColumn("predicted_intent", changed))
    return Q.unknown_labels(named.unionByName(predicted), known_intents(t))


def known_intents(t):
    return t.gold.filter("target_intent IS NOT NULL").select(F.col("target_intent").alias("name")).distinct()


@query(
    "v06_unknown_activities",
    f"""WITH r AS (
      SELECT 'case|' || case_id AS key, 'perturbation' AS kind,
        CASE WHEN {mut('V06d', 'case_id', 10)} AND perturbation IS NOT NULL THEN 'intent_9' ELSE perturbation END AS label FROM gold
      UNION ALL SELECT 'case|' || case_id, 'recent_activity', CASE WHEN {mut('V06e', 'case_id', 10)} AND recent_activity IS NOT NULL
        THEN 'intent_8' ELSE recent_activity END FROM gold
      UNION ALL SELECT arm || '|' || case_id, 'candidate', CASE WHEN {mut('V06f', 'case_id', 3)} THEN 'intent_7' ELSE 'intent_1' END
        FROM predictions WHERE candidates = 'intent_0|intent_1')
    SELECT 'V06' AS rule, key, kind || ':' || label AS detail FROM r WHERE label IN ('intent_7', 'intent_8', 'intent_9')""",
    "gold predictions",
)
def v06_activities(t):
    """Mutated perturbations, recent activities and second candidates."""
    c = F.col

    def unknown(rule, column, label):
        return F.when(hit(rule, "case_id", 10) & c(column).isNotNull(), label).otherwise(c(column))

    gold = t.gold.withColumns(
        {
            "perturbation": unknown("V06d", "perturbation", "intent_9"),
            "recent_activity": unknown("V06e", "recent_activity", "intent_8"),
        }
    )
    named = Q.label_references(gold).withColumn("key", F.concat(F.lit("case|"), "key"))
    second = F.transform("candidate_intents", lambda s: F.when((s == "intent_1") & hit("V06f", "case_id", 3), "intent_7").otherwise(s))
    predicted = Q.prediction_references(t.predictions.withColumn("candidate_intents", second))
    return Q.unknown_labels(named.unionByName(predicted), known_intents(t))


QUOTE_SQL = f"""quotes AS (SELECT conv_id, CASE WHEN {mut('V07', 'conv_id', 10)} THEN '#' ELSE '' END
      || substr(text, 1, 24) AS quote FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
      FROM conversations) z WHERE rn = 1)"""


def quotes(t):
    last = t.conversations.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return last.select(
        "conv_id",
        F.concat(F.when(hit("V07", "conv_id", 10), "#").otherwise(""), F.substring("text", 1, 24)).alias("quote"),
    )


@query(
    "v07_evidence_in_context",
    f"""WITH {QUOTE_SQL} SELECT 'V07' AS rule, CAST(q.conv_id AS VARCHAR) AS key, 'quote_not_in_context' AS detail FROM quotes q
    WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = q.conv_id
       AND contains(replace(replace(c.text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
                    replace(replace(q.quote, chr(13) || chr(10), chr(10)), chr(13), chr(10))))""",
)
def v07(t):
    return Q.evidence_in_turns(quotes(t), t.conversations, "conv_id")


V08_SQL = f"""WITH tg AS (SELECT case_id, tag FROM tags WHERE NOT (tag = 'hard_negative' AND {mut('V08', 'case_id')})
     UNION ALL SELECT case_id, 'near_oos' FROM gold WHERE {mut('V08b', 'case_id')}
     UNION ALL SELECT case_id, 'context_control' FROM gold WHERE {mut('V08c', 'case_id')}),
 g AS (SELECT g.case_id, any_value(decision) AS decision, any_value(perturbation) AS perturbation, any_value(sibling_intent) AS s,
     any_value(CASE WHEN NOT {mut('V08d', 'g.case_id')} THEN competitor END) AS c, count(*) AS nt, count(DISTINCT tag) AS dt,
     count(DISTINCT tag) FILTER (tag LIKE 'context%') AS ctx, count(*) FILTER (tag = 'near_oos') > 0 AS near,
     count(*) FILTER (tag = 'hard_negative') > 0 AS hard, count(*) FILTER (tag = 'quiet_control') > 0 AS quiet
   FROM gold g JOIN tg ON g.case_id = tg.case_id GROUP BY g.case_id) """ + clauses(
    "g",
    "V08",
    "case_id",
    {
        "tags_repeated": "nt <> dt",
        "both_context_tags": "ctx > 1",
        "perturbation_mismatch": "(ctx > 0) <> (perturbation IS NOT NULL)",
        "near_oos_not_oos": "near AND decision <> 'oos'",
        "near_oos_without_sibling": "near AND s IS NULL",
        "near_oos_not_hard": "near AND NOT hard",
        "sibling_without_near_oos": "NOT near AND s IS NOT NULL",
        "hard_without_competitor": "hard AND c IS NULL",
        "hard_in_scope": "hard AND decision = 'in_scope'",
        "hard_ambiguous_needs_two": "hard AND decision = 'ambiguous'",
        "competitor_without_hard": "NOT hard AND c IS NOT NULL",
        "competitors_not_siblings": "near AND c IS DISTINCT FROM s",
        "probe_mismatch": "near",
        "quiet_not_no_intent": "quiet AND decision <> 'no_intent'",
    },
)


@query("v08_diagnostic_tags", V08_SQL, "gold tags")
def v08(t):
    c = F.col
    none = F.array().cast("array<string>")
    kept = F.when(hit("V08", "case_id"), F.array_remove("tags", "hard_negative")).otherwise(c("tags"))
    more = F.array_compact(
        F.array(F.when(hit("V08b", "case_id"), "near_oos"), F.when(hit("V08c", "case_id"), "context_control"))
    )
    rivals = F.when(hit("V08d", "case_id"), none).otherwise(c("hard_negative_against"))
    return Q.diagnostic_tags(t.gold.withColumns({"tags": F.concat(kept, more), "hard_negative_against": rivals}))


@query(
    "v09_unlinked_siblings",
    f"""WITH n AS (SELECT case_id, contrast_id, CASE WHEN {mut('V09', 'case_id', 5)} THEN 'intent_9' ELSE sibling_intent END AS s
      FROM gold WHERE sibling_intent IS NOT NULL)
    SELECT 'V09' AS rule, CAST(case_id AS VARCHAR) AS key, s AS detail FROM n WHERE NOT EXISTS
      (SELECT 1 FROM gold g WHERE g.contrast_id = n.contrast_id AND g.decision = 'in_scope' AND g.target_intent = n.s)""",
    "gold",
)
def v09(t):
    other = F.transform("siblings", lambda s: F.lit("intent_9"))
    return Q.unlinked_siblings(
        t.gold.withColumn("siblings", F.when(hit("V09", "case_id", 5), other).otherwise(F.col("siblings")))
    )


V10_SQL = f"""WITH g AS (SELECT * REPLACE (
       CASE WHEN {mut('V10', 'case_id')} AND case_id % 2 = 1 THEN 'far' ELSE decision END AS decision,
       CASE WHEN {mut('V10b', 'case_id')} THEN scenario_id + 1 ELSE scenario_id END AS scenario_id,
       CASE WHEN {mut('V10c', 'case_id')} THEN 'x' ELSE recent_activity END AS recent_activity,
       CASE WHEN {mut('V10d', 'case_id')} THEN dialogue || '!' ELSE dialogue END AS dialogue,
       CASE WHEN {mut('V10e', 'case_id')} THEN 'x' ELSE state_summary END AS state_summary)
     FROM gold WHERE NOT {mut('V10f', 'case_id')}),
 k AS (SELECT contrast_id, count(*) AS members FROM g GROUP BY 1),
 odd AS (SELECT DISTINCT g.contrast_id FROM g JOIN k USING (contrast_id) WHERE pair_kind LIKE 'ctx%' AND members <> 2),
 p AS (SELECT c.contrast_id AS k, {", ".join(f"c.{f} IS DISTINCT FROM d.{f} AS x_{f}" for f in Q._PAIR_FIELDS)},
     c.competitor IS DISTINCT FROM d.competitor AS x_competitor, (c.case_id % 3 = 0) <> (d.case_id % 3 = 0) AS x_tags,
     c.recent_activity IS NOT NULL AS x_recent, d.state_summary <> 'then ' || c.state_summary AS x_state,
     d.recent_activity IS DISTINCT FROM d.perturbation AS x_activity
   FROM g c JOIN g d ON c.contrast_id = d.contrast_id WHERE c.pair_kind LIKE 'ctx%' AND c.case_id % 2 = 0 AND d.case_id % 2 = 1)
 SELECT 'V10' AS rule, CAST(contrast_id AS VARCHAR) AS key, 'not_a_pair' AS detail FROM odd UNION ALL """ + clauses(
    "p",
    "V10",
    "k",
    {f"{f}_differs": f"x_{f}" for f in Q._PAIR_FIELDS}
    | {
        "competitors_differ": "x_competitor",
        "tags_differ": "x_tags",
        "control_has_recent_activity": "x_recent",
        "state_not_perturbed": "x_state",
        "activity_not_perturbed": "x_activity",
    },
)


@query("v10_context_pairs", V10_SQL, "gold")
def v10(t):
    c, odd = F.col, F.col("case_id") % 2 == 1
    gold = t.gold.filter(~hit("V10f", "case_id"))
    return Q.context_pair_contract(
        gold.withColumns(
            {
                "decision": F.when(hit("V10", "case_id") & odd, "far").otherwise(c("decision")),
                "scenario_id": F.when(hit("V10b", "case_id"), c("scenario_id") + 1).otherwise(c("scenario_id")),
                "recent_activity": F.when(hit("V10c", "case_id"), "x").otherwise(c("recent_activity")),
                "dialogue": F.when(hit("V10d", "case_id"), F.concat("dialogue", F.lit("!"))).otherwise(c("dialogue")),
                "state_summary": F.when(hit("V10e", "case_id"), "x").otherwise(c("state_summary")),
            }
        )
    )


@query(
    "v11_split_leakage",
    f"""WITH s AS (SELECT case_id, cluster_id AS true_cluster,
       CASE WHEN {mut('V11', 'case_id')} THEN 'flipped' ELSE 'dev' END AS split,
       cluster_id + CASE WHEN {mut('V11b', 'case_id')} THEN 1 ELSE 0 END AS cluster_id FROM gold)
    SELECT 'V11' AS rule, 'group ' || cluster_id AS key, 'crosses_splits' AS detail FROM s
      GROUP BY cluster_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'V11', 'case ' || case_id, 'unstable_group' FROM s WHERE cluster_id <> true_cluster""",
    "gold",
)
def v11(t):
    cases = t.gold.select(
        "case_id",
        F.when(hit("V11", "case_id"), "flipped").otherwise("dev").alias("split"),
        (F.col("cluster_id") + F.when(hit("V11b", "case_id"), 1).otherwise(0)).alias("cluster_id"),
    )
    return Q.split_leakage(cases, components(t.gold))


@query(
    "v12_duplicate_contexts",
    """SELECT 'V12' AS rule, CAST(min(doc_id) AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM documents
    GROUP BY replace(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), 'ß', 'ss') HAVING count(*) > 1""",
)
def v12(t):
    return Q.duplicate_contexts(t.documents, "doc_id", "text")


@query(
    "v13_quota",
    """WITH e AS (SELECT * FROM (VALUES ('decision', 'in_scope', 8625), ('decision', 'oos', 3000), ('decision', 'no_intent', 1500),
        ('decision', 'other', 10), ('tag', 'far_oos', 2250), ('tag', 'hard_negative', 1)) v(dimension, value, expected)),
     o AS (SELECT 'decision' AS dimension, decision AS value, count(*) AS n FROM gold GROUP BY 2
       UNION ALL SELECT 'tag', tag, count(*) FROM tags GROUP BY 2)
    SELECT 'V13' AS rule, coalesce(e.dimension, o.dimension) || '=' || coalesce(e.value, o.value) AS key,
      coalesce(expected, 0) || '/' || coalesce(n, 0) AS detail
    FROM e FULL OUTER JOIN o ON e.dimension = o.dimension AND e.value = o.value WHERE coalesce(expected, 0) <> coalesce(n, 0)""",
    "gold tags",
)
def v13(t):
    wanted = [
        ("decision", "in_scope", 8625),
        ("decision", "oos", 3000),
        ("decision", "no_intent", 1500),
        ("decision", "other", 10),
        ("tag", "far_oos", 2250),
        ("tag", "hard_negative", 1),
    ]
    rows = [F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"), F.lit(n).alias("expected")) for d, v, n in wanted]
    expected = t.spark.range(1).select(F.inline(F.array(*rows)))
    facts = F.concat(
        F.array(F.struct(F.lit("decision").alias("dimension"), F.col("decision").alias("value"))),
        F.transform("tags", lambda x: F.struct(F.lit("tag").alias("dimension"), x.alias("value"))),
    )
    observed = t.gold.select(F.inline(facts)).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return Q.quota_differences(expected, observed)


@query(
    "v14_mixed_clusters",
    f"""WITH g AS (SELECT paraphrase_id, concat_ws('/', CASE WHEN {mut('V14', 'case_id')} THEN 'zzz' ELSE decision END, target_intent)
       AS label FROM gold)
    SELECT 'V14' AS rule, CAST(paraphrase_id AS VARCHAR) AS key, min(label) || '|' || max(label) AS detail FROM g
    GROUP BY paraphrase_id HAVING count(DISTINCT label) > 1""",
    "gold",
)
def v14(t):
    return Q.mixed_clusters(t.gold.withColumn("decision", F.when(hit("V14", "case_id"), "zzz").otherwise(F.col("decision"))))


@query(
    "v15_leaking_cues",
    f"""WITH c AS (SELECT role, CASE WHEN {mut('V15', 'conv_id', 3)} THEN 'cue ' || (conv_id % 17)
         ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS text,
       CASE conv_id % 5 WHEN 0 THEN 'in_scope' WHEN 1 THEN 'in_scope' WHEN 2 THEN 'oos' WHEN 3 THEN 'no_intent' ELSE 'ambiguous' END
         AS decision FROM conversations)
    SELECT 'V15' AS rule, sha256(text) AS key, count(*) || '/' || min(decision) AS detail FROM c WHERE role = 'user'
    GROUP BY text HAVING count(*) >= 2 AND count(DISTINCT decision) = 1""",
)
def v15(t):
    kinds = F.array(*[F.lit(x) for x in ["in_scope", "in_scope", "oos", "no_intent", "ambiguous"]])
    cue = F.concat(F.lit("cue "), (F.col("conv_id") % 17).cast("string"))
    return Q.leaking_cues(
        t.conversations.select(
            "role",
            F.when(hit("V15", "conv_id", 3), cue).otherwise(F.col("text")).alias("text"),
            F.get(kinds, (F.col("conv_id") % 5).cast("int")).alias("decision"),
        )
    )


@query(
    "v16_near_pairs",
    f"""WITH g AS (SELECT * REPLACE (
        CASE WHEN {mut('V16', 'case_id')} THEN scenario_id + 1 ELSE scenario_id END AS scenario_id,
        CASE WHEN {mut('V16b', 'case_id')} THEN dialogue || '!' ELSE dialogue END AS dialogue,
        CASE WHEN {mut('V16c', 'case_id')} THEN 'x' ELSE recent_activity END AS recent_activity)
       FROM gold WHERE NOT {mut('V16d', 'case_id')}),
     k AS (SELECT contrast_id, count(*) AS members FROM g GROUP BY 1),
     p AS (SELECT n.case_id, members, s.case_id AS s_id, n.scenario_id <> s.scenario_id AS x1,
         (n.case_id % 3 = 0) <> (s.case_id % 3 = 0) AS x2, n.recent_activity IS DISTINCT FROM s.recent_activity AS x3,
         n.dialogue <> s.dialogue AS x4
       FROM g n JOIN k ON n.contrast_id = k.contrast_id
       LEFT JOIN g s ON s.contrast_id = n.contrast_id AND s.decision = 'in_scope' WHERE n.sibling_intent IS NOT NULL) """
    + clauses(
        "p",
        "V16",
        "case_id",
        {
            "not_a_pair": "members <> 2",
            "sibling_missing": "s_id IS NULL",
            "scenario_differs": "x1",
            "turn_shape_differs": "x2",
            "recent_activity_differs": "s_id IS NOT NULL AND x3",
            "dialogue_differs": "x4",
        },
    ),
    "gold",
)
def v16(t):
    c = F.col
    return Q.near_pair_contract(
        t.gold.filter(~hit("V16d", "case_id")).withColumns(
            {
                "scenario_id": F.when(hit("V16", "case_id"), c("scenario_id") + 1).otherwise(c("scenario_id")),
                "dialogue": F.when(hit("V16b", "case_id"), F.concat("dialogue", F.lit("!"))).otherwise(c("dialogue")),
                "recent_activity": F.when(hit("V16c", "case_id"), "x").otherwise(c("recent_activity")),
            }
        )
    )


TAG_LIST = ", ".join(f"'{x}'" for x in SLICE_TAGS)
PATTERN_LIST = ", ".join(f"'{x}'" for x in PATTERN_TAGS)


@query(
    "v17_draft_rules",
    f"""WITH tg AS (SELECT * FROM tags UNION ALL SELECT case_id, 'odd_tag' FROM gold WHERE {mut('V17', 'case_id')}
        UNION ALL SELECT case_id, 'multi_turn_recency' FROM gold WHERE {mut('V17b', 'case_id', 2)}
        UNION ALL SELECT case_id, 'far_oos' FROM gold WHERE {mut('V17c', 'case_id')}
        UNION ALL SELECT case_id, 'rest_eat_confusion' FROM gold WHERE {mut('V17d', 'case_id')}),
      g AS (SELECT g.case_id, any_value(decision) AS decision, any_value(target_intent) AS target,
        count(*) FILTER (tag NOT IN ({TAG_LIST})) AS unknown,
        count(DISTINCT tag) FILTER (tag IN ('single_turn', 'multi_turn')) AS shape,
        count(DISTINCT tag) FILTER (tag IN ({PATTERN_LIST})) AS patterns,
        count(DISTINCT tag) FILTER (tag IN ('near_oos', 'far_oos')) AS nf,
        count(*) FILTER (tag = 'multi_turn') > 0 AS multi, count(*) FILTER (tag = 'rest_eat_confusion') > 0 AS slice
      FROM gold g JOIN tg ON g.case_id = tg.case_id GROUP BY g.case_id) """
    + clauses(
        "g",
        "V17",
        "case_id",
        {
            "unknown_tag": "unknown > 0",
            "turn_shape": "shape <> 1",
            "pattern_missing": "multi AND patterns <> 1",
            "pattern_on_single_turn": "NOT multi AND patterns > 0",
            "oos_needs_near_or_far": "decision = 'oos' AND nf <> 1",
            "near_far_without_oos": "decision <> 'oos' AND nf > 0",
            "rest_eat_confusion_target": "slice AND decision = 'in_scope' AND target NOT IN ('intent_0', 'intent_1')",
        },
    ),
    "gold tags",
)
def v17(t):
    more = F.array_compact(
        F.array(
            F.when(hit("V17", "case_id"), "odd_tag"),
            F.when(hit("V17b", "case_id", 2), "multi_turn_recency"),
            F.when(hit("V17c", "case_id"), "far_oos"),
            F.when(hit("V17d", "case_id"), "rest_eat_confusion"),
        )
    )
    return Q.draft_rules(
        t.gold.withColumn("tags", F.concat("tags", more)), {"rest_eat_confusion": ["intent_0", "intent_1"]}
    )


@query(
    "v17_candidate_rules",
    f"""WITH d AS (SELECT case_id, decision, target_intent,
       case_id IN (SELECT case_id FROM tags WHERE tag = 'multi_turn') AS multi,
       CASE WHEN {mut('V17h', 'case_id')} THEN 'human_authored' ELSE 'llm_assisted_pending_human_review' END AS source,
       CASE WHEN {mut('V17i', 'case_id')} THEN 'reviewed' ELSE 'draft' END AS status,
       CASE WHEN {mut('V17j', 'case_id')} THEN 'replace-me' ELSE CAST(scenario_id AS VARCHAR) END AS relation,
       {mut('V17k', 'case_id')} AS turned, CASE WHEN {mut('V17l', 'case_id')} THEN 'fly_kite' ELSE recent_activity END AS recent,
       {mut('V17m', 'case_id', 4)} AS brandless, state_summary || CASE WHEN {mut('V17n', 'case_id', 5)} THEN ' with the kite' ELSE '' END AS state, dialogue
     FROM gold) """
    + clauses(
        "d",
        "V17",
        "case_id",
        {
            "source_not_pending": "source <> 'llm_assisted_pending_human_review'",
            "status_not_draft": "status <> 'draft'",
            "relation_placeholder": "contains(relation, 'replace-')",
            "turn_shape_disagrees": "turned",
            "unknown_recent_activity": "recent NOT IN (" + ", ".join(f"'{i}'" for i in INTENTS) + ")",
            "brandless_xhs_candidate": "brandless AND (decision <> 'in_scope' OR target_intent IS DISTINCT FROM 'intent_0' OR contains(state, 'kite') OR contains(dialogue, 'kite'))",
        },
    ),
    "gold tags",
)
def v17d(t):
    """Drafts as they should be, with known slices that are not."""
    multi = F.array_contains("tags", "multi_turn")
    kept = F.filter("tags", lambda x: x != "brandless_xhs")
    drafts = t.gold.select(
        "case_id",
        "decision",
        "target_intent",
        F.when(hit("V17m", "case_id", 4), F.concat(kept, F.array(F.lit("brandless_xhs")))).otherwise(kept).alias("tags"),
        F.when(hit("V17h", "case_id"), "human_authored").otherwise("llm_assisted_pending_human_review").alias("source"),
        F.when(hit("V17i", "case_id"), "reviewed").otherwise("draft").alias("adjudication_status"),
        F.array(F.when(hit("V17j", "case_id"), "replace-me").otherwise(F.col("scenario_id").cast("string")), F.col("contrast_id").cast("string")).alias("relations"),
        F.when(multi != hit("V17k", "case_id"), 2).otherwise(0).alias("n_turns"),
        F.array_compact(F.array(F.when(hit("V17l", "case_id"), "fly_kite").otherwise(F.col("recent_activity")))).alias("recent"),
        F.array(F.concat("state_summary", F.when(hit("V17n", "case_id", 5), " with the kite").otherwise("")), F.col("dialogue")).alias("carriers"),
    )
    return Q.candidate_rules(drafts, INTENTS, {"brandless_xhs": ("intent_0", "kite")})


@query(
    "v17_final_turn",
    f"""WITH {QUOTE_SQL},
      l AS (SELECT conv_id, role, text, count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
      p AS (SELECT l.conv_id, role, text, quote FROM l JOIN quotes q ON l.conv_id = q.conv_id WHERE rn = 1 AND n > 1) """
    + clauses(
        "p",
        "V17",
        "conv_id",
        {"final_role": "role <> 'assistant'", "final_without_quote": "NOT contains(text, quote)"},
    ),
)
def v17b(t):
    return Q.final_turn_rules(t.conversations, quotes(t), "conv_id")


@query(
    "v17_final_turn_tagged",
    f"""WITH {QUOTE_SQL},
      kept AS (SELECT * FROM conversations WHERE NOT ({mut('V17f', 'conv_id', 10)} AND turn > (SELECT min(turn) FROM conversations))),
      l AS (SELECT conv_id, role, text, count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM kept WHERE NOT {mut('V17g', 'conv_id', 10)}),
      tg AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1),
      p AS (SELECT tg.conv_id, n, role, text, quote FROM tg LEFT JOIN l ON l.conv_id = tg.conv_id AND rn = 1
         LEFT JOIN (SELECT * FROM quotes WHERE NOT {mut('V17e', 'conv_id', 10)}) q ON q.conv_id = tg.conv_id) """
    + clauses(
        "p",
        "V17",
        "conv_id",
        {
            "turns_missing": "n IS NULL OR n < 2",
            "final_role": "role <> 'assistant' OR (n IS NOT NULL AND role IS NULL)",
            "quote_missing": "quote IS NULL",
            "final_without_quote": "NOT contains(text, quote)",
        },
    ),
)
def v17c(t):
    """Tagged conversations, of which some have lost their quote, all turns but the first, or all turns."""
    tagged = t.conversations.groupBy("conv_id").agg((F.count("*") > 1).alias("multi_turn"))
    first = t.conversations.agg(F.min("turn")).scalar()
    turns = t.conversations.filter(~(hit("V17f", "conv_id", 10) & (F.col("turn") > first)) & ~hit("V17g", "conv_id", 10))
    return Q.final_turn_rules(turns, quotes(t).filter(~hit("V17e", "conv_id", 10)), "conv_id", tagged)


@query(
    "v18_sibling_relation",
    """WITH e AS (SELECT DISTINCT o_custkey AS name, CAST(floor(o_orderkey / 10) AS BIGINT) AS sibling FROM orders),
      n AS (SELECT DISTINCT c_custkey AS name FROM customer WHERE c_acctbal >= 0)
    SELECT 'V18' AS rule, name || '>' || sibling AS key, 'own_sibling' AS detail FROM e WHERE name = sibling
    UNION ALL SELECT 'V18', name || '>' || sibling, 'unknown_sibling' FROM e WHERE sibling NOT IN (SELECT name FROM n)
    UNION ALL SELECT 'V18', name || '>' || sibling, 'not_symmetric' FROM e WHERE NOT EXISTS
      (SELECT 1 FROM e r WHERE r.name = e.sibling AND r.sibling = e.name)""",
)
def v18(t):
    edges = t.orders.select(
        F.col("o_custkey").alias("name"), F.floor(F.col("o_orderkey") / 10).cast("bigint").alias("sibling")
    )
    return Q.sibling_relation(edges, t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("name")))


@query(
    "v33_vector_validity",
    f"""WITH v AS (SELECT vec_id, CASE WHEN {mut('V33', 'vec_id')} THEN embedding[1:63] ELSE embedding END AS e,
        {mut('V33b', 'vec_id')} AS zero, {mut('V33c', 'vec_id')} AS nan FROM embeddings)
    SELECT 'V33' AS rule, CAST(vec_id AS VARCHAR) AS key, 'dimension' AS detail FROM v WHERE len(e) <> 64
    UNION ALL SELECT 'V33', CAST(vec_id AS VARCHAR), 'not_finite' FROM v WHERE nan
    UNION ALL SELECT 'V33', CAST(vec_id AS VARCHAR), 'zero_norm' FROM v WHERE zero AND NOT nan""",
)
def v33(t):
    e = F.col("embedding")
    broken = (
        F.when(hit("V33", "vec_id"), F.slice(e, 1, 63)).otherwise(e)
    )
    zero = F.when(hit("V33b", "vec_id"), F.transform(broken, lambda x: F.lit(0.0))).otherwise(broken)
    nan = F.when(hit("V33c", "vec_id"), F.transform(zero, lambda x: F.lit(float("nan")))).otherwise(zero)
    return Q.vector_validity(t.vectors.withColumn("embedding", nan), "vec_id", 64)


# ---- calls -----------------------------------------------------------------------------------------------------

STAGES = {("B", 1): ["click"], ("B", 2): ["view"], ("C", 1): ["purchase", "error"], ("C", 2): ["purchase"]}


# Calls two by two: every event is in, as the first or second call of a case of its user.
PAIRED_SQL = """fc AS (SELECT * REPLACE (case_id * 100000 + CAST(floor((call_index - 1) / 2) AS BIGINT) AS case_id,
      (call_index - 1) % 2 + 1 AS call_index) FROM calls)"""


def paired_calls(t):
    return t.calls.withColumns(
        {
            "case_id": F.col("case_id") * 100000 + F.floor((F.col("call_index") - 1) / 2).cast("bigint"),
            "call_index": (F.col("call_index") - 1) % 2 + 1,
        }
    )


TOKEN_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in TOKEN_FIELDS)
SAID_SUMS = ", ".join(
    f"CASE WHEN count(total_tokens) = count(*) THEN CAST(sum({c}) AS BIGINT)"
    + (f" + CASE WHEN {mut('V19c', 'case_id')} THEN 1 ELSE 0 END" if c == "output_tokens" else "")
    + f" END AS said_{c}"
    for c in TOKEN_FIELDS
)
SAID_FIELDS = ", ".join(f"said_{c}" for c in TOKEN_FIELDS)
USAGE_DIFFERS = " OR ".join(f"sum_{c} IS DISTINCT FROM said_{c}" for c in TOKEN_FIELDS)


@query(
    "v19_call_sequences",
    f"""WITH {PAIRED_SQL},
      c AS (SELECT * REPLACE (case_id + CASE WHEN {mut('V19b', 'case_id')} THEN 99000000000 ELSE 0 END AS case_id)
        FROM fc WHERE NOT (call_index = 1 AND {mut('V19', 'event_id', 10)})),
      g AS (SELECT arm, case_id, arm || '|' || case_id AS k, list(call_index ORDER BY call_index) AS idx,
        count(*) FILTER (arm = 'B' AND call_index = 1 AND stage <> 'click' OR arm = 'B' AND call_index = 2 AND stage <> 'view'
          OR arm = 'C' AND call_index = 1 AND stage NOT IN ('purchase', 'error') OR arm = 'C' AND call_index = 2 AND stage <> 'purchase')
          AS wrong,
        count(*) AS n, count(total_tokens) = count(*) AS known, {TOKEN_SUMS},
        coalesce(sum(retry_input_tokens + retry_output_tokens), 0) AS retries FROM c GROUP BY 1, 2),
      o AS (SELECT arm, case_id, CASE WHEN bool_and(status = 'success') THEN 'success' ELSE 'other' END AS said, {SAID_SUMS} FROM fc GROUP BY 1, 2),
      gs AS (SELECT g.*, said, {SAID_FIELDS} FROM g LEFT JOIN o ON o.arm = g.arm AND o.case_id = g.case_id) """
    + clauses(
        "gs",
        "V19",
        "k",
        {
            "indexes": "idx <> [1] AND idx <> [1, 2]",
            "stage": "wrong > 0",
            "success_needs_two_calls": "said = 'success' AND n <> 2",
            "usage_differs": f"known AND said_total_tokens IS NOT NULL AND ({USAGE_DIFFERS})",
            "retry_usage": "retries > 0",
            "unknown_case": "case_id NOT IN (SELECT case_id FROM fc)",
        },
    )
    + """ UNION ALL SELECT 'V19', arm || '|' || case_id, 'no_calls' FROM (SELECT DISTINCT arm, case_id FROM fc) f
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.arm = f.arm AND g.case_id = f.case_id)""",
    "calls",
)
def v19(t):
    calls = paired_calls(t)
    broken = calls.filter(~((F.col("call_index") == 1) & hit("V19", "event_id", 10))).withColumn(
        "case_id", F.col("case_id") + F.when(hit("V19b", "case_id"), 99000000000).otherwise(0)
    )
    said = merged_predictions(calls)
    said = said.withColumn("output_tokens", F.col("output_tokens") + F.when(hit("V19c", "case_id"), 1).otherwise(0))
    return Q.call_sequences(broken, calls, STAGES, said)


REUSE_FIELDS = [
    *["cache_key", "call_contract_sha256", "requested_model", "reported_model", "status", *TOKEN_FIELDS],
    *["raw_response_sha256", "error_type", "cache_origin", "source_cache_key"],
]


def field_diff_sql(rule, left, right, keys, fields):
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    key = " || '|' || ".join(f"CAST(coalesce(a.{k}, b.{k}) AS VARCHAR)" for k in keys)
    parts = {"left_missing": f"a.{keys[0]} IS NULL", "right_missing": f"b.{keys[0]} IS NULL"}
    parts |= {
        f: f"a.{keys[0]} IS NOT NULL AND b.{keys[0]} IS NOT NULL AND a.{f} IS DISTINCT FROM b.{f}" for f in fields
    }
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {key} AS key, '{n}' AS detail FROM {left} a FULL OUTER JOIN {right} b ON {on} WHERE {c}"
        for n, c in parts.items()
    )


@query(
    "v20_reused_calls",
    f"""WITH {PAIRED_SQL}, f1 AS (SELECT * FROM fc WHERE call_index = 1),
     a0 AS (SELECT * FROM f1 WHERE NOT {mut('V20c', 'event_id')}),
     b0 AS (SELECT * REPLACE (CASE WHEN {mut('V20', 'event_id')} THEN NULL ELSE source_cache_key END AS source_cache_key,
        CASE WHEN {mut('V20e', 'event_id')} THEN 'other' ELSE raw_response_sha256 END AS raw_response_sha256,
        CASE WHEN {mut('V20f', 'event_id')} THEN 'model-x' ELSE requested_model END AS requested_model,
        latency_ms + 1 AS latency_ms, CASE WHEN {mut('V20b', 'event_id')} THEN NULL ELSE input_tokens END AS input_tokens)
       FROM f1 WHERE NOT {mut('V20d', 'event_id')}) """
    + field_diff_sql("V20", "a0", "b0", ["arm", "case_id"], REUSE_FIELDS),
    "calls",
)
def v20(t):
    first = paired_calls(t).filter("call_index = 1")
    reused = first.filter(~hit("V20d", "event_id")).withColumns(
        {
            "source_cache_key": F.when(~hit("V20", "event_id"), F.col("source_cache_key")),
            "raw_response_sha256": F.when(hit("V20e", "event_id"), "other").otherwise(F.col("raw_response_sha256")),
            "requested_model": F.when(hit("V20f", "event_id"), "model-x").otherwise(F.col("requested_model")),
            "latency_ms": F.col("latency_ms") + 1,  # no field that a reused call has to share
            "input_tokens": F.when(hit("V20b", "event_id"), None).otherwise(F.col("input_tokens")),
        }
    )
    return Q.differing_fields(first.filter(~hit("V20c", "event_id")), reused, ["arm", "case_id"], REUSE_FIELDS, "V20")


FORMED_SQL = """formed AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'clear' WHEN 'view' THEN 'none'
      WHEN 'error' THEN 'ambiguous' ELSE 'deferred' END AS evidence_status,
      CASE WHEN event_id % 7 <> 0 AND event_type <> 'view' OR event_id % 11 = 0 THEN 'act' END AS action,
      CASE WHEN event_id % 13 = 0 THEN 'obj' END AS object, event_id % 5 AS n_alt,
      CASE WHEN event_id % 3 = 0 THEN 'now' ELSE 'later' END AS horizon FROM events)"""


def formed(t):
    e = F.col("event_id")
    status = (
        F.when(F.col("event_type") == "click", "clear")
        .when(F.col("event_type") == "view", "none")
        .when(F.col("event_type") == "error", "ambiguous")
        .otherwise("deferred")
    )
    acts = ((e % 7 != 0) & (F.col("event_type") != "view")) | (e % 11 == 0)
    return t.events.select(
        e.alias("id"),
        status.alias("evidence_status"),
        F.when(acts, "act").alias("action"),
        F.when(e % 13 == 0, "obj").alias("object"),
        F.array_repeat(F.lit("alt"), (e % 5).cast("int")).alias("alternatives"),
        F.when(e % 3 == 0, "now").otherwise("later").alias("horizon"),
    )


@query(
    "v23_formed_truth_table",
    f"WITH {FORMED_SQL} "
    + clauses(
        "formed",
        "V23",
        "id",
        {
            "none_with_fields": "evidence_status = 'none' AND (action IS NOT NULL OR object IS NOT NULL OR n_alt > 0)",
            "one_action_needed": "evidence_status IN ('clear', 'deferred') AND (action IS NULL OR n_alt > 0)",
            "ambiguous_needs_choice": "evidence_status = 'ambiguous' AND action IS NULL AND n_alt < 2",
            "deferred_not_later": "evidence_status = 'deferred' AND horizon <> 'later'",
        },
    ),
)
def v23(t):
    return Q.formed_truth_table(formed(t))


LEAK_NAMES = ["ther", "eaux", "tion", "oron", "hain the"]


@query(
    "v24_leaked_names",
    "WITH n AS (SELECT DISTINCT regexp_extract(text, '^[^ ]+ [^ ]+') AS name FROM benchmark UNION VALUES "
    + ", ".join(f"('{n}')" for n in LEAK_NAMES)
    + ") SELECT 'V24' AS rule, CAST(doc_id AS VARCHAR) AS key, name AS detail FROM documents, n WHERE name <> '' AND contains(text, name)",
)
def v24(t):
    """Names are the first two words of each benchmark item, and a few that are known to occur."""
    opening = t.benchmark.select(F.regexp_extract("text", "^[^ ]+ [^ ]+", 0).alias("name"))
    names = opening.unionByName(t.spark.range(1).select(F.explode(F.array(*map(F.lit, LEAK_NAMES))).alias("name")))
    return Q.leaked_names(t.documents, "doc_id", "text", names)


@query(
    "v29_catalog_difference",
    f"""WITH w AS (SELECT DISTINCT l_suppkey AS name FROM lineitem),
      f AS (SELECT s_suppkey + CASE WHEN {mut('V29', 's_suppkey', 5)} THEN 1000000 ELSE 0 END AS name FROM supplier),
      r AS (SELECT DISTINCT l_partkey AS name FROM lineitem)
    SELECT 'V29' AS rule, CAST(name AS VARCHAR) AS key, 'missing' AS detail FROM w WHERE name NOT IN (SELECT name FROM f)
    UNION ALL SELECT 'V29', CAST(name AS VARCHAR), 'extra' FROM f WHERE name NOT IN (SELECT name FROM w)
    UNION ALL SELECT 'V29', CAST(name AS VARCHAR), 'unknown_reference' FROM r WHERE name NOT IN (SELECT name FROM f)""",
)
def v29(t):
    wanted = t.lineitem.select(F.col("l_suppkey").alias("name"))
    renamed = F.col("s_suppkey") + F.when(hit("V29", "s_suppkey", 5), 1000000).otherwise(0)
    references = t.lineitem.select(F.col("l_partkey").alias("name"))
    return Q.catalog_difference(wanted, t.supplier.select(renamed.alias("name")), references)


KINDS = ["plain_in", "near", "far", "quiet", "amb"]


@query(
    "v30_coverage",
    "WITH c AS (SELECT d.decision, k.kind, count(g.case_id) AS n FROM (VALUES "
    + ", ".join(f"('{d}')" for d in DECISIONS)
    + ") d(decision) CROSS JOIN (VALUES "
    + ", ".join(f"('{k}')" for k in KINDS)
    + """) k(kind) LEFT JOIN gold g ON g.decision = d.decision AND g.pair_kind = k.kind GROUP BY 1, 2),
     s AS (SELECT DISTINCT scenario_id, decision FROM gold),
     p AS (SELECT a.decision AS a, b.decision AS b, count(*) AS n FROM s a JOIN s b ON a.scenario_id = b.scenario_id GROUP BY 1, 2)
    SELECT 'V30' AS rule, decision || '/' || kind AS key, CAST(n AS VARCHAR) AS detail FROM c WHERE n <> 1500
    UNION ALL SELECT 'V30', a || '+' || b, 'never_together' FROM (VALUES ('in_scope', 'oos'), ('in_scope', 'no_intent'),
      ('in_scope', 'ambiguous'), ('oos', 'no_intent'), ('oos', 'ambiguous'), ('no_intent', 'ambiguous')) w(a, b)
      WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = w.a AND p.b = w.b)
    UNION ALL SELECT 'V30', tag, 'not_covered' FROM (VALUES """
    + ", ".join(f"('{x}')" for x in SLICE_TAGS)
    + """) k(tag) WHERE tag NOT IN (SELECT tag FROM tags)""",
    "gold tags",
)
def v30(t):
    counts = t.gold.groupBy("decision", F.col("pair_kind").alias("kind")).agg(F.count("*").alias("n"))
    return Q.coverage_gaps(counts, DECISIONS, KINDS, 1500).unionByName(
        Q.missing_decision_pairs(t.gold, "scenario_id", DECISIONS)
    ).unionByName(Q.uncovered_tags(t.gold, SLICE_TAGS))


SHOT_SQL = f"""shots AS (SELECT min(case_id) AS case_id, cluster_id, decision FROM gold GROUP BY 2, 3
      UNION ALL SELECT min(case_id), cluster_id, decision FROM gold GROUP BY 2, 3 HAVING {mut('V31', 'cluster_id', 5)})"""


@query(
    "v31_selection",
    f"""WITH {SHOT_SQL} SELECT 'V31' AS rule, CAST(case_id AS VARCHAR) AS key, 'case_repeated' AS detail FROM shots
      GROUP BY case_id HAVING count(*) > 1
    UNION ALL SELECT 'V31', CAST(cluster_id AS VARCHAR), 'cluster_repeated' FROM shots GROUP BY cluster_id HAVING count(*) > 1
    UNION ALL SELECT 'V31', w.decision, CAST(count(s.case_id) AS VARCHAR) FROM (VALUES ('in_scope', 8), ('oos', 4), ('no_intent', 4),
      ('ambiguous', 4)) w(decision, k) LEFT JOIN shots s ON s.decision = w.decision GROUP BY w.decision, k HAVING count(s.case_id) <> k
    UNION ALL SELECT DISTINCT 'V31', CAST(case_id AS VARCHAR), 'rationale_missing' FROM shots WHERE {mut('V31b', 'case_id')}
    UNION ALL SELECT DISTINCT 'V31', CAST(case_id + 50000000 AS VARCHAR), 'rationale_not_selected' FROM shots WHERE {mut('V31c', 'case_id')}""",
    "gold",
)
def v31(t):
    picked = t.gold.groupBy("cluster_id", "decision").agg(F.min("case_id").alias("case_id"))
    twice = picked.filter(hit("V31", "cluster_id", 5))
    told = picked.filter(~hit("V31b", "case_id")).select("case_id")
    other = picked.filter(hit("V31c", "case_id")).select((F.col("case_id") + 50000000).alias("case_id"))
    required = {"in_scope": 8, "oos": 4, "no_intent": 4, "ambiguous": 4}
    return Q.selection_contract(picked.unionByName(twice), required).unionByName(
        Q.rationale_coverage(picked, told.unionByName(other))
    )
