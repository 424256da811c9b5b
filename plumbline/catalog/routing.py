"""Queries for texts, contexts, the lexical router and the embedding baseline."""

from pyspark.sql import functions as F

from plumbline.catalog.comparison import DOMAIN_SQL  # noqa: F401
from plumbline.catalog.evaluation import BASIC
from plumbline.catalog.registry import query
from plumbline.functions import labels as L
from plumbline.functions import text as X
from plumbline.functions.lineage import cut
from plumbline.operators import evaluate as E
from plumbline.operators import prototype as P
from plumbline.operators import route as Rt
from plumbline.plans import embedding as Em
from plumbline.schemas import DECISIONS
from plumbline.sources.views import ARMS

JSON_TEXT = "CAST(to_json({0}) AS VARCHAR)"
TURN_JSON = "'{\"content\":' || " + JSON_TEXT.format("text") + " || ',\"role\":' || " + JSON_TEXT.format("role") + " || '}'"
CONTEXT_SQL = f"""cx AS (SELECT conv_id, '{{"conversation":[' || string_agg({TURN_JSON}, ',' ORDER BY turn) || '],"recent_activities":[],"state_summary":'
     || {JSON_TEXT.format("'conversation ' || conv_id")} || '}}' AS context_json,
     coalesce(arg_max(text, turn) FILTER (role = 'assistant'), 'conversation ' || conv_id) AS decision_text,
     string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS flat FROM conversations GROUP BY conv_id)"""


def contexts(t):
    nested = X.contexts_from_turns(t.conversations, "conv_id")
    return nested.withColumns(
        {
            "state_summary": F.concat(F.lit("conversation "), F.col("conv_id").cast("string")),
            "recent_activities": F.array().cast("array<string>"),
        }
    )


@query("p04_context_json", f"WITH {CONTEXT_SQL} SELECT conv_id, context_json FROM cx")
def p04(t):
    body = X.serialise_context(F.col("state_summary"), F.col("conversation"), F.col("recent_activities"))
    return contexts(t).select("conv_id", body.alias("context_json"))


@query("p05_decision_text", f"WITH {CONTEXT_SQL} SELECT conv_id, decision_text FROM cx")
def p05(t):
    state = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    return X.decision_text_from_turns(t.conversations, "conv_id", state)


@query(
    "p06_evidence_text",
    "SELECT doc_id, sha256(replace(replace(text, 'e', 'fi'), chr(13) || chr(10), chr(10))) AS normal FROM documents",
)
def p06(t):
    odd = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("ﬁ")), F.lit("\n"), F.lit("\r\n"))
    return t.documents.select("doc_id", F.sha2(X.normalise_evidence(odd), 256).alias("normal"))


@query(
    "p07_context_signature",
    """SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), 'ß', 'ss')) AS signature FROM documents""",
)
def p07(t):
    return t.documents.select("doc_id", F.sha2(X.context_text(F.col("text")), 256).alias("signature"))


@query("p20_flat_conversation", f"WITH {CONTEXT_SQL} SELECT conv_id, flat FROM cx")
def p20(t):
    return contexts(t).select("conv_id", X.flat_conversation(F.col("conversation")).alias("flat"))


RULES = {
    "no_intent": ["la .{0,40}eaux", "that an.*ing the"],
    "oos": ["und .*der", "qui.{0,4}el"],
    "ambiguity": ["(?:hain|ther).*und ", "con.*los "],
    "future": ["tion", "ent.{0,2}er"],
    "in_scope": {
        "intent_0": ["hain .*the", "ond"],
        "intent_1": ["ther.{0,8}in", "entre"],
        "intent_2": ["ing the.*of "],
        "intent_3": ["der(?:e|a)", "los (?:de|en)"],
        "intent_4": ["est [a-f]"],
    },
}


def rx(patterns, column):
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({column}, '{joined}')"


def router_sql(source, body, current):
    hits = ", ".join(f"CASE WHEN {rx(v, body)} THEN '{k}' END" for k, v in RULES["in_scope"].items())
    return f"""m AS (SELECT *, {rx(RULES['no_intent'], body)} AS quiet, {rx(RULES['oos'], body)} AS oos_, {rx(RULES['ambiguity'], body)} AS unsure,
      concat_ws(',', {hits}) AS hits, CASE WHEN {rx(RULES['future'], current)} THEN 'later' ELSE 'now' END AS horizon FROM {source}),
     k AS (SELECT *, CASE WHEN hits = '' THEN 0 ELSE len(string_split(hits, ',')) END AS n FROM m),
     ro AS (SELECT *, CASE WHEN quiet THEN 'no_intent' WHEN oos_ AND NOT unsure THEN 'oos' WHEN unsure OR n > 1 THEN 'ambiguous'
        WHEN n = 1 THEN 'in_scope' WHEN oos_ THEN 'oos' ELSE 'no_intent' END AS decision FROM k)"""


ROUTED = "decision, CASE WHEN decision = 'in_scope' THEN hits END AS predicted_intent, CASE WHEN decision = 'ambiguous' AND n >= 2 THEN hits ELSE '' END AS candidates, horizon"


@query(
    "t06_lexical_router",
    f"WITH {CONTEXT_SQL}, {router_sql('cx', 'context_json', 'decision_text')} SELECT conv_id, {ROUTED} FROM ro",
)
def t06(t):
    c = contexts(t)
    body = X.serialise_context(F.col("state_summary"), F.col("conversation"), F.col("recent_activities"))
    current = X.current_decision_text(F.col("state_summary"), F.col("conversation"))
    routed = Rt.lexical_router(c.select("conv_id", body.alias("context_json"), current.alias("decision_text")), RULES)
    return routed.select(
        "conv_id", "decision", "predicted_intent", F.array_join("candidate_intents", ",").alias("candidates"), "horizon"
    )


@query(
    "t06_document_router",
    f"WITH {router_sql('documents', 'replace(text, chr(10), chr(32))', 'text')} SELECT doc_id, {ROUTED} FROM ro",
)
def t06b(t):
    one_line = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    docs = t.documents.select("doc_id", one_line.alias("context_json"), F.col("text").alias("decision_text"))
    return Rt.lexical_router(docs, RULES).select(
        "doc_id", "decision", "predicted_intent", F.array_join("candidate_intents", ",").alias("candidates"), "horizon"
    )


# ---- prototypes from gold --------------------------------------------------------------------------------------

STRATA = ["near_oos", "hard_negative", "far_oos", "quiet_control", "__other__"]
STRATUM = """CASE WHEN sibling_intent IS NOT NULL THEN 'near_oos' WHEN competitor IS NOT NULL THEN 'hard_negative'
   WHEN pair_kind IN ('far', 'ctx_oos') THEN 'far_oos' WHEN g.decision = 'no_intent' THEN 'quiet_control' ELSE '__other__' END"""
PICK_SQL = f"""rep AS (SELECT decision, cluster_id, min(case_id) AS case_id FROM gold WHERE decision IN ('oos', 'no_intent') GROUP BY 1, 2),
 sr AS (SELECT g.case_id, g.decision, g.cluster_id, {STRATUM} AS stratum FROM gold g JOIN rep USING (case_id)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY decision, stratum ORDER BY case_id) AS rn,
    list_position({STRATA!r}, stratum) AS place FROM sr),
 pick AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY rn, place) AS position FROM rk QUALIFY position <= 8)"""


def rejections(t):
    return t.gold.filter(F.col("decision").isin("oos", "no_intent"))


@query("w03_representatives", f"WITH {PICK_SQL} SELECT decision, cluster_id, case_id FROM rep", "gold")
def w03(t):
    return P.representatives(rejections(t), ["decision"])


@query(
    "w04_round_robin",
    f"WITH {PICK_SQL} SELECT decision, stratum, case_id, CAST(position AS INTEGER) AS position FROM pick",
    "gold",
)
def w04(t):
    return P.stratified_round_robin(rejections(t), STRATA, 8).select("decision", "stratum", "case_id", "position")


@query(
    "j12_hold_out",
    f"""WITH {PICK_SQL}, k AS (SELECT 'without_cases' AS held, gp.* FROM gp WHERE case_id NOT IN (SELECT case_id FROM pick)
       UNION ALL SELECT 'without_clusters', gp.* FROM gp WHERE cluster_id NOT IN (SELECT cluster_id FROM pick)),
     tl AS (SELECT held, arm, label, count(*) FILTER (decision = label AND pred_decision = label) AS tp,
       count(*) FILTER (pred_decision = label) AS np, count(*) FILTER (decision = label) AS ng
       FROM k CROSS JOIN (VALUES {", ".join(f"('{d}')" for d in DECISIONS)}) l(label) GROUP BY 1, 2, 3),
     f AS (SELECT held, arm, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END), 9) AS macro_f1 FROM tl GROUP BY 1, 2)
    SELECT k.held, k.arm, count(*) AS n, avg(hit) AS hem, any_value(macro_f1) AS macro_f1 FROM k JOIN f ON f.held = k.held AND f.arm = k.arm GROUP BY 1, 2""",
    "gold gp",
)
def j12(t):
    shots = P.stratified_round_robin(rejections(t), STRATA, 8).select("case_id", "cluster_id")
    marked = (
        t.gold.join(shots.select("case_id", F.lit(1).alias("c")), "case_id", "left")
        .join(shots.select("cluster_id", F.lit(1).alias("k")).distinct(), "cluster_id", "left")
        .withColumn(
            "held",
            F.array_compact(
                F.array(
                    F.when(F.col("c").isNull(), "without_cases"), F.when(F.col("k").isNull(), "without_clusters")
                )
            ),
        )
    )
    rows = E.join_predictions(marked, t.predictions, ARMS, BASIC).withColumn("held", F.explode("held"))
    counts = cut(E.outcome_counts(rows, ["held", "arm"]))
    f1 = E.macro_f1(E.label_counts(counts, ["held", "arm"], "decision", "pred_decision", DECISIONS), ["held", "arm"], "macro_f1")
    return E.hit_rate(counts, ["held", "arm"]).join(f1, ["held", "arm"]).select("held", "arm", "n", "hem", "macro_f1")


# ---- embedding baseline ----------------------------------------------------------------------------------------

GRID = {
    "tau_actionability": [-0.1, -0.05, 0.0, 0.05],
    "tau_oos_margin": [0.0, 0.05, 0.1, 0.3],
    "tau_activity_min": [0.0, 0.05, 0.1, 0.3],
    "tau_ambiguity": [0.0, 0.01, 0.02, 0.05],
}
PROTO_STRATA = ["multi_turn", "__other__"]


def cosine_sql(source):
    """Long form: one row per (query, label, position)."""
    return f"""pv AS (SELECT proto, id, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM {source}),
 pn AS (SELECT proto, id, sqrt(sum(v * v)) AS nn FROM pv GROUP BY 1, 2),
 ce AS (SELECT pv.proto, pos, avg(v / nn) AS v FROM pv JOIN pn ON pv.proto = pn.proto AND pv.id = pn.id GROUP BY 1, 2),
 cn AS (SELECT proto, sqrt(sum(v * v)) AS nn FROM ce GROUP BY 1),
 cu AS (SELECT ce.proto, pos, v / nn AS v FROM ce JOIN cn ON ce.proto = cn.proto)"""


def score_sql(source):
    return f"""qv AS (SELECT vec_id, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM {source}),
 qn AS (SELECT vec_id, sqrt(sum(v * v)) AS nn FROM qv GROUP BY 1),
 cs AS (SELECT q.vec_id, proto, round(sum(q.v / nn * cu.v), 9) AS s FROM qv q JOIN qn ON qn.vec_id = q.vec_id JOIN cu ON cu.pos = q.pos GROUP BY 1, 2),
 ra AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, proto) AS rn FROM cs WHERE proto NOT IN ('oos', 'no_intent')),
 sc AS (SELECT ra.vec_id, max(CASE WHEN rn = 1 THEN ra.proto END) AS top_intent, max(CASE WHEN rn = 2 THEN ra.proto END) AS second_intent,
    max(CASE WHEN rn = 1 THEN ra.s END) AS activity_score, max(CASE WHEN rn = 2 THEN ra.s END) AS second_score,
    any_value(n.s) AS no_intent_score, any_value(o.s) AS oos_score
   FROM ra JOIN cs n ON n.vec_id = ra.vec_id AND n.proto = 'no_intent' JOIN cs o ON o.vec_id = ra.vec_id AND o.proto = 'oos' GROUP BY 1),
 sm AS (SELECT sc.*, decision, target_intent, part, round(greatest(activity_score, oos_score) - no_intent_score, 9) AS actionability,
    round(oos_score - activity_score, 9) AS oos_margin, round(activity_score - second_score, 9) AS ambiguity_margin
   FROM sc JOIN vectors v ON v.vec_id = sc.vec_id)"""


EMB = "CAST(embedding AS DOUBLE[])"
PROTO_SQL = f"""pr AS (SELECT coalesce(target_intent, decision) AS proto, vec_id AS id, {EMB} AS e FROM vectors WHERE part = 'prototype'),
 qs AS (SELECT vec_id, {EMB} AS e FROM vectors)"""
SCORED = f"{PROTO_SQL}, {cosine_sql('pr')}, {score_sql('qs')}"
GRID_ROWS = " CROSS JOIN ".join(
    f"(VALUES {', '.join(f'({v}::DOUBLE)' for v in GRID[a])}) g{i}({a})" for i, a in enumerate(P.AXES)
)
GATE = """CASE WHEN actionability < tau_actionability THEN 'no_intent' WHEN oos_margin >= tau_oos_margin OR activity_score < tau_activity_min THEN 'oos'
   WHEN ambiguity_margin < tau_ambiguity THEN 'ambiguous' ELSE 'in_scope' END"""
GRID_SQL = f"""gr AS (SELECT {", ".join(P.AXES)}, decision, {GATE} AS predicted, CASE WHEN ({GATE}) = decision AND (decision <> 'in_scope'
     OR top_intent = target_intent) THEN 1 ELSE 0 END AS hit FROM sm CROSS JOIN {GRID_ROWS} WHERE part = 'dev'),
 gt AS (SELECT {", ".join(P.AXES)}, label, count(*) FILTER (decision = label AND predicted = label) AS tp,
     count(*) FILTER (predicted = label) AS np, count(*) FILTER (decision = label) AS ng
   FROM gr CROSS JOIN (VALUES {", ".join(f"('{d}')" for d in DECISIONS)}) l(label) GROUP BY ALL),
 gf AS (SELECT {", ".join(P.AXES)}, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END), 9) AS f FROM gt GROUP BY ALL),
 gs AS (SELECT {", ".join("gr." + a for a in P.AXES)}, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 9) AS hem, any_value(f) AS decision_macro_f1
   FROM gr JOIN gf USING ({", ".join(P.AXES)}) GROUP BY ALL),
 bp AS (SELECT * FROM gs ORDER BY hem DESC, decision_macro_f1 DESC, {", ".join(sorted(P.AXES))} LIMIT 1)"""


def labelled_vectors(t):
    return t.vectors.withColumn("proto", F.coalesce("target_intent", "decision"))


def centers(t):
    return P.centroids(labelled_vectors(t).filter("part = 'prototype'"), "proto")


def scored(t):
    return P.scores(t.vectors, centers(t), "proto")


@query(
    "t07_centroids",
    f"WITH {PROTO_SQL}, {cosine_sql('pr')} SELECT proto, CAST(pos - 1 AS INTEGER) AS pos, round(v, 9) AS v FROM cu",
    "vectors",
)
def t07(t):
    return centers(t).select("proto", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round("v", 9))


SCORES = "vec_id, activity_score, second_score, no_intent_score, oos_score, actionability, oos_margin, ambiguity_margin"


@query("t08_cosine_scores", f"WITH {SCORED} SELECT {SCORES} FROM sm", "vectors")
def t08(t):
    return scored(t).select(*SCORES.split(", "))


@query("w08_top_labels", f"WITH {SCORED} SELECT vec_id, top_intent, second_intent FROM sm", "vectors")
def w08(t):
    return scored(t).select("vec_id", "top_intent", "second_intent")


FIXED = {"tau_actionability": 0.0, "tau_oos_margin": 0.05, "tau_activity_min": 0.1, "tau_ambiguity": 0.02}
_GATED = GATE
for _name, _value in FIXED.items():
    _GATED = _GATED.replace(_name, f"{_value}::DOUBLE")


@query(
    "t09_gate_routing",
    f"WITH {SCORED}, r AS (SELECT *, {_GATED} AS p_decision FROM sm) SELECT vec_id, p_decision, CASE WHEN p_decision = 'in_scope' THEN top_intent END AS p_intent FROM r",
    "vectors",
)
def t09(t):
    taus = {k: F.lit(v) for k, v in FIXED.items()}
    routed = scored(t).withColumn("p_decision", P.gated(taus))
    return routed.select("vec_id", "p_decision", F.when(F.col("p_decision") == "in_scope", F.col("top_intent")).alias("p_intent"))


@query("t10_threshold_grid", f"WITH {SCORED}, {GRID_SQL} SELECT * FROM gs", "vectors")
def t10(t):
    return P.grid_scores(scored(t).filter("part = 'dev'"), GRID)


@query("w09_best_point", f"WITH {SCORED}, {GRID_SQL} SELECT * FROM bp", "vectors")
def w09(t):
    return P.best_point(P.grid_scores(scored(t).filter("part = 'dev'"), GRID))


DEV_SQL = f"""dv AS (SELECT vec_id AS case_id, decision, CAST(floor(vec_id / 6) AS BIGINT) AS cluster_id,
     CASE WHEN vec_id % 2 = 0 THEN 'multi_turn' ELSE '__other__' END AS stratum, {EMB} AS e FROM vectors WHERE part = 'dev' AND decision IN ('oos', 'no_intent')),
 dr AS (SELECT decision, cluster_id, min(case_id) AS case_id FROM dv GROUP BY 1, 2),
 dk AS (SELECT dv.*, row_number() OVER (PARTITION BY dv.decision, stratum ORDER BY dv.case_id) AS rn FROM dv JOIN dr USING (case_id)),
 dp AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY rn, CASE stratum WHEN 'multi_turn' THEN 1 ELSE 2 END) AS position FROM dk QUALIFY position <= 8),
 pr AS (SELECT target_intent AS proto, vec_id AS id, {EMB} AS e FROM vectors WHERE part = 'prototype' AND target_intent IS NOT NULL
   UNION ALL SELECT decision, case_id, e FROM dp),
 qs AS (SELECT vec_id, {EMB} AS e FROM vectors)"""


@query(
    "t11_embedding_baseline",
    f"""WITH {DEV_SQL}, {cosine_sql('pr')}, {score_sql('qs')}, {GRID_SQL},
     te AS (SELECT decision, {GATE} AS predicted, CASE WHEN ({GATE}) = decision AND (decision <> 'in_scope' OR top_intent = target_intent) THEN 1 ELSE 0 END AS hit
       FROM sm CROSS JOIN (SELECT {", ".join(P.AXES)} FROM bp) b WHERE part = 'test'),
     tl AS (SELECT label, count(*) FILTER (decision = label AND predicted = label) AS tp, count(*) FILTER (predicted = label) AS np,
       count(*) FILTER (decision = label) AS ng FROM te CROSS JOIN (VALUES {", ".join(f"('{d}')" for d in DECISIONS)}) l(label) GROUP BY 1)
    SELECT 'cases' AS metric, count(*)::DOUBLE AS value FROM te UNION ALL SELECT 'hem', round(avg(hit), 9) FROM te
    UNION ALL SELECT 'decision_macro_f1', round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END), 9) FROM tl
    """
    + " ".join(f"UNION ALL SELECT '{a}', {a} FROM bp" for a in P.AXES),
    "vectors",
)
def t11(t):
    tags = F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("multi_turn"))).otherwise(F.array().cast("array<string>"))
    v = t.vectors.withColumns(
        {"case_id": F.col("vec_id"), "cluster_id": F.floor(F.col("vec_id") / 6).cast("bigint"), "tags": tags}
    )
    activity = v.filter("part = 'prototype' AND target_intent IS NOT NULL")
    predicted, chosen = Em.embedding_baseline(
        activity, v.filter("part = 'dev'"), v.filter("part = 'test'"), PROTO_STRATA, 8, GRID
    )
    return Em.embedding_report(predicted, chosen)
