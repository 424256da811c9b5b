"""Strict scans of real files, publishing, text normal forms and rule mutations."""

import json
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.functions import text as X
from plumbline.operators import quality as Q
from plumbline.sources import publish as P
from plumbline.sources import scan as S

GOOD = {"case_id": "case-1", "status": "success", "decision": "oos", "slots": {"horizon": "now"}, "latency_ms": 1.5}


def judged(spark, tmp_path, lines):
    folder = tmp_path / "run_id=r1"
    folder.mkdir()
    (folder / "predictions.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return S.judge_lines(S.read_lines(spark, str(tmp_path)), schemas.PREDICTION)


def test_bad_lines_are_kept_with_their_reason(spark, tmp_path):
    lines = [
        json.dumps(GOOD),
        "",
        '{"case_id": "x"',
        json.dumps({**GOOD, "extra": 1}),
        json.dumps({**GOOD, "slots": {"horizon": "now", "mood": "x"}}),
        json.dumps({**GOOD, "slots": {"object": "x"}}),
        json.dumps({k: v for k, v in GOOD.items() if k != "case_id"}),
        json.dumps({**GOOD, "latency_ms": "soon"}),
    ]
    result = judged(spark, tmp_path, lines)
    got = {r["reason"]: r["n"] for r in result.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert got == {None: 1, "blank_line": 1, "invalid_json": 2, "unknown_field": 2, "missing_field": 2}
    row = S.good_rows(result, ["run_id"]).first()
    assert (row["run_id"], row["case_id"], row["slots"]["horizon"]) == ("r1", "case-1", "now")
    assert S.bad_lines(result).count() == 7


TURN = {"role": "user", "content": "x"}
CASE = {
    "id": "case-1", "split": "dev", "context": {"state_summary": "s", "conversation": [TURN]},
    "gold": {"decision": "oos", "target_intent": None, "evidence_quote": "s", "slots": {"desired_experience": None, "object": None, "horizon": "now"}},
    "scenario_family_id": "f", "contrast_group_id": "c", "paraphrase_cluster_id": "p",
    "source": "human_authored", "annotator_id": "a", "adjudication_status": "draft", "annotation_note": "n",
}


def test_values_of_cases_are_held_to_their_fields(spark):
    lines = [
        (CASE, None),
        ({**CASE, "split": "train"}, "bad_value"),
        ({**CASE, "id": "A"}, "bad_value"),
        ({**CASE, "id": "case-1\n"}, "bad_value"),
        ({**CASE, "annotator_id": ""}, "bad_value"),
        ({**CASE, "tags": None}, "missing_field"),
        ({**CASE, "context": {"state_summary": "s", "conversation": [TURN, {**TURN, "role": "system"}]}}, "bad_value"),
        ({**CASE, "context": {"state_summary": "s", "conversation": [{"role": "user"}]}}, "bad_value"),
        ({**CASE, "context": {"state_summary": "s", "conversation": [{**TURN, "at": 1}]}}, "unknown_field"),
        ({**CASE, "context_perturbation": {"id": "p-1", "state_summary_prefix": ""}}, "bad_value"),
        ({k: v for k, v in CASE.items() if k != "source"}, "missing_field"),
    ]
    df = spark.createDataFrame([(i, json.dumps(line)) for i, (line, _) in enumerate(lines)], "i int, value string")
    rows = {r["i"]: r for r in S.judge_lines(df, schemas.CASE).collect()}
    assert [rows[i]["reason"] for i in range(len(lines))] == [reason for _, reason in lines]
    assert (rows[0]["row"]["tags"], rows[0]["row"]["gold"]["near_oos_sibling_intents"]) == ([], [])
    assert rows[0]["row"]["context_perturbation"] is None


def test_values_of_predictions_and_defaults(spark):
    usage = {"input_tokens": 1, "output_tokens": 2, "total_tokens": 3}
    lines = [
        ({**GOOD, "usage": usage}, None),
        ({**GOOD, "reason_short": "r" * 201}, "bad_value"),
        ({**GOOD, "usage": {**usage, "input_tokens": -1}}, "bad_value"),
        ({**GOOD, "usage": {**usage, "retry_input_tokens": None}}, "missing_field"),
        ({**GOOD, "raw_response_sha256": "A" * 64}, "bad_value"),
        ({"case_id": "case-1"}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(line)) for i, (line, _) in enumerate(lines)], "i int, value string")
    rows = {r["i"]: r for r in S.judge_lines(df, schemas.PREDICTION).collect()}
    assert [rows[i]["reason"] for i in range(len(lines))] == [reason for _, reason in lines]
    assert (rows[0]["row"]["usage"]["retry_input_tokens"], rows[5]["row"]["status"], rows[5]["row"]["usage"]) == (0, "success", None)


INTENTION = {"evidence_status": "clear", "action": "walk", "qualifiers": ["a"], "horizon": "now", "reason_short": "r"}
FORMED = {"case_id": "case-1", "status": "success", "formed_intention": INTENTION, "error_type": None, "usage": None, "latency_ms": 3}


def test_values_of_formed_intentions(spark):
    lines = [
        (FORMED, None),
        ({**FORMED, "formed_intention": None, "status": "schema_invalid", "error_type": "x"}, None),
        ({**FORMED, "formed_intention": {**INTENTION, "qualifiers": list("abcdefg")}}, "bad_value"),
        ({**FORMED, "formed_intention": {**INTENTION, "alternative_actions": list("abcde")}}, "bad_value"),
        ({**FORMED, "formed_intention": {**INTENTION, "alternative_actions": None}}, "missing_field"),
        ({**FORMED, "formed_intention": {**INTENTION, "action": "w" * 121}}, "bad_value"),
        ({**FORMED, "formed_intention": {**INTENTION, "mood": {"deep": [{"er": 1}]}}}, "unknown_field"),
        ({**FORMED, "formed_intention": {k: v for k, v in INTENTION.items() if k != "qualifiers"}}, "missing_field"),
        ({**FORMED, "formed_intention": [INTENTION]}, "invalid_json"),
        ({**FORMED, "case_id": 7}, "invalid_json"),
        ({**FORMED, "formed_intention": {**INTENTION, "qualifiers": [1]}}, "invalid_json"),
        ({**FORMED, "odd name, `of` it": 1}, "unknown_field"),
    ]
    df = spark.createDataFrame([(i, json.dumps(line)) for i, (line, _) in enumerate(lines)], "i int, value string")
    rows = {r["i"]: r for r in S.judge_lines(df, schemas.FORMED).collect()}
    assert [rows[i]["reason"] for i in range(len(lines))] == [reason for _, reason in lines]
    assert (rows[0]["row"]["formed_intention"]["alternative_actions"], rows[0]["row"]["schema_version"]) == ([], 1)


def test_a_line_is_parsed_once(spark):
    df = S.judge_lines(spark.createDataFrame([(json.dumps(FORMED),)], "value string"), schemas.FORMED)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and "from_json" not in plan


def test_a_scan_without_a_good_row_says_so(spark, tmp_path):
    outcomes = {r["outcome"] for r in S.scan_summary(judged(spark, tmp_path, ["", "{"])).collect()}
    assert outcomes == {"blank_line", "invalid_json", "empty"}


def test_publishing_twice(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(50).withColumn("x", F.col("id") / 3)
    assert P.publish(df, path) == "created"
    assert P.publish(df.orderBy(F.desc("id")), path) == "unchanged"
    assert P.publish(df.filter("id <> 7"), path) == "conflict"
    assert spark.read.parquet(path).count() == 50


def test_a_half_written_output_is_named_and_can_be_replaced(spark, tmp_path):
    path = tmp_path / "half"
    path.mkdir()
    df = spark.range(5)
    assert P.publish(df, str(path)) == "incomplete"
    assert P.publish(df, str(path), replace_incomplete=True) == "created"
    assert P.publish(df, str(path)) == "unchanged"


def test_csv_and_json_keep_nulls_and_empty_strings(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a,\"b")], "i int, s string")
    for kind in ["csv", "json", "parquet"]:
        path = str(tmp_path / kind)
        P.write(df, path, kind)
        assert sorted(map(tuple, P.read(spark, path, kind, df.schema).collect())) == [(1, None), (2, ""), (3, 'a,"b')]


def test_evidence_normal_form(spark):
    rows = [("ﬁ①\r\nx\ry", "fi1\nx\ny"), ("plain", "plain"), ("é", "é"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(X.normalise_evidence(F.col("a")).alias("n"), "b")
    assert all(r["n"] == r["b"] for r in df.collect())


def test_context_normal_form(spark):
    rows = [("  Straße\n X ", "strasse x"), ("STRASSE X", "strasse x"), ("a\u3000b", "a b"), ("\u2028ﬁ\x85A ", "fi a"), ("a\x1c\x0b B\t", "a b"), ("\u00a0", ""), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(X.context_text(F.col("a")).alias("n"), "b")
    assert all(r["n"] == r["b"] for r in df.collect())


def test_copies_of_contexts_across_forms(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A\u3000b"), (3, "STRASSE"), (4, "straße"), (5, "c")], "id long, t string")
    got = Q.duplicate_contexts(df, "id", "t").collect()
    assert sorted((r["key"], r["detail"]) for r in got) == [("1", "2"), ("3", "2")]


def test_context_json_sorts_keys_and_keeps_nulls(spark):
    schema = T.StructType([T.StructField("context", schemas.CONTEXT)])
    df = spark.createDataFrame([({"state_summary": 's"', "conversation": [{"role": "user", "content": "a\nb"}], "recent_activities": []},)], schema)
    c = F.col("context")
    out = df.select(
        X.serialise_context(c["state_summary"], c["conversation"], c["recent_activities"]).alias("j"),
        X.current_decision_text(c["state_summary"], c["conversation"]).alias("d"),
    ).first()
    wanted = {"conversation": [{"content": "a\nb", "role": "user"}], "recent_activities": [], "state_summary": 's"'}
    assert out["j"] == json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert out["d"] == 's"'


PREDICTION = "arm string, case_id bigint, status string, decision string, predicted_intent string, candidate_intents array<string>, horizon string, reason_short string, error_type string"
SOUND = {"arm": "A", "case_id": 1, "status": "success", "decision": "oos", "predicted_intent": None, "candidate_intents": [], "horizon": "now", "reason_short": "r", "error_type": None}
BROKEN = [
    ({}, []),
    ({"decision": "in_scope", "predicted_intent": "x"}, []),
    ({"decision": "ambiguous", "candidate_intents": ["a", "b"]}, []),
    ({"decision": "in_scope"}, ["in_scope_contract"]),
    ({"predicted_intent": "x"}, ["rejection_with_target"]),
    ({"decision": "ambiguous", "candidate_intents": ["a"]}, ["ambiguous_with_one"]),
    ({"candidate_intents": ["a", "b"]}, ["candidates_not_allowed"]),
    ({"decision": "ambiguous", "candidate_intents": ["a", "a"]}, ["candidates_repeated"]),
    ({"error_type": "x"}, ["success_with_error"]),
    ({"reason_short": "r" * 201}, ["reason_too_long"]),
    ({"status": "provider_failure", "error_type": "x"}, ["failed_with_semantics"]),
    ({"status": "schema_invalid", "decision": None, "candidate_intents": None, "horizon": None, "reason_short": None}, ["failed_without_error"]),
]


def test_prediction_rules_find_exactly_the_broken_clause(spark):
    rows = [tuple({**SOUND, **change, "case_id": i}.values()) for i, (change, _) in enumerate(BROKEN)]
    found = Q.prediction_truth_table(spark.createDataFrame(rows, PREDICTION)).collect()
    got = {}
    for r in found:
        got.setdefault(int(r["key"].split("|")[1]), []).append(r["detail"])
    assert got == {i: names for i, (_, names) in enumerate(BROKEN) if names}


def test_call_sequence_rules(spark):
    rows = [
        ("B", 1, 1, "a", "success", 0, 0), ("B", 1, 2, "b", "success", 0, 0),
        ("B", 2, 1, "a", "success", 0, 0),
        ("B", 3, 1, "a", "provider_failure", 0, 0),
        ("B", 4, 1, "b", "success", 0, 0), ("B", 4, 2, "b", "success", 3, 0),
        ("B", 5, 2, "b", "success", 0, 0), ("B", 5, 2, "b", "success", 0, 0),
    ]
    calls = spark.createDataFrame(rows, "arm string, case_id bigint, call_index int, stage string, status string, retry_input_tokens bigint, retry_output_tokens bigint")
    cases = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "case_id bigint")
    got = {(r["key"], r["detail"]) for r in Q.call_sequences(calls, cases, {("B", 1): ["a"], ("B", 2): ["b"]}).collect()}
    assert got == {
        ("B|2", "success_needs_two_calls"), ("B|4", "stage"), ("B|4", "retry_usage"), ("B|5", "indexes"), ("B|5", "unknown_case"),
    }


def test_vector_rules(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [float("inf"), 1.0])]
    got = {(r["key"], r["detail"]) for r in Q.vector_validity(spark.createDataFrame(rows, "i int, embedding array<double>"), "i", 2).collect()}
    assert got == {("2", "zero_norm"), ("3", "not_finite"), ("4", "dimension"), ("5", "not_finite")}


def test_a_table_that_is_published_again_is_counted_once(spark, monkeypatch):
    from plumbline.catalog import scans
    from plumbline.catalog.registry import QUERIES

    plans = []
    monkeypatch.setattr(scans.P, "publish", lambda df, path: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or "created")
    QUERIES["s09_idempotent_publish"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 4 and not any("Join" in plan or "parquet" in plan for plan in plans)


def test_rows_of_orders_are_dealt_out_by_their_number(spark, monkeypatch):
    from plumbline.sources import views

    monkeypatch.setattr(views, "PIECE_ROWS", {"orders": 100}, raising=False)
    tables = views.Tables(spark, "/root/testdata/sf0.001")
    assert tables.gold.rdd.getNumPartitions() == -(-tables.orders.count() // 100) > 8
    assert tables.gold.select("case_id").exceptAll(tables.orders.select("o_orderkey")).isEmpty() and tables.gold.count() == tables.orders.count()


def test_lines_are_made_and_judged_in_methods_of_their_own(spark):
    from plumbline.catalog.registry import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["s02_prediction_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert re.search(r"Coalesce \d+\n\W*\*\(\d+\) Project", plan)
