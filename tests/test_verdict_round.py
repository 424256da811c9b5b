"""Cases the registered tables do not hold: repeats, unknown evidence, neighbouring seeds, missing calls, giant groups."""

import random

from pyspark.sql import functions as F

from plumbline.operators import budget, compare, evaluate, quality, review, split
from plumbline.plans import matrix
from plumbline.plans.run_report import run_report
from plumbline.sources.views import INTENTS, Tables
from tests.harness import DATA


def test_repeated_prediction_is_not_chosen_and_marks_the_run(spark):
    gold = spark.createDataFrame([(1,), (2,)], "case_id long")
    rows = spark.createDataFrame([("A", 1, "success"), ("A", 1, "provider_failure"), ("B", 1, "success"), ("C", 9, "success")], "arm string, case_id long, status string")
    got = {r["arm"]: (r["repeated"], r["unknown"], r["valid"]) for r in evaluate.run_validity(gold, rows, ["A", "B", "C", "D"]).collect()}
    assert got == {"A": (1, 0, False), "B": (0, 0, True), "C": (0, 1, False), "D": (0, 0, True)}
    side = {r["arm"]: r["status"] for r in evaluate.prediction_side(rows.unionByName(rows.filter("arm = 'B'"))).collect()}
    assert side == {"A": None, "B": "success", "C": "success"}


def evidence(spark, near):
    part = "struct<point:double,lower:double,upper:double>"
    flags = ", ".join(f"{f} boolean" for f in ("valid", "aligned", "estimable", "usage_complete", "cost_complete", "latency_complete"))
    counts = ", ".join(f"{s}_{c} long" for s in ("left", "right") for c in ("context_errors", "schema_invalid", "tokens"))
    good = (0.2, 0.1, 0.3)
    row = (True, True, True, True, True, True, good, good, near, good, 0, 0, 10, 0, 0, 10)
    return spark.createDataFrame([row], f"{flags}, hem {part}, intent {part}, near {part}, quiet {part}, {counts}")


def test_unknown_evidence_is_never_promising(spark):
    assert compare.decide(evidence(spark, (0.2, 0.1, 0.3))).first()["verdict"] == "promising"
    for near in (None, (0.2, None, None), (float("nan"), 0.1, 0.3)):
        got = compare.decide(evidence(spark, near)).first()
        assert (got["verdict"], got["reasons"]) == ("inconclusive", ["required_ci_unavailable"])


def test_neighbouring_seeds_share_no_more_than_distant_ones(spark):
    columns = ["a", "b", "c"]
    powers = [F.pow("id", F.lit(k)).cast("long").alias(c) for k, c in enumerate(columns, 1)]
    clusters = spark.range(1, 101).select(F.lit("d").alias("domain"), *powers)
    classes = compare.vector_classes(clusters, columns).cache()

    def draws(seed):
        rows = compare.drawn_sums(classes, {"d": 100}, columns, 40, seed).collect()
        return {tuple(r[c] for c in columns) for r in rows}

    first = draws(7)
    assert len(first) == 40 and not first & draws(8) and not first & draws(900)


def test_missing_retry_tokens_count_as_none(spark):
    usage = spark.createDataFrame([("a", 10, 5, None, None, 99), ("b", 10, 5, None, None, 15)], "k string, input_tokens long, output_tokens long, retry_input_tokens long, retry_output_tokens long, total_tokens long")
    assert [r["key"] for r in quality.usage_totals(usage, F.col("k")).collect()] == ["a"]


def test_case_without_a_call_is_reported(spark):
    calls = spark.createDataFrame([("A", 1, 1, "x", "success", 0, 0)], "arm string, case_id long, call_index long, stage string, status string, retry_input_tokens long, retry_output_tokens long")
    cases = spark.createDataFrame([("A", 1), ("A", 2)], "arm string, case_id long")
    got = quality.call_sequences(calls, cases, {("A", 1): ["x"], ("A", 2): ["y"]}).collect()
    assert ("A|2", "no_calls") in {(r["key"], r["detail"]) for r in got}


def test_policy_without_context_is_reported(spark):
    flagged = spark.createDataFrame([(1, 5)], "item_id long, packet_id long")
    policies = spark.createDataFrame([(1, 5, 8, "q")], "item_id long, packet_id long, policy_id long, quote string")
    contexts = spark.createDataFrame([], "item_id long, text string")
    assert [r["detail"] for r in review.policy_alignment(flagged, policies, contexts).collect()] == ["context_missing"]


def test_giant_group_leaves_the_quota_to_others(spark):
    groups = spark.createDataFrame([(i, "s", 1) for i in range(200)] + [(999, "s", 300)], "group_id long, stratum string, cases long")
    taken = split.candidate_splits(groups, 8, 3, 10).filter("dev = 1").groupBy("seed").agg(F.sum("cases").alias("n")).collect()
    assert [r["n"] for r in taken] == [150] * 8


def test_invalid_run_has_no_metrics_intervals_or_verdict(spark):
    tables = Tables(spark, f"{DATA}/sf0.001")
    predictions = tables.predictions
    differing = predictions.filter("arm = 'B' AND case_id = 3").withColumn("status", F.lit("schema_invalid"))
    predictions = predictions.unionByName(differing)
    report = run_report(tables.gold, predictions, ["A", "B"], INTENTS)
    got = {(r["arm"], r["metric"]): r["value"] for r in report.filter("slice = 'all'").collect()}
    assert got["B", "hierarchical_exact_match"] is None and got["B", "repeated_predictions"] == 1.0
    assert got["A", "hierarchical_exact_match"] > 0 and ("A", "repeated_predictions") not in got
    rows = evaluate.join_predictions(tables.gold, predictions, ["A", "B"])
    validity = evaluate.run_validity(tables.gold, predictions, ["A", "B"])
    intervals = compare.compare_domains(rows, [("A", "B")], INTENTS, 20, 1, validity=validity)
    assert {(r["point"], r["lower"], r["unavailable_reason"]) for r in intervals.collect()} == {(None, None, "invalid_run")}
    ungated = compare.compare_domains(rows, [("A", "B")], INTENTS, 20, 1)
    summaries = matrix.run_summaries(rows, ["A", "B"], INTENTS, "B")
    for listed in (validity, validity.filter("arm = 'A'")):
        verdict = matrix.pilot_verdicts(ungated, summaries, listed).first()
        assert (verdict["verdict"], verdict["reasons"]) == (None, ["invalid_run"])


def test_tagged_cases_without_turns_or_quote_are_judged(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "assistant", "q"), (4, 0, "user", "a"), (4, 1, "assistant", "q")],
        "id long, turn long, role string, text string",
    )
    quotes = spark.createDataFrame([(2, "q"), (3, "q"), (4, "q")], "id long, quote string")
    tagged = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False)], "id long, multi_turn boolean")
    got = {(r["key"], r["detail"]) for r in quality.final_turn_rules(turns, quotes, "id", tagged).collect()}
    assert got == {("1", "final_role"), ("1", "quote_missing"), ("2", "turns_missing"), ("3", "turns_missing")}
    untagged = {(r["key"], r["detail"]) for r in quality.final_turn_rules(turns, quotes, "id").collect()}
    assert untagged == {("1", "final_role"), ("1", "quote_missing")}


def test_a_prediction_decides_whether_two_calls_are_needed_and_its_usage_is_their_sum(spark):
    fields = "input_tokens bigint, output_tokens bigint, retry_input_tokens bigint, retry_output_tokens bigint, total_tokens bigint"
    rows = [("A", 1, 1, "x", "success", 5, 1, 0, 0, 6), ("A", 2, 1, "x", "success", 5, 1, 0, 0, 6), ("A", 2, 2, "y", "success", 5, 1, 0, 0, 6)]
    rows += [("A", 3, 1, "x", "success", 5, 1, 0, 0, 6), ("A", 4, 1, "x", "success", None, None, None, None, None), ("A", 4, 2, "y", "success", 5, 1, 0, 0, 6)]
    calls = spark.createDataFrame(rows, f"arm string, case_id bigint, call_index bigint, stage string, status string, {fields}")
    said = [("A", 1, "schema_invalid", 5, 1, 0, 0, 6), ("A", 2, "success", 10, 3, 0, 0, 12), ("A", 3, "success", 5, 1, 0, 0, 6), ("A", 4, "success", 9, 9, 0, 0, 18)]
    predictions = spark.createDataFrame(said, f"arm string, case_id bigint, status string, {fields}")
    got = quality.call_sequences(calls, calls, {("A", 1): ["x"], ("A", 2): ["y"]}, predictions).collect()
    assert {(r["key"], r["detail"]) for r in got} == {("A|2", "usage_differs"), ("A|3", "success_needs_two_calls")}


def test_calls_without_a_price_leave_the_cost_open(spark):
    fields = "input_tokens bigint, output_tokens bigint, retry_input_tokens bigint, retry_output_tokens bigint, total_tokens bigint, latency_ms double"
    rows = [("A", 1, "m", 10, 2, None, 1, 13, 5.0), ("A", 1, "m", 1, 1, 0, 0, 2, 5.0), ("A", 2, "other", 1, 1, 0, 0, 2, 1.0), ("B", 1, "m", None, None, None, None, None, 1.0)]
    calls = spark.createDataFrame(rows, f"arm string, case_id bigint, requested_model string, {fields}")
    pricing = spark.createDataFrame([("m", 100, 1000)], "requested_model string, input_nano bigint, output_nano bigint")
    got = {(r["arm"], r["case_id"]): r["cost"] for r in budget.case_budgets(calls, pricing).collect()}
    assert got == {("A", 1): 5.1e-06, ("A", 2): None, ("B", 1): None}


def test_names_of_a_table_of_any_size_are_found_in_whole_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, ""), (61, None), (62, "x" * 5000 + words[0])]
    names = [(w,) for w in words[:200]] + [(f"{words[3]} {words[4]}",), ("",), (None,), ("not there",), (words[1],)]
    want = {(str(i), n) for i, t in texts if t for (n,) in names if n and n in t}
    df, table = spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame(names, "name string")
    for limit in (quality.NAME_BYTES, 100):
        got = [(r["key"], r["detail"]) for r in quality.leaked_names(df, "id", "text", table, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    many = spark.range(100_000).select(F.concat(F.lit("name "), "id", F.lit(" of it")).alias("name"))
    one = spark.createDataFrame([(1, "so name 4711 of it, and name 99999 of it."), (2, "name 100000 of it")], "id int, text string")
    assert {r["detail"] for r in quality.leaked_names(one, "id", "text", many).collect()} == {"name 4711 of it", "name 99999 of it"}
    assert quality.leaked_names(df, "id", "text", table.filter("false")).collect() == []
