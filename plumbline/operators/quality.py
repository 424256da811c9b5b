"""Data-quality rules. Each returns violations (rule, key, detail); a table is valid when there are none."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.operators.budget import TOKEN_FIELDS
from plumbline.functions.text import context_text, normalise_evidence
from plumbline.schemas import PATTERN_TAGS, PROBE_TAGS, SLICE_TAGS


def violation(df: DataFrame, rule: str, key: Column | str, detail: Column | str) -> DataFrame:
    column = F.col(key) if isinstance(key, str) else key
    text = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(rule).alias("rule"), column.cast("string").alias("key"), text.cast("string").alias("detail"))


def violations(df: DataFrame, rule: str, key: Column | str, clauses: dict[str, Column]) -> DataFrame:
    """One row per broken clause; a null condition is not a violation. One pass over the table."""
    broken = F.array_compact(F.array(*[F.when(condition, name) for name, condition in clauses.items()]))
    return violation(df.withColumn("_clause", F.explode(broken)), rule, key, F.col("_clause"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _empty(array: Column) -> Column:
    return F.coalesce(F.size(array) == 0, F.lit(True))


def _repeats(array: str) -> Column:
    return F.size(array) != F.size(F.array_distinct(array))


def duplicate_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return violation(counted, "V01", F.concat_ws("|", *keys), F.col("n"))


def extra_predictions(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    extra = predictions.join(gold.select("case_id"), "case_id", "left_anti")
    return violation(extra, "V02", F.concat_ws("|", "arm", "case_id"), "not_in_gold")


def gold_truth_table(gold: DataFrame) -> DataFrame:
    inside = F.col("decision") == "in_scope"
    return violations(
        gold,
        "V03",
        "case_id",
        {
            "target_missing": inside & F.col("target_intent").isNull(),
            "target_unexpected": ~inside & F.col("target_intent").isNotNull(),
            "siblings_repeated": _repeats("siblings"),
        },
    )


def prediction_truth_table(predictions: DataFrame) -> DataFrame:
    won = F.col("status") == "success"
    inside, unsure = F.col("decision") == "in_scope", F.col("decision") == "ambiguous"
    candidates, target = F.col("candidate_intents"), F.col("predicted_intent")
    semantic = F.coalesce("decision", "predicted_intent", "horizon", "reason_short").isNotNull()
    some = F.coalesce(F.size(candidates) > 0, F.lit(False))
    return violations(
        predictions,
        "V04",
        F.concat_ws("|", "arm", "case_id"),
        {
            "failed_with_semantics": ~won & (semantic | candidates.isNotNull()),
            "failed_without_error": ~won & F.col("error_type").isNull(),
            "success_with_error": won & F.col("error_type").isNotNull(),
            "success_without_decision": won & (F.col("decision").isNull() | candidates.isNull()),
            "success_without_slots": won & (F.col("horizon").isNull() | F.col("reason_short").isNull()),
            "reason_too_long": won & (F.char_length("reason_short") > 200),
            "candidates_repeated": won & _repeats("candidate_intents"),
            "in_scope_contract": won & inside & (target.isNull() | some),
            "rejection_with_target": won & ~inside & target.isNotNull(),
            "ambiguous_with_one": won & unsure & (F.size(candidates) == 1),
            "candidates_not_allowed": won & ~inside & ~unsure & some,
        },
    )


def usage_totals(usage: DataFrame, key: Column) -> DataFrame:
    billed = F.col("input_tokens") + F.col("output_tokens") + sum(F.coalesce(c, F.lit(0)) for c in ("retry_input_tokens", "retry_output_tokens"))
    return violation(usage.filter(F.col("total_tokens") != billed), "V05", key, F.col("total_tokens") - billed)


def unknown_labels(references: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``references``: key, kind and the label referred to; ``taxonomy``: its names."""
    unknown = references.filter("label IS NOT NULL").join(taxonomy.select(F.col("name").alias("label")), "label", "left_anti")
    return violation(unknown.distinct(), "V06", "key", F.concat_ws(":", "kind", "label"))


def label_references(gold: DataFrame) -> DataFrame:
    """Targets, siblings, competitors, and the activities of the perturbation and of the context, of each case in one pass."""

    def each(column, kind):
        return F.transform(F.col(column), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("label")))

    def one(column, kind):
        return F.array(F.struct(F.lit(kind).alias("kind"), F.col(column).alias("label")))

    single = {"target_intent": "target", "perturbation": "perturbation", "recent_activity": "recent_activity"}
    lists = [each("siblings", "sibling"), each("hard_negative_against", "competitor")]
    facts = F.concat(*[one(c, kind) for c, kind in single.items()], *[F.coalesce(x, F.array()) for x in lists])
    return gold.select(F.col("case_id").cast("string").alias("key"), F.inline(facts))


def prediction_references(predictions: DataFrame) -> DataFrame:
    """The predicted intent and every candidate of each prediction."""
    said = F.array(F.struct(F.lit("predicted").alias("kind"), F.col("predicted_intent").alias("label")))
    listed = F.transform("candidate_intents", lambda s: F.struct(F.lit("candidate").alias("kind"), s.alias("label")))
    return predictions.select(F.concat_ws("|", "arm", "case_id").alias("key"), F.inline(F.concat(said, F.coalesce(listed, F.array()))))


def evidence_in_turns(quotes: DataFrame, turns: DataFrame, id_column: str) -> DataFrame:
    """V07 for a table of turns: the longest conversation is still read turn by turn, combined before the shuffle."""
    quoted = F.contains(normalise_evidence(F.col("text")), normalise_evidence(F.col("quote")))
    found = skew_join(turns, quotes, [id_column]).groupBy(id_column).agg(F.max(L.as_flag(quoted)).alias("found"))
    missing = quotes.join(found.filter("found = 1"), id_column, "left_anti")
    return violation(missing, "V07", id_column, "quote_not_in_context")


def diagnostic_tags(gold: DataFrame) -> DataFrame:
    """V08 for each case."""
    tags, rivals = F.col("tags"), F.col("hard_negative_against")
    near, hard = L.has_tag("near_oos"), L.has_tag("hard_negative")
    context = F.array_intersect(tags, F.array(F.lit("context_control"), F.lit("context_distractor")))
    probe = F.arrays_overlap(tags, F.array(*[F.lit(x) for x in PROBE_TAGS]))
    inside, unsure = F.col("decision") == "in_scope", F.col("decision") == "ambiguous"
    same_rivals = _empty(F.array_except(rivals, "siblings")) & _empty(F.array_except("siblings", rivals))
    return violations(
        gold,
        "V08",
        "case_id",
        {
            "tags_repeated": _repeats("tags"),
            "both_context_tags": F.size(context) > 1,
            "perturbation_mismatch": (F.size(context) > 0) != F.col("perturbation").isNotNull(),
            "near_oos_not_oos": near & (F.col("decision") != "oos"),
            "near_oos_without_sibling": near & _empty(F.col("siblings")),
            "near_oos_not_hard": near & ~hard,
            "sibling_without_near_oos": ~near & ~_empty(F.col("siblings")),
            "competitors_repeated": _repeats("hard_negative_against"),
            "hard_without_competitor": hard & _empty(rivals),
            "hard_in_scope": hard & inside,
            "hard_ambiguous_needs_two": hard & unsure & (F.size(rivals) < 2),
            "competitor_without_hard": ~hard & ~_empty(rivals),
            "competitors_not_siblings": near & ~same_rivals,
            "probe_mismatch": L.has_tag("hypothesized_weak_model_probe") != probe,
            "quiet_not_no_intent": L.has_tag("quiet_control") & (F.col("decision") != "no_intent"),
        },
    )


def unlinked_siblings(gold: DataFrame) -> DataFrame:
    wanted = gold.filter(L.has_tag("near_oos")).select(
        "case_id", "contrast_id", F.explode("siblings").alias("target_intent")
    )
    linked = gold.filter("decision = 'in_scope'").select("contrast_id", "target_intent").distinct()
    missing = wanted.join(linked, ["contrast_id", "target_intent"], "left_anti")
    return violation(missing, "V09", "case_id", F.col("target_intent"))


_PAIR_FIELDS = [
    "scenario_id",
    "decision",
    "target_intent",
    "horizon",
    "desired_experience",
    "object_slot",
    "perturbation",
    "dialogue",
]


def _best(role: Column, name: str) -> Column:
    fields = ["case_id", *_PAIR_FIELDS, "hard_negative_against", "tags", "base_state", "state_summary", "recent_activity"]
    return F.max(F.when(role, F.struct(*fields))).alias(name)


def context_pair_contract(gold: DataFrame) -> DataFrame:
    """V10, by one aggregation per contrast group: counts say whether it is a pair, the two rows are then compared."""
    control, distractor = L.has_tag("context_control"), L.has_tag("context_distractor")
    groups = (
        gold.groupBy("contrast_id")
        .agg(
            F.count("*").alias("members"),
            F.sum(L.as_flag(control)).alias("controls"),
            F.sum(L.as_flag(distractor)).alias("distractors"),
            _best(control, "c"),
            _best(distractor, "d"),
        )
        .filter("controls + distractors > 0")
    )
    exact = (F.col("members") == 2) & (F.col("controls") == 1) & (F.col("distractors") == 1)
    c, d = F.col("c"), F.col("d")
    clauses = {"not_a_pair": ~exact}
    clauses |= {f"{f}_differs": exact & ~c[f].eqNullSafe(d[f]) for f in _PAIR_FIELDS}
    rest_c = F.array_sort(F.array_except(c["tags"], F.array(F.lit("context_control"))))
    rest_d = F.array_sort(F.array_except(d["tags"], F.array(F.lit("context_distractor"))))
    clauses |= {
        "competitors_differ": exact & (c["hard_negative_against"] != d["hard_negative_against"]),
        "tags_differ": exact & (rest_c != rest_d),
        "control_has_recent_activity": exact & c["recent_activity"].isNotNull(),
        "state_not_perturbed": exact & (d["state_summary"] != F.concat(F.lit("then "), c["state_summary"])),
        "activity_not_perturbed": exact & ~d["recent_activity"].eqNullSafe(d["perturbation"]),
    }
    return violations(groups, "V10", "contrast_id", clauses)


def split_leakage(cases: DataFrame, components: DataFrame) -> DataFrame:
    """A group in two splits, or a group id that is not the recomputed component."""
    spread = cases.groupBy("cluster_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b")
    moved = cases.join(components.select("case_id", "component"), "case_id").filter("component <> cluster_id")
    return violation(spread, "V11", F.concat(F.lit("group "), F.col("cluster_id")), "crosses_splits").unionByName(
        violation(moved, "V11", F.concat(F.lit("case "), F.col("case_id")), "unstable_group")
    )


def duplicate_contexts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only a hash of each context is shuffled, and no list of copies is built."""
    signed = df.select(key, F.sha2(context_text(F.col(text)), 256).alias("signature"))
    repeated = signed.groupBy("signature").agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")
    return violation(repeated, "V12", "first", F.col("n"))


def quota_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(dimension, value, expected) against (dimension, value, n), either side may lack a row."""
    joined = expected.join(observed, ["dimension", "value"], "full_outer").fillna(0, ["expected", "n"])
    return violation(
        joined.filter("expected <> n"),
        "V13",
        F.concat_ws("=", "dimension", "value"),
        F.concat_ws("/", F.col("expected").cast("string"), F.col("n").cast("string")),
    )


def mixed_clusters(gold: DataFrame) -> DataFrame:
    label = F.concat_ws("/", "decision", "target_intent")
    groups = gold.groupBy("paraphrase_id").agg(F.min(label).alias("a"), F.max(label).alias("b"))
    return violation(groups.filter("a <> b"), "V14", "paraphrase_id", F.concat_ws("|", "a", "b"))


def leaking_cues(turns: DataFrame) -> DataFrame:
    """User turns said at least twice, always under one decision."""
    said = (
        turns.filter("role = 'user'")
        .withColumn("cue", F.sha2(normalise_evidence(F.col("text")), 256))
        .groupBy("cue")
        .agg(F.count("*").alias("n"), F.min("decision").alias("a"), F.max("decision").alias("b"))
    )
    return violation(said.filter("n >= 2 AND a = b"), "V15", "cue", F.concat_ws("/", F.col("n").cast("string"), "a"))


def near_pair_contract(gold: DataFrame) -> DataFrame:
    """A near-OOS case and its in-scope sibling differ in the last turn only."""
    members = gold.groupBy("contrast_id").agg(
        F.count("*").alias("members"),
        F.max(
            F.when(
                F.col("decision") == "in_scope",
                F.struct("case_id", "scenario_id", "tags", "recent_activity", "dialogue"),
            )
        ).alias("s"),
    )
    near = skew_join(gold.filter(L.has_tag("near_oos")), members, ["contrast_id"])
    s = F.col("s")
    return violations(
        near,
        "V16",
        "case_id",
        {
            "not_a_pair": F.col("members") != 2,
            "sibling_missing": s.isNull(),
            "scenario_differs": s["scenario_id"] != F.col("scenario_id"),
            "turn_shape_differs": F.array_contains(s["tags"], "multi_turn") != L.has_tag("multi_turn"),
            "recent_activity_differs": s.isNotNull() & ~s["recent_activity"].eqNullSafe(F.col("recent_activity")),
            "dialogue_differs": s["dialogue"] != F.col("dialogue"),
        },
    )


def draft_rules(gold: DataFrame, slice_targets: dict[str, list[str]]) -> DataFrame:
    """Rules on one draft row. ``slice_targets``: which in-scope targets may be in a slice."""
    tags = F.col("tags")

    def among(names):
        return F.size(F.array_intersect(tags, F.array(*[F.lit(n) for n in names])))

    oos = F.col("decision") == "oos"
    clauses = {
        "unknown_tag": F.size(F.array_except(tags, F.array(*[F.lit(x) for x in SLICE_TAGS]))) > 0,
        "turn_shape": among(["single_turn", "multi_turn"]) != 1,
        "pattern_missing": L.has_tag("multi_turn") & (among(PATTERN_TAGS) != 1),
        "pattern_on_single_turn": L.has_tag("single_turn") & (among(PATTERN_TAGS) > 0),
        "oos_needs_near_or_far": oos & (among(["near_oos", "far_oos"]) != 1),
        "near_far_without_oos": ~oos & (among(["near_oos", "far_oos"]) > 0),
    }
    for tag, targets in slice_targets.items():
        clauses[f"{tag}_target"] = L.has_tag(tag) & (F.col("decision") == "in_scope") & ~F.col("target_intent").isin(*targets)
    return violations(gold, "V17", "case_id", clauses)


def candidate_rules(drafts: DataFrame, intents: list[str], word_slices: dict[str, tuple[str, str]]) -> DataFrame:
    """What a candidate must be before anybody has reviewed it.

    ``drafts`` has case_id, decision, target_intent, tags, source, adjudication_status, relations (its relation ids), n_turns (of the
    conversation), recent (activities) and carriers (the state and every turn). ``word_slices``: for a tag, the only target it may have,
    in scope, and a word that no carrier of it may hold.
    """
    unknown = lambda names: F.size(F.array_except(names, F.array(*[F.lit(i) for i in intents]))) > 0
    multi = F.coalesce(L.has_tag("multi_turn"), F.lit(False))
    clauses = {
        "source_not_pending": ~F.col("source").eqNullSafe("llm_assisted_pending_human_review"),
        "status_not_draft": ~F.col("adjudication_status").eqNullSafe("draft"),
        "relation_placeholder": F.exists("relations", lambda r: F.contains(r, F.lit("replace-"))),
        "turn_shape_disagrees": multi != (F.coalesce("n_turns", F.lit(0)) > 0),
        "unknown_recent_activity": unknown(F.col("recent")),
    }
    for tag, (target, word) in word_slices.items():
        right = (F.col("decision") == "in_scope") & F.col("target_intent").eqNullSafe(target)
        said = F.exists("carriers", lambda c: F.contains(c, F.lit(word)))  # noqa: B023
        clauses[f"{tag}_candidate"] = L.has_tag(tag) & (~F.coalesce(right, F.lit(False)) | F.coalesce(said, F.lit(False)))
    return violations(drafts, "V17", "case_id", clauses)


def final_turn_rules(turns: DataFrame, quotes: DataFrame, id_column: str, tagged: DataFrame | None = None) -> DataFrame:
    """A multi-turn case ends with the assistant, and that turn carries the quote.

    ``tagged`` (id, multi_turn) tells which cases are multi-turn; only where no tags are stored, those with several turns are.
    """
    last = turns.groupBy(id_column).agg(F.count("*").alias("n"), F.max(F.struct("turn", "role", "text")).alias("t"))
    if tagged is None:
        cases = last.filter("n > 1")
    else:
        cases = tagged.filter("multi_turn").select(id_column).distinct().join(last, id_column, "left")
    joined = cases.join(quotes, id_column, "left")
    quoted = F.contains(normalise_evidence(F.col("t.text")), normalise_evidence(F.col("quote")))
    few = F.coalesce(F.col("n"), F.lit(0)) < 2
    return violations(
        joined,
        "V17",
        id_column,
        {
            "turns_missing": few,
            "final_role": ~F.col("t.role").eqNullSafe(F.lit("assistant")) & F.col("n").isNotNull(),
            "quote_missing": F.col("quote").isNull(),
            "final_without_quote": ~quoted,
        },
    )


def sibling_relation(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, sibling) is irreflexive, known and symmetric."""
    edges = edges.select("name", "sibling").distinct()
    key = F.concat_ws(">", F.col("name").cast("string"), F.col("sibling").cast("string"))
    reverse = edges.select(F.col("sibling").alias("name"), F.col("name").alias("sibling"))
    known = names.select(F.col("name").alias("sibling"))
    return (
        violation(edges.filter("name = sibling"), "V18", key, "own_sibling")
        .unionByName(violation(edges.join(known, "sibling", "left_anti"), "V18", key, "unknown_sibling"))
        .unionByName(violation(edges.join(reverse, ["name", "sibling"], "left_anti"), "V18", key, "not_symmetric"))
    )


# ---- calls and runs --------------------------------------------------------------------------------------------


def call_sequences(
    calls: DataFrame, cases: DataFrame, stages: dict[tuple[str, int], list[str]], predictions: DataFrame | None = None
) -> DataFrame:
    """V19 from counts per (arm, case); nothing is collected, so a case with very many calls is no harder.

    ``cases`` (case_id, and arm where it matters) must have been called; one that has no call at all is reported as such.
    ``predictions`` (arm, case_id, status and usage) say which cases succeeded and must have two calls, and where all usage is known, theirs is
    the sum of the calls'. Without them a case succeeded whose calls all did.
    """
    expected = F.lit(None)
    for (arm, index), names in stages.items():
        expected = F.when(
            (F.col("arm") == arm) & (F.col("call_index") == index), F.col("stage").isin(*names)
        ).otherwise(expected)
    grouped = calls.withColumn("_stage_ok", expected).groupBy("arm", "case_id").agg(
        F.count("*").alias("n"),
        F.sum(L.as_flag(F.col("call_index") == 1)).alias("first"),
        F.sum(L.as_flag(F.col("call_index") == 2)).alias("second"),
        F.sum(L.as_flag(~F.col("_stage_ok"))).alias("wrong_stage"),
        F.bool_and(F.col("status") == "success").alias("won"),
        *([] if predictions is None else [F.bool_and(F.col("total_tokens").isNotNull()).alias("known"), *[F.sum(c).alias(f"sum_{c}") for c in TOKEN_FIELDS]]),
        F.sum(F.coalesce(F.col("retry_input_tokens") + F.col("retry_output_tokens"), F.lit(0))).alias("retries"),
    )
    key = F.concat_ws("|", "arm", "case_id")
    won, usage = F.col("won"), {}
    if predictions is not None:
        said = predictions.select("arm", "case_id", F.col("status").alias("said"), *[F.col(c).alias(f"said_{c}") for c in TOKEN_FIELDS])
        grouped = grouped.join(said, ["arm", "case_id"], "left")
        won = F.col("said") == "success"
        other = reduce(Column.__or__, [~F.col(f"sum_{c}").eqNullSafe(F.col(f"said_{c}")) for c in TOKEN_FIELDS])
        usage = {"usage_differs": F.col("known") & F.col("said_total_tokens").isNotNull() & other}
    good = (F.col("first") == 1) & (F.col("second") == F.col("n") - 1) & (F.col("n") <= 2)
    rows = violations(
        grouped,
        "V19",
        key,
        {
            "indexes": ~good,
            "stage": F.col("wrong_stage") > 0,
            "success_needs_two_calls": won & (F.col("n") != 2),
            "retry_usage": F.col("retries") > 0,
            **usage,
        },
    )
    extra = grouped.join(cases.select("case_id").distinct(), "case_id", "left_anti")
    own = [c for c in ("arm", "case_id") if c in cases.columns]
    silent = cases.select(*own).distinct().join(grouped.select(*own), own, "left_anti")
    silent = violation(silent, "V19", F.concat_ws("|", *own), "no_calls")
    return rows.unionByName(violation(extra, "V19", key, "unknown_case")).unionByName(silent)


def differing_fields(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], rule: str) -> DataFrame:
    """Both sides one row per key; rows on one side only, or unequal fields."""
    a = left.select(*keys, F.struct(*fields).alias("a"))
    b = right.select(*keys, F.struct(*fields).alias("b"))
    joined = a.join(b, keys, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    clauses = {"left_missing": F.col("a").isNull(), "right_missing": F.col("b").isNull()}
    clauses |= {f: both & ~F.col("a")[f].eqNullSafe(F.col("b")[f]) for f in fields}
    return violations(joined, rule, F.concat_ws("|", *keys), clauses)


def formed_truth_table(formed: DataFrame) -> DataFrame:
    """V23."""
    status, action = F.col("evidence_status"), F.col("action")
    alternatives = F.coalesce(F.size("alternatives"), F.lit(0))
    positive = action.isNotNull() | F.col("object").isNotNull() | (alternatives > 0)
    return violations(
        formed,
        "V23",
        "id",
        {
            "none_with_fields": (status == "none") & positive,
            "one_action_needed": status.isin("clear", "deferred") & (action.isNull() | (alternatives > 0)),
            "ambiguous_needs_choice": (status == "ambiguous") & action.isNull() & (alternatives < 2),
            "deferred_not_later": (status == "deferred") & (F.col("horizon") != "later"),
        },
    )


#: Bytes of the names that are looked for in one pass over the texts.
NAME_BYTES = 8 << 20


def leaked_names(df: DataFrame, key: str, text: str, names: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """Every name of a taxonomy table (``name``) that occurs anywhere in a whole text.

    An automaton finds all names of a block in one pass over a text, however many they are, so no text is paired with names and
    none is shuffled. A block of names is sent to the executors; blocks hold ``name_bytes`` at most, but for single longer names, and a
    table of more is gone through block by block. Null and empty names and null texts match nothing.
    """
    known = cut(names.select(F.col("name").cast("string").alias("name")).filter("name <> ''").distinct())
    total = known.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    blocks = max(1, -(-total // name_bytes))
    context, found = df.sparkSession.sparkContext, None
    texts = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL")
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block)
        sent = context.broadcast(sorted(r["name"] for r in part.collect()))
        hits = texts.mapInArrow(_names_in(sent), "key string, name string")
        found = hits if found is None else found.unionByName(hits)
    return violation(found, "V24", "key", F.col("name"))


def _names_in(sent):
    def hits(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in sent.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            pairs = [(k, n) for k, t in zip(keys, texts, strict=True) if len(automaton) for n in sorted({n for _, n in automaton.iter(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["key", "name"])

    return hits


def catalog_difference(wanted: DataFrame, found: DataFrame, references: DataFrame) -> DataFrame:
    """Names missing or extra, and references to names the catalog lacks."""
    key = F.col("name")
    dangling = references.select("name").distinct().join(found.select("name").distinct(), "name", "left_anti")
    return (
        violation(wanted.select("name").subtract(found.select("name")), "V29", key, "missing")
        .unionByName(violation(found.select("name").subtract(wanted.select("name")), "V29", key, "extra"))
        .unionByName(violation(dangling, "V29", key, "unknown_reference"))
    )


def coverage_gaps(counts: DataFrame, rows: list[str], kinds: list[str], wanted: int) -> DataFrame:
    """Exactly ``wanted`` examples in every cell of (decision, kind)."""
    cells = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in rows])).alias("decision"))
    cells = cells.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    joined = cells.join(counts, ["decision", "kind"], "left").fillna(0, ["n"])
    return violation(joined.filter(F.col("n") != wanted), "V30", F.concat_ws("/", "decision", "kind"), F.col("n"))


def missing_decision_pairs(members: DataFrame, group: str, decisions: list[str]) -> DataFrame:
    """Pairs of decisions that no group holds together. Sets per group are at most the fixed decisions."""
    present = members.groupBy(group).agg(
        *[F.max(L.as_flag(F.col("decision") == d)).alias(d) for d in decisions]
    )
    pairs = [(a, b) for i, a in enumerate(decisions) for b in decisions[i + 1 :]]
    counts = present.agg(
        F.array(
            *[
                F.struct(F.lit(f"{a}+{b}").alias("pair"), F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias("n"))
                for a, b in pairs
            ]
        ).alias("p")
    ).select(F.inline("p"))
    return violation(counts.filter("n = 0"), "V30", "pair", "never_together")


def uncovered_tags(members: DataFrame, tags: list[str]) -> DataFrame:
    """Boundary tags that no example carries; one aggregation over all tags."""
    counts = members.agg(
        F.array(
            *[
                F.struct(F.lit(t).alias("tag"), F.coalesce(F.sum(L.as_flag(L.has_tag(t))), F.lit(0)).alias("n"))
                for t in tags
            ]
        ).alias("t")
    ).select(F.inline("t"))
    return violation(counts.filter("n = 0"), "V30", "tag", "not_covered")


def rationale_coverage(selected: DataFrame, rationales: DataFrame) -> DataFrame:
    """Every selected case has a rationale, and no rationale is for another case."""
    ids, told = selected.select("case_id").distinct(), rationales.select("case_id").distinct()
    return violation(ids.join(told, "case_id", "left_anti"), "V31", "case_id", "rationale_missing").unionByName(
        violation(told.join(ids, "case_id", "left_anti"), "V31", "case_id", "rationale_not_selected")
    )


def selection_contract(selected: DataFrame, required: dict[str, int]) -> DataFrame:
    """Ids and clusters of a selection are unique, and the count per decision is as required."""
    ids = selected.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1")
    clusters = selected.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n > 1")
    entries = [F.struct(F.lit(d).alias("decision"), F.lit(n).cast("bigint").alias("wanted")) for d, n in required.items()]
    wanted = selected.sparkSession.range(1).select(F.inline(F.array(*entries)))
    counts = selected.groupBy("decision").agg(F.count("*").alias("n"))
    short = wanted.join(counts, "decision", "left").fillna(0, ["n"]).filter("n <> wanted")
    return (
        violation(ids, "V31", "case_id", "case_repeated")
        .unionByName(violation(clusters, "V31", "cluster_id", "cluster_repeated"))
        .unionByName(violation(short, "V31", "decision", F.col("n")))
    )


def vector_validity(vectors: DataFrame, key: str, dimension: int) -> DataFrame:
    """V33."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return violations(
        vectors, "V33", key, {"dimension": F.size(v) != dimension, "not_finite": bad, "zero_norm": ~bad & (norm == 0)}
    )
