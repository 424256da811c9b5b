"""From blind reviews to gold: comparison with drafts, adjudication packets, resolutions, final labels and audits."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import hashing as H
from plumbline.functions import labels as L
from plumbline.functions.lineage import cut
from plumbline.functions.text import normalise_evidence
from plumbline.functions.skew import skew_join
from plumbline.operators.quality import violation, violations
from plumbline.operators.split import phased_sample
from plumbline.schemas import ACCEPT, AUDIT_SAMPLE_TAGS, CONFIRM, DECISIONS, KEEP, REWRITE, RULE_CHANGE


def compare_reviews(reviews: DataFrame, drafts: DataFrame) -> DataFrame:
    """Completed reviews beside their drafts, with four match flags."""
    decision = F.col("human_decision").eqNullSafe(F.col("draft_decision"))
    target = F.col("human_target").eqNullSafe(F.col("draft_target"))
    horizon = F.col("human_horizon").eqNullSafe(F.col("draft_horizon"))
    return reviews.join(drafts, "item_id").withColumns(
        {
            "decision_matches": L.as_flag(decision),
            "target_matches": L.as_flag(target),
            "horizon_matches": L.as_flag(horizon),
            "hierarchical_matches": L.as_flag(decision & ((F.col("draft_decision") != "in_scope") | target)),
        }
    )


def packet_fields(compared: DataFrame) -> DataFrame:
    """Sample kind, focus and recommendation of each compared item."""
    agreed = F.col("hierarchical_matches") == 1
    near = F.array_contains("tags", "near_oos")
    picked = (F.col("decision_matches") == 1) & (F.col("target_matches") == 0)

    def choose(agreement, grounding, target, rule):
        return F.when(agreed, agreement).when(near, grounding).when(picked, target).otherwise(rule)

    return compared.withColumns(
        {
            "sample_kind": F.when(agreed, "agreement_audit").otherwise("hierarchical_disagreement"),
            "review_focus": choose(
                "agreement_audit", "near_oos_grounding_boundary", "target_selection", "decision_rule_boundary"
            ),
            "recommendation": choose(
                "confirm_agreement",
                "grounding_evidence_required",
                "likely_reviewer_input_error",
                "current_rule_lean_keep_draft",
            ),
        }
    )


def agreement_sample(compared: DataFrame, count: int) -> DataFrame:
    """First agreement by hash for each decision, then each tag, then whatever comes next up to ``count``."""
    rows = compared.filter("hierarchical_matches = 1").withColumn("key", H.stable_key("adjudication-audit-v1", "item_id"))
    phases = [(F.col("human_decision") == d, 1) for d in DECISIONS]
    phases += [(F.array_contains("tags", tag), 1) for tag in AUDIT_SAMPLE_TAGS]
    phases += [(F.lit(True), count)]
    return phased_sample(rows, phases, ["key"], "item_id", "item_id", limit=count)


def adjudication_packet(compared: DataFrame, count: int) -> DataFrame:
    """Near-OOS disagreements, other disagreements, then the agreement sample, numbered through."""
    wrong = cut(
        compared.filter("hierarchical_matches = 0").select(
            "item_id", F.when(F.array_contains("tags", "near_oos"), 0).otherwise(1).alias("section")
        )
    )
    ranked = H.number_rank(wrong, ["section"], "item_id", "rank")
    sample = agreement_sample(compared, count).select(
        "item_id", F.lit(2).alias("section"), (F.col("position") + 1).cast("bigint").alias("rank")
    )
    both = ranked.select("item_id", "section", "rank").unionByName(cut(sample))
    sizes = both.groupBy("section").agg(F.count("*").alias("n"))
    before = sizes.select(
        "section",
        (F.sum("n").over(Window.orderBy("section").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    kinds = F.element_at(
        F.array(F.lit("hierarchical_disagreement"), F.lit("hierarchical_disagreement"), F.lit("agreement_audit")),
        F.col("section") + 1,
    )
    return both.join(before, "section").select(
        "item_id", kinds.alias("sample_kind"), (F.col("rank") + F.col("before")).alias("packet_number")
    )


def policy_impact(action="action", recommendation="recommendation") -> Column:
    """P14."""
    against = F.col(recommendation).isin("grounding_evidence_required", "current_rule_lean_keep_draft")
    return F.when((F.col(action) == ACCEPT) & against, "taxonomy_or_decision_rule_review_required").otherwise("none")


def lineage_join(drafts: DataFrame, reviews: DataFrame, resolutions: DataFrame, policies: DataFrame) -> DataFrame:
    """Drafts with whatever review, resolution and policy they have; one shuffle key for all three joins."""
    return (
        drafts.join(reviews, "item_id", "left")
        .join(resolutions.select("item_id", "action", "final_decision", "final_target", "final_horizon"), "item_id", "left")
        .join(policies.select("item_id", "policy_id"), "item_id", "left")
    )


def final_labels(joined: DataFrame) -> DataFrame:
    """The controlled label and where it came from; ``problem`` names what cannot be materialised."""
    c = F.col
    agreed = (
        c("human_decision").eqNullSafe(c("draft_decision"))
        & c("human_target").eqNullSafe(c("draft_target"))
        & c("human_horizon").eqNullSafe(c("draft_horizon"))
    )
    open_ = c("action").isNull()
    final = c("action").isin(CONFIRM, ACCEPT)
    lacking = c("final_decision").isNull() | c("final_horizon").isNull()
    source = (
        F.when(open_ & agreed, "blind_human_review")
        .when(open_, None)
        .when(c("policy_id").isNotNull(), "policy_dual_channel_draft")
        .when(c("action") == KEEP, "adjudicated_draft")
        .when(final & lacking, None)
        .when(c("action") == CONFIRM, "blind_human_review")
        .when(c("action") == ACCEPT, "adjudicated_human")
    )
    from_draft = c("label_source").isin("policy_dual_channel_draft", "adjudicated_draft")

    def pick(draft, resolved, human):
        return F.when(from_draft, c(draft)).when(open_ & c("label_source").isNotNull(), c(human)).when(
            c("label_source").isNotNull(), c(resolved)
        )

    return joined.withColumn("label_source", source).withColumns(
        {
            "decision": pick("draft_decision", "final_decision", "human_decision"),
            "target_intent": pick("draft_target", "final_target", "human_target"),
            "horizon": pick("draft_horizon", "final_horizon", "human_horizon"),
            "problem": F.when(open_ & ~agreed, "unresolved_disagreement")
            .when(c("label_source").isNull() & final, "resolution_without_label")
            .when(c("label_source").isNull(), "action_not_materialised"),
        }
    )


def label_source_counts(labelled: DataFrame) -> DataFrame:
    """A35."""
    return labelled.filter("label_source IS NOT NULL").groupBy("label_source", "decision").agg(F.count("*").alias("n"))


def agreement_report(entries: DataFrame, drafts: DataFrame, by: str) -> DataFrame:
    """Agreement counts of each review pass; nothing is shown while a pass has pending items."""
    quotes = normalise_evidence(F.col("human_quote")) == normalise_evidence(F.col("draft_quote"))
    joined = compare_reviews(entries, drafts).withColumns(
        {
            "evidence_matches": L.as_flag(quotes),
            "experience_matches": L.as_flag(F.col("human_experience").eqNullSafe(F.col("draft_experience"))),
            "object_matches": L.as_flag(F.col("human_object").eqNullSafe(F.col("draft_object"))),
        }
    )
    done = F.col("complete") == 1
    flags = ["decision_matches", "target_matches", "horizon_matches", "hierarchical_matches"]
    flags += ["evidence_matches", "experience_matches", "object_matches"]
    sums = joined.groupBy(by).agg(
        F.count("*").alias("item_count"),
        F.sum("complete").alias("completed_count"),
        *[F.sum(F.when(done, F.col(f)).otherwise(0)).alias(f) for f in flags],
    )
    open_ = F.col("completed_count") == F.col("item_count")
    return sums.select(
        by,
        "item_count",
        "completed_count",
        F.when(open_, "revealed_after_pass_complete").otherwise("locked_until_pass_complete").alias("agreement_status"),
        *[F.when(open_, F.col(f)).alias(f) for f in flags],
    )


def audit_rows(items: DataFrame, roles: list[str], formed: DataFrame) -> DataFrame:
    """Every audit item once per role, with its formed intention if there is one."""
    spread = items.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))
    return spread.join(formed, ["item_id", "role"], "left").withColumn("stage_status", F.coalesce("stage_status", F.lit("missing")))


RATINGS = ["preserved", "partial", "lost"]


def rating_counts(rows: DataFrame, roles: list[str]) -> DataFrame:
    """Counts per role, field and rating on the complete grid, with all-preserved and failure counts."""
    fields = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"{f}_rating").alias("rating")) for f in ["action", "object", "horizon"]]
    )
    all_kept = F.array(
        F.struct(
            F.lit("all").alias("field"),
            F.when(
                (F.col("action_rating") == "preserved")
                & (F.col("object_rating") == "preserved")
                & (F.col("horizon_rating") == "preserved"),
                "preserved",
            ).alias("rating"),
        ),
        F.struct(F.lit("stage").alias("field"), F.when(F.col("stage_status") != "success", "failed").alias("rating")),
    )
    counts = (
        rows.select("role", F.inline(F.concat(fields, all_kept)))
        .filter("rating IS NOT NULL")
        .groupBy("role", "field", "rating")
        .agg(F.count("*").alias("n"))
    )
    cells = [(f, r) for f in ["action", "object", "horizon"] for r in RATINGS] + [("all", "preserved"), ("stage", "failed")]
    grid = rows.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(r) for r in roles])).alias("role"),
    ).select("role", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("rating")) for f, r in cells])))
    return grid.join(counts, ["role", "field", "rating"], "left").fillna(0, ["n"])


# ---- rules -----------------------------------------------------------------------------------------------------


def review_completeness(entries: DataFrame) -> DataFrame:
    """V25."""
    parts = [F.col("reviewer_id").isNull(), F.col("reviewed_at").isNull(), F.col("human_decision").isNull()]
    none = parts[0] & parts[1] & parts[2]
    some = parts[0] | parts[1] | parts[2]
    return violations(
        entries,
        "V25",
        "item_id",
        {"pending_with_note": none & F.col("review_note").isNotNull(), "partial_attribution": some & ~none},
    )


def pending_by_batch(entries: DataFrame) -> DataFrame:
    return entries.groupBy("batch").agg(
        F.count("*").alias("items"), F.sum(L.as_flag(F.col("human_decision").isNull())).alias("pending")
    )


def resolution_rules(packet: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolutions against the packet item they resolve."""
    c = F.col
    j = packet.join(resolutions, "item_id", "full_outer")
    both = c("sample_kind").isNotNull() & c("action").isNotNull()

    def same(side):
        return (
            c("final_decision").eqNullSafe(c(f"{side}_decision"))
            & c("final_target").eqNullSafe(c(f"{side}_target"))
            & c("final_horizon").eqNullSafe(c(f"{side}_horizon"))
        )

    any_final = F.coalesce("final_decision", "final_target", "final_horizon").isNotNull()
    label = both & (c("action") != REWRITE)
    audit = c("sample_kind") == "agreement_audit"
    equal = c("human_decision").eqNullSafe(c("draft_decision")) & c("human_target").eqNullSafe(c("draft_target")) & c(
        "human_horizon"
    ).eqNullSafe(c("draft_horizon"))
    return violations(
        j,
        "V26",
        "item_id",
        {
            "unresolved": c("action").isNull(),
            "not_in_packet": c("sample_kind").isNull(),
            "rewrite_with_label": both & (c("action") == REWRITE) & any_final,
            "label_incomplete": label & (c("final_decision").isNull() | c("final_horizon").isNull()),
            "target_missing": label & (c("final_decision") == "in_scope") & c("final_target").isNull(),
            "target_unexpected": label & (c("final_decision") != "in_scope") & c("final_target").isNotNull(),
            "confirm_on_disagreement": both & (c("action") == CONFIRM) & ~audit,
            "confirm_unequal": both & (c("action") == CONFIRM) & audit & ~equal,
            "confirm_differs": both & (c("action") == CONFIRM) & ~same("human"),
            "audit_not_confirmed": both & audit & (c("action") != CONFIRM),
            "accept_differs": both & (c("action") == ACCEPT) & ~same("human"),
            "keep_differs": both & (c("action") == KEEP) & ~same("draft"),
            "change_without_note": both & (c("action") == RULE_CHANGE) & c("note").isNull(),
        },
    )


def policy_alignment(flagged: DataFrame, policies: DataFrame, contexts: DataFrame) -> DataFrame:
    """Policies cover exactly the flagged resolutions, name the same packet item, and quote the context."""
    j = flagged.select("item_id", "packet_id").join(
        policies.select("item_id", F.col("packet_id").alias("policy_packet_id"), "policy_id", "quote"), "item_id", "full_outer"
    )
    both = F.col("packet_id").isNotNull() & F.col("policy_id").isNotNull()
    quoted = j.filter(both).join(contexts.select("item_id", "text"), "item_id", "left")
    return violations(
        j,
        "V27",
        "item_id",
        {
            "policy_missing": F.col("policy_id").isNull(),
            "policy_not_flagged": F.col("packet_id").isNull(),
            "packet_differs": both & (F.col("packet_id") != F.col("policy_packet_id")),
        },
    ).unionByName(violation(quoted.filter(~F.contains("text", F.col("quote"))), "V27", "item_id", "quote_not_in_context")).unionByName(
        violation(quoted.filter("text IS NULL"), "V27", "item_id", "context_missing")
    )


def provenance_lineage(rows: DataFrame) -> DataFrame:
    """Adjudication fields are all there or none, and the label source says which."""
    fields = ["packet_id", "action", "adjudicator_id", "adjudicated_at"]
    known = sum((L.as_flag(F.col(f).isNotNull()) for f in fields[1:]), L.as_flag(F.col(fields[0]).isNotNull()))
    dual = F.col("label_source") == "policy_dual_channel_draft"
    return violations(
        rows,
        "V28",
        "item_id",
        {
            "adjudication_partial": (known > 0) & (known < 4),
            "source_needs_adjudication": (known == 0) & (F.col("label_source") != "blind_human_review"),
            "dual_without_policy": dual & F.col("policy_id").isNull(),
            "policy_without_dual": ~dual & F.col("policy_id").isNotNull(),
        },
    )


def audit_row_rules(rows: DataFrame) -> DataFrame:
    """V32 on one row."""
    ratings = F.array("action_rating", "object_rating", "horizon_rating")
    failed = F.col("stage_status") != "success"
    return violations(
        rows,
        "V32",
        F.concat_ws("|", F.col("item_id").cast("string"), "role"),
        {
            "note_missing": F.exists(ratings, lambda r: r != "preserved") & F.col("note").isNull(),
            "failed_not_lost": failed & F.exists(ratings, lambda r: r != "lost"),
            "failed_note": failed & ~F.coalesce(F.col("note") == "stage_a_provider_failure", F.lit(False)),
        },
    )


def context_fingerprint(turns: DataFrame, by: str) -> DataFrame:
    """A fingerprint of all turns of a context from sums of their whole hashes, so no conversation is gathered in one place."""
    text = F.concat_ws("|", F.col("turn").cast("string"), "role", "text")
    hashed = turns.select(by, F.sha2(text, 256).alias("h"))

    def part(start):
        return F.conv(F.substring("h", start, 16), 16, 10).cast("decimal(20,0)")

    return hashed.groupBy(by).agg(
        F.concat_ws(
            "-",
            F.count("*").cast("string"),
            *[F.sum(part(start)).cast("string") for start in (1, 17, 33, 49)],
        ).alias("fingerprint")
    )


def carried_labels(new_contexts: DataFrame, old_contexts: DataFrame, old_labels: DataFrame) -> DataFrame:
    """A label moves to the new version only if its context is the same; otherwise it is pending."""
    known = (
        old_contexts.join(old_labels, "item_id")
        .groupBy("fingerprint")
        .agg(F.min(F.struct("item_id", "label")).alias("o"), F.count("*").alias("sources"))
    )
    return skew_join(new_contexts, known, ["fingerprint"], "left").select(
        "item_id",
        F.col("o.label").alias("label"),
        F.col("o.item_id").alias("source_item"),
        F.coalesce("sources", F.lit(0)).alias("sources"),
        F.when(F.col("o").isNull(), "pending").otherwise("carried").alias("state"),
    )
