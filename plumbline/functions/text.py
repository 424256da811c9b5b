"""Text and context expressions."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else unicodedata.normalize("NFKC", value))


@F.pandas_udf(T.StringType())
def _context(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else " ".join(unicodedata.normalize("NFKC", value).split()).casefold())


def one_newline(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalise_evidence(text: Column) -> Column:
    """NFKC, then LF line ends. Pure ASCII needs no normal form; only the other texts are sent to Python."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return one_newline(F.when(ascii_only, text).otherwise(_nfkc(F.when(~ascii_only, text))))


def normal_space(text: Column) -> Column:
    """ASCII blanks, the four separator controls included, collapsed."""
    return F.trim(F.regexp_replace(text, "[\\s\\x1C-\\x1F]+", " "))


def context_text(text: Column) -> Column:
    """P07 for one carrier: NFKC, white space collapsed, case folded. Only texts that are not pure ASCII are sent to Python."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(normal_space(text))).otherwise(_context(F.when(~ascii_only, text)))


def serialise_context(state: Column, conversation: Column, recent: Column) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    turns = F.transform(conversation, lambda t: F.struct(t["content"].alias("content"), t["role"].alias("role")))
    return F.to_json(
        F.struct(turns.alias("conversation"), recent.alias("recent_activities"), state.alias("state_summary")),
        {"ignoreNullFields": "false"},
    )


def current_decision_text(state: Column, conversation: Column) -> Column:
    """The latest assistant turn, else the state summary."""
    said = F.filter(conversation, lambda t: t["role"] == "assistant")
    return F.coalesce(F.try_element_at(said, F.lit(-1))["content"], state)


def flat_conversation(conversation: Column) -> Column:
    """P20."""
    return F.array_join(F.transform(conversation, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def quote_in_carriers(quote: Column, carriers: Column) -> Column:
    """V07 on one row: the normalised quote is part of some normalised carrier (carriers already normalised)."""
    return F.exists(carriers, lambda c: F.contains(c, quote))


def contexts_from_turns(turns: DataFrame, by: str) -> DataFrame:
    """Turns to nested contexts. A context is one value of one row by its data model, so its turns must meet there."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(by).agg(said.alias("t")).select(
        by,
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversation"),
    )


def decision_text_from_turns(turns: DataFrame, by: str, state: Column) -> DataFrame:
    """P05 on a table of turns, combined before the shuffle."""
    assistant = F.when(F.col("role") == "assistant", F.col("turn"))
    return turns.groupBy(by).agg(F.max_by("text", assistant).alias("said"), F.min_by("text", "turn").alias("state")).select(
        by, F.coalesce("said", state).alias("decision_text")
    )
