"""Secret scan: matches in every text, and how widely each matched value is owned in the whole corpus."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.llm.common import query, row_key, table

# The kinds of the contract, with the group that holds the value and its least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A long token of letters and digits; counted as a secret only when it looks drawn at random and few own it.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "live"]
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int) -> Column:
    """All leftmost matches that do not overlap, with places in code points: the pieces between them tell where they are."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.transform(F.split(text, pattern, -1), F.char_length)
    lengths = F.arrays_zip(whole.alias("m"), values.alias("v"), F.slice(pieces, 1, F.size(whole)).alias("gap"))

    def add(state, x):
        start = state["at"] + x["gap"]
        stop = start + F.char_length(x["m"])
        span = F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), stop.cast("int").alias("stop"), x["v"].alias("value"))
        return F.struct(stop.cast("int").alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(lengths, state, add)["spans"]).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    part = lambda x: F.concat_ws(":", F.element_at(kind, x["kind"] + 1), x["start"], x["stop"])
    return F.array_join(F.transform(spans, part), ",")


def find_candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One narrow row for each document: its key, owner, repository, base spans and further random-looking tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), owner.alias("owner"), repository.alias("repo"), text.alias("text"))
    rows = rows.select(
        "doc_id", "key", "owner", "repo", _spans(F.col("text"), ASSIGN, 0, 1).alias("assign"), _spans(F.col("text"), ACCESS, 1, 0).alias("access"),
        _spans(F.col("text"), HEX, 2, 0).alias("hex"), _spans(F.col("text"), OPAQUE, 3, 0).alias("opaque"),
    )
    base = F.array_sort(F.concat(F.filter("assign", lambda x: F.char_length(x["value"]) >= 12), "access", "hex"))
    rows = rows.select("doc_id", "key", "owner", "repo", base.alias("base"), "opaque")
    random = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    return rows.withColumn("opaque", F.filter("opaque", lambda x: random(x) & apart(x)))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repos): over how many owners and repositories each candidate value is spread.

    Rows are reduced to distinct triples, then pairs, then values; each step combines before its shuffle, so a value
    that a third of the rows hold costs no more than one row for each repository.
    """
    triples = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    pairs = triples.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return pairs.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, owner: Column, repository: Column, wide: int = 3) -> DataFrame:
    """For each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    A value that ``wide`` or more owners hold is a widely copied example; one that fewer hold is owner-specific and
    looks live. Base spans stay whatever their ownership; random-looking tokens outside them are added, as kind
    ``live``, where they are owner-specific. n_live and n_example count the spans by ownership. Null texts are empty;
    null owners and repositories count as one of their own. Rows that repeat id and text get the same result each.
    """
    found = cut(find_candidates(docs, owner, repository))
    each = found.select("key", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("s"))
    each = each.select("key", "owner", "repo", "s.start", "s.kind", "s.stop", F.sha2("s.value", 256).alias("hash"))
    owned = skew_join(each.select("key", "start", "kind", "stop", "hash"), ownership(each), ["hash"])
    span = F.struct("start", "kind", "stop", (F.col("owners") < wide).alias("live"))
    judged = owned.groupBy("key").agg(F.collect_set(span).alias("judged"))
    text = F.col("base")
    rows = found.join(judged, "key", "left").withColumn("judged", F.coalesce("judged", F.array().cast("array<struct<start:int,kind:int,stop:int,live:boolean>>")))
    spans = F.array_sort(F.filter("judged", lambda x: (x["kind"] < 3) | x["live"]))
    rows = rows.withColumn("found", spans)
    number = lambda k: F.size(F.filter(text, lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_joined(text).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def _sql_spans(pattern: str, kind: int, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
        'start': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda x: length(x))), 0),
        'kind': {kind},
        'stop': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i], lambda x: length(x))),
        'v': regexp_extract_all(t, '{p}', {group})[i]}}), lambda x: length(x.v) >= {least})"""


_TEXT = "array_to_string(list_transform({0}, lambda x: ['assign', 'access', 'hex', 'live'][x.kind + 1] || ':' || x.start::BIGINT || ':' || x.stop::BIGINT), ',')"
SQL = f"""
WITH d AS (SELECT doc_id, source AS owner, source || '/' || lang AS repo, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, owner, repo, t, list_sort(list_concat(list_concat({_sql_spans(ASSIGN, 0, 1, 12)}, {_sql_spans(ACCESS, 1, 0, 18)}), {_sql_spans(HEX, 2, 0, 16)})) AS base FROM d),
c AS (SELECT *, list_filter({_sql_spans(OPAQUE, 3, 0, 20)}, lambda x: regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]')
        AND len(list_filter(base, lambda y: y.start < x.stop AND x.start < y.stop)) = 0) AS opaque FROM b),
e AS (SELECT doc_id, owner, unnest(list_concat(base, opaque)) AS s FROM c),
o AS (SELECT s.v AS v, count(DISTINCT owner) AS owners FROM e GROUP BY 1),
j AS (SELECT doc_id, list({{'start': s.start, 'kind': s.kind, 'stop': s.stop, 'live': owners < 3}} ORDER BY s.start, s.kind) FILTER (s.kind < 3 OR owners < 3) AS found
      FROM e JOIN o ON e.s.v = o.v GROUP BY doc_id)
SELECT c.doc_id, len(list_filter(base, lambda x: x.kind = 0)) AS n_assign, len(list_filter(base, lambda x: x.kind = 1)) AS n_access,
    len(list_filter(base, lambda x: x.kind = 2)) AS n_hex, sha256({_TEXT.format('base')}) AS base_sha256,
    coalesce({_TEXT.format('found')}, '') AS spans, coalesce(len(list_filter(found, lambda x: x.live)), 0) AS n_live,
    coalesce(len(list_filter(found, lambda x: NOT x.live)), 0) AS n_example
FROM c LEFT JOIN j ON c.doc_id = j.doc_id
"""


@query("op1_secret_scan", SQL)
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of a document is its source, the repository the source's part in one language."""
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return scan(table(spark, sf_dir, "documents"), F.col("source"), repository)
