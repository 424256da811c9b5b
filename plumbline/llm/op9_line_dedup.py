"""Line deduplication by an exact set-similarity join of lines, with DataFrame functions only."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.llm import setjoin
from plumbline.llm.common import LOWER, UPPER, ascii_lower, query, table

BLANKS = r"[\x20\x09-\x0D]+"
#: Removed lines are broadcast up to so many.
BROADCAST_LINES = 2_000_000


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), ascii_lower(text).alias("t"))
    return rows.select("doc_id", "h", F.posexplode(F.split("t", "\n", -1)).alias("line", "t"))


def _tokens(line: Column, k: int) -> Column:
    """The distinct shingles of ``k`` words of a line, sorted; with fewer words, all of them as one."""
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    hashes = F.transform(F.split(bare, BLANKS), lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) < k, F.array(F.xxhash64(w))).otherwise(runs)

    each = F.element_at(F.transform(F.array(hashes), shingles), 1)
    return F.when(bare == "", F.array().cast("array<long>")).otherwise(F.array_sort(F.array_distinct(each)))


def remove_lines(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, kept_text) of each row of ``docs`` (doc_id, text).

    A line is its set of shingles of ``k`` words (A-Z folded). Lines match when their sets are equal or have a Jaccard
    similarity of ``percent`` or more; matches are followed on, and of all lines so connected the first by (doc_id,
    line) stays. n_near counts removed lines whose own set differs from that of the line that stays. Blank lines stay.
    A null text is one blank line, rows without an id come first, and rows that repeat id and text get the same result.
    """
    # no filter on the sets, nor one that explode would infer: it would be evaluated below, and the sets made twice
    lines = _lines(docs).filter(F.btrim("t", F.lit(" \t\x0b\x0c\r")) != "").select("doc_id", "h", "line", _tokens(F.col("t"), k).alias("s"))
    keyed = lines.select("doc_id", "h", "line", F.xxhash64("s").alias("k"), F.xxhash64(F.lit(2), "s").alias("k2"), F.size("s").cast("long").alias("n"))
    keyed = cut(keyed)
    place = F.struct("doc_id", "line", "h")
    classes = cut(keyed.groupBy("k", "k2", "n").agg(F.min(place).alias("first")))
    seen = lines.select(F.xxhash64("s").alias("k"), F.explode_outer(F.slice("s", 1, setjoin.first_tokens("size(s)"))).alias("token")).filter("token IS NOT NULL")
    node = F.concat_ws("-", F.hex("k"), F.hex("k2")).alias("node")
    open_sets = classes.filter("n > 3").join(setjoin.unlinked(seen), "k", "left").filter(setjoin.passes("n", "lone"))
    open_sets = cut(open_sets.select(node, "n", "first.*"))
    wanted = F.broadcast(open_sets) if open_sets.count() <= setjoin.BROADCAST_ROWS else open_sets
    same = F.col("l.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("l.h") == F.col("w.h")) & (F.col("l.line") == F.col("w.line"))
    again = _lines(docs).alias("l").join(wanted.alias("w"), same)
    sets = again.select("w.node", "w.n", _tokens(F.col("l.t"), k).alias("tokens"))
    found = setjoin.linked_components(cut(sets.dropDuplicates(["node"])), percent)
    named = classes.select(node, "k", "k2", "n", "first").join(found, "node", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "node")))
    stays = named.groupBy("component").agg(F.min("first").alias("stays"))
    decided = skew_join(named, stays, ["component"]).select("k", "k2", "n", "stays", (F.col("stays") != F.col("first")).alias("near"))
    removed = skew_join(keyed, decided, ["k", "k2", "n"]).filter(~place.eqNullSafe(F.col("stays")))
    gone = cut(removed.groupBy("doc_id", "h").agg(F.collect_set("line").alias("gone"), F.count_if("near").alias("n_near")))
    total = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    gone = F.broadcast(gone) if total <= BROADCAST_LINES else gone
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).alias("d")
    rows = rows.join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.h") == F.col("g.h")), "left")
    parts = F.split("d.text", "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(
        F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n")
    )
    return rows.select(
        "d.doc_id", F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), kept.alias("kept_text"),
    )


SQL = rf"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
w AS (SELECT *, regexp_extract_all(translate(raw, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM l),
s AS (SELECT *, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT s, min((doc_id, p)) AS first, row_number() OVER () AS c FROM s GROUP BY s),
t AS (SELECT c, len(s) AS n, unnest(s) AS t FROM c),
k AS (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT a AS c, b AS other FROM k UNION SELECT r.c, k.b FROM r JOIN k ON r.other = k.a),
f AS (SELECT c.c, any_value(c.s) AS s, any_value(c.first) AS first, least(any_value(c.first), coalesce(min(o.first), any_value(c.first))) AS stays
      FROM c LEFT JOIN r ON c.c = r.c LEFT JOIN c o ON r.other = o.c GROUP BY c.c),
g AS (SELECT s.doc_id, s.p, f.first <> f.stays AS near FROM s JOIN f ON s.s = f.s WHERE (s.doc_id, s.p) <> f.stays)
SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed, count(*) FILTER (g.near) AS n_near,
    sha256(coalesce(string_agg(l.raw, chr(10) ORDER BY l.p) FILTER (g.p IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id
"""


@query("op9_line_dedup", SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
