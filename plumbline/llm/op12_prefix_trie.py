"""The trie of conversation beginnings, rolled up by centroid decomposition of its parent edges.

A node is the digest of the turns that lead to it. Turns are numbered in sorted ranges of the whole table, so that a conversation of any
length is dealt to many tasks. Prefix digests are made in chunks of ``CHUNK`` turns; the digests of whole chunks are joined by
doubling, so a conversation of m turns takes log m rounds, over the conversations that are that long only.

Rollup. The weight of a node is the number of conversations through it; the weight of a subtree is known without any rollup, as
every conversation through its top gives the turns it has from there on. In each round every component is split at its centroid: the
deepest node whose subtree in the component weighs half of it or more. The nodes above that weigh as much are the path from
the centroid to the top of the component, as two subtrees beside each other can't both weigh half. The total of the centroid's part is
added to all nodes of the path, the centroid is done, and what is left are the parts below it and the one above, none of more
than half the weight. So rounds grow with the logarithm of the rows, whatever the depth of the trie, and each node is written once.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.llm.common import query, table

#: Turns whose digests are joined inside one row.
CHUNK = 16
#: Ids of one piece of a list that is hashed.
PIECE = 4096


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, bytes): turns from 0, by turn (null first), then by the digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_id"), F.octet_length(text).cast("long").alias("bytes"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "turn_id"]
    slim = cut(slim.filter("conv_id IS NOT NULL")).withColumn("spread", F.monotonically_increasing_id())
    ordered = slim.repartitionByRange(*keys, "spread").sortWithinPartitions(*keys, "spread")
    placed = cut(ordered.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).drop("spread", "turn"))
    parts = placed.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("conv_id", "part", (F.col("first") - F.coalesce(before, F.lit(0))).alias("first"))
    return skew_join(placed, starts, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("first")).alias("pos"), "turn_id", "bytes")


def rebuilt_turns(turns: DataFrame, group: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of all conversations, n turns when rebuilt, and their turns (conv_id, pos, turn_id, bytes).

    A conversation begins with the first h turns of conversation c - c % ``group``, where h is crc32(c) % ``spread``, and goes on with
    its own turns after its first h.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    wanted = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": F.crc32(F.col("conv_id").cast("string")) % spread})
    first = turns.filter((F.col("pos") < spread - 1) & (F.col("conv_id") % group == 0))
    heads = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "bytes"))).alias("head"))
    heads = heads.withColumnRenamed("conv_id", "base")
    joined = wanted.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,turn_id:string,bytes:bigint>>")), F.lit(1), F.col("h").cast("int")))
    size = F.size("head").cast("long")
    plans = cut(joined.select("conv_id", "h", size.alias("got"), (size + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"), "head"))
    kept = skew_join(turns, plans.select("conv_id", "h", "got"), ["conv_id"]).filter("pos >= h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "turn_id", "bytes")
    return plans.select("conv_id", "n"), plans.select("conv_id", F.inline("head")).unionByName(kept)


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, bytes, prefix, above) of each turn: the digests of all turns up to it and up to the one before."""
    part = F.floor(F.col("pos") / chunk).alias("part")
    chunks = turns.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "bytes"))).alias("turns"))
    ids = F.transform("turns", lambda t: t["turn_id"])
    inner = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: F.sha2(F.array_join(F.slice(ids, F.lit(1), i), ""), 256))
    chunks = cut(chunks.withColumn("inner", inner))
    ends = cut(chunks.filter(F.size("turns") == chunk).select("conv_id", "part", F.element_at("inner", -1).alias("whole")))
    reach = 1
    while not ends.filter(F.col("part") >= reach).isEmpty():
        # ``whole`` covers the last ``reach`` chunks, or all from the start
        earlier = ends.select("conv_id", (F.col("part") + reach).alias("part"), F.col("whole").alias("earlier"))
        both = F.when(F.col("earlier").isNotNull(), F.sha2(F.concat("earlier", "whole"), 256)).otherwise(F.col("whole"))
        ends = cut(ends.join(earlier, ["conv_id", "part"], "left").select("conv_id", "part", both.alias("whole")))
        reach *= 2
    # no chunk before is "", the prefix of the root is "" as well
    before = ends.select("conv_id", (F.col("part") + 1).alias("part"), F.col("whole").alias("before"))
    rows = chunks.join(before, ["conv_id", "part"], "left").withColumn("before", F.coalesce("before", F.lit("")))
    upto = F.transform("inner", lambda x: F.concat("before", x))
    above = F.concat(F.array("before"), F.slice(upto, F.lit(1), F.size(upto) - 1))
    rows = rows.select("conv_id", F.inline(F.arrays_zip(F.col("turns"), upto.alias("upto"), above.alias("above"))))
    # a whole chunk's last prefix is the one that the next chunk has as ``before``
    last = (F.col("turns.pos") % chunk == chunk - 1).alias("last")
    rows = rows.select("conv_id", (F.col("turns.pos") + 1).alias("depth"), F.col("turns.bytes").alias("bytes"), "upto", "above", last)
    rows = rows.withColumn("part", F.floor((F.col("depth") - 1) / chunk))
    done = rows.filter("NOT last").withColumnRenamed("upto", "prefix")
    ended = rows.filter("last").join(ends, ["conv_id", "part"]).withColumnRenamed("whole", "prefix")
    columns = ["conv_id", "depth", "bytes", "prefix", "above"]
    return done.select(columns).unionByName(ended.select(columns))


def _hashed(batches):
    """The digest of each run of pieces of one node; pieces come in order, and no list is held whole."""
    node, digest = None, None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("node", "ids")), strict=True):
            if row[0] != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = row[0], hashlib.sha256(row[1].encode())
            else:
                digest.update(b"," + row[1].encode())
        if done:
            yield pa.RecordBatch.from_pydict({"node": [d[0] for d in done], "ends": [d[1] for d in done]})
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends": [digest.hexdigest()]})


def _pieces(batches):
    """Runs of ids of one node, joined; at most ``PIECE`` in a piece."""
    for batch in batches:
        nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
        start, out = 0, []
        for i in range(1, len(nodes) + 1):
            if i == len(nodes) or nodes[i] != nodes[start] or i - start == PIECE:
                out.append((nodes[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "least", "ids"])


def listed_digests(ends: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids of each node, ascending, joined by commas; ``ends`` has node and conv_id.

    A SHA-256 is made byte after byte, so one task hashes the list of a node, but sorting and writing out the ids is dealt to all.
    """
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node long, least long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "least").mapInArrow(_hashed, "node long, ends string")


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values): each node's values summed over its subtree, by centroid decomposition.

    ``nodes`` has node, depth, rep, weight and the values, where weight is the weight of its subtree and rises by at least 1 with
    every step up; ``paths`` (conv, depth, node, above) has the nodes on the way from the top to any node of that rep.
    """
    sums = [f"_sum_{v}" for v in values]
    top = nodes.agg(F.min_by("node", "depth")).first()[0]
    active = nodes.select("node", "depth", "rep", "weight", *values, F.lit(top).cast("long").alias("comp"), *[F.lit(0).cast("long").alias(s) for s in sums])
    done = None
    while True:
        totals = active.groupBy("comp").agg(F.max("weight").alias("total"))
        heavy = F.col("weight") * 2 >= F.col("total")
        weighed = skew_join(active, totals, ["comp"]).withColumn("heavy", heavy)
        found = weighed.filter("heavy").groupBy("comp").agg(F.max(F.struct("depth", "weight", "node")).alias("c"))
        found = found.select("comp", F.col("c.node").alias("centre"), F.col("c.depth").alias("level"), F.col("c.weight").alias("part"))
        placed = skew_join(weighed, found, ["comp"])
        below = paths.select(F.col("conv").alias("rep"), (F.col("depth") - 1).alias("level"), F.col("node").alias("child"), F.col("above").alias("centre"))
        placed = cut(skew_join(placed, below, ["rep", "level", "centre"], "left").withColumn("child", F.when(F.col("depth") > F.col("level"), F.col("child"))))
        inside = F.col("child").isNotNull() | (F.col("node") == F.col("centre"))
        parts = placed.filter(inside).groupBy("comp").agg(*[F.sum(v).alias(f"_part_{v}") for v in values])
        added = skew_join(placed.filter("heavy"), parts, ["comp"]).select(
            "node", "depth", "rep", (F.col("weight") - F.col("part")).alias("weight"), *values, "comp", "centre",
            *[(F.col(s) + F.col(f"_part_{v}")).alias(s) for s, v in zip(sums, values, strict=True)],
        )
        added = cut(added)
        finished = added.filter("node = centre").select("node", *[F.col(s).alias(v) for s, v in zip(sums, values, strict=True)])
        done = finished if done is None else done.unionByName(finished)
        light = placed.filter("NOT heavy").withColumn("comp", F.coalesce("child", "comp"))
        active = added.filter("node <> centre").select(active.columns).unionByName(light.select(active.columns))
        if active.isEmpty():
            return done


def prefix_trie(conversations: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; more columns are left out. Turns are ordered by turn, null first, and of equal
    turns by the digest of role and text, so rows that are repeated whole are turns that follow each other. Null role and text are
    empty. Rows without a conv_id belong to no conversation and are left out. Without any conversation there is no node.
    """
    plans, turns = rebuilt_turns(numbered_turns(conversations), group, spread)
    rows = prefixes(turns)
    # the root is the prefix "" of all conversations, those without turns too
    rows = skew_join(rows, plans, ["conv_id"]).unionByName(
        plans.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit("").alias("prefix"), F.lit(None).cast("string").alias("above"), "n")
    )
    rows = cut(rows)
    found = rows.groupBy("prefix").agg(
        F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.max("above").alias("above"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight"), F.count_if(F.col("n") == F.col("depth")).alias("n_ends"),
    )
    found = cut(found.withColumn("node", F.monotonically_increasing_id()))
    children = found.groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("n_children"))
    nodes = skew_join(found, children, ["prefix"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = found.select(F.col("prefix").alias("above"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut(skew_join(nodes, parents, ["above"], "left").drop("above"))
    own = nodes.select(
        "node", "depth", F.col("conv_id").alias("rep"), "weight", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    steps = rows.select(F.col("conv_id").alias("conv"), "depth", "prefix", "n")
    steps = cut(skew_join(steps, nodes.select("prefix", "node", F.col("parent").alias("above"), "conv_id"), ["prefix"]))
    # a conversation's way is asked for only down to the last node that it is the smallest member of
    longest = own.groupBy(F.col("rep").alias("conv")).agg(F.max("depth").alias("longest"))
    paths = cut(steps.filter("depth > 0").join(longest, "conv").filter("depth <= longest").select("conv", "depth", "node", "above"))
    totals = rollup(own, paths, ["n_leaves", "saved_tokens"])
    ends = listed_digests(steps.filter("depth = n").select("node", F.col("conv").alias("conv_id")))
    empty = hashlib.sha256(b"").hexdigest()
    out = nodes.join(totals, "node").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(empty)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 of a text of ASCII letters, bit by bit, with the polynomial 0xEDB88320.
CRC32 = """xor(4294967295, list_reduce(list_transform(string_split('~' || CAST({0} AS VARCHAR), ''), lambda c: CASE WHEN c = '~' THEN 4294967295 ELSE CAST(ascii(c) AS BIGINT) END),
   lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, (x % 2) * 3988292384))))"""
SQL = f"""
WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(concat_ws(':', CAST(strlen(coalesce(role, '')) AS VARCHAR), coalesce(role, ''), coalesce(text, '')))) AS l
     FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT t.*, CAST({CRC32.format("conv_id")} % 9 AS BIGINT) AS h FROM t),
b AS (SELECT h.conv_id, list_concat(coalesce(base.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN t base ON base.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(l) AS n, d.range AS depth, sha256(CAST(l[1:d.range] AS VARCHAR)) AS k, CASE WHEN d.range > 0 THEN sha256(CAST(l[1:d.range - 1] AS VARCHAR)) END AS up,
     CASE WHEN d.range > 0 THEN strlen(l[d.range].t) ELSE 0 END AS bytes FROM b, range(0, len(l) + 1) d),
n AS (SELECT depth, k, min(up) AS up, min(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
     FROM p GROUP BY depth, k),
c AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1, 2),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, k)),
s AS (SELECT p.depth, p.k, CAST(sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((w.n_convs - 1) * w.bytes) AS BIGINT) AS saved_tokens
     FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY 1, 2)
SELECT w.conv_id, w.depth, x.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s USING (depth, k) LEFT JOIN n x ON x.k = w.up AND x.depth = w.depth - 1
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
