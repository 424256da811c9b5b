"""Shards of equal bytes: a k-d tree over metadata, split at distributed weighted medians."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.lineage import cut
from plumbline.llm.common import query, table

BITS = 12
KEY_BITS = 60


def _unit(name: str) -> Column:
    """A text as a place between 0 and 1; null has its own."""
    return F.coalesce(F.xxhash64(F.col(name)) / F.lit(2.0**64) + F.lit(0.5), F.lit(-1.0))


def _small_table(spark: SparkSession, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """A table of a few rows the driver knows, one a node of the tree, marked for broadcast; made of literals, without Python workers."""
    cells = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, schema.items())]) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*cells))))


def _medians(points: DataFrame, nodes: list[dict], tolerance: float) -> list[dict]:
    """For each node, the key that its first ``share`` of the weight lies below.

    The key is found by its leading digits: weights are summed by digit (before any shuffle), the digit in which the
    wanted weight is reached is taken, and the next pass looks inside it, until what is left inside weighs little.
    """
    spark = points.sparkSession
    for n in nodes:
        n.update(prefix=0, below=0.0, shift=KEY_BITS, done=False)
    for shift in range(KEY_BITS - BITS, -1, -BITS):
        open_nodes = [(n["node"], n["prefix"], n["share"] * n["weight"] - n["below"]) for n in nodes if not n["done"]]
        if not open_nodes:
            break
        wanted = _small_table(spark, open_nodes, {"node": "int", "prefix": "long", "want": "double"})
        inside = points.join(wanted, "node").filter(F.shiftright("key", shift + BITS) == F.col("prefix"))
        digit = F.shiftright("key", shift).bitwiseAND(F.lit((1 << BITS) - 1))
        sums = inside.groupBy("node", "want", digit.alias("digit")).agg(F.sum("w").alias("w"))
        order = Window.partitionBy("node").orderBy("digit")
        reached = sums.withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        last = F.max("digit").over(Window.partitionBy("node"))
        chosen = (
            reached.withColumn("last", last)
            .filter((F.col("upto") >= F.col("want")) | (F.col("digit") == F.col("last")))
            .groupBy("node")
            .agg(F.min(F.struct("digit", "w", "upto")).alias("c"))
        )
        picked = {r["node"]: r["c"] for r in chosen.collect()}
        for n in nodes:
            if n["done"]:
                continue
            c = picked[n["node"]]
            before = c["upto"] - c["w"]
            want = n["share"] * n["weight"] - n["below"]
            n["prefix"] = (n["prefix"] << BITS) | c["digit"]
            n["shift"] = shift
            n["done"] = c["w"] <= tolerance or shift == 0
            n["take"] = abs(c["upto"] - want) < abs(before - want)
            n["below"] += before
    for n in nodes:
        n["cut"] = (n["prefix"] + (1 if n["take"] else 0)) << n["shift"]
    return nodes


def kd_leaves(points: DataFrame, dims: list[str], leaves: int) -> DataFrame:
    """``points`` (w, tie and the dimensions, doubles without null) with ``node`` = leaf 0 .. leaves - 1.

    A node of several leaves is split along the dimension in which it is widest, as a share of the whole's width, at
    the weighted median (for an odd number of leaves, at their share). Ties in a dimension are split in the order of
    ``tie``. Only one row for each node comes to the driver.
    """
    points = cut(points.withColumn("node", F.lit(0)))
    width = {0: leaves}
    whole = None
    spark = points.sparkSession
    while any(k > 1 for k in width.values()):
        facts = points.groupBy("node").agg(
            F.sum("w").alias("weight"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
        )
        rows = {r["node"]: r for r in facts.collect()}
        whole = whole or {d: (rows[0][f"max_{d}"] - rows[0][f"min_{d}"]) or 1.0 for d in dims} if rows else {}
        nodes = []
        for node, k in width.items():
            if k > 1 and node in rows:
                r = rows[node]
                spread = {d: (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d] for d in dims}
                wide = max(dims, key=lambda d: spread[d])
                nodes.append(
                    {"node": node, "dim": wide, "lo": float(r[f"min_{wide}"]), "hi": float(r[f"max_{wide}"]), "weight": float(r["weight"]), "share": (k // 2) / k}
                )
        if not nodes:
            break
        splits = [(n["node"], n["dim"], n["lo"], n["hi"]) for n in nodes]
        plan = _small_table(spark, splits, {"node": "int", "dim": "string", "lo": "double", "hi": "double"})
        value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in dims])
        place = F.when(F.col("hi") > F.col("lo"), (value - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
        half = KEY_BITS // 2
        key = F.shiftleft(F.floor(place * ((1 << half) - 1)).cast("long"), half) + F.col("tie").bitwiseAND(F.lit((1 << half) - 1))
        keyed = cut(points.join(plan, "node", "left").withColumn("key", key).drop("dim", "lo", "hi"))
        target = sum(n["weight"] for n in nodes) / sum(width[n["node"]] for n in nodes)
        nodes = _medians(keyed.filter("key IS NOT NULL"), nodes, target * 1e-4)
        new, step = {}, {}
        base = 0
        split = {n["node"]: n for n in nodes}
        for node in sorted(width):
            k = width[node]
            if node in split:
                step[node] = (base, base + 1, split[node]["cut"])
                new[base], new[base + 1] = k // 2, k - k // 2
                base += 2
            else:
                step[node] = (base, base, 0)
                new[base] = k
                base += 1
        moves = _small_table(spark, [(n, *s) for n, s in step.items()], {"node": "int", "left": "int", "right": "int", "at": "long"})
        side = F.when(F.col("key") < F.col("at"), F.col("left")).otherwise(F.col("right")).cast("int")
        points = cut(keyed.join(moves, "node").withColumn("node", side).drop("key", "left", "right", "at"))
        width = new
    return points


def kd_shards(docs: DataFrame, dims: dict[str, Column], target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """Each row of ``docs`` with size, text_crc32, shard and slot; shards reach ``target_bytes`` (or are so many).

    Size is the UTF-8 bytes of the text plus 1, null having none. Rows of equal texts are one point of the tree and
    stay together; a group heavier than a hundredth of a shard (there are at most a hundred a shard) is dealt out in parts of
    about that weight. Null metadata has a place of its own; repeated rows are rows. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = ["_row", "_same", "_size", "_crc", *[f"_d{i}" for i in range(len(dims))]]
    rows = docs.select(
        F.col("doc_id").alias("_row"),
        F.sha1(text.cast("binary")).alias("_same"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        *[c.cast("double").alias(f"_d{i}") for i, c in enumerate(dims.values())],
    ).select(kept)
    rows = cut(rows)
    total = rows.agg(F.sum("_size")).first()[0] or 0
    count = shards if shards else max(1, math.ceil(total / target_bytes))
    part = max(1.0, total / count / 100)
    heavy = F.broadcast(rows.groupBy("_same").agg(F.sum("_size").alias("_all")).filter(F.col("_all") > part))
    parts = F.coalesce(F.ceil(F.col("_all") / part), F.lit(1))
    rows = rows.join(heavy, "_same", "left").withColumn("_part", F.pmod(F.xxhash64("_row"), parts)).drop("_all")
    names = kept[4:]
    points = rows.groupBy("_same", "_part").agg(F.sum("_size").cast("double").alias("w"), *[F.min(d).alias(d) for d in names])
    leaves = kd_leaves(points.withColumn("tie", F.xxhash64("_same", "_part")), names, count)
    placed = rows.drop(*names).join(leaves.select("_same", "_part", F.col("node").alias("shard")), ["_same", "_part"])
    return slots(placed.select(F.col("_row").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard"))


def slots(rows: DataFrame, parts: int = 4096) -> DataFrame:
    """Numbers the rows of each shard from 0 without a gap: within parts of a shard, after the rows of the parts before."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32"))
    return rows.withColumn("_k", within).join(counts, ["shard", "_part"]).withColumn("slot", F.col("_before") + F.col("_k") - 1).drop("_part", "_before", "_k")


def document_dims() -> dict[str, Column]:
    return {
        "length": F.log2(F.coalesce(F.col("n_chars"), F.lit(0)) + 2),
        "source": _unit("source"),
        "lang": _unit("lang"),
        "id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)),
    }


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), document_dims(), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
