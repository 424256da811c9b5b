"""Near copies of vectors, by spherical-cap filters from a structured random product code.

Unit vectors are turned by sign flips and Hadamard transforms, then cut into four parts. A filter is one codeword for each part, so
its direction is a product code, and the product of a vector with it is a sum of four. The filters whose product reaches a
threshold are listed by pairing halves: the sums of the first two parts with the sorted sums of the last two. Two
vectors of high cosine exceed common filters; they are joined on these, and cosines are computed in double precision, block by block.

A pair can meet at several filters. It counts where it meets at the least one that both exceed. A meeting returns a number of links and a
group for each vector, never pairs. Equal vectors are one vector with a number of copies.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.llm.common import query, table
from plumbline.llm.vectors import finite, matrix
from plumbline.operators.components import components

#: Parts of a direction, and codewords of one part at most.
PARTS, MOST_WORDS = 4, 200
#: Filters that a vector exceeds on the average, and in any case its best so many; vectors at a filter aimed at.
LISTED, LEAST, AT_FILTER = 14, 10, 128
#: Vectors that the threshold is measured on.
SAMPLE = 256
#: Vectors of one filter in one block; larger filters are split into pairs of blocks.
BLOCK = 1024
SEED = 20_240


class ProductCode:
    """Directions that are one of ``words`` codewords in each of four parts of a turned space."""

    def __init__(self, dims: int, words: int):
        self.dims, self.words = max(16, 1 << (dims - 1).bit_length()), words
        rng = np.random.default_rng(SEED)
        self.flips = rng.choice([-1.0, 1.0], (3, self.dims))
        code = rng.standard_normal((PARTS, words, self.dims // PARTS))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True)

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), self.dims))
        out[:, : vectors.shape[1]] = vectors
        for flips in self.flips:
            out, half = out * flips, 1
            while half < self.dims:
                pairs = out.reshape(len(out), -1, 2, half)
                out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), -1)
                half *= 2
            out /= np.sqrt(self.dims)
        return out

    def halves(self, vectors: np.ndarray):
        """For each vector the sums of its first two parts with all pairs of codewords, and of the last two."""
        parts = self.turned(vectors).reshape(len(vectors), PARTS, -1)
        sums = [parts[:, i] @ self.code[i].T for i in range(PARTS)]
        for a, b, c, d in zip(*sums, strict=True):
            yield (a[:, None] + b).ravel(), (c[:, None] + d).ravel()

    def threshold(self, vectors: np.ndarray, listed: int) -> float:
        """The sum that ``listed`` filters of a vector reach on the average."""
        halves = [(a, np.sort(b)) for a, b in self.halves(vectors)]
        low, high = -float(PARTS), float(PARTS)
        for _ in range(40):
            middle = (low + high) / 2
            reached = sum(len(b) * len(a) - np.searchsorted(b, middle - a).sum() for a, b in halves)
            low, high = (middle, high) if reached > listed * len(halves) else (low, middle)
        return high

    def filters(self, vectors: np.ndarray, threshold: float, least: int):
        """For each vector all filters that reach the threshold, or the sum of its ``least`` best ones where that is smaller."""
        for first, last in self.halves(vectors):
            order = np.argsort(-last, kind="stable")
            sums = last[order]
            top = min(least, len(first))
            front = np.partition(first, len(first) - top)[len(first) - top :]
            both = np.sort((front[:, None] + sums[:top]).ravel())
            reach = min(threshold, both[-min(least, len(both))])
            near = np.flatnonzero(first + sums[0] >= reach)
            # rounding of the difference must not lose the sum that set the limit
            counts = np.searchsorted(-sums, first[near] - reach + 1e-12, side="right")
            ends = np.cumsum(counts)
            place = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
            yield np.sort(np.repeat(near, counts) * len(last) + order[place])


def _units(column, dims: int) -> np.ndarray:
    """Vectors scaled to length 1; first by a power of two, so that squares neither overflow nor vanish."""
    vectors = matrix(column, dims, np.float64)
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
    vectors = np.ldexp(vectors, -np.frexp(largest)[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _listing(code: ProductCode, dims: int, threshold: float, least: int):
    def listing(batches):
        for batch in batches:
            if len(batch):
                found = list(code.filters(_units(batch.column("v"), dims), threshold, least))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int32()))], names=["node", "filters"])

    return listing


def _lists(column, before: int) -> list[np.ndarray]:
    """The filters of each vector that come before this one."""
    return [f[f < before] for f in (np.asarray(x, np.int64) for x in column.to_pylist())]


def _met_before(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs have one of the listed filters in common."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    met = np.zeros((len(left), len(right)), bool)
    for start in range(0, len(common), 2048):
        part = common[start : start + 2048]
        sides = [np.zeros((len(lists), len(part)), np.float32) for lists in (left, right)]
        for side, lists in zip(sides, (left, right), strict=True):
            for i, filters in enumerate(lists):
                side[i, np.flatnonzero(np.isin(part, filters, assume_unique=True))] = 1
        met |= sides[0] @ sides[1].T > 0
    return met


def _groups(links: np.ndarray) -> np.ndarray:
    """The least member that links lead to, from a symmetric matrix."""
    label = np.arange(len(links))
    while True:
        least = np.minimum(label, np.where(links, label, len(links)).min(axis=1, initial=len(links)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _meeting(dims: int, cosine: float):
    names = ["node", "links", "group"]

    def meet(key, members):
        place, i, j = (k.as_py() for k in key)
        units, own = _units(members["v"], dims), members["own"].to_numpy()
        left, right = (np.flatnonzero(own == b) for b in (i, j))
        linked = np.zeros((len(members), len(members)), bool)
        linked[np.ix_(left, right)] = units[left] @ units[right].T >= cosine
        linked |= linked.T
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(axis=1))
        if len(some):
            lists = _lists(members["filters"].take(pa.array(some)), place)
            linked = linked[np.ix_(some, some)] & ~_met_before(lists, lists)
        counts = linked @ members["copies"].to_numpy()[some] if len(some) else np.empty(0, np.int64)
        group = _groups(linked) if len(some) else np.empty(0, np.int64)
        here = np.flatnonzero(counts > 0)
        nodes = members["node"].to_numpy()[some]
        names_of = [f"{place}~{nodes[g]}" for g in group[here]]
        return pa.table([pa.array(nodes[here], pa.int64()), pa.array(counts[here], pa.int64()), pa.array(names_of, pa.string())], names=names)

    return meet


def near_copies(vectors: DataFrame, cosine: float = 0.95, listed: int = LISTED, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``vectors`` (vec_id, v) as (vec_id, n_links, component_id, kept), one row for each row.

    Two rows link when their cosine in double precision is ``cosine`` or more and both exceed a common filter; the README says which
    share of such pairs was found. component_id is the smallest vec_id that links lead to. Vectors that are null, zero or hold a null
    or a component that is not finite link with nothing and stay. A shorter vector counts as filled up with zeros. Rows with
    equal vectors link with each other; rows that repeat a vec_id are rows of their own. A row without a vec_id links like any other, but
    names a component only where no row has one, as null; it is kept when nothing with an id links with it.
    """
    v = F.transform("v", lambda x: x + F.lit(0).cast("float"))  # -0.0 is 0.0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    usable = finite(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable).select("vec_id", v.alias("v"))
    rest = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    grouped = good.groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    n, dims = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rest.withColumn("kept", F.lit(True))
    words = min(MOST_WORDS, max(4, int(np.ceil((n * listed / AT_FILTER) ** (1 / PARTS)))))
    code = ProductCode(dims, words)
    sample = nodes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    threshold = code.threshold(_units(sample["v"], dims), listed)
    lists = cut(nodes.select("node", "v").mapInArrow(_listing(code, dims, threshold, least), "node long, filters array<int>"))
    each = lists.select("node", F.explode("filters").alias("filter"))
    sizes = each.groupBy("filter").agg(F.count("*").alias("size")).filter("size > 1")
    shared = skew_join(each, sizes, ["filter"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("filter", "size"))).alias("met"))
    members = nodes.join(shared, "node").select("node", "v", "copies", F.col("met.filter").alias("filters"), F.inline("met"))
    blocks = F.ceil(F.col("size") / block)
    members = members.withColumn("own", F.pmod(F.xxhash64("node", "filter"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    members = members.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    met = members.select("filter", "i", "j", "node", "v", "copies", "filters", "own").groupBy("filter", "i", "j")
    met = cut(met.applyInArrow(_meeting(dims, cosine), "node long, links long, group string"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("case_id"), "group"), ["group"]).distinct()
    named = nodes.join(links, "node", "left").join(roots.select(F.col("case_id").alias("node"), F.col("component").alias("root")), "node", "left")
    named = cut(named.select("v", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    tops = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = skew_join(named, tops, ["root"]).select("v", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    found = skew_join(good, named, ["v"]).select("vec_id", "n_links", "component_id").unionByName(rest)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
     WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS least FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


@query("op13_embedding_dedup", SQL)
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")))
