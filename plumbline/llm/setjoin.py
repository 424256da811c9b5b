"""Components of sets under an exact Jaccard join, by token combinations in extended prefixes.

Two sets link when 100 times their common tokens is at least ``percent`` (80) times the tokens of both. Of a set x of
n tokens that links, at most n // 5 are missing in the other, and the two differ in n // 4 tokens at most. From this follow

* the sieve: of the first n // 5 + t tokens of x, ordered by their value, t or more are common, and the first t common ones are among
  the first m // 5 + t of the other set's m tokens too. With t = n // 8 + 1, and a set of at least 4/5 n tokens on the other side, a set links with
  none if fewer of those first tokens are also among the first ones of another set than t is for 4/5 n tokens. A third of
  the tokens so tells most sets that link with none, and cannot tell it wrongly;
* the signatures. Tokens are ordered from rare to frequent, and the first common one is among the first n // 5 + 1.
  If it is of the rare class it is a signature itself. If not, all common tokens are of the frequent class, and
  of the first n // 4 + n // 5 + 2 so many are common that, with n // 4 tokens to stand in between, two of them
  follow each other in both sets: the pairs of neighbours of the frequent class are the signatures. Both
  numbers grow with the set, not with its square.

Sets that share a signature and are of fitting size are compared in rounds. Of buckets with the same members one is kept, as
it holds the same pairs; members are told by two 64-bit sums of their names. While comparing all is much work, each bucket
compares its members with one of them only; members found in one component need no further comparison, and only buckets
that still hold a pair to compare go on to the next round. Then every pair of different components that is left in a
bucket is compared, so no link is lost. What two sets differ in at least
is told before by the tokens that no other set has and by bitmaps: each shared token flips one bit of a set's bitmap, so
bitmaps of two sets differ in no more bits than the sets do in shared tokens.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.operators.components import components

#: Tokens of at most so many sets, or of the square root of all sets if that is more, are of the rare class. So the class of a
#: token hardly changes as groups of copies grow with the input, and a bucket of a rare token stays small beside it.
RARE = 16
#: All pairs left are compared when they are at most so many for each membership of a bucket, or a round has left most of them.
PAIRS = 8
#: Words of 64 bits in the bitmap of a set.
WORDS = 4
#: So many set ids are broadcast at most.
BROADCAST_ROWS = 400_000


def first_tokens(n):
    """How many tokens, from the least on, the sieve looks at in a set of ``n``; for whole numbers and for SQL names of them."""
    if isinstance(n, str):
        return F.expr(f"int({n} div 5 + {n} div 8 + 1)")
    return n // 5 + n // 8 + 1


def passes(n: str, lone: str) -> Column:
    """Whether a set of ``n`` tokens can link, by the number (or null) of its first tokens that ``unlinked`` found to be lone."""
    return first_tokens(n) - F.coalesce(F.col(lone), F.lit(0)) >= F.expr(f"({n} - {n} div 5) div 8 + 1")


def unlinked(tokens: DataFrame) -> DataFrame:
    """(k, lone): how many of a set's first tokens are not among those of another one; ``tokens`` (k, token) can repeat rows."""
    owners = tokens.groupBy("token").agg(F.min("k").alias("k"), F.max("k").alias("other"))
    return owners.filter("k = other").groupBy("k").agg(F.count("*").alias("lone"))


def _ranked(sets: DataFrame) -> DataFrame:
    """(node, n, u, shared, df, b0, ...): the tokens a set shares with others, from rare to frequent, in how many sets each is,
    and the bitmap of them; ``u`` it shares with none. Two flat arrays take a third of the room of one array of structs."""
    each = sets.select("node", "n", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("df")).filter("df > 1")
    bit = F.expr("shiftleft(1L, int(shiftrightunsigned(token, 1) & 63))")
    word = F.pmod(F.shiftrightunsigned("token", 7), F.lit(WORDS))
    bitmap = [F.bit_xor(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{w}") for w in range(WORDS)]
    ranked = skew_join(each, counts, ["token"]).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("s"), *bitmap)
    shared = ranked.select("node", "n", F.col("s.token").alias("shared"), F.col("s.df").alias("df"), *[f"b{w}" for w in range(WORDS)])
    return shared.withColumn("u", F.col("n") - F.size("shared")).filter("u <= floor(n / 5)")


def _buckets(ranked: DataFrame, rare: int = RARE) -> DataFrame:
    """(bucket, own, node, n, u, i): one row for each signature and each of two bands of sizes, the set's own and the next.

    ``i`` is the place of the signature's (first) token among the shared tokens of the set. Sets of one band meet in their
    own, sets of neighbouring bands in the upper one, so of two that are to be compared one is in its own band.

    Only buckets with two members or more are kept of which one is light (see ``_light``) and one in its own band, and
    one bucket only of those that have the same members.
    """
    reach = F.floor(F.col("n") / 4) + F.floor(F.col("n") / 5) + 2 - F.col("u")
    first = lambda c: F.slice(c, 1, F.greatest(reach, F.lit(0)).cast("int"))
    rows = ranked.select("node", "n", "u", first("shared").alias("s"), first("df").alias("df"))
    near = F.floor(F.col("n") / 5) - F.col("u")

    def signature(x: Column, i: Column) -> Column:
        after, df = F.get("s", i + 1), F.get("df", i)
        single = F.when((df <= rare) & (i <= near), F.xxhash64(F.lit(1), x))
        pair = F.when((df > rare) & after.isNotNull(), F.xxhash64(F.lit(2), x, after))
        return F.struct(F.coalesce(single, pair).alias("sig"), (i + 1).alias("i"))

    signed = F.filter(F.transform("s", signature), lambda x: x["sig"].isNotNull())
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25)))
    rows = rows.select("node", "n", "u", band.alias("band"), F.inline(signed))
    both = [F.struct(F.xxhash64("sig", F.col("band") + up).alias("bucket"), F.lit(up == 0).alias("own")) for up in (0, 1)]
    rows = rows.select("node", "n", "u", "i", F.inline(F.array(*both)))
    names = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    several = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.max(_light()).alias("any"), F.max("own").alias("home"), *names)
    apart = several.filter("m > 1 AND any AND home").groupBy("m", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket")
    return skew_join(rows, apart, ["bucket"])


def _verified(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    sets = ranked.select(F.col("node"), F.col("n"), F.col("shared").alias("t"))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("t").alias(f"t_{c}"))
    both = skew_join(skew_join(pairs, side("a"), ["a"]), side("b"), ["b"])
    common = F.size(F.array_intersect("t_a", "t_b"))
    both = both.select("a", "b", common.alias("common"), (F.col("n_a") + F.col("n_b") - common).alias("all"))
    return both.filter(F.col("common") * 100 >= F.col("all") * percent).select("a", "b")


def _light() -> Column:
    """Two linked sets differ in a quarter of either's tokens at most, so one has few that no other set has."""
    return F.col("u") * 8 <= F.col("n")


def _fits(percent: int) -> Column:
    """Whether a pair can link: at best, of the tokens that either shares with any set, as many are common before and after
    the signature as the side with fewer has there."""
    before = F.least("i_a", "i_b")
    after = F.least(F.col("n_a") - F.col("u_a") - F.col("i_a"), F.col("n_b") - F.col("u_b") - F.col("i_b"))
    best = before + after
    return best * 100 >= (F.col("n_a") + F.col("n_b") - best) * percent


def _near_bitmaps(percent: int) -> Column:
    """Whether a pair can link: it differs in the tokens of either that no other set has, and in as many shared ones as bits."""
    bits = sum((F.bit_count(F.col(f"b{w}_a").bitwiseXOR(F.col(f"b{w}_b"))) for w in range(WORDS)), F.lit(0))
    both, apart = F.col("n_a") + F.col("n_b"), F.col("u_a") + F.col("u_b") + bits
    return (both - apart) * 100 >= (both + apart) * percent


def _lowered(labels: DataFrame, links: DataFrame, steps: int) -> DataFrame:
    """Each linked node takes the least label among its own and its neighbours', ``steps`` times."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(steps):
        theirs = skew_join(ends.withColumnRenamed("b", "node"), labels, ["node"], "left")
        least = theirs.groupBy(F.col("a").alias("node")).agg(F.min(F.coalesce("component", "node")).alias("least"))
        labels = least.join(labels, "node", "full").select("node", F.least("least", "component", "node").alias("component"))
    return cut(labels)


def _closed(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after which no link joins two; the labels that links still join are usually few, or none."""
    one = skew_join(links, labels.select(F.col("node").alias("a"), F.col("component").alias("x")), ["a"])
    two = skew_join(one, labels.select(F.col("node").alias("b"), F.col("component").alias("y")), ["b"])
    open_links = cut(two.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    if open_links.isEmpty():
        return labels
    name = F.concat_ws("~", F.col("x").cast("string"), F.col("y").cast("string"))
    ends = open_links.select(F.explode(F.array("x", "y")).alias("case_id"), name.alias("link"))
    roots = components(ends, ["link"]).distinct().select(F.col("case_id").alias("component"), F.col("component").alias("root"))
    return skew_join(labels, roots, ["component"], "left").select("node", F.coalesce("root", "component").alias("component"))


def linked_components(sets: DataFrame, percent: int = 80) -> DataFrame:
    """(node, component) of the ``sets`` (node, n, tokens without repeats) that link with another one.

    ``component`` is the smallest node that links lead to; sets that link with none have no row.
    """
    ranked = cut(_ranked(sets))
    members = cut(_buckets(ranked, max(RARE, math.isqrt(ranked.count()))))
    allowed = PAIRS * members.count()
    labels = members.select("node", F.col("node").alias("component")).filter("false")
    links = members.select(F.col("node").alias("a"), F.col("node").alias("b")).filter("false")
    state = members.withColumn("comp", F.col("node"))
    before, last = None, False
    rounds = 0
    while not last:
        sizes = state.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum(_light().cast("int")).alias("light"))
        facts = sizes.groupBy("bucket").agg(
            F.sum("c").alias("all"), F.sum("light").alias("lights"), F.count("*").alias("comps"), F.max(F.struct("c", "light", "comp")).alias("m")
        )
        pairs_left = "(lights - m.light) * double(all) + (all - lights - m.c + m.light) * double(lights)"
        facts = facts.filter("comps > 1").select("bucket", F.col("m.comp").alias("main"), F.expr(pairs_left).alias("work"))
        facts = cut(facts.filter("work > 0"))
        work = facts.agg(F.sum("work")).first()[0] or 0.0
        if not work:
            break
        rounds += 1
        last = work <= allowed or before is not None and work > 0.8 * before
        before = work
        left = cut(skew_join(state, facts.select("bucket", "main"), ["bucket"]))
        open_rows = left
        columns = ["own", "n", "u", "i", "comp"]
        if last:
            bitmap = [f"b{w}" for w in range(WORDS)]
            open_rows = skew_join(open_rows, ranked.select("node", *bitmap), ["node"])
            columns += bitmap
        named = lambda c: [F.col(x).alias(f"{x}_{c}") for x in columns] + [_light().alias(f"light_{c}")]  # noqa: E731,B023
        mine = open_rows.select("bucket", "main", F.col("node").alias("a"), *named("a"))
        other = open_rows.select("bucket", F.col("node").alias("b"), *named("b"))
        if last:
            pairs = mine.filter("comp_a <> main").join(other, "bucket").filter("(comp_b = main OR a < b) AND (light_a OR light_b)")
            pairs = pairs.filter("own_a OR own_b").filter(_near_bitmaps(percent))
        else:
            # first the set with the fewest tokens of its own, which an original has among its near copies; then any
            turn = F.xxhash64("b", F.lit(rounds)).alias("turn")
            own = (F.col("u_b") / F.col("n_b") if rounds == 1 else ~F.col("light_b")).alias("own")
            pivots = other.groupBy("bucket").agg(F.min(F.struct(own, turn, "b", "n_b", "u_b", "i_b", "comp_b")).alias("p"))
            pairs = skew_join(mine, pivots.select("bucket", "p.b", "p.n_b", "p.u_b", "p.i_b", "p.comp_b"), ["bucket"])
        pairs = pairs.filter("comp_a <> comp_b").filter(_fits(percent)).select("a", "b").distinct()
        new = cut(_verified(pairs, ranked, percent))
        links = links.unionByName(new)
        labels = _lowered(labels, links, 1 if last else 2)
        known = skew_join(left.drop("main", "comp"), labels, ["node"], "left")
        state = known.select("bucket", "own", "node", "n", "u", "i", F.coalesce("component", "node").alias("comp"))
    return _closed(labels, links)
