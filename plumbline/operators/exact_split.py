"""W10 with exact quotas: whole groups whose cases add up to each stratum's quota wherever some choice of groups does.

Nothing is decided group by group. Groups of a stratum that have as many cases and equal feature counts are one class with a number of
groups. How many groups of each size to take is a bounded subset sum over the distinct sizes; the classes of a size get their share of that,
and swaps between classes of one size, which leave every quota as it is, bring the features of the whole nearer to their targets.
Only then groups are taken, by hash order inside their class.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import hashing as H
from plumbline.functions.lineage import cut
from plumbline.functions.skew import skew_join
from plumbline.operators.split import ALL_FEATURES, group_table, half_up_share


def fill(sizes: list[int], counts: list[int], quota: int, share: int, whole: int) -> tuple[list[int], int]:
    """(groups to take of each size, cases left unfilled): the largest reachable sum up to ``quota``, near the share of each size.

    Let y be the shares rounded down, r the cases they leave of the quota, and d the largest size. Take the solution that is nearest
    to y. Its changes can be ordered so that their running sum stays between -d and r + d, and no value comes twice, as what lies
    between could be left out. So no count differs by more than r + 2d + 1 from y, which bounds the sums to look at by the sizes, not by the
    cases. A sum less than d below the quota is always reachable, hence the further d.
    """
    near = [c * share // whole for c in counts]
    largest = max(sizes)
    reach = quota - sum(s * y for s, y in zip(sizes, near, strict=True)) + 3 * largest + 2
    low = [max(0, y - reach) for y in near]
    high = [min(c, y + reach) for c, y in zip(counts, near, strict=True)]
    target = quota - sum(s * k for s, k in zip(sizes, low, strict=True))
    mask, sums, layers = (1 << (target + 1)) - 1, 1, []
    for size, first, last in zip(sizes, low, high, strict=True):
        layers.append(sums)
        left, step = last - first, 1
        while left:
            part = min(step, left)
            sums |= (sums << (size * part)) & mask
            left, step = left - part, step * 2
    total = sums.bit_length() - 1
    unfilled, take = target - total, [0] * len(sizes)
    for i in reversed(range(len(sizes))):
        for k in sorted(range(low[i], high[i] + 1), key=lambda k: (abs(k - near[i]), k)):  # noqa: B023
            before = total - sizes[i] * (k - low[i])
            if before >= 0 and layers[i] >> before & 1:
                take[i], total = k, before
                break
    return take, unfilled


def size_quotas(classes: DataFrame, share: int, whole: int) -> DataFrame:
    """(stratum, cases, take, quota, unfilled): groups to take of each size; a task holds the distinct sizes of one stratum."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cases", ascending=False)
        sizes, counts = rows["cases"].tolist(), rows["n"].tolist()
        total = sum(s * c for s, c in zip(sizes, counts, strict=True))
        quota = (total * share + whole // 2) // whole
        take, unfilled = fill(sizes, counts, quota, share, whole)
        return rows[["stratum", "cases"]].assign(take=np.array(take, np.int64), quota=quota, unfilled=unfilled)

    sizes = classes.groupBy("stratum", "cases").agg(F.sum("n").alias("n"))
    return sizes.groupBy("stratum").applyInPandas(solve, "stratum string, cases bigint, take bigint, quota bigint, unfilled bigint")


def shared_out(classes: DataFrame, quotas: DataFrame) -> DataFrame:
    """Adds ``taken``: each class's share of its size's groups, the rest to the largest remainders."""
    cell = Window.partitionBy("stratum", "cases")
    rows = classes.join(quotas.select("stratum", "cases", "take"), ["stratum", "cases"]).withColumn("all", F.sum("n").over(cell))
    even = F.expr("take * n div all")
    rows = rows.withColumn("even", even).withColumn("over", F.col("take") * F.col("n") - F.col("even") * F.col("all"))
    rank = F.row_number().over(cell.orderBy(F.desc("over"), "order"))
    rest = F.col("take") - F.sum("even").over(cell)
    return rows.withColumn("taken", F.col("even") + (rank <= rest).cast("bigint")).drop("take", "all", "even", "over")


def improved(classes: DataFrame, features: list[str], share: int, whole: int, rounds: int) -> DataFrame:
    """Swaps groups between classes of a size in rounds, while the squared relative error of the features falls.

    A round is one job over the classes: of each size the best class to take from and to give to, by the slope of the error, then the best
    of these. What it swaps is two numbers; only they, and the sums of the features, come to the driver.
    """
    names = [f"f_{f}" for f in features]
    each = [F.sum(F.col("taken") * F.col(c)) for c in names] + [half_up_share(F.sum(F.col("n") * F.col(c)), share, whole) for c in names]
    first = classes.agg(*[c.alias(f"v{i}") for i, c in enumerate(each)]).first()
    if first[0] is None:
        return classes
    error = np.array(first[: len(names)], float) - np.array(first[len(names) :], float)
    weight = 1 / np.maximum(np.array(first[len(names) :], float), 1) ** 2
    moved: dict[tuple, int] = {}
    for _ in range(rounds):
        now = _moved(classes, names, moved)
        slope = sum((F.lit(float(2 * e * w)) * F.col(c) for e, w, c in zip(error, weight, names, strict=True)), F.lit(0.0))
        row = F.struct(slope.alias("slope"), "order", F.col("taken"), (F.col("n") - F.col("taken")).alias("free"), *names)
        ends = now.groupBy("stratum", "cases").agg(
            F.max(F.when(F.col("taken") > 0, row)).alias("out"), F.min(F.when(F.col("taken") < F.col("n"), row)).alias("into")
        )
        change = [F.col(f"into.{c}") - F.col(f"out.{c}") for c in names]
        line = sum((F.lit(float(e * w)) * d for e, w, d in zip(error, weight, change, strict=True)), F.lit(0.0))
        square = sum((F.lit(float(w)) * d * d for w, d in zip(weight, change, strict=True)), F.lit(0.0))
        ends = ends.filter("out.order <> into.order").withColumns({"line": line, "square": square}).filter("line < 0 AND square > 0")
        times = F.least(F.greatest(F.round(-F.col("line") / F.col("square")), F.lit(1.0)), F.col("out.taken"), F.col("into.free"))
        ends = ends.withColumn("times", times.cast("bigint")).withColumn("gain", F.expr("2 * line * times + square * times * times"))
        best = ends.filter("gain < -1e-12").orderBy("gain", "out.order", "into.order").limit(1).collect()
        if not best:
            break
        out, into, times = best[0]["out"], best[0]["into"], best[0]["times"]
        for row, by in ((out, -times), (into, times)):
            this = (best[0]["stratum"], best[0]["cases"], *[row[c] for c in names])
            moved[this] = moved.get(this, 0) + by
        error += times * (np.array([into[c] for c in names], float) - np.array([out[c] for c in names], float))
    return _moved(classes, names, moved)


def _moved(classes: DataFrame, names: list[str], moved: dict[tuple, int]) -> DataFrame:
    taken = F.col("taken")
    for values, by in moved.items():
        here = reduce(Column.__and__, [F.col(c) == v for c, v in zip(["stratum", "cases", *names], values, strict=True)])
        taken = taken + F.when(here, by).otherwise(0)
    return classes.withColumn("taken", taken)


def exact_split(
    cases: DataFrame, group: str, share: int = 3, whole: int = 10, features: list[str] = ALL_FEATURES, rounds: int = 20, namespace: str = "split-v1"
) -> DataFrame:
    """(group_id, split, stratum, cases, quota, unfilled): dev groups fill every stratum's quota exactly wherever whole groups can.

    Where they cannot, as many cases as possible below it, and ``unfilled`` tells how many are missing.
    """
    names = [f"f_{f}" for f in features]
    groups = cut(group_table(cases, group))
    classes = groups.groupBy("stratum", "cases", *names).agg(F.count("*").alias("n")).withColumn("order", F.xxhash64("stratum", "cases", *names))
    classes = cut(classes)
    quotas = cut(size_quotas(classes, share, whole))
    chosen = improved(cut(shared_out(classes, quotas)), features, share, whole, rounds)
    chosen = chosen.join(quotas.drop("take"), ["stratum", "cases"]).select("stratum", "cases", *names, "taken", "quota", "unfilled")
    keyed = groups.withColumn("key", H.stable_key(namespace, "group_id"))
    by = ["stratum", "cases", *names]
    ranked = H.hash_rank(keyed, by, "key", "group_id", "rank")
    split = F.when(F.col("rank") <= F.col("taken"), "dev").otherwise("test").alias("split")
    return skew_join(ranked, chosen, by).select("group_id", split, "stratum", "cases", "quota", "unfilled")
