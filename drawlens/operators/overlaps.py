"""Draws that repeat or overlap other draws."""

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlens.functions.odds import hypergeometric
from drawlens.history import History


def exact(h: History) -> DataFrame:
    """game, numbers, draws, first, last: combinations drawn more than once. A group-by of the combination, whatever the history's length."""
    return h.draws.groupBy("game", F.array_join("sorted", "-").alias("numbers")).agg(F.count(F.lit(1)).alias("draws"), F.min("t").alias("first"), F.max("t").alias("last")).where("draws > 1")


def _subsets(h: History, size: int) -> DataFrame:
    """game, t and `part`, each ascending choice of `size` of the draw's numbers."""
    rows = h.draws.select("game", "t", "sorted", F.array().cast("array<int>").alias("part"), F.lit(0).alias("at"))
    for _ in range(size):
        rows = rows.where(F.col("at") < h.d).select("game", "t", "sorted", "part", F.explode(F.sequence(F.col("at") + 1, F.lit(h.d))).alias("next"))
        rows = rows.select("game", "t", "sorted", F.array_append("part", F.get("sorted", F.col("next") - 1)).alias("part"), F.col("next").alias("at"))
    return rows.select("game", "t", "part")


def histogram(h: History) -> DataFrame:
    """game, overlap, pairs, expected: pairs of draws by how many numbers they share.

    No pair is built: the draws that share each m-number subset are counted, S_m = sum of C(count, m-subset sharers, 2) counts a pair C(overlap, m) times, and
    inclusion-exclusion gives the pairs with each overlap. The cost is linear in the draws.
    """
    levels = None
    for m in range(h.d + 1):
        if m:
            shared = _subsets(h, m).groupBy("game", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("game").agg(F.sum(F.expr("cast(c * (c - 1) div 2 as decimal(38, 0))")).alias("s"))
        else:
            shared = h.sizes.select("game", F.expr("cast(draws * (draws - 1) div 2 as decimal(38, 0))").alias("s"))
        shared = shared.withColumn("m", F.lit(m))
        levels = shared if levels is None else levels.unionByName(shared)
    out = []
    for q in range(h.d + 1):
        sign = [(-1) ** (m - q) * comb(m, q) if m >= q else 0 for m in range(h.d + 1)]  # whole numbers throughout: the terms cancel
        out.append(F.struct(F.lit(q).alias("overlap"), F.sum(F.get(F.array(*[F.lit(x) for x in sign]), F.col("m")) * F.col("s")).alias("pairs"), F.lit(hypergeometric(h.k, h.d, h.d, q)).alias("p")))
    rows = levels.groupBy("game").agg(F.array(*out).alias("o")).select("game", F.inline("o")).join(h.sizes, "game")
    return rows.select("game", "overlap", F.col("pairs").cast("long").alias("pairs"), (F.col("p") * F.col("draws") * (F.col("draws") - 1) / 2).alias("expected"))


def closest(h: History, most: int = 4) -> DataFrame:
    """game, place, a, b, overlap: the pairs of draws that share the most numbers, earliest first.

    Draws that share m numbers meet in one of their m-number subsets; of each subset the first `most` + 1 draws hold its earliest pairs, so no subset is paired in full.
    """
    rows = None
    for m in range(1, h.d + 1):
        part = _subsets(h, m).withColumn("overlap", F.lit(m))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("game", "part").orderBy("t"))).where(F.col("r") <= most + 1)
    held = rows.groupBy("game", "overlap", "part").agg(F.array_sort(F.collect_list("t")).alias("ts")).where(F.size("ts") > 1)
    pairs = F.flatten(F.transform("ts", lambda x: F.transform(F.filter("ts", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = held.select("game", "overlap", F.inline(pairs)).withColumn("best", F.max("overlap").over(Window.partitionBy("game"))).where("overlap = best").distinct()
    place = F.row_number().over(Window.partitionBy("game").orderBy("a", "b"))
    return pairs.withColumn("place", place).where(F.col("place") <= most).select("game", "place", "a", "b", "overlap")


def sharing(h: History, numbers: list[int]) -> DataFrame:
    """game, overlap, draws, last: how many draws share how many numbers with one combination."""
    mine = F.size(F.array_intersect("sorted", F.array(*[F.lit(n) for n in numbers])))
    return h.draws.groupBy("game", mine.alias("overlap")).agg(F.count(F.lit(1)).alias("draws"), F.max("t").alias("last"))
