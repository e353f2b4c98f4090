"""Tests of whether a history looks drawn at random."""

from math import comb, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlens.history import History
from drawlens.operators import describe


def colex_rank(numbers: Column, d: int) -> Column:
    """The rank of an ascending combination in colexicographic order, from 0, as a double."""
    out = F.lit(0.0)
    for i in range(1, d + 1):
        term = F.lit(1.0)
        for j in range(i):
            term = term * (F.get(numbers, F.lit(i - 1)) - 1 - j) / F.lit(j + 1.0)
        out = out + term
    return out


def ball_chi2(h: History, corrected: bool = False) -> DataFrame:
    """game, test, value, z: the counts of all numbers against the even share. A draw's numbers differ, so the plain statistic averages k - d, not k - 1; `corrected` scales it to k - 1."""
    scale = (h.k - 1) / (h.k - h.d) if corrected else 1.0
    e = F.col("draws") * (h.d / h.k)
    rows = describe.frequency(h).join(h.sizes, "game").groupBy("game").agg((F.sum((F.col("hits") - e) * (F.col("hits") - e) / e) * scale).alias("value"))
    return rows.select("game", F.lit("ball_chi2").alias("test"), "value", ((F.col("value") - (h.k - 1)) / sqrt(2 * (h.k - 1))).alias("z"))


def combination_ks(h: History) -> DataFrame:
    """The Kolmogorov-Smirnov distance of the combinations' ranks from even ones. Ranks are numbered by blocks of their range, so no task sorts a game."""
    rows = h.draws.select("game", "t", (colex_rank(F.col("sorted"), h.d) / float(comb(h.k, h.d))).alias("u")).withColumn("b", F.floor(F.col("u") * 256))
    before = Window.partitionBy("game").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("game", "b").agg(F.count(F.lit(1)).alias("c")).withColumn("s", F.coalesce(F.sum("c").over(before), F.lit(0))).select("game", "b", "s")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("game", "b").orderBy("u", "t"))).join(starts, ["game", "b"]).join(h.sizes, "game")
    i, n = F.col("s") + F.col("r") - 1, F.col("draws")
    ks = rows.groupBy("game").agg(F.max(F.greatest(F.abs(F.col("u") - i / n), F.abs((i + 1) / n - F.col("u")))).alias("value"), F.max(n).alias("n"))
    return ks.select("game", F.lit("combination_ks").alias("test"), "value", (F.col("value") * 2 / (F.lit(1.36) / F.sqrt("n"))).alias("z"))


def serial(h: History) -> DataFrame:
    """The correlation of each draw's sum with the next."""
    rows = h.draws.select("game", "t", F.aggregate("sorted", F.lit(0), lambda a, x: a + x).cast("double").alias("s"))
    mean = rows.groupBy("game").agg(F.avg("s").alias("m"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(rows.select("game", (F.col("t") - 1).alias("t"), F.col("s").alias("next")), ["game", "t"], "left").join(mean, "game")
    c = rows.groupBy("game").agg((F.sum((F.col("s") - F.col("m")) * (F.col("next") - F.col("m"))) / F.sum((F.col("s") - F.col("m")) * (F.col("s") - F.col("m")))).alias("value"), F.max("n").alias("n"))
    return c.select("game", F.lit("serial").alias("test"), "value", (F.col("value") * F.sqrt("n")).alias("z"))


def repeat_rate(h: History, corrected: bool = False) -> DataFrame:
    """The mean number of numbers that a draw shares with the one before, against d * d / k, with the variance of d independent numbers, or, `corrected`, of d different ones."""
    rows = h.draws.select("game", "t", "sorted").join(h.previous, ["game", "t"]).select("game", F.size(F.array_intersect("sorted", "prev")).alias("o"))
    e = h.d * h.d / h.k
    var = e * (1 - h.d / h.k) * ((h.k - h.d) / (h.k - 1) if corrected else 1)
    return rows.groupBy("game").agg(F.avg("o").alias("value"), F.count(F.lit(1)).alias("n")).select("game", F.lit("repeat_rate").alias("test"), "value", ((F.col("value") - e) / F.sqrt(var / F.col("n"))).alias("z"))


def mean_gap(h: History) -> DataFrame:
    """The mean gap between draws of a number, against k / d."""
    rows = h.hits.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("game", "n").orderBy("t")))
    p = h.d / h.k
    return rows.groupBy("game").agg(F.avg("gap").alias("value"), F.count("gap").alias("n")).select("game", F.lit("mean_gap").alias("test"), "value", ((F.col("value") - 1 / p) / F.sqrt(((1 - p) / p**2) / F.col("n"))).alias("z"))


def bonus_chi2(h: History) -> DataFrame:
    """The counts of bonus numbers against the even share, with 201 bonus draws at least."""
    rows = describe.bonus_counts(h)
    spread = sqrt(2 * max(1, h.ks - 1))
    n = rows.groupBy("game").agg(F.sum("hits").alias("all"), F.sum((F.col("hits") * F.col("hits")).cast("double")).alias("ss")).where("all >= 201")
    value = F.col("ss") * h.ks / F.col("all") - F.col("all")
    return n.select("game", F.lit("bonus_chi2").alias("test"), value.alias("value"), ((value - (h.ks - 1)) / spread).alias("z"))


def tests(h: History) -> DataFrame:
    """game, test, value, z, verdict: fair below 2, watch below 3, else odd. Games of fewer than 200 draws aren't tested."""
    rows = ball_chi2(h)
    for f in (combination_ks, serial, repeat_rate, mean_gap, bonus_chi2):
        rows = rows.unionByName(f(h))
    z = F.abs("z")
    rows = rows.join(h.sizes.where("draws >= 200").select("game"), "game", "leftsemi")
    return rows.withColumn("verdict", F.when(z < 2, "fair").when(z < 3, "watch").otherwise("odd"))
