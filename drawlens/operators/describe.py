"""Descriptive statistics of numbers, pairs and weekdays."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlens.functions.odds import smoothed_rate
from drawlens.history import BLOCK, History, blocked, gapless


def frequency(h: History) -> DataFrame:
    """game, n, hits, rate (one even draw added), last_seen, since (draws since; all if never seen)."""
    seen = h.hits.groupBy("game", "n").agg(F.count(F.lit(1)).alias("hits"), F.max("t").alias("last_seen"))
    rows = h.numbers.join(seen, ["game", "n"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select("game", "n", "hits", smoothed_rate(F.col("hits"), F.col("draws"), h.d / h.k).alias("rate"), "last_seen", F.coalesce(F.col("draws") - F.col("last_seen"), F.col("draws")).alias("since"))


def by_weekday(h: History) -> DataFrame:
    """game, dow, n, hits, draws: the hits of each number on each weekday that has draws."""
    days = h.draws.groupBy("game", "dow").agg(F.count(F.lit(1)).alias("draws"))
    full = days.select("game", "dow", "draws", F.explode(F.sequence(F.lit(1), F.lit(h.k))).alias("n"))
    hits = h.hits.groupBy("game", "dow", "n").agg(F.count(F.lit(1)).alias("hits"))
    return full.join(hits, ["game", "dow", "n"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def schedule(h: History) -> DataFrame:
    """game, dow, draws: the weekdays with at least two draws and 4 % of all; else the last draw's weekday."""
    days = h.draws.groupBy("game", "dow").agg(F.count(F.lit(1)).alias("draws"), F.max("t").alias("last"))
    own = Window.partitionBy("game")
    days = days.withColumn("_least", F.greatest(F.lit(2), F.floor(F.sum("draws").over(own) * 0.04)))
    days = days.withColumn("_fits", F.col("draws") >= F.col("_least")).withColumn("_any", F.max("_fits").over(own)).withColumn("_last", F.max("last").over(own))
    return days.where(F.col("_fits") | (~F.col("_any") & (F.col("last") == F.col("_last")))).select("game", "dow", "draws")


def gaps(h: History) -> DataFrame:
    """game, n, gaps, mean_gap, gap_sd (population), max_gap. Without a gap the mean is k / d, and with one the deviation is the mean."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("game", "n").orderBy("t"))
    rows = h.hits.withColumn("gap", gap).groupBy("game", "n").agg(F.count("gap").alias("gaps"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"), F.max("gap").alias("max_gap"))
    full = h.numbers.join(rows, ["game", "n"], "left")
    mean = F.coalesce("m", F.lit(h.k / h.d))
    count = F.coalesce("gaps", F.lit(0))
    return full.select("game", "n", count.alias("gaps"), mean.alias("mean_gap"), F.when(count >= 2, F.col("s")).otherwise(mean).alias("gap_sd"), "max_gap")


def recent_counts(h: History, windows: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """game, n, draws, hits and last_<w>: all numbers, counted in one pass over the hits."""
    near = h.hits.join(h.sizes, "game")
    counts = near.groupBy("game", "n").agg(F.count(F.lit(1)).alias("hits"), *[F.sum((F.col("t") >= F.col("draws") - w).cast("long")).alias(f"last_{w}") for w in windows])
    rows = h.numbers.join(counts, ["game", "n"], "left")
    return rows.select("game", "n", "draws", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", *[f"last_{w}" for w in windows])])


def _top(df: DataFrame, order: list[Column], most: int, column: str = "place", by: tuple[str, ...] = ("game",)) -> DataFrame:
    return df.withColumn(column, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(column) <= most)


def hot_z(h: History) -> DataFrame:
    """recent_counts with z: how far the last 20 draws are from the number's rate (ten even draws added)."""
    rows = recent_counts(h, (10, 20, 50))
    w = F.least("draws", F.lit(20))
    p = smoothed_rate(F.col("hits"), F.col("draws"), h.d / h.k, 10)
    return rows.withColumn("z", (F.col("last_20") - w * p) / F.sqrt(F.greatest(F.lit(1e-9), w * p * (1 - p))))


def hot_cold(h: History, most: int = 8) -> DataFrame:
    """game, kind, place, n, last_20, z: the hottest numbers, ties to the smaller, and the coldest, ties to the larger."""
    rows = hot_z(h).withColumn("z", F.round("z", 9))
    hot = _top(rows, [F.col("z").desc(), F.col("n")], most).withColumn("kind", F.lit("hot"))
    cold = _top(rows, [F.col("z"), F.col("n").desc()], most).withColumn("kind", F.lit("cold"))
    return hot.unionByName(cold).select("game", "kind", "place", "n", "last_20", "z")


def overdue(h: History, most: int = 8) -> DataFrame:
    """game, place, n, since, mean_gap, ratio: numbers seen twice at least, by draws since seen over their mean gap."""
    rows = frequency(h).where("hits >= 2").join(gaps(h), ["game", "n"])
    rows = rows.withColumn("ratio", F.round(F.col("since") / F.greatest(F.lit(1.0), F.col("mean_gap")), 9))
    return _top(rows, [F.col("ratio").desc(), F.col("n")], most).select("game", "place", "n", "since", "mean_gap", "ratio")


def pair_counts(h: History) -> DataFrame:
    """game, a, b, together, for a < b: the pairs of each draw come from its array, without a join."""
    pairs = F.flatten(F.transform("sorted", lambda x: F.transform(F.filter("sorted", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return h.draws.select("game", F.inline(pairs)).groupBy("game", "a", "b").agg(F.count(F.lit(1)).alias("together"))


def top_pairs(h: History, most: int = 15) -> DataFrame:
    """game, place, a, b, together, expected, lift: pairs seen twice at least, by count, then lift."""
    f = frequency(h).select("game", "n", "hits")
    rows = pair_counts(h).where("together >= 2").join(h.sizes, "game")
    rows = rows.join(f.select("game", F.col("n").alias("a"), F.col("hits").alias("ha")), ["game", "a"]).join(f.select("game", F.col("n").alias("b"), F.col("hits").alias("hb")), ["game", "b"])
    fix = (h.d - 1) * h.k / (h.d * (h.k - 1))
    rows = rows.withColumn("expected", F.col("ha") * F.col("hb") / F.col("draws") * fix).withColumn("lift", F.round((F.col("together") + 0.5) / (F.col("expected") + 0.5), 9))
    return _top(rows, [F.col("together").desc(), F.col("lift").desc(), F.col("a"), F.col("b")], most).select("game", "place", "a", "b", "together", "expected", "lift")


def successions(h: History) -> DataFrame:
    """game, t, dow, j, i: every number j of draw t - 1 with every number i of draw t."""
    rows = h.draws.select("game", "t", "dow", "sorted").join(h.previous, ["game", "t"])
    return rows.select("game", "t", "dow", "sorted", F.explode("prev").alias("j")).select("game", "t", "dow", "j", F.explode("sorted").alias("i"))


def transitions(h: History) -> DataFrame:
    """game, j, i, followed, chances: how often i came in the draw after j, and how often a draw came after j."""
    rows = successions(h).groupBy("game", "j", "i").agg(F.count(F.lit(1)).alias("followed"))
    last = h.sizes.withColumnRenamed("draws", "all")
    chances = h.hits.join(last, "game").where(F.col("t") < F.col("all") - 1).groupBy("game", F.col("n").alias("j")).agg(F.count(F.lit(1)).alias("chances"))
    return rows.join(chances, ["game", "j"]).select("game", "j", "i", "followed", "chances")


def top_followers(h: History, most: int = 12) -> DataFrame:
    """game, place, j, i, followed, chances, lift, z: followers with a binomial z of 4 at least over the even share."""
    p = h.d / h.k
    rows = transitions(h).where("chances >= 6 and followed >= 4")
    rows = rows.withColumn("lift", F.col("followed") / F.col("chances") / p).withColumn("z", (F.col("followed") - F.col("chances") * p) / F.sqrt(F.col("chances") * (p * (1 - p))))
    rows = rows.where("z >= 4").withColumn("_order", F.round(F.col("lift") * F.log1p("followed"), 9))
    return _top(rows, [F.col("_order").desc(), F.col("j"), F.col("i")], most).select("game", "place", "j", "i", "followed", "chances", "lift", "z")


def repeats(h: History) -> DataFrame:
    """game, n, repeated, chances, rate: how often a number came again in the next draw."""
    rows = transitions(h).where("j = i")
    return rows.select("game", F.col("i").alias("n"), F.col("followed").alias("repeated"), "chances", (F.col("followed") / F.col("chances")).alias("rate"))


def hazard(h: History, most: int = 199) -> DataFrame:
    """game, gap, exposures, hits: over all draws and numbers, by draws since last seen (at most `most`), as before the draw. Never seen counts from the start.

    Only hits are visited: a number that comes again after g draws was exposed at 1 to g, and until its first hit at 0 and on; so counts of stretches by length give exposures at each gap. The hit before comes from the own block of draws, or the last one of earlier blocks.
    """
    rows = h.hits.withColumn("b", F.floor(F.col("t") / BLOCK))
    last = rows.groupBy("game", "n", "b").agg(F.max("t").alias("m"))
    earlier = last.select("game", "n", "b", F.max("m").over(Window.partitionBy("game", "n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    prev = F.coalesce(F.lag("t").over(Window.partitionBy("game", "n", "b").orderBy("t")), F.col("before"))
    rows = rows.join(earlier, ["game", "n", "b"]).select("game", "t", prev.alias("prev"))
    closed = rows.select("game", F.when(F.col("prev").isNull(), 0).otherwise(1).alias("first"), (F.col("t") - F.coalesce("prev", F.lit(0))).alias("upto"), F.lit(True).alias("hit"))
    ends = h.numbers.join(last.groupBy("game", "n").agg(F.max("m").alias("m")), ["game", "n"], "left")
    open_ = ends.select("game", F.when(F.col("m").isNull(), 0).otherwise(1).alias("first"), (F.col("draws") - 1 - F.coalesce("m", F.lit(0))).alias("upto"), F.lit(False).alias("hit"))
    runs = closed.unionByName(open_.where(F.col("upto") >= F.col("first"))).groupBy("game", "first", "upto", "hit").agg(F.count(F.lit(1)).alias("c"))
    each = runs.select("game", "upto", "hit", "c", F.explode(F.sequence(F.least("first", F.lit(most)), F.least("upto", F.lit(most)))).alias("gap"))
    times = F.when(F.col("gap") < most, 1).otherwise(F.col("upto") - most + 1)
    struck = F.col("hit") & (F.least("upto", F.lit(most)) == F.col("gap"))
    return each.groupBy("game", "gap").agg(F.sum(F.col("c") * times).alias("exposures"), F.sum(F.when(struck, F.col("c")).otherwise(0)).alias("hits"))


def shape(h: History) -> DataFrame:
    """game, draws, mean_sum, sum_sd (population), mean_spread."""
    total = F.aggregate("sorted", F.lit(0), lambda a, x: a + x)
    spread = F.element_at("sorted", -1) - F.element_at("sorted", 1)
    return h.draws.groupBy("game").agg(F.count(F.lit(1)).alias("draws"), F.avg(total).alias("mean_sum"), F.greatest(F.stddev_pop(total), F.lit(1e-9)).alias("sum_sd"), F.avg(spread).alias("mean_spread"))


def odd_counts(h: History) -> DataFrame:
    """game, odd, draws: draws by their number of odd numbers."""
    return h.draws.groupBy("game", F.size(F.filter("sorted", lambda x: x % 2 == 1)).alias("odd")).agg(F.count(F.lit(1)).alias("draws"))


def bonus_counts(h: History) -> DataFrame:
    """game, special, hits, last_seen, mean_gap: bonus numbers; gaps are in draws that have one, and add up to the last place less the first."""
    rows = gapless(h.draws.where(F.col("special").isNotNull()).select("game", "special", "t"), "s")
    facts = rows.groupBy("game", "special").agg(F.count(F.lit(1)).alias("hits"), F.max("s").cast("int").alias("last_seen"), F.min("s").alias("first"))
    return facts.select("game", "special", "hits", "last_seen", F.when(F.col("hits") > 1, (F.col("last_seen") - F.col("first")) / (F.col("hits") - 1)).alias("mean_gap"))


def weekday_significance(h: History) -> DataFrame:
    """game, dow, draws, chi2, z: whether a scheduled weekday's numbers differ from the even share; weekdays with 20 draws and an expectation of 1 at least. Scaled to a mean of k - 1, as a draw's numbers differ."""
    expected = F.col("draws") * (h.d / h.k)
    rows = by_weekday(h).join(schedule(h).select("game", "dow"), ["game", "dow"], "leftsemi").where((F.col("draws") >= 20) & (expected >= 1))
    rows = rows.groupBy("game", "dow", "draws").agg(F.sum((F.col("hits") - expected) * (F.col("hits") - expected) / expected).alias("raw"))
    chi2 = F.col("raw") * ((h.k - 1) / (h.k - h.d))
    return rows.select("game", "dow", "draws", chi2.alias("chi2"), ((chi2 - (h.k - 1)) / F.sqrt(F.lit(2.0 * (h.k - 1)))).alias("z"))


def weekday_profiles(h: History, most: int = 6) -> DataFrame:
    """game, dow, place, n, hits, rate, lift: each scheduled weekday's most frequent numbers, ties by lift against the number's own rate."""
    rows = by_weekday(h).join(schedule(h).select("game", "dow"), ["game", "dow"], "leftsemi").join(frequency(h).select("game", "n", F.col("hits").alias("own_hits")), ["game", "n"]).join(h.sizes.select("game", F.col("draws").alias("all_draws")), "game").where("hits > 0")
    rows = rows.withColumn("rate", F.col("hits") / F.col("draws")).withColumn("lift", F.round(F.col("hits") / F.col("draws") / (F.col("own_hits") / F.col("all_draws")), 9))
    return _top(rows, [F.col("hits").desc(), F.col("lift").desc(), F.col("n")], most, by=("game", "dow")).select("game", "dow", "place", "n", "hits", "rate", "lift")


def trends(h: History, most: int = 6) -> DataFrame:
    """game, kind, place, n, momentum: rate of the last 10 draws less that of the last 50; rising above 0, falling below."""
    rows = recent_counts(h, (10, 50))
    rows = rows.withColumn("momentum", F.round(F.col("last_10") / F.least("draws", F.lit(10)) - F.col("last_50") / F.least("draws", F.lit(50)), 9))
    up = _top(rows.where("momentum > 0"), [F.col("momentum").desc(), F.col("n")], most).withColumn("kind", F.lit("rising"))
    down = _top(rows.where("momentum < 0"), [F.col("momentum"), F.col("n").desc()], most).withColumn("kind", F.lit("falling"))
    return up.unionByName(down).select("game", "kind", "place", "n", "momentum")


def streaks(h: History) -> DataFrame:
    """game, n, streak (the run of draws that ends with the last, else 0), max_streak."""
    island = F.col("t") - F.row_number().over(Window.partitionBy("game", "n").orderBy("t"))
    runs = h.hits.withColumn("island", island).groupBy("game", "n", "island").agg(F.count(F.lit(1)).alias("run"), F.max("t").alias("end")).join(h.sizes, "game")
    return runs.groupBy("game", "n").agg(F.coalesce(F.max(F.when(F.col("end") == F.col("draws") - 1, F.col("run"))), F.lit(0)).alias("streak"), F.max("run").alias("max_streak"))


def current_streaks(h: History, most: int = 8) -> DataFrame:
    """game, place, n, streak: runs of two draws at least that still go on."""
    return _top(streaks(h).where("streak >= 2"), [F.col("streak").desc(), F.col("n")], most).select("game", "place", "n", "streak")


def rolling_mean(df: DataFrame, value: str, width: int) -> DataFrame:
    """df (game, t: gapless) with mean_<width>, the mean of the last `width` values; at the start, of those there are."""
    w = Window.partitionBy("game", "block").orderBy("t").rowsBetween(-(width - 1), 0)
    return blocked(df, width - 1).withColumn(f"mean_{width}", F.avg(value).over(w)).where(~F.col("edge")).drop("block", "edge")
