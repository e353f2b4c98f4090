"""Combinations as rows: generators, exact counts, and portfolios of tickets."""

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlens.functions.shapes import families, features, total
from drawlens.history import History
from drawlens.operators.describe import pair_counts, shape
from drawlens.operators.money import TIERS


def subsets(spark: SparkSession, k: int, d: int) -> DataFrame:
    """sorted: every ascending choice of d of 1..k. Each step explodes a range, so rows are made where they are used, and the first two numbers spread them over tasks."""
    rows = spark.range(1, k - d + 2).select(F.array(F.col("id").cast("int")).alias("sorted"), F.col("id").cast("int").alias("at"))
    for i in range(2, d + 1):
        rows = rows.where(F.col("at") + 1 <= k - d + i).select("sorted", F.explode(F.sequence(F.col("at") + 1, F.lit(k - d + i))).alias("at")).select(F.array_append("sorted", F.col("at")).alias("sorted"), "at")
        if i == 2:
            rows = rows.repartition(spark.sparkContext.defaultParallelism * 4)
    return rows.select("sorted")


def chosen(rows: DataFrame, column: str, d: int) -> DataFrame:
    """rows with `part`: every choice of d of an array column's values, in its order."""
    rows = rows.withColumn("part", F.array().cast(dict(rows.dtypes)[column])).withColumn("_at", F.lit(0))
    for _ in range(d):
        rows = rows.where(F.col("_at") < F.size(column)).withColumn("_at", F.explode(F.sequence(F.col("_at") + 1, F.size(column)))).withColumn("part", F.array_append("part", F.get(column, F.col("_at") - 1)))
    return rows.drop("_at")


def family_counts(spark: SparkSession, k: int, d: int) -> DataFrame:
    """family, combinations, share: exact counts of all families, in one pass over the universe."""
    rows = subsets(spark, k, d)
    tests = families(F.col("sorted"), k, d)
    one = rows.agg(F.array(*[F.struct(F.lit(n).alias("family"), F.sum(c.cast("long")).alias("combinations")) for n, c in tests.items()]).alias("f")).select(F.inline("f"))
    return one.withColumn("share", F.col("combinations") / float(comb(k, d)))


def sum_distribution(spark: SparkSession, k: int, d: int) -> DataFrame:
    """total, combinations, at_most: how many combinations have each sum, and at most it, by adding one number of the pool after the other; sums are bounded by d * k rows."""
    ways = [[0] * (d * k + 1) for _ in range(d + 1)]
    ways[0][0] = 1
    for v in range(1, k + 1):
        for size in range(min(d, v), 0, -1):
            for s in range(d * k, v - 1, -1):
                ways[size][s] += ways[size - 1][s - v]
    rows, run = [], 0
    for s, n in enumerate(ways[d]):
        run += n
        if n:
            rows.append((s, n, run))
    return spark.createDataFrame(rows, "total int, combinations long, at_most long")


def at_most_count(k: int, d: int, r: int, v: int) -> int:
    """Combinations whose r-th smallest number is at most v."""
    return sum(comb(v, j) * comb(k - v, d - j) for j in range(r, d + 1))


def window_count(k: int, d: int, width: int) -> int:
    """Combinations within some window of `width` numbers: by their smallest."""
    return sum(comb(min(width - 1, k - m), d - 1) for m in range(1, k + 1))


def adjacency_count(k: int, d: int, pairs: int) -> int:
    """Combinations with at least so many touching pairs."""
    return sum(comb(d - 1, t) * comb(k - d + 1, d - t) for t in range(pairs, d))


def same_digit_count(k: int, d: int, least: int = 4) -> int:
    """Combinations of which at least `least` share a last digit."""
    size = [sum(1 for v in range(1, k + 1) if v % 10 == x) for x in range(10)]
    return sum(comb(n, j) * comb(k - n, d - j) for n in size for j in range(least, d + 1))


def band_count(k: int, d: int, bands: list[tuple[int, int]]) -> int:
    """Combinations whose r-th smallest number lies in the r-th band, for all r."""
    ways = [1] + [0] * d
    for v in range(1, k + 1):
        for r in range(d, 0, -1):
            if bands[r - 1][0] <= v <= bands[r - 1][1]:
                ways[r] += ways[r - 1]
    return ways[d]


def preset_counts(h: History) -> DataFrame:
    """game, preset, combinations, share, expected, observed: exact sizes of the presets, and how many draws fell in them."""
    k, d = h.k, h.d
    s = F.col("sorted")
    f = families(s, k, d) | features(s, k, d)
    everything = comb(k, d)
    presets = {
        "pos4low": (at_most_count(k, d, d - 1, 5), f[f"pos{d - 1}"] <= 5), "pos5low": (at_most_count(k, d, d, min(9, k - 1)), f[f"pos{d}"] <= min(9, k - 1)), "run": (k - d + 1, f["runFive"]), "clustered": (adjacency_count(k, d, 3), f["consec"] >= 3),
        "allHigh": (comb(10, d), f["pos1"] >= k - 9), "window10": (window_count(k, d, 10), f["spread"] <= 9), "digit4": (same_digit_count(k, d), F.array_max(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.size(F.filter(s, lambda v: v % 10 == x)))) >= 4), "dates": (comb(31, d), f[f"pos{d}"] <= 31),
    }
    parts = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(c).cast("long").alias("combinations"), F.sum(test.cast("long")).alias("observed")) for n, (c, test) in presets.items()])
    rows = h.draws.groupBy("game").agg(F.count(F.lit(1)).alias("draws"), parts.alias("p")).select("game", "draws", F.inline("p"))
    return rows.select("game", "preset", "combinations", (F.col("combinations") / float(everything)).alias("share"), (F.col("combinations") * F.col("draws") / float(everything)).alias("expected"), "observed")


def portfolio_stats(tickets: DataFrame, k: int, d: int, ks: int, tiers: list[tuple] = TIERS, by: list[str] | None = None) -> DataFrame:
    """tickets, covered, draws, any_prize, three, four, best_match: exact chances of a set of tickets (numbers, special) at one draw; of several sets, if `by` names the columns that tell them apart.

    A draw matters only by the numbers that the tickets cover: every choice of j of those stands for C(k - covered, d - j) draws. Bonus numbers are independent: the chance that
    some ticket that needs one of a choice's bonus numbers gets it is their distinct number over ks.
    """
    by = by or []
    rows = tickets.select(*by, F.array_sort("numbers").alias("numbers"), "special")
    cover = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("tickets"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("cover"), F.collect_list(F.struct("numbers", "special")).alias("held"))
    sizes = [chosen(cover, "cover", j).withColumn("weight", F.lit(float(comb(k, d)))).withColumn("j", F.lit(j)) for j in range(d + 1)]
    drawn = reduce(DataFrame.unionByName, sizes)
    outside = F.lit(k) - F.size("cover")

    def ways(j: int) -> Column:
        out = F.lit(1.0)
        for i in range(d - j):
            out = out * F.greatest(outside - i, F.lit(0)) / F.lit(i + 1.0)
        return out

    weight = F.lit(0.0)
    for j in range(d + 1):
        weight = F.when(F.col("j") == j, ways(j)).otherwise(weight)
    matches = F.transform("held", lambda x: F.struct(F.size(F.array_intersect(x["numbers"], "part")).alias("m"), x["special"].alias("s")))
    plain = sorted({m for m, b, _ in tiers if not b} | {d})
    with_bonus = sorted({m for m, b, _ in tiers if b} | {d})
    rows = drawn.withColumn("w", weight).withColumn("x", matches).withColumn("best", F.coalesce(F.array_max(F.transform("x", lambda y: y["m"])), F.lit(0)))
    sure = F.exists("x", lambda y: y["m"].isin(plain))
    luck = F.size(F.array_distinct(F.transform(F.filter("x", lambda y: y["m"].isin(with_bonus) & y["s"].isNotNull()), lambda y: y["s"]))) / F.lit(float(max(ks, 1)))
    prize = F.when(sure, 1.0).otherwise(luck)
    everything = float(comb(k, d))
    out = rows.groupBy(*by).agg(F.max("tickets").alias("tickets"), F.max(F.size("cover")).alias("covered"), F.sum("w").alias("draws"), (F.sum(F.col("w") * prize) / everything).alias("any_prize"), (F.sum(F.when(F.col("best") >= 3, F.col("w")).otherwise(0.0)) / everything).alias("three"), (F.sum(F.when(F.col("best") >= 4, F.col("w")).otherwise(0.0)) / everything).alias("four"), (F.sum(F.col("w") * F.col("best")) / everything).alias("best_match"))
    return out.withColumn("draws", F.round("draws").cast("long"))


def deal(scores: DataFrame, h: History, tickets: int, seed: int = 1, tries: int = 1200, accept: Column | None = None) -> DataFrame:
    """game, ticket, numbers: tickets drawn by weight without replacement from scores (game, n, score), each the first acceptable of `tries` candidates.

    A candidate takes the d numbers with the least of -ln(u) / weight, u from a hash of seed, ticket, try and number: the law of drawing one after the other. Candidates are rows, so tries run side by side.
    accept: a test of `numbers` (ascending); tickets without an acceptable candidate get their first.
    """
    own = Window.partitionBy("game")
    low, high = F.min("score").over(own), F.max("score").over(own)
    weight = F.when(low > 0, F.col("score")).otherwise(F.exp((F.col("score") - high) / F.greatest(high - low, F.lit(1e-9))))
    base = scores.withColumn("weight", weight)
    rows = base.select("game", "n", "weight", F.explode(F.sequence(F.lit(1), F.lit(tickets))).alias("ticket"))
    rows = rows.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "game", "ticket", "try", "n"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = rows.select("game", "ticket", "try", F.struct((-F.log(u) / F.col("weight")).alias("k"), "n").alias("k"))
    picked = keyed.groupBy("game", "ticket", "try").agg(F.slice(F.array_sort(F.collect_list("k")), 1, h.d).alias("k")).select("game", "ticket", "try", F.array_sort(F.transform("k", lambda x: x["n"])).alias("numbers"))
    good = F.lit(True) if accept is None else accept
    return picked.groupBy("game", "ticket").agg(F.min_by("numbers", F.struct((~good).cast("int"), F.col("try"))).alias("numbers"))


# The weights of a combination's pair lift, squared distance of its sum, odd count and columns, and how far from its mean a column may be.
PAIRS, SUM, ODD, COLUMNS, FREE = 0.3, 0.06, 0.25, 0.12, 1.5


def best_combinations(scores: DataFrame, h: History, pool: int = 12, most: int = 8, accept: Column | None = None) -> DataFrame:
    """game, place, numbers, score, sum_z, pair_lift (of the mean log lift), relative (to the best, of 100), in_top (numbers among the game's best d): of all choices of d of each game's best `pool` numbers, those with the highest score.

    A score is the sum of the numbers' scores, plus the mean log lift of their pairs, less the squared distance of their sum from the mean draw's, plus the log of how common their count of
    odd numbers is, less how far each place is from what that place has been. accept: a test of `numbers`; combinations that fail it are only used where none passes. The choices are a
    fixed number a game; pairs, odd counts and places are summed from the draws by themselves.
    """
    top = scores.withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.col("score").desc(), "n"))).where(F.col("r") <= pool)
    held = top.groupBy("game").agg(F.array_sort(F.collect_list("n")).alias("cover"), F.map_from_entries(F.collect_list(F.struct("n", "score"))).alias("of"))
    rows = chosen(held, "cover", h.d).select("game", F.col("part").alias("numbers"), "of")
    hits = h.hits.groupBy("game", "n").agg(F.count(F.lit(1)).alias("hits"))
    fix = (h.d - 1) * h.k / (h.d * (h.k - 1))
    a, b = (hits.select("game", F.col("n").alias(x), F.col("hits").alias(f"h{x}")) for x in "ab")
    near = top.select("game", F.col("n").alias("a")).join(top.select("game", F.col("n").alias("b")), "game").where("a < b")  # pairs of the pool's numbers
    near = near.join(h.sizes, "game").join(a, ["game", "a"], "left").join(b, ["game", "b"], "left").join(pair_counts(h), ["game", "a", "b"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    lift = F.log((zero("together") + 0.75) / (zero("ha") * zero("hb") / F.col("draws") * fix + 0.75))
    lifts = near.groupBy("game").agg(F.map_from_entries(F.collect_list(F.struct((F.col("a") * 1000 + F.col("b")).alias("k"), lift.alias("v")))).alias("lift"))
    odd_of = lambda x: F.size(F.filter(x, lambda v: v % 2 == 1))
    odd = h.draws.groupBy("game", odd_of(F.col("sorted")).alias("odd")).agg(F.count(F.lit(1)).alias("m")).groupBy("game").agg(F.map_from_entries(F.collect_list(F.struct("odd", "m"))).alias("odds"), F.max("m").alias("odd_most"))
    places = []
    for i in range(h.d):
        v = F.get("sorted", F.lit(i))
        places.append(F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most")))
    columns = h.draws.groupBy("game").agg(F.array(*places).alias("columns"))
    rows = rows.join(shape(h).select("game", "mean_sum", "sum_sd"), "game").join(lifts, "game").join(odd, "game").join(columns, "game")
    s = F.col("numbers")
    z = (total(s) - F.col("mean_sum")) / F.greatest(F.lit(1.0), F.col("sum_sd"))
    at = lambda i: F.get(s, F.lit(i))
    pairs = sum((F.element_at("lift", at(i) * 1000 + at(j)) for i in range(h.d) for j in range(i + 1, h.d)), F.lit(0.0)) / (h.d * (h.d - 1) / 2)
    odd_bonus = F.log((zero(F.try_element_at("odds", odd_of(s))) + 1.0) / (F.col("odd_most") + 1.0))
    far = F.lit(0.0)
    for i in range(h.d):
        c = F.get("columns", F.lit(i))
        off = F.abs(at(i) - c["mean"]) / c["sd"]
        beyond = F.when(off > FREE, (off - FREE) * (off - FREE)).otherwise(0.0) + F.when((at(i) < c["least"]) | (at(i) > c["most"]), 4.0).otherwise(0.0)
        far = far + F.when(c["sd"] > 0, beyond).otherwise(0.0)
    own = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.element_at("of", x))
    value = own + PAIRS * pairs - SUM * z * z + ODD * odd_bonus - COLUMNS * far
    rows = rows.select("game", "numbers", F.round(value, 9).alias("score"), z.alias("sum_z"), F.exp(pairs).alias("pair_lift"), (F.lit(True) if accept is None else accept).alias("good"))
    place = F.row_number().over(Window.partitionBy("game").orderBy(F.col("good").desc(), F.col("score").desc(), "numbers"))
    best = rows.withColumn("place", place).where(F.col("place") <= most).withColumn("any", F.max("good").over(Window.partitionBy("game")))
    best = best.where("good or not any").withColumn("first", F.max("score").over(Window.partitionBy("game")))
    leaders = top.where(F.col("r") <= h.d).groupBy("game").agg(F.collect_list("n").alias("leaders"))
    relative = F.round(100 * F.exp(0.9 * (F.col("score") - F.col("first")))).cast("int")
    return best.join(leaders, "game").select("game", "place", "numbers", "score", "sum_z", "pair_lift", relative.alias("relative"), F.size(F.array_intersect("numbers", "leaders")).alias("in_top"))
