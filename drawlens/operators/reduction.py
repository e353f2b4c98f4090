"""What is left of all combinations: members of families made without a scan, exact sizes of unions, and the ledger of a reduction."""

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.functions.shapes import FIBONACCI, GRIDS, LEAST_FACTOR, PRIMES, SLIP, SLIP_COLUMNS, TIGHT_SPAN, TIGHT_STEP, WIDE_GAP, families, features, total
from drawlens.history import History
from drawlens.operators import bands, constraints
from drawlens.operators.combinations import band_count, chosen, preset_counts, sum_distribution


def rank_of(s: Column, d: int) -> Column:
    """The place of an ascending array of d numbers among all of that size, from 0, ordered by their largest numbers first: a BIGINT that names the combination."""
    out = F.lit(0).cast("long")
    for i in range(1, d + 1):
        ways = F.lit(1).cast("long")
        for j in range(i):  # stays whole after each division
            ways = F.floor(ways * (F.get(s, F.lit(i - 1)) - 1 - j) / (j + 1)) if j else (F.get(s, F.lit(0 if i == 1 else i - 1)) - 1).cast("long")
        out = out + F.greatest(ways, F.lit(0).cast("long"))
    return out


def unranked(rank: Column, k: int, d: int) -> Column:
    """The ascending array of d of 1..k that has a rank: from the largest number down, each the most that still fits."""
    ways = [[comb(v, i) for v in range(k)] for i in range(d + 1)]
    start = F.struct(rank.cast("long").alias("left"), F.array().cast("array<int>").alias("s"))
    table = F.array(*[F.array(*[F.lit(w).cast("long") for w in row]) for row in ways[1:]])

    def step(a: Column, i: Column) -> Column:
        row = F.get(table, i - 1)
        v = F.size(F.filter(row, lambda w: w <= a["left"]))
        return F.struct((a["left"] - F.get(row, v - 1)).alias("left"), F.array_prepend(a["s"], v.cast("int")).alias("s"))

    return F.aggregate(F.sequence(F.lit(d), F.lit(1), F.lit(-1)), start, step, lambda a: a["s"])


def sums_at_most(spark: SparkSession, k: int, d: int, bound: int) -> DataFrame:
    """sorted: every choice of d of 1..k whose sum is at most bound. A prefix is dropped as soon as the least numbers that can follow would take it over, so nothing else is visited."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("sorted"), F.lit(0).alias("at"), F.lit(bound).alias("left"))
    for i in range(d):
        more = d - i  # numbers to come; v, v + 1, ... is the least way on
        top = F.least(F.lit(k - more + 1), F.floor((F.col("left") - more * (more - 1) // 2) / more).cast("int"))
        rows = rows.where(top > F.col("at")).select("sorted", "left", F.explode(F.sequence(F.col("at") + 1, top)).alias("at"))
        rows = rows.select(F.array_append("sorted", F.col("at")).alias("sorted"), "at", (F.col("left") - F.col("at")).alias("left"))
    return rows.select("sorted")


def sums_at_least(spark: SparkSession, k: int, d: int, bound: int) -> DataFrame:
    """sorted: every choice whose sum is at least bound, as mirrors n -> k + 1 - n of those of small sums."""
    low = sums_at_most(spark, k, d, d * (k + 1) - bound)
    return low.select(F.reverse(F.transform("sorted", lambda n: F.lit(k + 1) - n)).alias("sorted"))


def touching_at_least(spark: SparkSession, k: int, d: int, pairs: int) -> DataFrame:
    """sorted: every choice with at least so many touching pairs. A prefix that can't reach them any more goes on with touching numbers only."""
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(k - d + 1))).alias("at")).select(F.array("at").alias("sorted"), "at", F.lit(0).alias("met"))
    for i in range(1, d):
        free = F.col("met") + (d - 1 - i) >= pairs  # enough pairs can still come after this one
        end = F.when(free, F.lit(k - d + i + 1)).otherwise(F.least(F.col("at") + 1, F.lit(k - d + i + 1)))
        rows = rows.where(end > F.col("at")).select("sorted", "at", "met", F.explode(F.sequence(F.col("at") + 1, end)).alias("v"))
        rows = rows.select(F.array_append("sorted", F.col("v")).alias("sorted"), F.col("v").alias("at"), (F.col("met") + (F.col("v") == F.col("at") + 1).cast("int")).alias("met"))
    return rows.where(F.col("met") >= pairs).select("sorted")


def groups(spark: SparkSession, k: int, d: int) -> DataFrame:
    """family, numbers: the sets of numbers of which a family takes all d (each family of CUTS but the runs), d numbers at least."""
    upto = range(1, k + 1)
    digits = lambda n: {int(c) for c in str(n)}
    classes = lambda f: {key: [n for n in upto if f(n) == key] for key in {f(n) for n in upto}}.values()
    out: list[tuple[str, list[int]]] = []
    for name, f in (("oneDecade", lambda n: (n - 1) // 10), ("sameDigit", lambda n: n % 10), ("slipRow", lambda n: (n - 1) % SLIP), ("digitSum", lambda n: sum(map(int, str(n)))), *(("gridColumn", lambda n, m=m: n % m) for m in GRIDS), *(("slipDiagonal", lambda n, way=way: (n - 1) % SLIP + way * ((n - 1) // SLIP)) for way in (-1, 1))):
        out += [(name, x) for x in classes(f)]
    roots = {i * i for i in upto} | {i**3 for i in upto}
    out += [("mult5", [n for n in upto if n % 5 == 0]), ("squareCube", [n for n in upto if n in roots]), ("fib", [n for n in FIBONACCI if n <= k]), ("powerTwo", [n for n in upto if n & (n - 1) == 0]), ("repdigit", [n for n in upto if n >= 11 and len(digits(n)) == 1])]
    out += [("sameMultiple", [n for n in upto if n % m == 0]) for m in range(LEAST_FACTOR, k // d + 1)]
    out += [("tightSpan", list(range(m, m + TIGHT_SPAN + 1))) for m in range(1, k - TIGHT_SPAN + 1)]
    out += [("twoDigits", [n for n in upto if digits(n) <= {a, b}]) for a in range(10) for b in range(a + 1, 10)]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(x for x in out if len(x[1]) >= d)], "group int, family string, numbers array<int>").repartition(spark.sparkContext.defaultParallelism, "group").drop("group")


def family_members(spark: SparkSession, k: int, d: int) -> DataFrame:
    """family, rank, sorted: the members of the families that the reduced pool leaves out, and of the low places: all choices of d within each group of numbers, runs of even steps, and four of 1..5 with any other. A combination stands once for each family that has it."""
    of_groups = chosen(groups(spark, k, d), "numbers", d).select("family", F.col("part").alias("sorted"))
    steps = spark.range(1, TIGHT_STEP + 1).select(F.col("id").cast("int").alias("step")).where(k - (d - 1) * F.col("step") >= 1)
    even = steps.select("step", F.explode(F.sequence(F.lit(1), k - (d - 1) * F.col("step"))).alias("a")).select("step", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: (F.col("a") + i * F.col("step")).cast("int")).alias("sorted"))
    runs = even.select(F.lit("evenStepTight").alias("family"), "sorted").unionByName(even.where("step = 1").select(F.lit("runFive").alias("family"), "sorted"))
    few = spark.range(1).select(F.array(*[F.lit(n) for n in range(1, min(5, k) + 1)]).alias("few"))
    low = chosen(few, "few", d - 1).select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("n")).where(~F.array_contains("part", F.col("n"))).select(F.array_sort(F.array_append("part", F.col("n"))).alias("sorted"))
    top = chosen(spark.range(1).select(F.sequence(F.lit(1), F.lit(min(9, k))).alias("nine")), "nine", d).select(F.col("part").alias("sorted"))
    rows = of_groups.unionByName(runs).unionByName(low.unionByName(top).select(F.lit("low").alias("family"), "sorted"))
    return rows.withColumn("rank", rank_of(F.col("sorted"), d)).dropDuplicates(["family", "rank"]).select("family", "rank", "sorted")


def limits(mode: DataFrame) -> DataFrame:
    """game, mode, limits: the bands of each mode (game, mode, feature, lo, hi), one for each feature: where a mode has several rules on one feature, what lies within all of them."""
    one = mode.groupBy("game", "mode", "feature").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return one.groupBy("game", "mode").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi").alias("band")))).alias("limits"))


def passes(s: Column, limits: Column, k: int, d: int) -> Column:
    """Whether a combination lies within limits; features against earlier draws don't count. No limits: yes."""
    out = F.lit(True)
    for name, v in features(s, k, d).items():
        band = F.try_element_at(limits, F.lit(name))
        out = out & (band.isNull() | bands.held(v.cast("double"), band["lo"], band["hi"]))
    return F.coalesce(out, F.lit(True))


def ledger(h: History, mode: DataFrame | None = None, worth: DataFrame | None = None) -> DataFrame:
    """game, mode, place, step, removed, remaining, cost: what each step of a reduction takes from all combinations with all bonus numbers, each step only what the steps before it have left.

    Steps: the mode's bands (game, mode, feature, lo, hi; worth: mode_report(), whose share prices them), every combination drawn so far, the families and low places of family_members(), and sums at or beyond the record. cost: the draws that a step would have cost: draws that broke the
    bands, that repeat an earlier one, that fall in a family, that hold a record. Without a mode, `mode` is null and the first step is missing. Members are made by family, never by a scan; combinations meet by rank.
    """
    spark, d, k, bonus = h.draws.sparkSession, h.d, h.k, max(1, h.ks)
    games = h.sizes.select("game", "draws")
    at = games.withColumn("mode", F.lit(None).cast("double")).withColumn("limits", F.lit(None).cast("map<string,struct<lo:int,hi:int>>")) if mode is None else games.join(limits(mode), "game")
    sums = h.draws.groupBy("game").agg(F.min(total(F.col("sorted"))).alias("least"), F.max(total(F.col("sorted"))).alias("most"))
    members = cut(family_members(spark, k, d).select("rank", "sorted").dropDuplicates(["rank"]))
    drawn = cut(h.draws.select("game", rank_of(F.col("sorted"), d).alias("rank"), "sorted").groupBy("game", "rank", "sorted").agg(F.count(F.lit(1)).alias("times")))
    family = games.select("game").join(F.broadcast(members), F.lit(True))  # the members are those of one pool, whatever the histories
    edges = []
    for r in sums.collect():  # a record for each game
        edges.append(sums_at_most(spark, k, d, r.least).unionByName(sums_at_least(spark, k, d, r.most)).select(F.lit(r.game).alias("game"), "sorted"))
    edge = reduce(DataFrame.unionByName, edges).withColumn("rank", rank_of(F.col("sorted"), d)).dropDuplicates(["game", "rank"])
    parts = drawn.select("game", "rank", "sorted", F.lit(2).alias("place")).unionByName(family.select("game", "rank", "sorted", F.lit(3).alias("place"))).unionByName(edge.select("game", "rank", "sorted", F.lit(4).alias("place")))
    first = parts.groupBy("game", "rank").agg(F.min("place").alias("place"), F.first("sorted").alias("sorted"))
    left = at.select("game", "mode", "limits").join(first, "game").where(passes(F.col("sorted"), F.col("limits"), k, d))
    removed = left.groupBy("game", "mode", "place").agg((F.count(F.lit(1)) * bonus).alias("removed"))
    again = drawn.groupBy("game").agg(F.sum(F.col("times") - 1).alias("cost")).withColumn("place", F.lit(2))
    hit = drawn.join(members.select("rank"), "rank", "leftsemi").groupBy("game").agg(F.sum("times").alias("cost")).withColumn("place", F.lit(3))
    record = h.draws.join(sums, "game").where((total(F.col("sorted")) <= F.col("least")) | (total(F.col("sorted")) >= F.col("most"))).groupBy("game").agg(F.count(F.lit(1)).alias("cost")).withColumn("place", F.lit(4))
    costs = again.unionByName(hit).unionByName(record)
    names = F.create_map(F.lit(2), F.lit("drawn"), F.lit(3), F.lit("families"), F.lit(4), F.lit("sums"))
    rows = at.select("game", "mode", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("place")).join(costs, ["game", "place"], "left")
    same = F.coalesce("mode", F.lit(-1.0)).alias("m")
    rows = rows.select("*", same).join(removed.select("game", same, "place", "removed"), ["game", "m", "place"], "left")
    rows = rows.select("game", "mode", "place", F.element_at(names, F.col("place")).alias("step"), F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("cost", F.lit(0)).alias("cost"))
    start = comb(k, d) * bonus
    if mode is not None:
        band = worth.join(h.sizes, "game").select("game", "mode", F.lit(1).alias("place"), F.lit("bands").alias("step"), F.round((1 - F.col("share")) * start).cast("long").alias("removed"), F.col("broken").alias("cost"))
        rows = rows.unionByName(band)
    run = Window.partitionBy("game", "mode").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # four rows
    return rows.select("game", "mode", "place", "step", "removed", (start - F.sum("removed").over(run)).alias("remaining"), "cost")


def reduced(h: History, universe: DataFrame, mode: DataFrame) -> DataFrame:
    """game, mode, sorted: the combinations (sorted) of a universe that the reduced pool of each game and mode (game, mode, feature, lo, hi) holds: within the bands, in no family and no low place, with a sum within the records, and never drawn. No step depends on the order of rows."""
    sums = h.draws.groupBy("game").agg(F.min(total(F.col("sorted"))).alias("least"), F.max(total(F.col("sorted"))).alias("most"))
    at = limits(mode).join(sums, "game")
    rows = universe.select("sorted", rank_of(F.col("sorted"), h.d).alias("rank")).join(family_members(h.draws.sparkSession, h.k, h.d).select("rank"), "rank", "left_anti")
    rows = rows.join(F.broadcast(at), (total(F.col("sorted")) > F.col("least")) & (total(F.col("sorted")) < F.col("most")))
    rows = rows.where(passes(F.col("sorted"), F.col("limits"), h.k, h.d))
    return rows.join(h.draws.select("game", rank_of(F.col("sorted"), h.d).alias("rank")).distinct(), ["game", "rank"], "left_anti").select("game", "mode", "sorted")


def closed_sizes(k: int, d: int) -> dict[str, int]:
    """The sizes of the families that are measured but never cut, by arithmetic."""
    upto = range(1, k + 1)
    of = lambda sizes: sum(comb(m, d) for m in sizes)
    out = {"evenSpaced": sum(k - step * (d - 1) for step in range(1, (k - 1) // (d - 1) + 1)), "wideGaps": comb(max(0, k - (d - 1) * (WIDE_GAP - 1)), d), "allPrime": of([sum(n in PRIMES for n in upto)]), "triangular": of([sum(8 * n + 1 == round((8 * n + 1) ** 0.5) ** 2 for n in upto)])}
    out["slipColumn"] = of(sum(min(SLIP_COLUMNS - 1, (n - 1) // SLIP) == c for n in upto) for c in range(SLIP_COLUMNS))
    out["column7"] = of(sum((n - 1) % 7 == c for n in upto) for c in range(7))
    out["mirrorPool"] = comb(k // 2, d // 2) if d % 2 == 0 or k % 2 else 0
    last = [(1, 0), (0, 1)]  # the r-th number of a row of sums, as parts of the first two
    while len(last) < d:
        last.append((last[-1][0] + last[-2][0], last[-1][1] + last[-2][1]))
    a, b = last[d - 1]
    out["fibLike"] = sum(max(0, (k - a * x) // b - x) for x in upto)
    return out


def presets(h: History) -> DataFrame:
    """game, preset, combinations, share, expected, observed: every shape that a sorted sheet of draws suggests: its exact size, what chance expects of so many draws, and how many had it: low, high and tight draws, sums beyond the record, all families, outside the bands of places, within a month, and drawn before."""
    spark, k, d = h.draws.sparkSession, h.k, h.d
    everything = float(comb(k, d))
    sizes = family_members(spark, k, d).where("family <> 'low'").groupBy("family").agg(F.count(F.lit(1)).alias("combinations"))
    sizes = sizes.unionByName(spark.createDataFrame(list(closed_sizes(k, d).items()), "family string, combinations long"))
    each = F.array(*[F.struct(F.lit(n).alias("family"), F.sum(c.cast("long")).alias("observed")) for n, c in families(F.col("sorted"), k, d).items()])
    seen = h.draws.groupBy("game").agg(each.alias("x")).select("game", F.inline("x"))
    rows = seen.join(F.broadcast(sizes), "family").select("game", F.col("family").alias("preset"), "combinations", "observed")
    table = sum_distribution(spark, k, d)  # d * k rows
    record = h.draws.groupBy("game").agg(F.min(total(F.col("sorted"))).alias("least"), F.max(total(F.col("sorted"))).alias("most"))
    beyond = record.join(F.broadcast(table), F.lit(True)).groupBy("game").agg(F.sum(F.when(F.col("total") < F.col("least"), F.col("combinations")).otherwise(0)).alias("sumLow"), F.sum(F.when(F.col("total") > F.col("most"), F.col("combinations")).otherwise(0)).alias("sumHigh"))
    rows = rows.unionByName(beyond.select("game", F.inline(F.array(*[F.struct(F.lit(n).alias("preset"), F.col(n).alias("combinations")) for n in ("sumLow", "sumHigh")])), F.lit(0).cast("long").alias("observed")).where("combinations > 0"))
    at = constraints.position_bands(h).groupBy("game").agg(F.array_sort(F.collect_list(F.struct("position", "lo", "hi"))).alias("x"))
    bands_ = spark.createDataFrame([(r.game, comb(k, d) - band_count(k, d, [(p.lo, p.hi) for p in r.x]), [p.lo for p in r.x], [p.hi for p in r.x]) for r in at.collect()], "game string, combinations long, lo array<int>, hi array<int>")  # d bands a game
    out_of = ~F.forall(F.arrays_zip("sorted", "lo", "hi"), lambda p: p["sorted"].between(p["lo"], p["hi"]))
    rows = rows.unionByName(h.draws.join(F.broadcast(bands_), "game").groupBy("game", "combinations").agg(F.sum(out_of.cast("long")).alias("observed")).select("game", F.lit("posBands").alias("preset"), "combinations", "observed"))
    rows = rows.join(h.sizes, "game").select("game", "preset", "combinations", (F.col("combinations") / everything).alias("share"), (F.col("combinations") * F.col("draws") / everything).alias("expected"), "observed")
    drawn = h.draws.groupBy("game", "sorted").agg(F.count(F.lit(1)).alias("times")).groupBy("game").agg(F.count(F.lit(1)).alias("combinations"), F.sum("times").alias("n"), F.sum(F.col("times") - 1).alias("observed"))
    again = drawn.select("game", F.lit("pastWinner").alias("preset"), "combinations", (F.col("combinations") / everything).alias("share"), (F.col("n") * (F.col("n") - 1) / 2 / everything).alias("expected"), "observed")
    return preset_counts(h).unionByName(rows).unionByName(again)
