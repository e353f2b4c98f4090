"""Reports on one number, one ticket, slices of the record, the replay of the pool and the points of an evaluation."""

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlens.functions.shapes import bins, features, total
from drawlens.history import BLOCK, History
from drawlens.operators.combinations import chosen
from drawlens.operators.constraints import long, measured
from drawlens.operators.describe import pair_counts, transitions
from drawlens.operators import positions
from drawlens.operators.money import crowd_markers, latest, upper_median
from drawlens.operators.signals import next_draw, similar

CALENDAR = 31  # fixed value: the largest day of a month


def companions(h: History, most: int = 5) -> DataFrame:
    """game, n, kind (partner: in the same draw; follower: in the next one), place, other, times: each number's most frequent ones, ties to the smaller."""
    pairs = pair_counts(h)
    sides = [pairs.select("game", F.col(x).alias("n"), F.col(y).alias("other"), F.col("together").alias("times")) for x, y in ("ab", "ba")]
    partners = sides[0].unionByName(sides[1]).withColumn("kind", F.lit("partner"))
    followers = transitions(h).select("game", F.col("j").alias("n"), F.col("i").alias("other"), F.col("followed").alias("times"), F.lit("follower").alias("kind"))
    place = F.row_number().over(Window.partitionBy("game", "n", "kind").orderBy(F.col("times").desc(), "other"))
    return partners.unionByName(followers).withColumn("place", place).where(F.col("place") <= most).select("game", "n", "kind", "place", "other", "times")


def calendar_rate(h: History) -> DataFrame:
    """game, seen, draws, expected: how many draws lie within the days of a month, and the chance of that at one draw."""
    within = (F.element_at("sorted", -1) <= CALENDAR).cast("long")
    return h.draws.groupBy("game").agg(F.sum(within).alias("seen"), F.count(F.lit(1)).alias("draws"), F.lit(comb(CALENDAR, h.d) / comb(h.k, h.d)).alias("expected"))


def typical_sales(h: History, last: int = 40, least: int = 3) -> DataFrame:
    """game, sales: the upper median of the sales of the last `last` draws, over those that have any; null below `least` of them."""
    recent = h.draws.join(h.sizes, "game").where(F.col("t") >= F.col("draws") - last)
    known = recent.groupBy("game").agg(F.collect_list(F.when(F.col("sales") > 0, F.col("sales"))).alias("x"))  # `last` values at most
    return known.select("game", F.when(F.size("x") >= least, upper_median(F.col("x"))).alias("sales"))


def slice_floors(h: History) -> DataFrame:
    """game, slice, groups, chances, broke, rate, pooled_rate, rejected: how often a draw's total goes under the least total before it in its group, for slices by bonus number, first
    decade, odd count and weekday.

    rejected: 100 chances and 2 groups at least, and more than 1.5 times the rate of one floor for all draws: such floors are only the lowest of small samples. Draws without a bonus
    number have no group by it. The least before a draw is that of earlier blocks of draws and that of its own block until then, so no group is sorted in one task.
    """
    keys = {
        "pooled": F.lit(0), "bonus": F.col("special"), "decade": F.floor((F.element_at("sorted", 1) - 1) / 10).cast("int"),
        "odd": F.size(F.filter("sorted", lambda x: x % 2 == 1)), "weekday": F.col("dow"),
    }
    each = F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("int").alias("part")) for n, c in keys.items()])
    rows = h.draws.select("game", "t", total(F.col("sorted")).alias("v"), F.floor(F.col("t") / BLOCK).alias("block"), F.inline(each)).where("part is not null")
    by = ["game", "slice", "part"]
    least = rows.groupBy(*by, "block").agg(F.min("v").alias("least"))
    earlier = least.select(*by, "block", F.min("least").over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("lo0"))
    lo = F.min("v").over(Window.partitionBy(*by, "block").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("lo", lo).join(earlier, [*by, "block"]).withColumn("before", F.least("lo", "lo0"))
    groups = rows.groupBy(*by).agg(F.count("before").alias("chances"), F.sum((F.coalesce(F.col("v") < F.col("before"), F.lit(False))).cast("long")).alias("broke"))
    table = groups.groupBy("game", "slice").agg(F.count(F.lit(1)).alias("groups"), F.sum("chances").alias("chances"), F.sum("broke").alias("broke"))
    rate = F.when(F.col("chances") > 0, F.col("broke") / F.col("chances")).otherwise(0.0)
    table = table.withColumn("rate", rate)
    pooled = table.where("slice = 'pooled'").select("game", F.col("rate").alias("pooled_rate"))
    rejected = (F.col("chances") >= 100) & (F.col("groups") >= 2) & (F.col("rate") > 1.5 * F.col("pooled_rate"))
    return table.where("slice <> 'pooled'").join(pooled, "game").select("game", "slice", "groups", "chances", "broke", "rate", "pooled_rate", rejected.alias("rejected"))


def replay_reasons(replay: DataFrame) -> DataFrame:
    """game, place, cut_by, draws, judged, held, held_rate: of constraints.cut_by()'s verdicts, why draws were cut, most frequent first, ties by name; a game that lost no draw has one row without a reason."""
    whole = replay.groupBy("game").agg(F.count(F.lit(1)).alias("judged"), F.sum(F.col("kept").cast("long")).alias("held"))
    why = replay.where("not kept").groupBy("game", "cut_by").agg(F.count(F.lit(1)).alias("draws"))
    rows = whole.join(why, "game", "left").withColumn("draws", F.coalesce("draws", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("game").orderBy(F.col("draws").desc(), "cut_by"))
    return rows.select("game", place.alias("place"), "cut_by", "draws", "judged", "held", (F.col("held") / F.col("judged")).alias("held_rate"))


def point_summary(points: DataFrame, recent: int = 100) -> DataFrame:
    """game, points, best, times, last_t, late10, late_baseline, recent10: of learn.backtest()'s points the most hits of the ten, how often (0 if none ever hit) and when last; the mean hits of
    the later half, of the baseline there, and of the last `recent` points."""
    # A place is a running count over blocks of t, then within each, so no game is sorted in one task.
    rows = points.withColumn("block", F.floor(F.col("t") / BLOCK))
    before = Window.partitionBy("game").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("game", "block").agg(F.count(F.lit(1)).alias("m")).select("game", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("game", "block").orderBy("t")) - 1
    rows = rows.withColumn("within", within).join(starts, ["game", "block"]).withColumn("i", F.col("start") + F.col("within"))
    facts = points.groupBy("game").agg(F.count(F.lit(1)).alias("points"), F.max("hits10").alias("best"))
    rows = rows.join(facts, "game")
    late, top = F.col("i") >= F.floor(F.col("points") / 2), (F.col("hits10") == F.col("best")) & (F.col("best") > 0)
    return rows.groupBy("game", "points", "best").agg(
        F.sum(top.cast("long")).alias("times"), F.max(F.when(top, F.col("t"))).alias("last_t"), F.avg(F.when(late, F.col("hits10"))).alias("late10"),
        F.avg(F.when(late, F.col("baseline10"))).alias("late_baseline"), F.avg(F.when(F.col("i") >= F.col("points") - recent, F.col("hits10"))).alias("recent10"),
    )


def standing(h: History, prior: float = 1.0) -> DataFrame:
    """game, feature, value, observations, least, most, times, p, percentile: the last draw's features among those of all draws.

    times: draws with that value, rounded; p: its share, with `prior` spread over all bins that the feature has; percentile: the share of draws below. A game has as many rows
    here as its features have values.
    """
    values = long(measured(h, context=False)).withColumn("bin", F.floor(F.col("v") + 0.5).cast("int"))
    last = h.draws.groupBy("game").agg(F.max_by(F.struct("t", "dow", "sorted"), "t").alias("x")).select("game", "x.t", "x.dow", "x.sorted")
    own = last.select("game", "t", "dow", *[c.alias(n) for n, c in features(F.col("sorted"), h.k, h.d).items()])
    own = long(own).select("game", "feature", F.floor(F.col("v") + 0.5).cast("int").alias("value"))
    counts = values.groupBy("game", "feature", "bin").agg(F.count(F.lit(1)).alias("c"))
    rows = counts.join(own, ["game", "feature"])
    sizes = F.create_map(*[F.lit(x) for n, room in bins(h.k, h.d).items() for x in (n, room)])
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("c"))), F.lit(0))
    out = rows.groupBy("game", "feature", "value").agg(F.sum("c").alias("observations"), F.min("bin").alias("least"), F.max("bin").alias("most"), of(F.col("bin") == F.col("value")).alias("times"), of(F.col("bin") < F.col("value")).alias("below"))
    p = (F.col("times") + prior / F.element_at(sizes, F.col("feature"))) / (F.col("observations") + prior)
    return out.select("game", "feature", "value", "observations", "least", "most", "times", p.alias("p"), (F.col("below") / F.col("observations")).alias("percentile"))


def ticket_lab(tickets: DataFrame, h: History) -> DataFrame:
    """tickets (game, ticket, numbers, special) with total, total_below (the share of draws with a smaller total), odd_share (with as many odd numbers), pair_total (how often its pairs came),
    best_overlap, best_t (the first three draws with that overlap), three_up (draws with three numbers at least) and special_count (null without a bonus number).

    Tickets never meet draws pair by pair: they join counts of totals, odd counts, bonus numbers and shared subsets. Summed over a ticket's subsets of size j, the draws that hold each are the sum
    of C(m, j) over draws that share m numbers, which gives the draws that share exactly m, from the largest down. Tickets with the same numbers are worked out once.
    """
    odd_of = F.size(F.filter("sorted", lambda x: x % 2 == 1))
    sets = tickets.select("game", F.array_sort("numbers").alias("sorted")).distinct()
    part = F.array_join("part", "-").alias("part")
    drawn = reduce(DataFrame.unionByName, [chosen(h.draws.select("game", "t", "sorted"), "sorted", j).select("game", "t", part, F.lit(j).alias("j")) for j in range(1, h.d + 1)])
    mine = reduce(DataFrame.unionByName, [chosen(sets, "sorted", j).select("game", "sorted", part, F.lit(j).alias("j")) for j in range(1, h.d + 1)])
    met = drawn.join(mine.select("game", "part").distinct(), ["game", "part"], "left_semi")  # only the tickets' subsets are grouped
    counts = met.groupBy("game", "part").agg(F.count(F.lit(1)).alias("c"))
    sums = mine.join(counts, ["game", "part"]).groupBy("game", "sorted").agg(*[F.coalesce(F.sum(F.when(F.col("j") == j, F.col("c"))), F.lit(0)).alias(f"s{j}") for j in range(1, h.d + 1)])
    exact: dict[int, Column] = {}
    for m in range(h.d, 0, -1):
        exact[m] = reduce(lambda a, b: a - b, [comb(j, m) * exact[j] for j in exact], F.col(f"s{m}"))
    best = F.coalesce(*[F.when(exact[m] > 0, F.lit(m)) for m in range(h.d, 0, -1)], F.lit(0))
    three = reduce(lambda a, b: a + b, [exact[m] for m in range(3, h.d + 1)], F.lit(0))
    overlap = sets.join(sums, ["game", "sorted"], "left").fillna(0, [f"s{j}" for j in range(1, h.d + 1)])
    overlap = overlap.select("game", "sorted", best.alias("best_overlap"), three.cast("long").alias("three_up"), (F.col("s2") if h.d > 1 else F.lit(0)).cast("long").alias("pair_total"))
    # The first three draws with the most overlap: of each of its subsets of that size the first three, then of those. Any three draws share none.
    wanted = mine.join(overlap.select("game", "sorted", F.col("best_overlap").alias("j")), ["game", "sorted", "j"])
    early = met.join(wanted.select("game", "part").distinct(), ["game", "part"], "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("game", "part").orderBy("t"))).where("r <= 3")
    first = wanted.join(early, ["game", "part"]).groupBy("game", "sorted").agg(F.slice(F.array_sort(F.collect_set("t")), 1, 3).alias("best_t"))
    none = h.draws.where("t < 3").groupBy("game").agg(F.array_sort(F.collect_list("t")).alias("start"))
    n = h.sizes
    totals = h.draws.groupBy("game", total(F.col("sorted")).alias("total")).agg(F.count(F.lit(1)).alias("c"))  # d * k values at most
    asked = sets.select("game", total(F.col("sorted")).alias("total")).distinct()
    run = Window.partitionBy("game").orderBy("total").rangeBetween(Window.unboundedPreceding, -1)
    below = asked.join(totals, ["game", "total"], "full").withColumn("below", F.coalesce(F.sum("c").over(run), F.lit(0))).select("game", "total", "below")
    odd = h.draws.groupBy("game", odd_of.alias("odd")).agg(F.count(F.lit(1)).alias("same_odd"))
    rows = sets.withColumn("total", total(F.col("sorted"))).withColumn("odd", odd_of).join(n, "game").join(overlap, ["game", "sorted"]).join(below, ["game", "total"]).join(odd, ["game", "odd"], "left").join(first, ["game", "sorted"], "left").join(none, "game", "left")
    rows = rows.select("game", "sorted", "total", (F.col("below") / F.col("draws")).alias("total_below"), (F.coalesce("same_odd", F.lit(0)) / F.col("draws")).alias("odd_share"), "pair_total", "best_overlap", F.coalesce("best_t", "start").alias("best_t"), "three_up")
    bonus = h.draws.where("special is not null").groupBy("game", "special").agg(F.count(F.lit(1)).alias("_c"))
    out = tickets.withColumn("sorted", F.array_sort("numbers")).join(rows, ["game", "sorted"], "left").join(bonus, ["game", "special"], "left")
    return out.withColumn("special_count", F.when(F.col("special").isNotNull(), F.coalesce("_c", F.lit(0)))).drop("sorted", "_c")


def ticket_numbers(tickets: DataFrame, h: History, scores: DataFrame) -> DataFrame:
    """game, ticket, position, n, rank, below, log_likelihood, typical: each number of each ticket: its rank by scores (game, n, score; ties to the smaller), and how it stands among the numbers that had its place: the share of draws below, the log chance of the value (each value seen once more), and whether it lies
    within the 10 % and 90 % values. Tickets meet counts of values by place, not draws."""
    ranks = scores.select("game", "n", F.row_number().over(Window.partitionBy("game").orderBy(F.col("score").desc(), "n")).alias("rank"))
    values = positions.counts(h)
    own = Window.partitionBy("game", "position")
    run = F.coalesce(F.sum("hits").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = h.numbers.select("game", F.explode(F.sequence(F.lit(1), F.lit(h.d))).alias("position"), F.col("n").alias("v")).join(values, ["game", "position", "v"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    every = every.withColumn("under", run).withColumn("draws", F.sum("hits").over(own)).join(positions.statistics(h).select("game", "position", "p10", "p90"), ["game", "position"])
    table = every.select("game", "position", F.col("v").alias("n"), (F.col("under") / F.col("draws")).alias("below"), F.log((F.col("hits") + 1) / (F.col("draws") + h.k)).alias("log_likelihood"), F.col("v").between(F.col("p10"), F.col("p90")).alias("typical"))
    rows = tickets.select("game", "ticket", F.posexplode(F.array_sort("numbers")).alias("position", "n")).withColumn("position", F.col("position") + 1)
    return rows.join(table, ["game", "position", "n"], "left").join(ranks, ["game", "n"], "left").select("game", "ticket", "position", "n", F.coalesce("rank", F.lit(h.k)).alias("rank"), "below", "log_likelihood", "typical")


def ticket_crowd(tickets: DataFrame, h: History) -> DataFrame:
    """game, ticket, markers: why many people may hold each ticket (money.crowd_markers()), past winners included."""
    drawn = h.draws.select("game", F.array_join("sorted", "-").alias("key")).distinct().withColumn("drawn", F.lit(True))
    rows = tickets.withColumn("s", F.array_sort("numbers")).withColumn("key", F.array_join("s", "-")).join(drawn, ["game", "key"], "left")
    return rows.select("game", "ticket", F.array_join(crowd_markers(F.col("s"), h.k, F.coalesce("drawn", F.lit(False))), ",").alias("markers"))


def jackpot_series(h: History, last: int = 120) -> DataFrame:
    """game, t, date, jackpot, won of the last draws that have a jackpot."""
    return latest(h.draws.where(F.col("jackpot").isNotNull()).select("game", "t", "date", "jackpot", F.col("winner_location").isNotNull().alias("won")), last)


def similar_outcomes(h: History, scores: DataFrame, most: int = 6, top: int = 10) -> DataFrame:
    """game, place, u, similarity, outcome, shared: what was drawn in the situations most like the one before the draw to come, and which of it is among the `top` best numbers of scores (game, n, score)."""
    best = scores.withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.col("score").desc(), "n"))).where(F.col("r") <= top).groupBy("game").agg(F.collect_list("n").alias("best"))
    alike = similar(h, next_draw(h)).where(F.col("place") <= most)
    rows = alike.join(h.draws.select("game", F.col("t").alias("u"), F.col("sorted").alias("outcome")), ["game", "u"]).join(best, "game")
    return rows.select("game", "place", "u", "similarity", "outcome", F.array_sort(F.array_intersect("outcome", "best")).alias("shared"))
