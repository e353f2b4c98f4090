"""Jackpots, prizes and tickets."""

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlens.history import BLOCK, History, gapless

# The lower prizes of a 5 + 1 game: main matches, with the bonus number, dollars.
TIERS = [(5, False, 1_000_000.0), (4, True, 50_000.0), (4, False, 100.0), (3, True, 100.0), (3, False, 7.0), (2, True, 7.0), (1, True, 4.0), (0, True, 4.0)]


def upper_median(values: Column) -> Column:
    """Of an array of numbers the value at half its size, from 0, in ascending order; null of an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def jackpots(h: History) -> DataFrame:
    """game, known, latest, biggest, biggest_t (the first), winners, rollover (draws since the last winner; 0 if there never was one), sales_corr."""
    rows = h.draws.join(h.sizes, "game")
    j = F.col("jackpot")
    both = j.isNotNull() & F.col("sales").isNotNull() if "sales" in h.draws.columns else F.lit(False)
    corr = F.when(F.sum(both.cast("int")) >= 8, F.corr(F.when(both, j), F.when(both, F.col("sales")))) if "sales" in h.draws.columns else F.lit(None).cast("double")
    last_win = F.max(F.when(F.col("winner_location").isNotNull(), F.col("t")))
    return rows.groupBy("game").agg(
        F.count(j).alias("known"), F.max_by("jackpot", F.when(j.isNotNull(), F.col("t"))).alias("latest"), F.max(j).alias("biggest"), F.min_by("t", F.struct(-j, F.col("t"))).alias("biggest_t"), F.count("winner_location").alias("winners"),
        F.coalesce(F.max("draws") - 1 - last_win, F.lit(0)).alias("rollover"), corr.alias("sales_corr"),
    )


def winners(h: History, most: int = 10) -> DataFrame:
    """game, place, t, jackpot, winner_location: the last draws that were won."""
    place = F.row_number().over(Window.partitionBy("game").orderBy(F.col("t").desc()))
    return h.draws.where(F.col("winner_location").isNotNull()).withColumn("place", place).where(F.col("place") <= most).select("game", "place", "t", "jackpot", "winner_location")


def thirds(h: History, buckets: int = 1024) -> DataFrame:
    """game, low_mean, high_mean, welch_t: ball values of the draws with the lowest and the highest third of jackpots; null below 30 jackpots. A jackpot's place is a count of buckets between the least and the most, then of its own bucket, so no game is sorted in one task."""
    rows = h.draws.where(F.col("jackpot").isNotNull()).select("game", "t", "jackpot", "sorted")
    ends = rows.groupBy("game").agg(F.min("jackpot").alias("least"), F.max("jackpot").alias("most"), F.count(F.lit(1)).alias("m"))
    at = F.floor((F.col("jackpot") - F.col("least")) / F.greatest(F.lit(1e-9), F.col("most") - F.col("least")) * buckets)
    rows = rows.join(ends, "game").withColumn("b", at)
    before = Window.partitionBy("game").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    starts = rows.groupBy("game", "b").agg(F.count(F.lit(1)).alias("c")).select("game", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("game", "b").orderBy("jackpot", "t"))).join(starts, ["game", "b"]).withColumn("i", F.col("start") + F.col("r") - 1).withColumn("third", F.floor(F.col("m") / 3))
    balls = rows.withColumn("part", F.when(F.col("i") < F.col("third"), "low").when(F.col("i") >= F.col("m") - F.col("third"), "high")).where(F.col("part").isNotNull() & (F.col("m") >= 30)).select("game", "part", F.explode("sorted").alias("v"))
    of = lambda f, p: f(F.when(F.col("part") == p, F.col("v")))
    a = balls.groupBy("game").agg(of(F.avg, "low").alias("low_mean"), of(F.avg, "high").alias("high_mean"), of(F.var_samp, "low").alias("vl"), of(F.var_samp, "high").alias("vh"), of(F.count, "low").alias("nl"), of(F.count, "high").alias("nh"))
    return a.select("game", "low_mean", "high_mean", ((F.col("high_mean") - F.col("low_mean")) / F.sqrt(F.greatest(F.lit(1e-12), F.col("vl") / F.col("nl") + F.col("vh") / F.col("nh")))).alias("welch_t"))


def latest(rows: DataFrame, most: int) -> DataFrame:
    """rows (game, t): the `most` latest of each game, first of each block of t, then of all."""
    back = lambda *by: F.row_number().over(Window.partitionBy("game", *by).orderBy(F.col("t").desc()))
    rows = rows.withColumn("_b", F.floor(F.col("t") / BLOCK))
    few = rows.withColumn("_r", back("_b")).where(F.col("_r") <= most)
    # Blocks are gone through from the last one on until `most` rows are there.
    later = few.groupBy("game", "_b").agg(F.count(F.lit(1)).alias("_c"))
    after = F.coalesce(F.sum("_c").over(Window.partitionBy("game").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = later.withColumn("_a", after).where(F.col("_a") < most).select("game", "_b", "_a")
    return few.join(need, ["game", "_b"]).where(F.col("_a") + F.col("_r") <= most).drop("_b", "_r", "_a")


def projection(h: History) -> DataFrame:
    """game, basis, projected: the next jackpot. After a win the upper median of the last 20 first jackpots after wins; else the last one, and for each draw since it, the upper median of the
    last 30 steps upward between draws without a win. The jackpot before a draw comes by an equi-join on gapless places."""
    rows = gapless(h.draws.where(F.col("jackpot").isNotNull()).select("game", "t", "jackpot", F.col("winner_location").isNotNull().alias("won")))
    prior = rows.select("game", (F.col("i") + 1).alias("i"), F.col("jackpot").alias("before"), F.col("won").alias("before_won"))
    rows = rows.join(prior, ["game", "i"], "left")
    resets = latest(rows.where("before_won").select("game", "t", "jackpot"), 20).groupBy("game").agg(F.collect_list("jackpot").alias("resets"))
    steps = latest(rows.where("not before_won and jackpot > before").select("game", "t", (F.col("jackpot") - F.col("before")).alias("step")), 30).groupBy("game").agg(F.collect_list("step").alias("steps"))
    facts = rows.groupBy("game").agg(F.count(F.lit(1)).alias("known"), F.max_by("jackpot", "t").alias("last"), F.max_by("won", "t").alias("last_won"), F.max("t").alias("last_t"))
    facts = facts.join(h.sizes, "game").where("known >= 4").join(resets, "game", "left").join(steps, "game", "left")
    gap = F.col("draws") - F.col("last_t")
    rolled = F.col("last") + gap * upper_median(F.col("steps"))
    return facts.select("game", F.when(F.col("last_won"), "reset").otherwise("roll").alias("basis"), F.when(F.col("last_won"), upper_median(F.col("resets"))).otherwise(rolled).alias("projected"))


def tier_chances(k: int, d: int, ks: int, tiers: list[tuple] = TIERS) -> list[tuple[int, bool, float, float]]:
    """match, with_bonus, prize and chance of each tier."""
    out = []
    for match, bonus, prize in tiers:
        p = comb(d, match) * comb(k - d, d - match) / comb(k, d) if match <= d else 0.0
        out.append((match, bonus, prize, p * ((1 / ks) if bonus else (1 - 1 / ks)) if ks else p))
    return out


def ticket_value(df: DataFrame, jackpot: str, sold: str, k: int, d: int, ks: int, price: float = 2.0, tiers: list[tuple] = TIERS) -> DataFrame:
    """df with lower_value (fixed prizes), split (the chance that another ticket wins too), share (of the jackpot that a winner keeps, on average) and value (expected, less the price)."""
    lower = sum(prize * p for *_, prize, p in tier_chances(k, d, ks, tiers))
    p = 1 / (comb(k, d) * max(1, ks))
    x = F.col(sold) * p
    share = F.when(x > 0, (1 - F.exp(-x)) / F.when(x > 0, x)).otherwise(1.0)
    return df.withColumn("lower_value", F.lit(lower)).withColumn("split", 1 - F.exp(-x)).withColumn("share", share).withColumn("value", F.lit(lower) + F.col(jackpot) * p * F.col("share") - price)


def graded(tickets: DataFrame, h: History, tiers: list[tuple] = TIERS) -> DataFrame:
    """tickets (game, ticket, numbers, special, for_date, cost) with status, mains, special_hit, jackpot and prize, against the last draw of their date.

    settled: there is a draw of that date; pending: there is none; open: the ticket has no date, and is graded against the game's last draw. All mains win the jackpot if the bonus matches or the draw has none. A ticket without a bonus number
    that has all mains gets the tier of all mains.
    """
    drawn = h.draws.groupBy("game", "date").agg(F.max_by(F.struct("sorted", "special"), "t").alias("r")).select("game", F.col("date").alias("for_date"), "r.sorted", F.col("r.special").alias("drawn_special"))
    latest = h.draws.groupBy("game").agg(F.max_by(F.struct("sorted", "special"), "t").alias("l"))  # a row for each game
    rows = tickets.join(drawn, ["game", "for_date"], "left").join(latest, "game", "left")
    opened = F.col("for_date").isNull()
    rows = rows.withColumn("sorted", F.when(opened, F.col("l.sorted")).otherwise(F.col("sorted"))).withColumn("drawn_special", F.when(opened, F.col("l.special")).otherwise(F.col("drawn_special"))).drop("l")
    mains = F.size(F.array_intersect("numbers", "sorted"))
    hit = F.coalesce(F.col("special") == F.col("drawn_special"), F.lit(False))
    rows = rows.withColumn("status", F.when(opened, "open").when(F.col("sorted").isNull(), "pending").otherwise("settled"))
    rows = rows.withColumn("mains", F.when(F.col("sorted").isNotNull(), mains)).withColumn("special_hit", F.when(F.col("sorted").isNotNull(), hit))
    won = F.coalesce((F.col("mains") == h.d) & (F.col("drawn_special").isNull() | F.col("special_hit")), F.lit(False))
    prize = F.lit(0.0)
    for match, bonus, dollars in tiers:
        prize = F.when((F.col("mains") == match) & (F.col("special_hit") == bonus), dollars).otherwise(prize)
    return rows.withColumn("jackpot", won).withColumn("prize", F.when(F.col("sorted").isNotNull(), F.when(won, 0.0).otherwise(prize))).drop("sorted", "drawn_special")


def added(tickets: DataFrame, more: DataFrame) -> DataFrame:
    """tickets (game, ticket, numbers, special, for_date, cost) and those of `more` that aren't among them: a ticket is its game, numbers in any order, bonus number and date. Of equal new ones the smallest `ticket` stays."""
    key = F.concat_ws("|", "game", F.array_join(F.array_sort("numbers"), "-"), F.coalesce(F.col("special").cast("string"), F.lit("")), F.coalesce(F.col("for_date").cast("string"), F.lit("")))
    new = more.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("ticket"))).where("_r = 1").join(tickets.select(key.alias("_key")), "_key", "left_anti")
    return tickets.unionByName(new.select(*tickets.columns))


def without(draws: DataFrame, gone: DataFrame) -> DataFrame:
    """draws without those of a date and numbers (game, date, sorted) in `gone`; all equal rows go."""
    return draws.join(gone.select("game", "date", "sorted").distinct(), ["game", "date", "sorted"], "left_anti").select(*draws.columns)


def ledger(grades: DataFrame) -> DataFrame:
    """game, tickets, settled, pending, open, spent, won, net, best_mains, best_special: totals of graded tickets. A dated ticket is spent, drawn or not; open ones never touch money or the best result, which counts a bonus hit as half a number."""
    of = lambda s: F.sum((F.col("status") == s).cast("long"))
    done = F.col("status") == "settled"
    spent, won = F.sum(F.when(F.col("status") != "open", F.col("cost")).otherwise(0.0)), F.sum(F.when(done, F.col("prize")).otherwise(0.0))
    best = F.max(F.when(done, F.struct("mains", "special_hit")))
    rows = grades.groupBy("game").agg(F.count(F.lit(1)).alias("tickets"), of("settled").alias("settled"), of("pending").alias("pending"), of("open").alias("open"), spent.alias("spent"), won.alias("won"), (won - spent).alias("net"), best.alias("best"))
    return rows.select("game", "tickets", "settled", "pending", "open", "spent", "won", "net", F.col("best.mains").alias("best_mains"), F.col("best.special_hit").alias("best_special"))


def crowd_markers(numbers: Column, k: int, drawn: Column | None = None) -> Column:
    """Why many people may play an ascending combination: an array of months or calendar, run or step, fives, same_digit, and past_winner where `drawn` (it was drawn before) holds."""
    top = F.element_at(numbers, -1)
    steps = F.array_distinct(F.zip_with(F.slice(numbers, 2, 100), F.slice(numbers, F.lit(1), F.size(numbers) - 1), lambda a, b: a - b))
    even = F.size(steps) == 1
    marks = F.array(
        F.when(top <= 12, "months").when((top <= 31) & F.lit(k > 31), "calendar"),
        F.when(even & (F.get(steps, F.lit(0)) == 1), "run").when(even & (F.size(numbers) >= 3), "step"),
        F.when(F.forall(numbers, lambda x: x % 5 == 0), "fives"),
        F.when(F.size(F.array_distinct(F.transform(numbers, lambda x: x % 10))) == 1, "same_digit"),
        F.when(F.lit(False) if drawn is None else drawn, "past_winner"),
    )
    return F.array_compact(marks)
