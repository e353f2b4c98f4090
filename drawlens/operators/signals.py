"""Scores of every number for a target draw, from the draws before it alone."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.functions.odds import smoothed_rate
from drawlens.history import History
from drawlens.operators import describe

KEYS = ["freqAll", "freqDow", "dowRecent", "recencyFast", "recency", "recencySlow", "window10", "window20", "window50", "zone", "hot", "momentum", "overdue", "hazard", "cycle", "repeat", "follower", "followerDow", "similarity"]
HALF_LIVES = {"recencyFast": 8, "recency": 20, "recencySlow": 45}
BLOCK, CARRIED = 512, 8  # of EWMA sums: draws to a block, and blocks that are carried on


def next_draw(h: History) -> DataFrame:
    """game, t, date, dow of the draw to come: the first day of the schedule within 14 days after the last draw, else the day after it."""
    last = h.draws.groupBy("game").agg(F.max("t").alias("last_t"), F.max("date").alias("last_date"))
    days = describe.schedule(h).select("game", "dow")
    ahead = last.select("game", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("k"), "last_date").withColumn("dow", F.dayofweek(F.date_add("last_date", F.col("k"))) - 1)
    step = ahead.join(days, ["game", "dow"], "leftsemi").groupBy("game").agg(F.min("k").alias("k"))
    rows = last.join(step, "game", "left").withColumn("date", F.date_add("last_date", F.coalesce("k", F.lit(1))))
    return rows.select("game", (F.col("last_t") + 1).alias("t"), "date", (F.dayofweek("date") - 1).alias("dow"))


def _rows(h: History) -> DataFrame:
    """The grid with a row of unknown hits for each number of the next draw."""
    ahead = next_draw(h).select("game", "t", "dow", F.explode(F.sequence(F.lit(1), F.lit(h.k))).alias("n"), F.lit(None).cast("int").alias("hit"))
    return h.grid.unionByName(ahead)


def recency(h: History, half_life: float, targets: DataFrame, name: str) -> DataFrame:
    """game, t, n, `name`: for the targets (game, t) the exponentially weighted share of hits before each, x <- w x + (1 - w) hit from 0.

    Weights grow within blocks of draws and start anew in each, so nothing overflows; what earlier blocks leave is carried on. Hits and questions stand in one order, and a running
    sum answers every question.
    """
    w = 0.5 ** (1 / half_life)
    block, at = F.floor(F.col("t") / BLOCK), (F.col("t") % BLOCK).cast("double")
    first = targets.groupBy("game").agg((F.min(block) - CARRIED).alias("first"))  # no earlier block is carried on to a target
    hits = h.hits.join(F.broadcast(first), "game").where(block >= F.col("first")).select("game", "t", "n", block.alias("block"), F.lit(False).alias("asked"), F.pow(F.lit(w), -at).alias("x"))
    sums = hits.groupBy("game", "n", "block").agg((F.sum("x") * ((1 - w) * w ** (BLOCK - 1))).alias("s"))
    later = sums.select("game", "n", F.explode(F.sequence(F.lit(1), F.lit(CARRIED))).alias("k"), "block", "s")
    later = later.select("game", "n", (F.col("block") + F.col("k")).alias("block"), (F.col("s") * F.pow(F.lit(w), (BLOCK * (F.col("k") - 1)).cast("double"))).alias("s"))
    carried = later.groupBy("game", "n", "block").agg(F.sum("s").alias("carry"))
    asked = targets.select("game", "t", F.explode(F.sequence(F.lit(1), F.lit(h.k))).alias("n"), block.alias("block"), F.lit(True).alias("asked"), F.lit(0.0).alias("x"))
    inside = Window.partitionBy("game", "n", "block").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    rows = hits.unionByName(asked).withColumn("own", F.sum("x").over(inside)).where("asked").join(carried, ["game", "n", "block"], "left")
    value = F.coalesce("carry", F.lit(0.0)) * F.pow(F.lit(w), at) + F.coalesce("own", F.lit(0.0)) * (1 - w) * F.pow(F.lit(w), at - 1)
    return rows.select("game", "t", "n", value.alias(name))


def panel(h: History) -> DataFrame:
    """Every draw, and the next one, by every number: the counts before it that signals are made of."""
    rows = _rows(h)
    before = Window.partitionBy("game", "n").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    order, day = Window.partitionBy("game", "n").orderBy("t"), Window.partitionBy("game", "n", "dow").orderBy("t")
    one = F.col("hit") == 1
    rows = rows.withColumn("prev_hit", F.coalesce(F.lag("hit").over(order), F.lit(0)))
    rows = rows.withColumn("last_seen", F.max(F.when(one, F.col("t"))).over(before)).withColumn("gap", F.when(one, F.col("t") - F.col("last_seen")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    # The count of the last w is the running count less what it was w rows before: one running sum, whatever the widths.
    rows = rows.withColumn("c", zero(F.sum("hit").over(before))).withColumn("c_dow", zero(F.sum("hit").over(day.rowsBetween(Window.unboundedPreceding, -1))))
    last = lambda c, w, o: F.col(c) - F.lag(c, w, 0).over(o)
    return rows.select(
        "game", "t", "dow", "n", "hit", "prev_hit", "last_seen", "c", last("c", 10, order).alias("c10"), last("c", 20, order).alias("c20"), last("c", 50, order).alias("c50"),
        "c_dow", F.count("hit").over(day.rowsBetween(Window.unboundedPreceding, -1)).alias("n_dow"), last("c_dow", 8, day).alias("c_dow8"),
        F.count("gap").over(before).alias("gaps"), F.avg("gap").over(before).alias("gap_mean"), F.stddev_pop("gap").over(before).alias("gap_sd"),
        zero(F.sum((one & (F.col("prev_hit") == 1)).cast("int")).over(before)).alias("repeated"), zero(F.sum("prev_hit").over(before)).alias("repeat_chances"),
    )


def live_panel(h: History, targets: DataFrame, keys: list[str]) -> DataFrame:
    """panel()'s rows for the next draw alone (targets: game, t, dow), by aggregates over hits: no window goes along the whole history. What no key needs is null."""
    near = h.hits.withColumnRenamed("dow", "_dow").join(F.broadcast(targets.select("game", F.col("t").alias("aim"), "dow")), "game")
    late = lambda w: F.sum((F.col("t") >= F.col("aim") - w).cast("long")).alias(f"c{w}")
    rows = targets.select("game", "t", "dow", F.explode(F.sequence(F.lit(1), F.lit(h.k))).alias("n"), F.lit(None).cast("int").alias("hit"))
    counts = near.groupBy("game", "n").agg(F.max("t").alias("last_seen"), F.count(F.lit(1)).alias("c"), late(10), late(20), late(50), F.sum((F.col("_dow") == F.col("dow")).cast("long")).alias("c_dow"))
    rows = rows.join(counts, ["game", "n"], "left")
    own = h.draws.select("game", "t", "dow", "sorted").join(F.broadcast(targets.select("game", "dow")), ["game", "dow"])
    days = own.groupBy("game").agg(F.count(F.lit(1)).alias("n_dow"))
    by_block = own.groupBy("game", F.floor(F.col("t") / BLOCK).alias("b")).agg(F.count(F.lit(1)).alias("m"))  # the block that holds the eighth draw from the end
    since = by_block.withColumn("m", F.sum("m").over(Window.partitionBy("game").orderBy(F.col("b").desc()))).withColumn("enough", F.col("m") >= 8)
    since = since.groupBy("game").agg(F.coalesce(F.max(F.when(F.col("enough"), F.col("b"))), F.lit(0)).alias("b"))
    last = own.join(F.broadcast(since), "game").where(F.col("t") >= F.col("b") * BLOCK).withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.col("t").desc()))).where("r <= 8")
    rows = rows.join(days, "game", "left").join(last.select("game", F.explode("sorted").alias("n")).groupBy("game", "n").agg(F.count(F.lit(1)).alias("c_dow8")), ["game", "n"], "left")
    none = lambda t: F.lit(None).cast(t)
    if {"overdue", "cycle"} & set(keys):
        gaps = describe.gaps(h).select("game", "n", "gaps", F.when(F.col("gaps") > 0, F.col("mean_gap")).alias("gap_mean"), F.col("gap_sd"))
        rows = rows.join(gaps, ["game", "n"], "left")
    else:
        rows = rows.withColumns({"gaps": none("long"), "gap_mean": none("double"), "gap_sd": none("double")})
    before = h.draws.join(F.broadcast(targets.select("game", F.col("t").alias("aim"))), "game").where(F.col("t") == F.col("aim") - 1).select("game", F.explode("sorted").alias("n"), F.lit(1).alias("prev_hit"))
    rows = rows.join(before, ["game", "n"], "left").withColumn("prev_hit", F.coalesce("prev_hit", F.lit(0)))
    if "repeat" in keys:
        again = h.draws.select("game", "t", "sorted").join(h.previous, ["game", "t"]).select("game", F.explode(F.array_intersect("sorted", "prev")).alias("n")).groupBy("game", "n").agg(F.count(F.lit(1)).alias("repeated"))
        rows = rows.join(again, ["game", "n"], "left")
    else:
        rows = rows.withColumn("repeated", none("long"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("game", "t", "dow", "n", "hit", "prev_hit", "last_seen", *map(zero, ("c", "c10", "c20", "c50", "c_dow", "n_dow", "c_dow8", "gaps")), "gap_mean", "gap_sd", zero("repeated"), (F.coalesce("c", F.lit(0)) - F.col("prev_hit")).alias("repeat_chances"))


def _live_follower(h: History, targets: DataFrame, rates: DataFrame, strength: float, by_day: bool, name: str) -> DataFrame:
    """_follower() for the next draw alone: what came after the numbers of the last draw is counted, without a window."""
    day = ["dow"] if by_day else []
    last = h.draws.withColumnRenamed("dow", "_dow").join(F.broadcast(targets.select("game", F.col("t").alias("aim"), "dow")), "game").where(F.col("t") == F.col("aim") - 1).select("game", "dow", F.explode("sorted").alias("j"))
    rows = h.draws.select("game", "t", "dow", "sorted").join(h.previous, ["game", "t"]).select("game", "dow", "sorted", F.explode("prev").alias("j"))
    rows = rows.join(F.broadcast(last.select("game", *day, "j")), ["game", *day, "j"])
    chances = rows.groupBy("game", "j").agg(F.count(F.lit(1)).alias("chances"))
    followed = rows.select("game", "j", F.explode("sorted").alias("n")).groupBy("game", "j", "n").agg(F.count(F.lit(1)).alias("followed"))
    asked = last.select("game", "j").join(rates, "game").join(chances, ["game", "j"], "left").join(followed, ["game", "j", "n"], "left")
    return asked.groupBy("game", "t", "n").agg((F.sum((F.coalesce("followed", F.lit(0)) + strength * F.col("p20")) / (F.coalesce("chances", F.lit(0)) + strength)) / h.d).alias(name))


def _follower(h: History, targets: DataFrame, rates: DataFrame, strength: float, by_day: bool, name: str) -> DataFrame:
    """game, t, n, `name`: the mean, over the numbers j of the draw before, of how often n followed j until then, drawn towards n's rate.

    Occurrences and questions stand in one order for each pair (j, n), and a running count answers every question: nothing is joined by range.
    """
    day = ["dow"] if by_day else []
    happened = describe.successions(h).select("game", "t", *day, "j", F.col("i").alias("n"), F.lit(1).alias("w"), F.lit(False).alias("asked"))
    prev = h.draws.select("game", (F.col("t") + 1).alias("t"), F.explode("sorted").alias("j"))
    chances = h.draws.select("game", "t", *day).join(h.previous, ["game", "t"]).select("game", "t", *day, F.explode("prev").alias("j"), F.lit(1).alias("w"), F.lit(False).alias("asked"))
    asked = targets.join(prev, ["game", "t"]).select("game", "t", *day, "j", F.lit(0).alias("w"), F.lit(True).alias("asked"))
    order = lambda keys: Window.partitionBy("game", *keys, *day).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    total = chances.unionByName(asked).withColumn("chances", F.coalesce(F.sum("w").over(order(["j"])), F.lit(0))).where("asked").select("game", "t", "j", "chances")
    wide = asked.select("game", "t", *day, "j", F.explode(F.sequence(F.lit(1), F.lit(h.k))).alias("n"), "w", "asked")
    rows = happened.unionByName(wide).withColumn("followed", F.coalesce(F.sum("w").over(order(["j", "n"])), F.lit(0))).where("asked")
    rows = rows.join(total, ["game", "t", "j"]).join(rates, ["game", "t", "n"])
    return rows.groupBy("game", "t", "n").agg((F.sum((F.col("followed") + strength * F.col("p20")) / (F.col("chances") + strength)) / h.d).alias(name))


def similar(h: History, targets: DataFrame, back: int = 1500, most: int = 25) -> DataFrame:
    """game, t, u, similarity, place: for each target the earlier draws in the most similar circumstances (numbers and sum of the draw before, weekday). Ties to the older draw."""
    first = targets.groupBy("game").agg(((F.floor(F.min("t") / back) - 1) * back).alias("first"))  # no earlier draw is asked for
    draws = h.draws.select("game", "t", "dow", "sorted").join(F.broadcast(first), "game").where(F.col("t") >= F.col("first") - 1).drop("first")
    prev = draws.select("game", (F.col("t") + 1).alias("t"), F.col("sorted").alias("prev"), F.aggregate("sorted", F.lit(0), lambda a, x: a + x).alias("s"))
    past = draws.select("game", "t", "dow").join(prev, ["game", "t"]).select("game", F.col("t").alias("u"), F.col("dow").alias("udow"), F.col("prev").alias("uprev"), F.col("s").alias("us"), F.floor(F.col("t") / back).alias("span"))
    asked = targets.where("t >= 8").select("game", "t", "dow").join(prev, ["game", "t"]).withColumn("span", F.explode(F.array(F.floor(F.col("t") / back), F.floor(F.col("t") / back) - 1)))
    near = asked.join(past, ["game", "span"]).where((F.col("u") < F.col("t")) & (F.col("u") >= F.greatest(F.lit(1), F.col("t") - back)))
    sim = 0.55 * F.size(F.array_intersect("prev", "uprev")) / h.d + F.when(F.col("dow") == F.col("udow"), 0.2).otherwise(0.0) + 0.25 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("s") - F.col("us")) / 50)
    near = near.select("game", "t", "u", F.round(sim, 9).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("game", "t").orderBy(F.col("similarity").desc(), "u"))
    return near.withColumn("place", place).where(F.col("place") <= most)


def raw(h: History, targets: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """game, t, dow, n, hit and a column for each of keys (of KEYS; all, if not given), for the targets (game, t, dow; the next draw, if not given). What no key needs isn't computed."""
    keys, live = keys or KEYS, targets is None
    share = h.d / h.k
    targets = cut(next_draw(h).select("game", "t", "dow") if live else targets)
    rows = cut(live_panel(h, targets, keys) if live else panel(h).join(targets.select("game", "t"), ["game", "t"], "leftsemi"))  # parts below read these rows again
    t, c = F.col("t"), F.col("c")
    p20, p10 = smoothed_rate(c, t, share, 20), smoothed_rate(c, t, share, 10)
    w10, w20, w50 = (F.least(t, F.lit(w)) for w in (10, 20, 50))
    since = F.coalesce(t - F.col("last_seen"), t)
    mean = F.coalesce("gap_mean", F.lit(1 / share))
    sd = F.greatest(F.lit(1.0), F.when(F.col("gaps") >= 2, F.col("gap_sd")).otherwise(mean))
    in_prev = F.col("prev_hit") == 1
    first = F.array_contains("first_draw", F.col("n")).cast("int")
    rows = rows.join(h.draws.where("t = 0").select("game", F.col("sorted").alias("first_draw")), "game")
    fresh_chances = F.greatest(F.lit(0), t - 1 - F.col("repeat_chances"))
    z = (since - mean) / sd
    ratio = lambda a, b: a / F.greatest(F.lit(1), b)
    rows = rows.select(
        "game", "t", "dow", "n", "hit", "c", since.alias("since"), p20.alias("p20"),
        p20.alias("freqAll"),
        ((F.col("c_dow") + 15 * p20) / (F.col("n_dow") + 15)).alias("freqDow"),
        F.when(F.col("n_dow") > 0, ratio(F.col("c_dow8"), F.least(F.col("n_dow"), F.lit(8)))).otherwise(0.0).alias("dowRecent"),
        ratio(F.col("c10"), w10).alias("window10"), ratio(F.col("c20"), w20).alias("window20"), ratio(F.col("c50"), w50).alias("window50"),
        ((F.col("c20") - w20 * p10) / F.sqrt(F.greatest(F.lit(1e-9), w20 * p10 * (1 - p10)))).alias("hot"),
        F.when((w10 >= 5) & (w50 >= 20), (ratio(F.col("c10"), w10) - ratio(F.col("c50"), w50)) / F.sqrt(F.greatest(F.lit(1e-9), p10 * (1 - p10) / F.greatest(F.lit(1), w10)))).otherwise(0.0).alias("momentum"),
        F.least(F.lit(3.0), since / F.greatest(F.lit(1.0), mean)).alias("overdue"),
        F.when(F.col("gaps") < 4, 0.0).otherwise(F.exp(-z * z / 2) * mean / (sd + mean)).alias("cycle"),
        F.when(t < 2, p20).when(in_prev, (F.col("repeated") + 25 * p20) / (F.col("repeat_chances") + 25)).otherwise((c - F.col("repeated") - first + 25 * p20) / (fresh_chances + 25)).alias("repeat"),
    )
    if "zone" in keys:  # neighbours within 5, weighted by a bell of width 2
        bell = [(d, 2.718281828459045 ** (-((d / 2) ** 2) / 2)) for d in range(-5, 6)]
        near = rows.select("game", "t", F.col("n").alias("m"), "c", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(g).alias("g")) for d, g in bell])).alias("b"))
        near = near.select("game", "t", (F.col("m") + F.col("b.d")).alias("n"), (F.col("c") * F.col("b.g")).alias("x"), F.col("b.g").alias("g"))
        rows = rows.join(near.groupBy("game", "t", "n").agg((F.sum("x") / F.sum("g")).alias("zone")), ["game", "t", "n"])
    if "hazard" in keys and live:
        both = describe.hazard(h).select("game", F.col("gap").alias("g"), ((F.col("hits") + 40 * share) / (F.col("exposures") + 40)).alias("hazard"))
        rows = rows.withColumn("g", F.least("since", F.lit(199))).join(both, ["game", "g"], "left").withColumn("hazard", F.coalesce("hazard", F.lit(share))).drop("g")
    elif "hazard" in keys:  # hits and exposures by draws since seen, over all numbers and earlier draws
        seen = F.max(F.when(F.col("hit") == 1, F.col("t"))).over(Window.partitionBy("game", "n").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
        exposed = h.grid.withColumn("g", F.least(F.coalesce(F.col("t") - seen, F.col("t")), F.lit(199))).groupBy("game", "t", "g").agg(F.count(F.lit(1)).alias("e"), F.sum("hit").alias("x"))
        asked = rows.select("game", "t", F.least("since", F.lit(199)).alias("g")).distinct().withColumn("e", F.lit(0)).withColumn("x", F.lit(0)).withColumn("asked", F.lit(True))
        run = Window.partitionBy("game", "g").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
        both = exposed.withColumn("asked", F.lit(False)).unionByName(asked)
        both = both.withColumn("hazard", (F.coalesce(F.sum("x").over(run), F.lit(0)) + 40 * share) / (F.coalesce(F.sum("e").over(run), F.lit(0)) + 40)).where("asked").select("game", "t", "g", "hazard")
        rows = rows.withColumn("g", F.least("since", F.lit(199))).join(both, ["game", "t", "g"]).drop("g")
    aims = targets.select("game", "t", "dow")
    rates = rows.select("game", "t", "n", "p20")
    for name, half in HALF_LIVES.items():
        if name in keys:
            rows = rows.join(recency(h, half, aims, name), ["game", "t", "n"])
    for name, strength, by_day in (("follower", 12, False), ("followerDow", 20, True)):
        if name in keys:
            rows = rows.join((_live_follower if live else _follower)(h, aims, rates, strength, by_day, name), ["game", "t", "n"], "left")
    if "similarity" in keys:
        alike = cut(similar(h, aims))
        close = alike.join(h.hits.select("game", F.col("t").alias("u"), "n"), ["game", "u"])
        weight = close.groupBy("game", "t", "n").agg(F.sum("similarity").alias("x"))
        whole = alike.groupBy("game", "t").agg(F.sum("similarity").alias("y"))
        rows = rows.join(weight, ["game", "t", "n"], "left").join(whole, ["game", "t"], "left").withColumn("similarity", F.coalesce(F.try_divide("x", "y"), F.lit(0.0))).drop("x", "y")
    return rows.select("game", "t", "dow", "n", "hit", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in keys])


def _before(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums down the rows, each without its own row, on top of start."""
    return start + np.cumsum(x, axis=0) - x


class Past:
    """What the draws before leave for the signals of the next ones. signals() goes along the draws, some at a time, and says what raw() says by tables."""

    def __init__(self, k: int, d: int, back: int = 1500, most: int = 25) -> None:
        self.k, self.d, self.back, self.most = k, d, back, most
        zero = lambda *shape: np.zeros(shape)
        self.count, self.by_day, self.days, self.first = zero(k), zero(7, k), zero(7), zero(k)
        self.after, self.after_day, self.met, self.met_day = zero(k, k), zero(7, k, k), zero(k), zero(7, k)
        self.hot, self.dow = zero(0, k), np.zeros(0, np.int64)  # the last back + 1 draws
        self.last8 = zero(7, 8, k)
        self.seen, self.gaps, self.gap1, self.gap2, self.repeated, self.chances = np.full(k, -1.0), zero(k), zero(k), zero(k), zero(k), zero(k)
        self.exposed, self.struck = zero(200), zero(200)
        self.moving = {name: zero(k) for name in HALF_LIVES}
        # Similarity by shared numbers, same weekday and distance of sums: whole parts of 1e9, as raw() rounds to nine digits.
        parts = [[[0.55 * o / d + 0.2 * same + 0.25 * max(0.0, 1 - gap / 50) for gap in range(51)] for same in (0, 1)] for o in range(d + 1)]
        self.alike = np.array([int(Decimal(repr(x)).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP)) for a in parts for b in a for x in b], dtype=np.int64)
        n = np.arange(1, k + 1)
        near = np.abs(n[:, None] - n)
        self.bell = np.where(near <= 5, 2.718281828459045 ** (-((near / 2) ** 2) / 2), 0.0)

    def _follower(self, after: np.ndarray, met: np.ndarray, prev: np.ndarray, hit: np.ndarray, drawn: np.ndarray, p20: np.ndarray, strength: float, out: np.ndarray, rows: np.ndarray) -> None:
        """Adds to out, for the rows, what followed each number of the draw before until then; leaves the counts (after, met) after them."""
        for j in np.flatnonzero(prev[rows].any(axis=0)):
            at = rows[prev[rows, j] > 0]
            run = np.cumsum(hit[at], axis=0)
            out[at] += (after[j] + run - hit[at] + strength * p20[at]) / (met[j] + np.arange(len(at))[:, None] + strength)
            after[j] += run[-1]
            met[j] += drawn[at].sum()

    def _similarity(self, t: np.ndarray, dow: np.ndarray, hot: np.ndarray, days: np.ndarray) -> np.ndarray:
        """The share of each number in the draws most like each draw's circumstances. hot, days: the draws kept and these."""
        out = np.zeros((len(t), self.k))
        begin = t[0] - (len(hot) - len(t))  # the place of the first draw kept
        sums, flat = hot @ np.arange(1, self.k + 1), hot.astype(np.float32)
        for a in range(0, len(t), 256):
            at = t[a : a + 256]
            u = np.arange(max(1, begin + 1, at[0] - self.back), at[-1])
            if not len(u) or at[-1] < 8:
                continue
            q, i = at - 1 - begin, u - 1 - begin
            shared = (flat[np.maximum(q, 0)] @ flat[i].T).astype(np.int64)
            gap = np.minimum(50, np.abs(sums[np.maximum(q, 0)][:, None] - sums[i])).astype(np.int64)
            value = self.alike[(shared * 2 + (dow[a : a + 256, None] == days[i + 1])) * 51 + gap]
            ok = (u < at[:, None]) & (u >= np.maximum(1, at - self.back)[:, None]) & (at >= 8)[:, None]
            order = np.where(ok, value * 4096 + (4095 - np.arange(len(u))), -1)  # ties to the older draw
            some = min(self.most, len(u))
            best = np.argpartition(-order, some - 1, axis=1)[:, :some]
            weight = np.where(np.take_along_axis(ok, best, axis=1), np.take_along_axis(value, best, axis=1) / 1e9, 0.0)
            whole = weight.sum(axis=1, keepdims=True)
            each = np.einsum("rm,rmk->rk", weight, hot[u[best] - begin])
            out[a : a + 256] = np.where(whole > 0, each / np.where(whole > 0, whole, 1), 0.0)
        return out

    def signals(self, t: np.ndarray, dow: np.ndarray, hit: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """KEYS by number before each of some draws that follow those before (t gapless; hit: draws by numbers, 0 or 1; a draw to come, drawn false, is the last)."""
        k, share, m = self.k, self.d / self.k, len(t)
        at = t[:, None].astype(float)
        if t[0] == 0:
            self.first = hit[0].copy()
        kept = np.vstack([self.hot, hit])
        prev = np.vstack([self.hot[-1:] if len(self.hot) else np.zeros((1, k)), hit[:-1]])
        c = _before(hit, self.count)
        ext = np.vstack([np.zeros((1 + max(0, 50 - len(self.hot)), k)), self.hot[-50:], hit])
        run = np.cumsum(ext, axis=0)
        late = {w: run[50 : 50 + m] - run[50 - w : 50 - w + m] for w in (10, 20, 50)}
        width = {w: np.minimum(at, w) for w in (10, 20, 50)}
        p20, p10 = (c + 20 * share) / (at + 20), (c + 10 * share) / (at + 10)
        c_dow, c_dow8, n_dow = np.zeros((m, k)), np.zeros((m, k)), np.zeros((m, 1))
        follower, follower_day = np.zeros((m, k)), np.zeros((m, k))
        self._follower(self.after, self.met, prev, hit, drawn, p20, 12, follower, np.arange(m))
        for day in np.unique(dow):
            rows = np.flatnonzero(dow == day)
            ran = np.cumsum(np.vstack([np.zeros((1, k)), self.last8[day], hit[rows]]), axis=0)
            c_dow[rows], c_dow8[rows] = _before(hit[rows], self.by_day[day]), ran[8 : 8 + len(rows)] - ran[: len(rows)]
            n_dow[rows, 0] = self.days[day] + np.arange(len(rows))
            self._follower(self.after_day[day], self.met_day[day], prev, hit, drawn, p20, 20, follower_day, rows)
            real = rows[drawn[rows]]
            self.last8[day] = np.vstack([self.last8[day], hit[real]])[-8:]
            self.by_day[day] += hit[rows].sum(axis=0)
            self.days[day] += len(real)
        upto = np.maximum(np.maximum.accumulate(np.where(hit > 0, at, -1.0), axis=0), self.seen)
        seen = np.vstack([self.seen, upto[:-1]])
        since = np.where(seen >= 0, at - seen, at)
        gap = np.where((hit > 0) & (seen >= 0), at - seen, 0.0)
        gaps, gap1, gap2 = _before((gap > 0).astype(float), self.gaps), _before(gap, self.gap1), _before(gap * gap, self.gap2)
        mean = np.where(gaps > 0, gap1 / np.maximum(gaps, 1), 1 / share)
        sd = np.maximum(1.0, np.where(gaps >= 2, np.sqrt(np.maximum(0.0, gaps * gap2 - gap1 * gap1)) / np.maximum(gaps, 1), mean))
        repeated, chances = _before(hit * prev, self.repeated), _before(prev * drawn[:, None], self.chances)
        fresh = np.maximum(0.0, at - 1 - chances)
        g = np.minimum(since, 199).astype(np.int64)
        cell = (np.arange(m)[:, None] * 200 + g).ravel()
        exposed = np.bincount(cell, weights=np.repeat(drawn.astype(float), k), minlength=m * 200).reshape(m, 200)
        struck = np.bincount(cell, weights=hit.ravel(), minlength=m * 200).reshape(m, 200)
        hazard = (_before(struck, self.struck) + 40 * share) / (_before(exposed, self.exposed) + 40)
        moving, i = {}, np.arange(m)[:, None]
        for name, half in HALF_LIVES.items():
            w = 0.5 ** (1 / half)
            sums = _before(hit * w ** -i.astype(float), np.zeros(k))
            moving[name] = self.moving[name] * w**i + (1 - w) * w ** (i - 1.0) * sums
            self.moving[name] = moving[name][-1] * w + (1 - w) * hit[-1]
        z = (since - mean) / sd
        ten, fifty = late[10] / np.maximum(1, width[10]), late[50] / np.maximum(1, width[50])
        out = {
            "freqAll": p20, "freqDow": (c_dow + 15 * p20) / (n_dow + 15), "dowRecent": np.where(n_dow > 0, c_dow8 / np.maximum(1, np.minimum(n_dow, 8)), 0.0), **moving, "window10": ten, "window20": late[20] / np.maximum(1, width[20]), "window50": fifty,
            "zone": c @ self.bell / self.bell.sum(axis=0), "hot": (late[20] - width[20] * p10) / np.sqrt(np.maximum(1e-9, width[20] * p10 * (1 - p10))),
            "momentum": np.where((width[10] >= 5) & (width[50] >= 20), (ten - fifty) / np.sqrt(np.maximum(1e-9, p10 * (1 - p10) / np.maximum(1, width[10]))), 0.0),
            "overdue": np.minimum(3.0, since / np.maximum(1.0, mean)), "hazard": np.take_along_axis(hazard, g, axis=1), "cycle": np.where(gaps < 4, 0.0, np.exp(-z * z / 2) * mean / (sd + mean)),
            "repeat": np.where(at < 2, p20, np.where(prev > 0, (repeated + 25 * p20) / (chances + 25), (c - repeated - self.first + 25 * p20) / (fresh + 25))),
            "follower": follower / self.d, "followerDow": follower_day / self.d, "similarity": self._similarity(t, dow, kept, np.concatenate([self.dow, dow])),
        }
        self.count, self.seen = self.count + hit.sum(axis=0), upto[-1]
        self.gaps, self.gap1, self.gap2 = self.gaps + (gap > 0).sum(axis=0), self.gap1 + gap.sum(axis=0), self.gap2 + (gap * gap).sum(axis=0)
        self.repeated, self.chances = self.repeated + (hit * prev).sum(axis=0), self.chances + (prev * drawn[:, None]).sum(axis=0)
        self.exposed, self.struck = self.exposed + exposed.sum(axis=0), self.struck + struck.sum(axis=0)
        self.hot, self.dow = kept[-self.back - 1 :], np.concatenate([self.dow, dow])[-self.back - 1 :]
        return np.stack([out[key] for key in KEYS], axis=2)


def normalised(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """rows with every signal as its distance from its target's mean, in population deviations; 0 where it doesn't vary."""
    own = Window.partitionBy("game", "t")
    keys = keys or KEYS

    def z(k: str) -> Column:
        sd = F.stddev_pop(k).over(own)
        return F.when(sd > 1e-12, (F.col(k) - F.avg(k).over(own)) / F.when(sd > 1e-12, sd)).otherwise(0.0)

    return rows.select(*[z(c).alias(c) if c in keys else F.col(c) for c in rows.columns])


def long(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """game, t, n, hit, key, value."""
    keys = keys or KEYS
    return rows.select("game", "t", "n", "hit", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("s")).select("game", "t", "n", "hit", "s.key", "s.value")
