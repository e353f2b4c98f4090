"""Shape rules: bands that draws keep to, learned from the draws before each."""


from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.functions.odds import choose, order_statistic, wilson
from drawlens.functions.shapes import bounds, conditional, count_where, families, features, total
from drawlens.history import BLOCK, History, blocked
from drawlens.operators import bands, eras

ALPHAS = [0.0005, 0.002, 0.01, 0.03]  # fixed values: the tails of the bands
TAILS = [round(a * bands.UNIT) for a in ALPHAS]
WARM_UP, LEAST_STEPS = 120, 40
WORD = 60  # combinations to a word of bits


def with_context(h: History) -> DataFrame:
    """draws with prev (the numbers of the draw before), last3 and last10 (the distinct numbers of so many before)."""
    rows = blocked(h.draws.select("game", "t", "dow", "sorted"), 10)
    by = Window.partitionBy("game", "block").orderBy("t")
    union = lambda w: F.array_distinct(F.flatten(F.collect_list("sorted").over(by.rowsBetween(-w, -1))))
    return rows.withColumn("prev", F.lag("sorted").over(by)).withColumn("last3", union(3)).withColumn("last10", union(10)).where(~F.col("edge")).drop("block", "edge")


def measured(h: History, context: bool = True) -> DataFrame:
    """game, t, dow and one column for each feature of the draw; with context also size3 and size10, how many numbers the draws before had."""
    own = features(F.col("sorted"), h.k, h.d)
    if not context:
        return h.draws.select("game", "t", "dow", *[c.alias(n) for n, c in own.items()])
    more = conditional(F.col("sorted"), F.col("prev"), F.col("last3"), F.col("last10"))
    return with_context(h).select("game", "t", "dow", *[c.alias(n) for n, c in (own | more).items()], F.size("last3").alias("size3"), F.size("last10").alias("size10"))


def long(rows: DataFrame) -> DataFrame:
    """game, t, dow, feature, v (double), for the features that aren't null."""
    names = [c for c in rows.columns if c not in ("game", "t", "dow", "size3", "size10")]
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names])
    return rows.select("game", "t", "dow", F.explode(each).alias("x")).select("game", "t", "dow", "x.feature", "x.v").where(F.col("v").isNotNull())


def steps(h: History, context: bool = True) -> DataFrame:
    """What each rule was before each draw from the warm-up on, and before the draw to come: bands.chunks() with the tails of ALPHAS, a row for each feature and block of draws. Computed once; by_rule() has a row for each rule and draw."""
    rows = measured(h, context)
    if context:  # how many numbers the draws before had, for shares()
        rows = rows.withColumns({"_dSum": F.col("sum") - F.col("dSum"), "_dSpread": F.col("spread") - F.col("dSpread"), "_dOdd": F.col("odd") - F.col("dOdd"), "_repeatPrev": F.lit(h.d), "_overlap3": F.col("size3"), "_overlap10": F.col("size10")})
    return cut(bands.chunks(cut(rows.drop("size3", "size10")), h.k, h.d, TAILS, least=WARM_UP))


def rules_of(tested: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """steps() with a row for each feature, block and alpha, lo and hi its band; of the rules of chosen (game, feature, alpha and other columns; a few rows), if given, with its columns."""
    each = F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, a in enumerate(ALPHAS)])
    out = tested.select("game", "feature", "t0", "dow", "v", "by", F.inline(each))
    return out if chosen is None else out.join(F.broadcast(chosen), ["game", "feature", "alpha"])


def by_rule(tested: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """game, feature, alpha, t, dow, v, by, lo, hi, held, and what else chosen has: steps(), one row for each rule (of chosen, if given) and draw."""
    more = [c for c in chosen.columns if c not in ("game", "feature", "alpha")] if chosen is not None else []
    rows = bands.draws_of(rules_of(tested, chosen), "alpha", *more)
    return rows.select("game", "feature", "alpha", "t", "dow", "v", "by", "lo", "hi", bands.held(F.col("v"), F.col("lo"), F.col("hi")).alias("held"), *more)


def lengths(tested: DataFrame) -> DataFrame:
    """game, draws: of steps(), a row for each game; the draw to come is the last."""
    return tested.groupBy("game").agg(F.max(F.col("t0") + F.size("v") - 1).alias("draws"))


def sample_universe(spark, k: int, d: int, n: int = 8000, seed: int = 1) -> DataFrame:
    """id, sorted: n combinations, each the d numbers of 1..k with the least md5 of seed, id and number: any row can be made anywhere, alone."""
    digest = lambda v: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), v.cast("string")).cast("binary"))
    keys = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda v: F.struct(digest(v).alias("h"), v.cast("int").alias("v")))
    return spark.range(n).select("id", F.array_sort(F.transform(F.slice(F.array_sort(keys), 1, d), lambda x: x["v"])).alias("sorted"))


def space_histogram(universe: DataFrame, k: int, d: int) -> DataFrame:
    """feature, bin, combinations: of a universe of combinations (all of them, or a sample)."""
    cols = features(F.col("sorted"), k, d)
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.floor(c.cast("double") + 0.5).cast("int").alias("bin")) for n, c in cols.items()])
    return universe.select(F.explode(each).alias("x")).groupBy("x.feature", "x.bin").agg(F.count(F.lit(1)).alias("combinations"))


def shares(h: History, tested: DataFrame, universe: DataFrame) -> DataFrame:
    """game, feature, alpha, share: how much of the universe each rule admitted, on average over the draws that it was tested on, each with the band and the draws before it as they then were.

    tested: by_rule(), without the draw to come. Features of one combination are counted in the universe; changes from the draw before are those of the combination, moved by what it started from (by); numbers shared with earlier draws follow the
    hypergeometric law of how many different numbers those had (by). Draws that ask the same are counted first, so what is looked up are bands, not draws.
    """
    space = cut(space_histogram(universe, h.k, h.d))
    everything = universe.count()
    moved = {"dSum": "sum", "dSpread": "spread", "dOdd": "odd"}
    common = ["repeatPrev", "overlap3", "overlap10"]
    key = ["game", "feature", "alpha"]
    times = cut(tested.groupBy(*key, "lo", "hi", "by").agg(F.count(F.lit(1)).alias("times")))
    names = F.create_map(*[F.lit(x) for pair in moved.items() for x in pair])
    asked = times.where(~F.col("feature").isin(common)).withColumn("shift", F.coalesce("by", F.lit(0))).select(*key, F.coalesce(F.try_element_at(names, F.col("feature")), "feature").alias("as"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"), "times")
    asked = asked.groupBy(*key, "as", "lo", "hi").agg(F.sum("times").alias("times"))
    places = asked.select("as", "lo", "hi").distinct()
    inside = places.join(F.broadcast(space.withColumnRenamed("feature", "as")), "as").where(F.col("bin").between(F.col("lo"), F.col("hi"))).groupBy("as", "lo", "hi").agg(F.sum("combinations").alias("c"))
    counted = asked.join(inside, ["as", "lo", "hi"], "left").select(*key, "times", (F.coalesce("c", F.lit(0)) / everything).alias("share"))
    met = times.where(F.col("feature").isin(common)).withColumnRenamed("by", "m")
    law = lambda o: choose(F.col("m"), o) * choose(h.k - F.col("m"), h.d - o) / float(comb(h.k, h.d))
    chance = reduce(lambda a, b: a + b, [F.when(F.lit(o).between(F.col("lo"), F.col("hi")), law(o)).otherwise(0.0) for o in range(h.d + 1)])
    shared = met.select(*key, "times", chance.alias("share"))
    return counted.unionByName(shared).groupBy(*key).agg((F.sum(F.col("times") * F.col("share")) / F.sum("times")).alias("share"))


def rules(h: History, universe: DataFrame | None = None, tested: DataFrame | None = None) -> DataFrame:
    """One row for each feature and alpha, for games of 160 draws at least: place (usable ones first, then by edge_z), lo and hi (the band from all draws), observed_min, observed_max, steps, survival with its Wilson interval, the survival of the last 50, 100
    and 250 draws and of the first half, stability (second half less first), share, edge_z, theory (the chance of the band, for places), tier, usable, proven.

    tier: typical if the band has all that the feature can be, or removes less than 0.1 % of the universe; ultra_rare if it leaves less than 2 %; historically_rare if survival is 2 errors above the share; else unsupported.
    Usable rules need no earlier draw and are not typical. `tested` is steps(), if it is at hand.
    """
    universe = cut(sample_universe(h.draws.sparkSession, h.k, h.d)) if universe is None else universe
    tested = steps(h) if tested is None else tested
    tails = F.array(*[F.struct(F.lit(a).alias("alpha"), F.element_at(f"lo{i}", -1).cast("int").alias("lo"), F.element_at(f"hi{i}", -1).cast("int").alias("hi")) for i, a in enumerate(ALPHAS)])
    final = tested.where(F.element_at("v", -1).isNull()).select("game", "feature", (F.col("t0") + F.size("v") - 1).alias("draws"), F.inline(tails)).select("game", "feature", "alpha", "lo", "hi", "draws")  # the bands before the draw to come
    final = cut(final.where(F.col("draws") >= WARM_UP + LEAST_STEPS))
    rows = by_rule(tested).where("v is not null")
    ok, back = F.col("held").cast("double"), F.col("draws") - F.col("t")
    late = lambda w: (F.sum(F.when(back <= w, ok).otherwise(0.0)) / F.least(F.lit(float(w)), F.count(F.lit(1)))).alias(f"recent_{w}")
    first = F.col("t") - WARM_UP < (F.col("draws") - WARM_UP) / 2
    stats = rows.join(F.broadcast(final.select("game", "draws").distinct()), "game").groupBy("game", "feature", "alpha").agg(
        F.count(F.lit(1)).alias("steps"), F.sum(F.col("held").cast("long")).alias("kept"), late(50), late(100), late(250), F.avg(F.when(first, ok)).alias("first_half"), F.coalesce(F.avg(F.when(~first, ok)), F.lit(0.0)).alias("second_half"),
    )
    values = measured(h)
    ends = F.array(*[F.struct(F.lit(n).alias("feature"), F.floor(F.min(n) + 0.5).cast("int").alias("observed_min"), F.floor(F.max(n) + 0.5).cast("int").alias("observed_max")) for n in bounds(h.k, h.d)])
    seen = values.groupBy("game").agg(ends.alias("x")).select("game", F.inline("x"))
    law = h.draws.sparkSession.createDataFrame([(f"pos{r}", v, order_statistic(h.k, h.d, r, v)) for r in range(1, h.d + 1) for v in range(1, h.k + 1)], "feature string, value int, p double")  # d * k rows
    theory = final.join(F.broadcast(law), "feature").where(F.col("value").between(F.col("lo"), F.col("hi"))).groupBy("game", "feature", "alpha").agg(F.sum("p").alias("theory"))
    key = ["game", "feature", "alpha"]
    out = final.join(stats, key).join(shares(h, rows, universe), key).join(seen, ["game", "feature"]).join(theory, key, "left")
    out = out.withColumn("survival", F.col("kept") / F.col("steps")).withColumn("w", wilson(F.col("kept"), F.col("steps")))
    out = out.withColumn("edge_z", (F.col("survival") - F.col("share")) / F.sqrt(F.greatest(F.lit(1e-12), F.col("share") * (1 - F.col("share")) / F.col("steps"))))
    limits = bounds(h.k, h.d)
    end = lambda i: F.element_at(F.create_map(*[F.lit(x) for f, b in limits.items() for x in (f, b[i])]), F.col("feature"))
    everything = (F.col("lo") <= end(0)) & (F.col("hi") >= end(1))
    typical = everything | (1 - F.col("share") < 0.001)
    out = out.withColumn("proven", F.col("edge_z") >= 2).withColumn("usable", ~typical & ~F.col("feature").isin(bands.CONDITIONAL))
    tier = F.when(typical, "typical").when(F.col("share") < 0.02, "ultra_rare").when(F.col("proven"), "historically_rare").otherwise("unsupported")
    place = F.row_number().over(Window.partitionBy("game").orderBy(F.col("usable").desc(), F.round("edge_z", 9).desc(), "feature", "alpha"))
    stability = F.col("second_half") - F.col("first_half")
    return out.withColumn("tier", tier).withColumn("place", place).select(
        "game", "place", "feature", "alpha", "lo", "hi", "observed_min", "observed_max", "steps", "survival", F.col("w.low").alias("low"), F.col("w.high").alias("high"), "recent_50", "recent_100", "recent_250", "first_half", stability.alias("stability"), "share", "edge_z", "theory", "tier", "usable", "proven",
    )


def rule_slices(h: History, tested: DataFrame | None = None) -> DataFrame:
    """game, feature, alpha, slice, part, draws, survival: each rule's survival by weekday (0 is Sunday) and, where the numbers show a change of the game's rules, in the eras before and after it."""
    rows = by_rule(steps(h) if tested is None else tested).where("v is not null")
    rows = rows.join(F.broadcast(eras.detect(h).select("game", "cutoff")), "game", "left")
    era = F.when(F.col("t") < F.col("cutoff"), "earlier").when(F.col("cutoff").isNotNull(), "current")
    rows = rows.groupBy("game", "feature", "alpha", "dow", era.alias("era")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("held").cast("long")).alias("k"))
    parts = F.array(F.struct(F.lit("weekday").alias("slice"), F.col("dow").cast("string").alias("part")), F.struct(F.lit("era").alias("slice"), F.col("era").alias("part")))
    rows = rows.select("game", "feature", "alpha", "c", "k", F.inline(parts)).where("part is not null")
    return rows.groupBy("game", "feature", "alpha", "slice", "part").agg(F.sum("c").alias("draws"), (F.sum("k") / F.sum("c")).alias("survival"))


def position_bands(h: History) -> DataFrame:
    """game, position, lo, hi, p25, median, p75: the band of each place from all draws at the tail of 0.2 %, and its quartiles by the same law."""
    names = [f"pos{r}" for r in range(1, h.d + 1)]
    values = long(measured(h, context=False)).where(F.col("feature").isin(names))
    rows = bands.whole(values, h.k, h.d, {"wide": TAILS[1], "mid": bands.UNIT // 4, "half": bands.UNIT // 2})
    return rows.select("game", F.substring("feature", 4, 9).cast("int").alias("position"), F.col("wide_lo").alias("lo"), F.col("wide_hi").alias("hi"), F.col("mid_lo").alias("p25"), F.col("half_lo").alias("median"), F.col("mid_hi").alias("p75"))


def prefix_shares(chosen: DataFrame, tested: DataFrame, universe: DataFrame, h: History, budget: int = 3000, least: int = 450) -> DataFrame:
    """game, mode, half (first, second), place, share, steps: of rules applied in order (game, mode, place, feature, alpha) what is left of the universe after each, with the bands as they stood at each draw, on average over draws.

    Draws are taken at a stride, as bands hardly move between neighbours: 450 of them, or `budget` over the number of rules, if that is less. The universe is packed into words of bits, one set of words for each different band; a running AND over the
    rules of a draw gives all prefixes at once.
    """
    sizes = chosen.groupBy("game", "mode").agg(F.max("place").alias("depth")).join(lengths(tested), "game").select("game", "mode", (F.col("draws") - WARM_UP).alias("all"), "depth")
    rows = by_rule(tested, cut(chosen.select("game", "feature", "alpha", "mode", "place").join(sizes, ["game", "mode"]))).where("v is not null")
    stride = F.greatest(F.lit(1), F.floor(F.col("all") / least + 0.5), F.floor(F.col("all") * F.col("depth") / budget + 0.5))
    step, half = F.col("t") - WARM_UP, F.floor(F.col("all") / 2)
    rows = rows.withColumn("half", F.when(step < half, "first").otherwise("second"))
    rows = rows.where((step - F.when(F.col("half") == "first", 0).otherwise(half)) % stride == 0)
    rows = cut(rows.select("game", "mode", "half", "place", "feature", "t", "lo", "hi"))
    cols = features(F.col("sorted"), h.k, h.d)
    each = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("v")) for n, c in cols.items()])
    values = universe.select("id", F.inline(each))
    bit = F.when(bands.held(F.col("v"), F.col("lo"), F.col("hi")), F.pow(F.lit(2.0), F.col("id") % WORD).cast("long")).otherwise(0)
    words = rows.select("feature", "lo", "hi").distinct().join(values, "feature").groupBy("feature", "lo", "hi", F.floor(F.col("id") / WORD).alias("word")).agg(F.sum(bit).alias("bits"))
    run = Window.partitionBy("game", "mode", "t", "word").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    left = rows.join(words, ["feature", "lo", "hi"]).withColumn("left", F.bit_count(F.bit_and("bits").over(run)))
    count = left.groupBy("game", "mode", "half", "place").agg(F.sum("left").alias("left"), F.countDistinct("t").alias("steps"))
    return count.select("game", "mode", "half", "place", (F.col("left") / F.col("steps") / universe.count()).alias("share"), "steps")


def kept_after(chosen: DataFrame, tested: DataFrame) -> DataFrame:
    """game, mode, t, out: for each draw and mode (game, mode, place, feature, alpha) the place of the first rule that the draw broke, null if it kept to all."""
    broken = by_rule(tested, chosen).where("v is not null").where(~F.col("held")).groupBy("game", "mode", "t").agg(F.min("place").alias("out"))
    every = bands.draws_of(tested.where("feature = 'pos1'").select("game", "feature", "t0", "dow", "v", "by")).where("v is not null").select("game", "t")
    return every.join(F.broadcast(chosen.select("game", "mode").distinct()), "game").join(broken, ["game", "mode", "t"], "left").select("game", "mode", "t", "out")


def frontier(h: History, universe: DataFrame | None = None, tested: DataFrame | None = None, all_rules: DataFrame | None = None, most: int = 12) -> DataFrame:
    """game, rules, share, survival, dominated: what is left of the universe, and of the draws, after the first 0 to `most` usable rules in order of share; dominated if another point leaves less of the universe and no fewer draws."""
    universe = cut(sample_universe(h.draws.sparkSession, h.k, h.d)) if universe is None else universe
    tested = steps(h) if tested is None else tested
    all_rules = rules(h, universe, tested) if all_rules is None else all_rules
    order = F.row_number().over(Window.partitionBy("game").orderBy(F.round("share", 9), "feature", "alpha"))
    chosen = cut(all_rules.where("usable").withColumn("place", order).where(F.col("place") <= most).select("game", F.lit(0.0).alias("mode"), "place", "feature", "alpha"))
    halves = prefix_shares(chosen, tested, universe, h)
    share = halves.groupBy("game", "place").agg((F.sum(F.col("share") * F.col("steps")) / F.sum("steps")).alias("share"))
    kept = kept_after(chosen, tested).groupBy("game", "out").agg(F.count(F.lit(1)).alias("c"))
    survival = share.join(kept, "game").groupBy("game", "place", "share").agg((F.sum(F.when(F.col("out").isNull() | (F.col("out") > F.col("place")), F.col("c")).otherwise(0)) / F.sum("c")).alias("survival"))
    points = survival.select("game", F.col("place").alias("rules"), "share", "survival").unionByName(share.select("game").distinct().select("game", F.lit(0).alias("rules"), F.lit(1.0).alias("share"), F.lit(1.0).alias("survival")))
    # Sorted by survival, a point is dominated if a point of no less survival has a smaller share.
    better = F.min("share").over(Window.partitionBy("game").orderBy(F.col("survival").desc()).rangeBetween(Window.unboundedPreceding, 0))
    return points.select("game", "rules", "share", "survival", (F.col("share") > better).alias("dominated"))


MODES = (0.99, 0.97, 0.94, 0.68)  # fixed values: the floors of survival


def modes(h: History, floors: tuple[float, ...] = MODES, candidates: int = 40, universe: DataFrame | None = None, tested: DataFrame | None = None, all_rules: DataFrame | None = None) -> DataFrame:
    """game, mode (its floor), place, feature, alpha, lo, hi, survival, share: for each floor of joint survival the rules that are taken, in order, each the one that removes most of the universe for the draws that it costs.

    Chosen on the first half of the draws, with the universe within the last bands. Candidates are the `candidates` usable rules of least share. Draws and combinations become bits, 60 to a word, in parallel; the choice itself is one task for each game, which holds one bit for each candidate and draw
    (5 MB for a million draws) and counts, a round for each rule that is taken, those that all of the chosen and a candidate leave.
    """
    universe = cut(sample_universe(h.draws.sparkSession, h.k, h.d)) if universe is None else universe
    tested = steps(h) if tested is None else tested
    all_rules = rules(h, universe, tested) if all_rules is None else all_rules
    order = F.row_number().over(Window.partitionBy("game").orderBy(F.round("share", 9), "feature", "alpha"))
    top = cut(all_rules.where("usable").withColumn("r", order).where(F.col("r") <= candidates).select("game", "feature", "alpha", "lo", "hi", "steps", "r"))
    past = by_rule(tested, top.select("game", "feature", "alpha", "steps", "r")).where("v is not null").withColumn("bit", F.col("t") - WARM_UP).where(F.col("bit") < F.floor(F.col("steps") / 2)).select("game", F.lit("past").alias("kind"), "r", "bit", "held")
    cols = features(F.col("sorted"), h.k, h.d)
    each = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("v")) for n, c in cols.items()])
    space = universe.select("id", F.inline(each)).join(F.broadcast(top), "feature").select("game", F.lit("space").alias("kind"), "r", F.col("id").alias("bit"), bands.held(F.col("v"), F.col("lo"), F.col("hi")).alias("held"))
    bits = past.unionByName(space).groupBy("game", "kind", "r", F.floor(F.col("bit") / WORD).alias("word")).agg(F.sum(F.when(F.col("held"), F.pow(F.lit(2.0), F.col("bit") % WORD).cast("long")).otherwise(0)).alias("w"), F.count(F.lit(1)).alias("n"))
    words = bits.groupBy("game", "kind", "r").agg(F.array_sort(F.collect_list(F.struct("word", "w"))).alias("x"), F.sum("n").alias("n")).select("game", "kind", "r", "n", F.transform("x", lambda x: x["w"]).alias("w"))
    rows = words.join(F.broadcast(top), ["game", "r"]).select("game", "kind", "r", "n", "w", "feature", "alpha", "lo", "hi")

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = {kind: some.sort_values("r") for kind, some in rows.groupby("kind")}
        names, out = kinds["space"].set_index("r"), []
        bits = {kind: np.array(some["w"].to_list(), dtype=np.int64) for kind, some in kinds.items()}  # a row of words for each rule, in order of r
        total = {kind: max(1, int(some["n"].iloc[0])) for kind, some in kinds.items()}
        order = kinds["space"]["r"].to_list()
        for floor in floors:
            survival, share, taken = 1.0, 1.0, []
            alive = {kind: np.full(x.shape[1], -1, np.int64) for kind, x in bits.items()}
            while True:
                best = None
                for i, r in enumerate(order):
                    if r in taken:
                        continue
                    left = {kind: int(np.bitwise_count(alive[kind] & x[i]).sum()) for kind, x in bits.items()}
                    keep, room = left.get("past", 0) / total.get("past", 1), left["space"] / total["space"]
                    if keep >= floor and share - room > 1e-6:
                        gain = Decimal(repr((share - room) / max(1e-4, survival - keep))).quantize(Decimal("1e-9"), ROUND_HALF_UP)
                        if best is None or gain > best[0]:
                            best = (gain, i, r, keep, room)
                if best is None:
                    break
                _, i, r, survival, share = best
                taken.append(r)
                alive = {kind: alive[kind] & x[i] for kind, x in bits.items()}
                out.append((rows["game"].iloc[0], floor, len(taken), names["feature"][r], names["alpha"][r], names["lo"][r], names["hi"][r], survival, share))
        return pd.DataFrame(out, columns=["game", "mode", "place", "feature", "alpha", "lo", "hi", "survival", "share"])

    return rows.groupBy("game").applyInPandas(chosen, "game string, mode double, place int, feature string, alpha double, lo int, hi int, survival double, share double")


def mode_report(h: History, mode: DataFrame, universe: DataFrame, tested: DataFrame) -> DataFrame:
    """game, mode, rules, survival (all draws), broken (draws that broke a rule), low (Wilson), share, combinations_after, edge_z (first half), holdout_survival, holdout_draws, holdout_edge_z: what modes() are worth, each survival against what its own rules then left of the universe."""
    chosen = cut(mode.select("game", "mode", "place", "feature", "alpha"))
    kept = kept_after(chosen, tested)
    sizes = kept.groupBy("game").agg((F.max("t") + 1 - WARM_UP).alias("n"))
    past = F.col("t") - WARM_UP < F.floor(F.col("n") / 2)
    ok = F.col("out").isNull().cast("double")
    facts = kept.join(sizes, "game").groupBy("game", "mode", "n").agg(F.avg(ok).alias("survival"), F.sum(F.col("out").isNull().cast("long")).alias("k"), F.avg(F.when(past, ok)).alias("first"), F.avg(F.when(~past, ok)).alias("holdout_survival"), F.sum((~past).cast("long")).alias("holdout_draws"), F.sum(past.cast("long")).alias("m"))
    depth = chosen.groupBy("game", "mode").agg(F.max("place").alias("rules"))
    halves = prefix_shares(chosen, tested, universe, h).join(depth, ["game", "mode"]).where("place = rules")
    share = halves.groupBy("game", "mode", "rules").agg(F.max(F.when(F.col("half") == "first", F.col("share"))).alias("a"), F.max(F.when(F.col("half") == "second", F.col("share"))).alias("b"), (F.sum(F.col("share") * F.col("steps")) / F.sum("steps")).alias("share"))
    z = lambda s, p, n: (s - p) / F.sqrt(F.greatest(F.lit(1e-12), p * (1 - p) / F.greatest(F.lit(1), n)))
    rows = facts.join(share, ["game", "mode"])
    return rows.select(
        "game", "mode", "rules", "survival", (F.col("n") - F.col("k")).alias("broken"), wilson(F.col("k"), F.col("n"))["low"].alias("low"), "share", F.round(F.col("share") * comb(h.k, h.d)).cast("long").alias("combinations_after"), z(F.col("first"), F.col("a"), F.col("m")).alias("edge_z"), "holdout_survival", "holdout_draws",
        z(F.col("holdout_survival"), F.col("b"), F.col("holdout_draws")).alias("holdout_edge_z"),
    )


def eliminated(h: History, mode: DataFrame, tested: DataFrame, most: int = 25) -> DataFrame:
    """game, mode, place, t, failed: the first `most` draws that broke a mode, and the rules (feature@alpha, in the mode's order) that they broke."""
    rows = by_rule(tested, mode.select("game", "mode", F.col("place").alias("p"), "feature", "alpha")).where("v is not null").where(~F.col("held"))
    draws = rows.groupBy("game", "mode", "t").agg(F.array_sort(F.collect_list(F.struct("p", F.concat_ws("@", "feature", F.col("alpha").cast("string")).alias("rule")))).alias("x"))
    place = F.row_number().over(Window.partitionBy("game", "mode").orderBy("t"))
    return draws.withColumn("place", place).where(F.col("place") <= most).select("game", "mode", "place", "t", F.array_join(F.transform("x", lambda r: r["rule"]), ",").alias("failed"))


# The families that the reduced pool leaves out, in the order in which they are asked.
CUTS = ["oneDecade", "mult5", "sameDigit", "evenStepTight", "tightSpan", "runFive", "slipRow", "squareCube", "fib", "digitSum", "sameMultiple", "gridColumn", "slipDiagonal", "twoDigits", "powerTwo", "repdigit"]


def mode_failures(mode: DataFrame, tested: DataFrame) -> DataFrame:
    """game, t: the draws that broke a rule of the mode (game, feature, alpha), each judged by the band from the draws before it."""
    return by_rule(tested, mode.select("game", "feature", "alpha").distinct()).where("v is not null").where(~F.col("held")).select("game", "t").distinct()


def cut_by(h: History, failed: DataFrame | None = None, warm_up: int = WARM_UP) -> DataFrame:
    """game, date, t, kept, cut_by: whether the reduced pool, as it stood before it, held the first draw of each date after the warm-up, and if not, why.

    The first of these counts: bands (failed, of mode_failures(), has a draw of its date), drawn before, low places, a sum at or beyond the record, or the first of CUTS that matches. The records
    before a draw are those of the blocks of draws before its own, and of its own until then. A game's retired pools should be left out of h (eras.detect()).
    """
    fam = families(F.col("sorted"), h.k, h.d)
    total = F.aggregate("sorted", F.lit(0), lambda a, x: a + x)
    rows = h.draws.select("game", "date", "t", "sorted", total.alias("s"), F.floor(F.col("t") / BLOCK).alias("block"))
    before = Window.partitionBy("game").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = rows.groupBy("game", "block").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    blocks = blocks.select("game", "block", F.min("lo").over(before).alias("lo0"), F.max("hi").over(before).alias("hi0"))
    own = Window.partitionBy("game", "block").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lo", F.min("s").over(own)).withColumn("hi", F.max("s").over(own)).join(blocks, ["game", "block"])
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("game", "sorted").orderBy("t"))).join(h.sizes, "game")
    first = F.when(F.col("draws") > warm_up, warm_up).otherwise(0)
    rows = rows.where(F.col("t") >= first).withColumn("r", F.row_number().over(Window.partitionBy("game", "date").orderBy("t"))).where("r = 1")
    record = (F.col("t") > first) & ((F.col("s") <= F.least("lo", "lo0")) | (F.col("s") >= F.greatest("hi", "hi0")))
    if failed is None:
        rows = rows.withColumn("failed", F.lit(False))
    else:
        days = h.draws.join(failed.select("game", "t"), ["game", "t"]).select("game", "date", F.lit(True).alias("failed")).distinct()
        rows = rows.join(days, ["game", "date"], "left")
    out = F.when(F.col("failed"), "bands").when(F.col("nth") > 1, "drawn").when((F.element_at("sorted", h.d - 1) <= 5) | (F.element_at("sorted", h.d) <= 9), "low").when(record, "record")
    for name in CUTS:
        out = out.when(fam[name], name)
    return rows.select("game", "date", "t", out.isNull().alias("kept"), out.alias("cut_by"))


def closed_form_overlap(h: History) -> DataFrame:
    """game, t, overlap, p: the chance that a draw shares so many numbers with the union of the 10 before it, by the hypergeometric law of that union's size."""
    ways = {(size, m): comb(size, m) * comb(h.k - size, h.d - m) / comb(h.k, h.d) for size in range(h.k + 1) for m in range(h.d + 1)}
    table = h.draws.sparkSession.createDataFrame([(s, m, p) for (s, m), p in ways.items()], "size int, overlap int, p double")
    return with_context(h).where("prev is not null").select("game", "t", F.size("last10").alias("size")).join(table, "size").select("game", "t", "overlap", "p")
