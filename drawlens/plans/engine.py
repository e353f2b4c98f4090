"""The whole analysis of a history: one lazy table for each concept."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.functions.dates import countdown, instant
from drawlens.functions.odds import hypergeometric
from drawlens.functions.shapes import features
from drawlens.history import History
from drawlens.operators import bonus, combinations, constraints, describe, eras, fairness, learn, money, overlaps, positions, reduction, reports, signals

LEAST_DRAWS, MOST_POOL = 12, 150
LABELS = {
    "freqAll": "comes often", "freqDow": "comes often on this weekday", "dowRecent": "came on this weekday lately", "recencyFast": "came in the last few draws", "recency": "came in recent draws", "recencySlow": "came over a longer while", "window10": "in the last 10 draws", "window20": "in the last 20 draws",
    "window50": "in the last 50 draws", "zone": "its neighbours come often", "hot": "above its own rate", "momentum": "rising", "overdue": "longer away than its mean gap", "hazard": "numbers away so long tend to come", "cycle": "near its usual gap", "repeat": "may repeat", "follower": "follows the last numbers",
    "followerDow": "follows the last numbers on this weekday", "similarity": "came in similar situations", "mlModel": "the learned combination of all signals",
}


def problems(h: History) -> DataFrame:
    """game, problem: why a game can't be analysed; games without a problem have no row."""
    facts = h.draws.groupBy("game").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("sorted")).alias("least"), F.max(F.size("sorted")).alias("most"), F.max(F.array_max("sorted")).alias("top"))
    why = (
        F.when(F.col("n") < LEAST_DRAWS, "too few draws")
        .when(F.col("least") != F.col("most"), "draws of different sizes")
        .when(F.col("top") > MOST_POOL, "the pool is too large")
        .when(F.lit(h.k) < F.col("most") + 4, "the pool is too small")
    )
    return facts.withColumn("problem", why).where("problem is not null").select("game", "problem")


def number_stats(h: History) -> DataFrame:
    """One row for each number: game, n, hits, rate, expected, last_20, since, mean_gap, gap_sd, streak, max_streak, repeat_rate, momentum, hot_z, overdue_ratio."""
    w10, w50 = F.least("draws", F.lit(10)), F.least("draws", F.lit(50))
    hot = describe.hot_z(h).withColumn("momentum", F.col("last_10") / w10 - F.col("last_50") / w50).select("game", "n", "draws", "last_20", F.col("z").alias("hot_z"), "momentum")
    rows = describe.frequency(h).join(hot, ["game", "n"]).join(describe.gaps(h).select("game", "n", "mean_gap", "gap_sd"), ["game", "n"])
    rows = rows.join(describe.streaks(h), ["game", "n"], "left").join(describe.repeats(h).select("game", "n", F.col("rate").alias("repeat_rate")), ["game", "n"], "left")
    return rows.withColumn("expected", F.col("draws") * (h.d / h.k)).withColumn("overdue_ratio", F.col("since") / F.greatest(F.lit(1.0), F.col("mean_gap"))).drop("draws", "last_seen")


def confidence(evaluated: Column, edge: Column) -> Column:
    return F.when((evaluated >= 120) & (edge >= 1.12), "High").when((evaluated >= 40) & (edge >= 1.03), "Medium").otherwise("Low")


def prediction(h: History, weights: DataFrame | None = None, ranks: DataFrame | None = None, model: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(numbers, reasons) for the next draw. numbers: game, t, n, score, rank, probability (by rank; the even share without ranks). reasons: game, n, place, key, contribution, reason: each number's six largest.

    weights: game, key, weight (even, if not given); ranks: game, rank, fit; model: game, t, n, mlModel, the learned combiner's scores of the next draw; all as of learn.backtest().
    """
    z = signals.long(signals.normalised(signals.raw(h)))
    if model is not None:
        z = z.unionByName(signals.long(model.withColumn("hit", F.lit(None).cast(z.schema["hit"].dataType)), [learn.ML_KEY]))
    weighted = z.withColumn("weight", F.lit(1 / (len(signals.KEYS) + (model is not None)))) if weights is None else z.join(weights.where("weight > 0").select("game", "key", "weight"), ["game", "key"])
    parts = weighted.select("game", "t", "n", "key", (F.col("weight") * F.col("value")).alias("contribution"))
    score = parts.groupBy("game", "t", "n").agg(F.round(F.sum("contribution"), 12).alias("score"))
    score = score.withColumn("rank", F.row_number().over(Window.partitionBy("game").orderBy(F.col("score").desc(), "n")))
    even = F.lit(h.d / h.k)
    numbers = score.withColumn("probability", even) if ranks is None else score.join(ranks.select("game", "rank", F.col("fit").alias("probability")), ["game", "rank"], "left").withColumn("probability", F.coalesce("probability", even))
    place = F.row_number().over(Window.partitionBy("game", "n").orderBy(F.abs("contribution").desc(), "key"))
    said = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    reasons = parts.withColumn("place", place).where("place <= 6").select("game", "n", "place", "key", "contribution", F.concat(F.when(F.col("contribution") < 0, "against: ").otherwise(""), F.element_at(said, F.col("key"))).alias("reason"))
    return numbers.select("game", "t", "n", "score", "rank", "probability"), reasons


def drivers(weights: DataFrame, most: int = 5) -> DataFrame:
    """game, place, key, weight, learned: the signals that carry most weight; learned if one has more than 1.5 times the even weight."""
    own = Window.partitionBy("game")
    rows = weights.withColumn("learned", F.max("weight").over(own) > 1.5 / F.count(F.lit(1)).over(own))
    return rows.withColumn("place", F.row_number().over(own.orderBy(F.col("weight").desc(), "key"))).where((F.col("place") <= most) & (F.col("weight") > 0.005)).select("game", "place", "key", "weight", "learned")


def next_jackpot(h: History, manual: DataFrame, official: DataFrame, zone: str = "America/New_York", clock: str = "22:59", now: Column | None = None) -> DataFrame:
    """game, draw_date, source, jackpot, cash_value, draw_instant, left: what the next draw is worth, by precedence manual, official, projected. manual and official: game, draw_date, jackpot (and cash_value, of official)."""
    ahead = signals.next_draw(h).select("game", F.col("date").alias("draw_date"))
    rows = ahead.join(manual.select("game", "draw_date", F.col("jackpot").alias("m")), ["game", "draw_date"], "left").join(official.select("game", "draw_date", F.col("jackpot").alias("o"), "cash_value"), ["game", "draw_date"], "left").join(money.projection(h).select("game", F.col("projected").alias("p")), "game", "left")
    source = F.when(F.col("m").isNotNull(), "manual").when(F.col("o").isNotNull(), "official").when(F.col("p").isNotNull(), "projected").otherwise("none")
    at = instant(F.col("draw_date"), clock, zone)
    return rows.select("game", "draw_date", source.alias("source"), F.coalesce("m", "o", "p").alias("jackpot"), F.when(source == "official", F.col("cash_value")).alias("cash_value"), at.alias("draw_instant"), countdown(F.current_timestamp() if now is None else now, at).alias("left"))


def inspected(rules: DataFrame, numbers: list[int], k: int, d: int) -> DataFrame:
    """game, feature, alpha, v, lo, hi, passes: each rule that needs no earlier draw, on one combination."""
    spark = rules.sparkSession
    s = F.array(*[F.lit(n) for n in sorted(numbers)])
    cols = features(s, k, d)
    values = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("v")) for n, c in cols.items()])).alias("x")).select("x.*")
    return rules.join(values, "feature").select("game", "feature", "alpha", "v", "lo", "hi", F.col("v").between(F.col("lo"), F.col("hi")).alias("passes"))


def reality(points: DataFrame, h: History, picked: int) -> DataFrame:
    """game, hits, observed, expected: how often the picks hit 0, 1, 2 or 3 and more, against chance; games with 50 points at least."""
    law = [(m, sum(hypergeometric(h.k, h.d, picked, x) for x in range(m, h.d + 1)) if m == 3 else hypergeometric(h.k, h.d, picked, m)) for m in range(4)]
    table = points.sparkSession.createDataFrame(law, "hits int, p double")
    n = points.groupBy("game").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
    seen = points.groupBy("game", F.least(F.col("hits_pick"), F.lit(3)).cast("int").alias("hits")).agg(F.count(F.lit(1)).alias("observed"))
    return n.join(table).join(seen, ["game", "hits"], "left").select("game", "hits", F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("n") * F.col("p")).alias("expected"))


def recap(h: History, since: Column, grades: DataFrame, points: DataFrame, most: int = 4) -> DataFrame:
    """game, place, t, date, numbers, hits_pick, wins: the last draws after a date, with what the picks hit and how many tickets won something or had two mains."""
    fresh = h.draws.where(F.col("date") > since)
    won = grades.where((F.col("prize") > 0) | (F.col("mains") >= 2) | F.col("jackpot")).groupBy("game", F.col("for_date").alias("date")).agg(F.count(F.lit(1)).alias("wins"))
    place = F.row_number().over(Window.partitionBy("game").orderBy(F.col("t").desc()))
    rows = fresh.withColumn("place", place).where(F.col("place") <= most).join(points.select("game", "t", "hits_pick"), ["game", "t"], "left").join(won, ["game", "date"], "left")
    return rows.select("game", "place", "t", "date", F.array_join("sorted", "-").alias("numbers"), "hits_pick", F.coalesce("wins", F.lit(0)).alias("wins"))


def laboratory(h: History) -> dict[str, DataFrame]:
    """The rules of shape: rules, their slices, modes and what they are worth, the frontier, position bands, presets, the ledger with each mode, and the replay with the bands of the deepest mode. Bands and modes are worked out at once, as all tables stand on them."""
    universe, tested = cut(constraints.sample_universe(h.draws.sparkSession, h.k, h.d)), constraints.steps(h)
    rules = cut(constraints.rules(h, universe, tested))
    modes = cut(constraints.modes(h, universe=universe, tested=tested, all_rules=rules))
    reports_ = cut(constraints.mode_report(h, modes, universe, tested))
    deepest = modes.join(modes.groupBy("game").agg(F.min("mode").alias("mode")), ["game", "mode"])
    return {
        "rules": rules, "rule_slices": constraints.rule_slices(h, tested), "modes": modes, "mode_reports": reports_, "eliminated": constraints.eliminated(h, modes, tested), "frontier": constraints.frontier(h, universe, tested, rules), "position_bands": constraints.position_bands(h), "presets": reduction.presets(h),
        "ledger": reduction.ledger(h, modes, reports_), "replay": constraints.cut_by(h, constraints.mode_failures(deepest, tested)),
    }


def analysed(history: History, evaluated: bool = True, lab: bool = True) -> dict[str, DataFrame]:
    """Everything about the games that have no problem, on each game's current era: a table for each concept. Nothing runs until a table is asked for, but for the evaluation and the laboratory, which can be left out."""
    h = eras.scoped(history)
    h = History(cut(h.draws), h.k, h.d, h.ks)  # every table below reads the draws again
    h = History(cut(h.draws.join(problems(h), "game", "left_anti")), h.k, h.d, h.ks)
    test = learn.backtest(h) if evaluated else None
    numbers, reasons = prediction(h, test["signals"] if test else None, test["ranks"] if test else None, test["model"] if test else None)
    out = {
        "problems": problems(history), "eras": eras.detect(history), "next_draw": signals.next_draw(h), "numbers": numbers, "reasons": reasons, "number_stats": number_stats(h), "hot_cold": describe.hot_cold(h), "overdue": describe.overdue(h), "pairs": describe.top_pairs(h),
        "followers": describe.top_followers(h), "weekdays": describe.weekday_profiles(h), "weekday_tests": describe.weekday_significance(h), "trends": describe.trends(h), "streaks": describe.current_streaks(h), "positions": positions.statistics(h), "profiles": positions.profiles(h), "overlaps": overlaps.histogram(history),
        "repeats": overlaps.exact(history), "closest": overlaps.closest(history), "similar": signals.similar(h, signals.next_draw(h)), "fairness": fairness.tests(h), "replay": constraints.cut_by(h), "companions": reports.companions(h), "standing": reports.standing(h), "slice_floors": reports.slice_floors(h),
        "combinations": combinations.best_combinations(numbers.select("game", "n", "score"), h), "jackpots": money.jackpots(h), "projection": money.projection(h),
    }
    if lab:
        out |= laboratory(h)
    if h.ks:
        test_bonus = bonus.backtest(h)
        out |= {"bonus": bonus.live(h), "bonus_signals": test_bonus["signals"], "bonus_ranks": test_bonus["ranks"], "bonus_picks": test_bonus["picks"]}
    return out | ({"signals": test["signals"], "points": test["points"], "ranks": test["ranks"], "drivers": drivers(test["signals"]), "summary": reports.point_summary(test["points"]), "by_day": learn.summarised(test["points"], h), "skill": test["nats"], "log": learn.prediction_log(test["points"], h, out["replay"], test_bonus["points"] if h.ks else None)} if test else {})
