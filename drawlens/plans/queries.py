"""The queries over histories derived from order tables."""

from collections.abc import Callable
from math import comb

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.functions.odds import hypergeometric
from drawlens.functions.shapes import families, total
from drawlens.history import History, ordered
from drawlens.operators import bonus, combinations, constraints, describe, eras, fairness, learn, money, overlaps, portfolio, positions, reduction, reports, signals
from drawlens.sources import orders, table, text
from drawlens.sources.orders import history

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, as sums of doubles depend on their order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _of(f: Callable[[History], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf_dir: rounded(f(history(spark, sf_dir)), digits)


def _value(name: str) -> Query:
    return _of(lambda h: signals.raw(h, keys=[name]).select("game", "n", F.col(name).alias("value")))


def _with_sales(spark: SparkSession, sf_dir: str) -> History:
    h = history(spark, sf_dir)
    sales = orders.sales_by_day(spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return History(text.attach_sales(h.draws, sales), h.k, h.d, h.ks)


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket for each customer."""
    key = F.col("c_custkey")
    numbers = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (1 + i * 13 + key % 13).cast("int")))
    date = F.when(key % 11 > 0, F.date_add(F.to_date(F.lit("1995-01-01")), (key % 2400).cast("int")))  # some tickets have no date
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("main").alias("game"), key.alias("ticket"), numbers.alias("numbers"), (key % 26 + 1).cast("int").alias("special"), date.alias("for_date"), F.lit(2.0).alias("cost"))


def tier_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money.graded(_tickets(spark, sf_dir), history(spark, sf_dir)).select("game", "ticket", "status", "mains", "special_hit", "jackpot", "prize")


def merge_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = history(spark, sf_dir).draws.withColumn("sales", F.lit(None).cast("double"))
    columns = ["game", "date", "dow", "numbers", "sorted", "special", "jackpot", "winner_location", "sales"]
    old = d.where("t % 3 > 0").withColumn("jackpot", F.when(F.col("t") % 5 > 0, F.col("jackpot"))).withColumn("src", F.lit(1)).select(*columns)
    new = d.where("t % 3 < 2").select(*columns)
    merged = text.merge(old, new)
    found = merged.join(new.select("game", "date", "sorted", "special").distinct().withColumn("in_new", F.lit(True)), ["game", "date", "sorted", "special"], "left")
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return found.groupBy("game").agg(one(~F.col("added") & F.col("in_new")).alias("both"), one(~F.col("added") & F.col("in_new").isNull()).alias("only_old"), one(F.col("added")).alias("only_new"), F.count("jackpot").alias("jackpots"))


def ewma_asof(h: History) -> DataFrame:
    """The recency of half-life 20 before every draw."""
    return signals.recency(h, 20, h.draws.select("game", "t"), "recency")


def crowd_markers(h: History) -> DataFrame:
    """The markers of every draw; past winners are combinations that were drawn before it."""
    again = F.row_number().over(Window.partitionBy("game", "sorted").orderBy("t")) > 1
    rows = h.draws.select("game", "t", "sorted", again.alias("again"))
    return rows.select("game", "t", F.array_join(money.crowd_markers(F.col("sorted"), h.k, F.col("again")), ",").alias("markers"))


def _lab(h: History) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sampled universe, the bands before each draw, the rules, and the modes."""
    universe, tested = cut(constraints.sample_universe(h.draws.sparkSession, h.k, h.d)), constraints.steps(h)
    rules = cut(constraints.rules(h, universe, tested))
    return universe, tested, rules, cut(constraints.modes(h, universe=universe, tested=tested, all_rules=rules))


def pool_replay_bands(h: History) -> DataFrame:
    """The replay with the bands of the mode of the highest floor of survival."""
    _, tested, _, mode = _lab(h)
    top = mode.groupBy("game").agg(F.max("mode").alias("mode"))
    return constraints.cut_by(h, constraints.mode_failures(mode.join(top, ["game", "mode"]), tested))


def mode_reports(h: History) -> DataFrame:
    universe, tested, _, mode = _lab(h)
    return constraints.mode_report(h, mode, universe, tested)


def mode_eliminated(h: History) -> DataFrame:
    _, tested, _, mode = _lab(h)
    return constraints.eliminated(h, mode, tested)


def mode_ledger(h: History) -> DataFrame:
    universe, tested, _, mode = _lab(h)
    return reduction.ledger(h, mode, constraints.mode_report(h, mode, universe, tested))


def pool_left(h: History) -> DataFrame:
    """How many of the sampled combinations each mode's reduced pool holds."""
    universe, _, _, mode = _lab(h)
    return reduction.reduced(h, universe, mode).groupBy("game", "mode").agg(F.count(F.lit(1)).alias("combinations"))


def prediction_log(h: History) -> DataFrame:
    """The log of all predictions with the verdicts of the reduced pool, by the hits of the ten, best first."""
    log = learn.prediction_log(learn.backtest(h)["points"], h, constraints.cut_by(h), bonus.backtest(h)["points"])
    rows = learn.sorted_log(cut(log), "hits")
    return rows.select("game", "place", "t", F.array_join("predicted", "-").alias("predicted"), F.array_join("actual", "-").alias("actual"), "hits10", "pool_kept", "pool_cut_by", "bonus_hit")


def _typed(h: History) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The draws as a sheet with odd rows, imported again."""
    head = h.draws.sparkSession.createDataFrame([(x,) for x in table.HEAD], "line string")
    lines = cut(head.unionByName(table.odd_lines(h.draws)))
    some = [r.line for r in table.odd_lines(h.draws.where("t < 10")).collect()]  # as a file's first lines would be
    return table.imported(lines, [*table.HEAD, *some], "main")


def _rates(h: History) -> DataFrame:
    return describe.frequency(h).select("game", "n", F.col("rate").alias("score"))


def tickets_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tickets of each date there are after the tickets of even customers got those of all, some of which they hold already, and some with the numbers in another order."""
    all_ = _tickets(spark, sf_dir)
    more = all_.withColumn("numbers", F.reverse("numbers")).withColumn("ticket", F.col("ticket") + 1_000_000_000)
    return money.added(all_.where("ticket % 2 = 0").dropDuplicates(["game", "numbers", "special", "for_date"]), more).groupBy("game", "for_date").agg(F.count(F.lit(1)).alias("tickets"))


def draws_removed(h: History) -> DataFrame:
    """game, draws, first_t, last_t: what is left when the draws of every tenth place go, by date and numbers."""
    gone = h.draws.where("t % 10 = 0").select("game", "date", "sorted")
    return money.without(h.draws, gone).groupBy("game").agg(F.count(F.lit(1)).alias("draws"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def import_errors(h: History) -> DataFrame:
    """game, error, rows of the sheet's rows that hold no draw."""
    return _typed(h)[1].groupBy(F.lit("main").alias("game"), "error").agg(F.count(F.lit(1)).alias("rows"))


def planted_era(h: History) -> History:
    """The history with a smaller pool in its first part: draws with a number above 59 are left out there, and places are numbered anew."""
    rows = h.draws.join(h.sizes, "game").where((F.col("t") >= F.col("draws") * 0.6) | (F.element_at("sorted", -1) <= 59)).drop("draws")
    return History(cut(ordered(rows.drop("t"), "draw_key")), h.k, h.d, h.ks)


def planted_streak(h: History) -> History:
    """The history with a number in every late draw: of the last tenth only draws that hold 7 or 11 stay."""
    rows = h.draws.join(h.sizes, "game").where((F.col("t") < F.col("draws") * 0.9) | F.arrays_overlap("sorted", F.array(F.lit(7), F.lit(11)))).drop("draws")
    return History(cut(ordered(rows.drop("t"), "draw_key")), h.k, h.d, h.ks)


def touching(h: History) -> DataFrame:
    """game, combinations, draws, expected: the combinations of three touching pairs, made without a scan, and the draws among them, met by rank."""
    members = reduction.touching_at_least(h.draws.sparkSession, h.k, h.d, 3).select(reduction.rank_of(F.col("sorted"), h.d).alias("rank"), F.lit(True).alias("member"))
    size = members.agg(F.count(F.lit(1)).alias("combinations"))
    rows = h.draws.select("game", reduction.rank_of(F.col("sorted"), h.d).alias("rank")).join(members, "rank", "left")
    rows = rows.groupBy("game").agg(F.count("member").alias("draws"), F.count(F.lit(1)).alias("all")).join(F.broadcast(size), F.lit(True))
    return rows.select("game", "combinations", "draws", (F.col("all") * F.col("combinations") / float(comb(h.k, h.d))).alias("expected"))


def union_sizes(h: History) -> DataFrame:
    """game, family, members, draws: the exact size of each family that is cut, of all together (union), and the draws in them."""
    members = cut(reduction.family_members(h.draws.sparkSession, h.k, h.d).select("family", "rank"))
    both = members.unionByName(members.select(F.lit("union").alias("family"), "rank").distinct())
    drawn = h.draws.select("game", reduction.rank_of(F.col("sorted"), h.d).alias("rank"))
    hits = both.join(drawn, "rank").groupBy("game", "family").agg(F.count(F.lit(1)).alias("draws"))
    sizes = both.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    rows = h.sizes.select("game").join(F.broadcast(sizes), F.lit(True)).join(hits, ["game", "family"], "left")
    return rows.select("game", "family", "members", F.coalesce("draws", F.lit(0)).alias("draws"))


def sum_at_most(h: History) -> DataFrame:
    """Every total that was drawn, how often, and how many combinations have it or less."""
    table = combinations.sum_distribution(h.draws.sparkSession, h.k, h.d)
    drawn = h.draws.groupBy("game", total(F.col("sorted")).alias("total")).agg(F.count(F.lit(1)).alias("draws"))
    return drawn.join(table, "total").select("game", "total", "draws", "combinations", "at_most")


def band_count(h: History) -> DataFrame:
    """game, inside, draws_inside: how many combinations lie within the position bands, all at once, and how many draws."""
    at = constraints.position_bands(h).groupBy("game").agg(F.array_sort(F.collect_list(F.struct("position", "lo", "hi"))).alias("x"))
    table = [(r.game, combinations.band_count(h.k, h.d, [(p.lo, p.hi) for p in r.x]), [p.lo for p in r.x], [p.hi for p in r.x]) for r in at.collect()]  # d bands a game
    bands = h.draws.sparkSession.createDataFrame(table, "game string, inside long, lo array<int>, hi array<int>")
    ok = F.forall(F.arrays_zip("sorted", "lo", "hi"), lambda p: p["sorted"].between(p["lo"], p["hi"]))
    return h.draws.join(F.broadcast(bands), "game").groupBy("game", "inside").agg(F.sum(ok.cast("long")).alias("draws_inside"))


def spread_space(h: History) -> DataFrame:
    """Every spread, the combinations of the whole space that have it, and the draws."""
    space = combinations.subsets(h.draws.sparkSession, h.k, h.d).groupBy((F.element_at("sorted", -1) - F.element_at("sorted", 1)).alias("bin")).agg(F.count(F.lit(1)).alias("combinations"))
    drawn = h.draws.groupBy("game", (F.element_at("sorted", -1) - F.element_at("sorted", 1)).alias("bin")).agg(F.count(F.lit(1)).alias("draws"))
    return drawn.join(space, "bin").select("game", "bin", "combinations", "draws")


def picked_law(h: History) -> DataFrame:
    """game, hits, draws, p: how many of the ten most frequent numbers each draw held, against the law of chance."""
    top = describe.frequency(h).withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.col("hits").desc(), "n"))).where("r <= 10").groupBy("game").agg(F.collect_list("n").alias("top"))
    seen = h.draws.join(F.broadcast(top), "game").groupBy("game", F.size(F.array_intersect("sorted", "top")).alias("hits")).agg(F.count(F.lit(1)).alias("draws"))
    law = h.draws.sparkSession.createDataFrame([(m, hypergeometric(h.k, 10, h.d, m)) for m in range(h.d + 1)], "hits int, p double")
    return seen.join(F.broadcast(law), "hits").select("game", "hits", "draws", "p")


def families_drawn(h: History) -> DataFrame:
    """game, family, combinations, share, draws: every family's exact size, and the draws in it."""
    tests = families(F.col("sorted"), h.k, h.d)
    each = F.array(*[F.struct(F.lit(n).alias("family"), F.sum(c.cast("long")).alias("draws")) for n, c in tests.items()])
    drawn = h.draws.groupBy("game").agg(each.alias("x")).select("game", F.inline("x"))
    return drawn.join(combinations.family_counts(h.draws.sparkSession, h.k, h.d), "family").select("game", "family", "combinations", "share", "draws")


def portfolio_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact chances of the tickets of the five customers with the highest balance, as one portfolio."""
    rich = spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5)
    tickets = _tickets(spark, sf_dir).join(rich.select(F.col("c_custkey").alias("ticket")), "ticket", "leftsemi")
    return combinations.portfolio_stats(tickets, 69, 5, 26)


def _portfolio(h: History) -> DataFrame:
    """Five tickets by the rates of numbers, spread as far as they go, with the bonus number's live picks, shapes of the record, no past winner and no crowd marker."""
    rates = describe.frequency(h).select("game", "n", F.col("rate").alias("score"))
    specials = bonus.backtest(h)["picks"].select("game", "place", "n", "probability")
    return portfolio.built(rates, specials, h, 5, 1.0, shape=portfolio.shapes_of(h), barred=h.draws, accept=F.size(money.crowd_markers(F.col("c"), h.k)) == 0)


def portfolio_built(h: History) -> DataFrame:
    return _portfolio(h).withColumn("numbers", F.array_join("numbers", "-"))


def portfolio_checked(h: History) -> DataFrame:
    """game, tickets, covered, past_winners, crowded, out_of_shape, bonus_numbers: what the dealt tickets keep to."""
    tickets = _portfolio(h).where("kind = 'portfolio'").join(portfolio.shapes_of(h), "game")
    drawn = h.draws.select("game", F.col("sorted").alias("numbers"), F.lit(1).alias("drawn")).distinct()
    inside = F.forall(F.arrays_zip("numbers", "lo", "hi"), lambda x: x["numbers"].between(x["lo"], x["hi"])) & total(F.col("numbers")).between(F.col("sum_lo"), F.col("sum_hi"))
    rows = tickets.join(drawn, ["game", "numbers"], "left").withColumn("crowd", F.size(money.crowd_markers(F.col("numbers"), h.k)) > 0)
    return rows.groupBy("game").agg(F.count(F.lit(1)).alias("tickets"), F.size(F.array_distinct(F.flatten(F.collect_list("numbers")))).cast("long").alias("covered"), F.count("drawn").alias("past_winners"), F.sum(F.col("crowd").cast("long")).alias("crowded"), F.sum((~inside).cast("long")).alias("out_of_shape"), F.countDistinct("special").alias("bonus_numbers"))


def portfolio_scores(h: History) -> DataFrame:
    return portfolio.scored(_portfolio(h), h.k, h.d, h.ks)


def ticket_deal(h: History) -> DataFrame:
    scores = describe.frequency(h).select("game", "n", F.col("rate").alias("score"))
    return combinations.deal(scores, h, 5, accept=F.size(money.crowd_markers(F.col("numbers"), h.k)) == 0).select("game", "ticket", F.array_join("numbers", "-").alias("numbers"))


def ticket_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record says about every customer's ticket."""
    rows = reports.ticket_lab(_tickets(spark, sf_dir), history(spark, sf_dir))
    return rounded(rows.select("game", "ticket", "total", "total_below", "odd_share", "pair_total", "best_overlap", F.array_join(F.col("best_t").cast("array<string>"), "-").alias("best_t"), "three_up", "special_count"))


def queries() -> dict[str, Query]:
    joined = lambda df, c="numbers": df.withColumn(c, F.array_join(c, "-"))
    by_rate = lambda h: describe.frequency(h).join(h.sizes, "game").withColumn("p", F.round((F.col("hits") + 20 * h.d / h.k) / (F.col("draws") + 20), 12))
    return {
        "ball_frequency": _of(describe.frequency), "ball_by_weekday": _of(describe.by_weekday), "schedule_detect": _of(describe.schedule), "gap_stats": _of(describe.gaps), "window_counts": _of(describe.recent_counts), "hot_cold": _of(describe.hot_cold), "overdue": _of(describe.overdue),
        "top_pairs": _of(describe.top_pairs), "pair_counts": _of(describe.pair_counts), "transitions": _of(describe.transitions), "top_followers": _of(describe.top_followers), "repeat_rate": _of(describe.repeats), "position_counts": _of(positions.counts), "hazard": _of(describe.hazard),
        "draw_shape": _of(describe.shape), "odd_counts": _of(describe.odd_counts), "bonus_counters": _of(describe.bonus_counts), "weekday_chi2": _of(describe.weekday_significance), "dow_profiles": _of(describe.weekday_profiles), "trends": _of(describe.trends), "streaks": _of(describe.streaks), "current_streaks": _of(describe.current_streaks),
        "rolling_sum_mean": _of(lambda h: describe.rolling_mean(h.draws.select("game", "t", total(F.col("sorted")).alias("total")), "total", 10)), "position_profiles": _of(positions.profiles), "position_stats": _of(positions.statistics), "order_stat_pmf": _of(positions.theory, 9),
        "exact_repeats": _of(overlaps.exact), "pair_overlap_hist": _of(overlaps.histogram), "closest_pairs": _of(overlaps.closest),
        "latest_sharing": _of(lambda h: h.draws.join(h.draws.groupBy("game").agg(F.max_by("sorted", "t").alias("mine")), "game").groupBy("game", F.size(F.array_intersect("sorted", "mine")).alias("overlap")).agg(F.count(F.lit(1)).alias("draws"), F.max("t").alias("last"))),
        "era_detect": _of(eras.detect), "jackpot_stats": lambda s, d: rounded(money.jackpots(_with_sales(s, d))), "attach_sales": lambda s, d: rounded(_with_sales(s, d).draws.select("game", "t", "sales"), 2), "recent_winners": _of(money.winners), "jackpot_thirds": _of(money.thirds), "jackpot_projection": _of(money.projection),
        "ticket_ev": _of(lambda h: money.ticket_value(h.draws.select("game", "t", "jackpot", F.lit(1e7).alias("sold")), "jackpot", "sold", h.k, h.d, h.ks).select("game", "t", "lower_value", "split", "share", "value"), 9),
        "hypergeom_dist": _of(picked_law, 12), "tier_grade": tier_grade, "ticket_ledger": lambda s, d: money.ledger(money.graded(_tickets(s, d), history(s, d))),
        "crowd_markers": _of(crowd_markers), "ball_chi2": _of(fairness.ball_chi2), "serial_corr": _of(fairness.serial), "ks_colex": _of(fairness.combination_ks), "repeat_test": _of(fairness.repeat_rate), "mean_gap_test": _of(fairness.mean_gap), "bonus_chi2": _of(fairness.bonus_chi2),
        "fairness": _of(fairness.tests),
        "sum_record": _of(lambda h: h.draws.select("game", "t", total(F.col("sorted")).alias("s")).groupBy("game").agg(F.min("s").alias("least"), F.min_by("t", F.struct("s", "t")).alias("least_t"), F.max("s").alias("most"), F.min_by("t", F.struct(-F.col("s"), F.col("t"))).alias("most_t"))),
        "preset_eliminations": lambda s, d: reduction.presets(history(s, d)).select("game", "preset", "combinations", F.round("share", 9).alias("share"), F.round("expected", 6).alias("expected"), "observed"),
        "rolling_counts_asof": _of(lambda h: signals.panel(h).where("hit is not null").select("game", "t", "n", "hit", "c", "c10", "c20", "c50", "last_seen")), "weekday_recent_asof": _of(lambda h: signals.panel(h).where("hit is not null").select("game", "t", "n", "c_dow8", "c_dow")),
        "ewma_asof": _of(ewma_asof), "freq_signal": _value("freqAll"), "zone_signal": _value("zone"), "hot_signal": _value("hot"), "overdue_signal": _value("overdue"), "cycle_signal": _value("cycle"), "hazard_signal": _value("hazard"), "repeat_signal": _value("repeat"), "follower_signal": _value("follower"),
        "similar_situations": _of(lambda h: signals.similar(h, signals.next_draw(h)).select("game", "t", "u", "similarity", "place")), "next_draw": _of(signals.next_draw), "shape_features": _of(lambda h: constraints.measured(h, context=False)),
        "conditional_features": _of(lambda h: constraints.measured(h).select("game", "t", "dow", "repeatPrev", "overlap3", "overlap10", "dSum", "dSpread", "dOdd")),
        "rank_scores": _of(lambda h: by_rate(h).select("game", "n", F.row_number().over(Window.partitionBy("game").orderBy(F.col("p").desc(), "n")).alias("rank"))),
        "history_page": _of(lambda h: joined(h.draws.select("game", "t", "sorted").orderBy(F.col("t").desc()).offset(12).limit(12).withColumnRenamed("sorted", "numbers"))), "merge_draws": merge_draws,
        "isotonic_calibration": _of(lambda h: learn.isotonic(describe.frequency(h).select("game", F.row_number().over(Window.partitionBy("game").orderBy("n")).alias("rank"), F.col("hits").cast("double").alias("v")), "v", "rank").select("game", "rank", "fit")),
        "subset_families": _of(families_drawn, 12), "sum_at_most": _of(sum_at_most), "band_count": _of(band_count), "rule_space_share": _of(spread_space), "portfolio_exact": lambda s, d: rounded(portfolio_exact(s, d), 9), "portfolio_checked": _of(portfolio_checked),
        "touching_pairs": _of(touching), "union_sizes": _of(union_sizes), "ledger": _of(lambda h: reduction.ledger(h).drop("mode")), "position_bands": _of(constraints.position_bands), "constraint_rules": _of(constraints.rules), "rule_frontier": _of(constraints.frontier),
        "rule_slices": _of(constraints.rule_slices), "rule_slices_eras": _of(lambda h: constraints.rule_slices(planted_era(h))), "era_detect_planted": _of(lambda h: eras.detect(planted_era(h))), "current_streaks_planted": _of(lambda h: describe.current_streaks(planted_streak(h))),
        "bonus_signals": _of(bonus.live), "bonus_backtest": _of(lambda h: bonus.backtest(h)["signals"]), "bonus_ranks": _of(lambda h: bonus.backtest(h)["ranks"].select("game", "rank", "hits", "evaluated", "rate", "fit")), "bonus_points": _of(lambda h: joined(bonus.backtest(h)["points"], "picks")), "bonus_picks": _of(lambda h: bonus.backtest(h)["picks"]),
        "imported_draws": _of(lambda h: joined(_typed(h)[0].select("game", "date", "dow", F.col("sorted").alias("numbers"), "special", "jackpot")), 2), "import_errors": _of(import_errors), "import_facts": _of(lambda h: _typed(h)[2]),
        "ticket_numbers": lambda s, d: rounded(reports.ticket_numbers(_tickets(s, d), history(s, d), _rates(history(s, d)))), "ticket_crowd": lambda s, d: reports.ticket_crowd(_tickets(s, d), history(s, d)), "jackpot_series": _of(reports.jackpot_series), "similar_outcomes": _of(lambda h: joined(joined(reports.similar_outcomes(h, _rates(h)), "outcome"), "shared")),
        "tickets_added": tickets_added, "draws_removed": _of(draws_removed),
        "companions": _of(reports.companions), "calendar_rate": _of(reports.calendar_rate), "typical_sales": lambda s, d: rounded(reports.typical_sales(_with_sales(s, d)), 2), "slice_floors": _of(reports.slice_floors),
        "replay_reasons": _of(lambda h: reports.replay_reasons(constraints.cut_by(h))), "feature_standing": _of(reports.standing), "ticket_lab": ticket_lab,
        # Not for SQL: folds, samples and greedy choices, which tests hold against plain versions.
        "signals_next": _of(lambda h: signals.normalised(signals.raw(h)).drop("hit")), "walk_forward_signals": _of(lambda h: learn.backtest(h)["signals"]), "rank_calibration": _of(lambda h: learn.backtest(h)["ranks"]), "ml_combiner": _of(lambda h: learn.combiner(h)[1]), "ml_skill": _of(lambda h: learn.backtest(h)["nats"]),
        "walk_forward_summary": _of(lambda h: learn.summarised(learn.backtest(h)["points"], h)), "prediction_log": _of(prediction_log),
        "constraint_modes": _of(lambda h: _lab(h)[3]), "mode_reports": _of(mode_reports), "mode_eliminated": _of(mode_eliminated), "mode_ledger": _of(mode_ledger), "pool_left": _of(pool_left), "pool_replay": _of(constraints.cut_by), "pool_replay_bands": _of(pool_replay_bands), "overlap_law": _of(constraints.closed_form_overlap, 9),
        "portfolio_built": _of(portfolio_built), "portfolio_scores": _of(portfolio_scores), "ticket_deal": _of(ticket_deal), "best_combinations": _of(lambda h: joined(combinations.best_combinations(describe.frequency(h).select("game", "n", F.col("rate").alias("score")), h))), "positional_fit": _of(lambda h: positions.fit(h, [5, 17, 31, 44, 62])),
    }
