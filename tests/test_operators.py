"""Exact counts against brute force, conservation, leak guards, fair and planted histories."""

import datetime
from itertools import combinations as choices
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlens.functions import dates, odds, shapes
from drawlens.history import History
from drawlens.operators import combinations, constraints, describe, eras, fairness, learn, money, overlaps, positions, reduction, signals
from drawlens.sources import generated


@pytest.fixture(scope="module")
def fair(spark):
    h = generated.fair(spark, 400, games=2)
    return History(h.draws.persist(), h.k, h.d, h.ks)


def test_golden_odds():
    assert comb(69, 5) == 11_238_513
    assert odds.jackpot_odds(69, 5, 26) == 292_201_338
    assert 0.31 < sum(x * p for *_, x, p in money.tier_chances(69, 5, 26)) < 0.33
    assert combinations.at_most_count(69, 5, 4, 5) == 321
    assert combinations.at_most_count(69, 5, 5, 9) == comb(9, 5)
    assert combinations.adjacency_count(69, 5, 3) == 8385
    assert abs(sum(odds.order_statistic(69, 5, 2, v) for v in range(1, 70)) - 1) < 1e-12


@pytest.mark.parametrize(("k", "d"), [(12, 3), (16, 3), (20, 4)])
def test_exact_counts_match_enumeration(k, d):
    every = list(choices(range(1, k + 1), d))
    for r in range(1, d + 1):
        assert combinations.at_most_count(k, d, r, 7) == sum(c[r - 1] <= 7 for c in every)
    assert combinations.window_count(k, d, 6) == sum(c[-1] - c[0] <= 5 for c in every)
    assert combinations.adjacency_count(k, d, 2) == sum(sum(b - a == 1 for a, b in zip(c, c[1:], strict=False)) >= 2 for c in every)
    bands = [(1, 5), (4, 9), (7, k), (9, k)][:d]
    assert combinations.band_count(k, d, bands) == sum(all(lo <= v <= hi for v, (lo, hi) in zip(c, bands, strict=True)) for c in every)


def test_subsets_and_sums(spark):
    assert combinations.subsets(spark, 12, 4).distinct().count() == comb(12, 4)
    top = combinations.sum_distribution(spark, 12, 3).orderBy(F.col("total").desc()).first()
    assert (top.total, top.at_most) == (33, comb(12, 3))


def test_portfolio_against_simulation(spark):
    tickets = [([1, 2, 3], 1), ([2, 3, 4], 2)]
    r = combinations.portfolio_stats(spark.createDataFrame(tickets, "numbers array<int>, special int"), 10, 3, 3, [(3, False, 9.0), (2, True, 2.0)]).first()
    wins = best = 0
    for c in choices(range(1, 11), 3):
        m = [len(set(c) & set(t)) for t, _ in tickets]
        best += max(m)
        wins += sum(any((x == 3) or (x >= 2 and b == s) for x, (_, s) in zip(m, tickets, strict=True)) for b in (1, 2, 3)) / 3
    assert r.draws == comb(10, 3)
    assert abs(r.any_prize - wins / comb(10, 3)) < 1e-12
    assert abs(r.best_match - best / comb(10, 3)) < 1e-12


def test_hazard_and_overlaps_account_for_everything(fair):
    exposures = describe.hazard(fair).groupBy("game").agg(F.sum("exposures").alias("e"), F.sum("hits").alias("h")).collect()
    assert all((r.e, r.h) == (400 * 69, 400 * 5) for r in exposures)
    pairs = overlaps.histogram(fair).groupBy("game").agg(F.sum("pairs").alias("p"), F.sum("expected").alias("e")).collect()
    assert all(r.p == 400 * 399 // 2 and abs(r.e - r.p) < 1e-6 for r in pairs)


def test_games_do_not_mix(spark, fair):
    one = History(fair.draws.where("game = 'fair1'"), fair.k, fair.d, 0)
    for f in (describe.frequency, describe.top_pairs, positions.profiles, describe.streaks):
        both = f(fair).where("game = 'fair1'")
        assert both.exceptAll(f(one)).count() == 0


def test_later_draws_change_nothing_before_them(spark, fair):
    last = 399
    changed = History(fair.draws.withColumn("sorted", F.when(F.col("t") == last, F.array(*[F.lit(n) for n in (1, 2, 3, 4, 5)])).otherwise(F.col("sorted"))), fair.k, fair.d, 0)
    a, b = (signals.panel(h).where(F.col("t") < last) for h in (fair, changed))
    assert a.exceptAll(b).count() == 0
    x, y = (constraints.by_rule(constraints.steps(h)).where(F.col("t") < last) for h in (fair, changed))
    assert x.exceptAll(y).count() == 0


def test_fair_history_is_fair_and_weights_are_even(fair):
    assert {r.verdict for r in fairness.tests(fair).where("test in ('ball_chi2', 'serial', 'repeat_rate')").collect()} <= {"fair", "watch"}
    chance = learn.TOP * fair.d / fair.k
    keys = ["freqAll", "window20", "overdue"]
    got = learn.backtest(fair, keys)
    w = got["signals"].collect()
    assert len(w) == 2 * len(keys) and all(abs(r.mean_hits - chance) < 0.25 for r in w)
    fit = [r.fit for r in got["ranks"].where("game = 'fair0'").orderBy("rank").collect()]
    assert len(fit) == 69 and all(b <= a + 1e-12 for a, b in zip(fit, fit[1:], strict=False))


def test_planted_history_is_seen(spark):
    h = generated.planted(spark)
    z = signals.normalised(signals.raw(h, h.draws.where("t >= 30").select("game", "t", "dow"), ["repeat", "follower", "freqAll"]), ["repeat", "follower", "freqAll"])
    hits = learn.signal_hits(signals.long(z, ["repeat", "follower"])).groupBy("key").agg(F.avg("hits").alias("m"))
    chance = learn.TOP * h.d / h.k
    assert max(r.m for r in hits.collect()) > chance
    scores = learn.gradient_scores(h, z, ["repeat", "follower", "freqAll"])
    assert scores.count() == z.count()


def test_recency_is_the_recurrence(spark, fair):
    got = {(r.t, r.n): r.x for r in signals.recency(fair, 8, fair.draws.where("game = 'fair0'").select("game", "t"), "x").collect()}
    drawn = {r.t: set(r.sorted) for r in fair.draws.where("game = 'fair0'").collect()}
    w, x = 0.5 ** (1 / 8), np.zeros(70)
    for t in range(400):
        assert abs(got[t, 7] - x[7]) < 1e-9 and abs(got[t, 69] - x[69]) < 1e-9
        x = x * w + (1 - w) * np.array([n in drawn[t] for n in range(70)])


def test_isotonic(spark):
    v = [3.0, 4.0, 1.0, 2.0, 0.0]
    df = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate(v)], "game string, r int, v double")
    assert [r.fit for r in learn.isotonic(df, "v", "r").orderBy("r").collect()] == [3.5, 3.5, 1.5, 1.5, 0.0]


def test_era(spark):
    start = datetime.date(2000, 1, 1)
    rows = [("a", t, start + datetime.timedelta(days=t), sorted({1, 5, 9, 20, (49 if t < 300 else 39) - t % 3}), None) for t in range(600)]
    draws = spark.createDataFrame(rows, "game string, t long, date date, sorted array<int>, special int")
    r = eras.detect(History(draws, 69, 5, 0)).first()
    assert (r.kind, r.cutoff, r.current_max) == ("shrink", 300, 39)
    grown = draws.withColumn("sorted", F.transform("sorted", lambda x: F.when((F.col("t") >= 300) & (x >= 37), x + 20).otherwise(F.when(x >= 37, 36).otherwise(x))))
    r = eras.detect(History(grown, 69, 5, 0)).first()
    assert (r.kind, r.cutoff) == ("grow", 300)


def test_markers_and_families(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([5, 10, 15, 20, 25],), ([3, 17, 33, 48, 61],), ([7, 17, 27, 37, 47],)], "s array<int>")
    got = [r.m for r in df.select(money.crowd_markers(F.col("s"), 69).alias("m")).collect()]
    assert got == [["months", "run"], ["calendar", "step", "fives"], [], ["step", "same_digit"]]
    fam = shapes.families(F.col("s"), 69, 5)
    rows = df.select(*[c.alias(n) for n, c in fam.items()]).collect()
    assert rows[0].runFive and rows[0].evenStepTight and rows[1].mult5 and not rows[2].evenSpaced and rows[3].sameDigit


def test_grades(spark):
    day = datetime.date(2024, 1, 1)
    draws = spark.createDataFrame([("main", 0, day, [1, 2, 3, 4, 5], 9)], "game string, t long, date date, sorted array<int>, special int")
    tickets = spark.createDataFrame(
        [("main", 1, [1, 2, 3, 4, 5], 9, day, 2.0), ("main", 2, [1, 2, 3, 4, 5], None, day, 2.0), ("main", 3, [1, 2, 3, 40, 50], 9, day, 2.0), ("main", 4, [1, 2, 3, 4, 5], 9, None, 2.0), ("main", 5, [1, 2, 3, 4, 5], 9, day + datetime.timedelta(1), 3.0)],
        "game string, ticket long, numbers array<int>, special int, for_date date, cost double",
    )
    g = {r.ticket: r for r in money.graded(tickets, History(draws)).collect()}
    assert g[1].jackpot and g[2].prize == 1_000_000 and not g[2].jackpot and g[3].prize == 100 and g[4].status == "open" and g[4].mains == 5 and g[5].status == "pending" and g[5].prize is None
    total = money.ledger(money.graded(tickets, History(draws))).first()
    assert (total.settled, total.pending, total.open, total.spent, total.won, total.best_mains, total.best_special) == (3, 1, 1, 9.0, 1_000_100.0, 5, True)


def test_dates_and_money(spark):
    cells = ["2024-03-05", "3/25/2024", "25/3/2024", "3/5/24", "Mar 5, 2024", "Tue, March 5 2024", "5 Mar 2024", "45356", "2024-02-30", "x", None]
    got = [str(r.d) for r in spark.createDataFrame([(c,) for c in cells], "c string").select(dates.date_of(F.col("c")).alias("d")).collect()]
    assert got == ["2024-03-05", "2024-03-25", "2024-03-25", "2024-03-05", "2024-03-05", "2024-03-05", "2024-03-05", "2024-03-05", "None", "None", "None"]
    amounts = ["$1.5 million", "20M", "$1,000", "2 Billion", "0", "abc", None]
    got = [r.m for r in spark.createDataFrame([(c,) for c in amounts], "c string").select(dates.money(F.col("c")).alias("m")).collect()]
    assert got == [1.5e6, 2e7, 1000.0, 2e9, None, None, None]


def test_members_of_families(spark):
    """Members and neighbours of each family at 69 and 5."""
    members = {
        "oneDecade": ([2, 5, 6, 9, 10], [20, 21, 25, 28, 29]), "tightSpan": ([44, 45, 47, 50, 51], [44, 45, 47, 50, 52]), "slipRow": ([3, 17, 31, 45, 59], [3, 17, 31, 45, 60]), "slipColumn": ([57, 60, 63, 66, 69], [56, 60, 63, 66, 69]),
        "wideGaps": ([3, 19, 35, 51, 67], [3, 19, 35, 51, 65]), "evenStepTight": ([1, 12, 23, 34, 45], [1, 13, 25, 37, 49]), "slipDiagonal": ([1, 16, 31, 46, 61], [1, 16, 31, 46, 62]), "twoDigits": ([1, 11, 12, 21, 22], [1, 11, 12, 21, 23]),
        "sameMultiple": ([6, 12, 30, 48, 66], [5, 10, 15, 20, 25]), "repdigit": ([11, 22, 33, 44, 66], [11, 22, 33, 44, 65]), "digitSum": ([9, 18, 27, 36, 45], [9, 18, 27, 36, 46]), "mirrorPool": ([3, 19, 35, 51, 67], [3, 19, 35, 51, 66]), "fibLike": ([1, 3, 4, 7, 11], [1, 3, 4, 7, 12]),
        "squareCube": ([1, 8, 27, 36, 64], [1, 8, 27, 36, 63]), "powerTwo": ([1, 2, 4, 8, 64], [1, 2, 4, 8, 63]), "gridColumn": ([1, 10, 19, 28, 37], [1, 8, 15, 22, 29]),
    }
    rows = spark.createDataFrame([(n, i == 0, v) for n, both in members.items() for i, v in enumerate(both)], "family string, member boolean, s array<int>")
    for r in rows.select("family", "member", "s", *[c.alias(f"_{n}") for n, c in shapes.families(F.col("s"), 69, 5).items()]).collect():
        assert r[f"_{r.family}"] == r.member, r.family


def test_replay_by_bands_and_dates(spark):
    rows = [(f"2020-01-{1 + i // 2:02}", i, sorted([3 + i, 20 + i % 7, 35 + i % 5, 50 + i % 3, 60 + i % 9])) for i in range(30)]
    draws = spark.createDataFrame([("g", t, datetime.date.fromisoformat(d), 1, s, s, 1) for d, t, s in rows], "game string, t long, date date, dow int, numbers array<int>, sorted array<int>, special int")
    h = History(draws)
    failed = spark.createDataFrame([("g", 12)], "game string, t long")
    got = {r.t: r.cut_by for r in constraints.cut_by(h, failed, warm_up=10).collect()}
    assert sorted(got) == list(range(10, 30, 2)) and got[12] == "bands"
    for t, why in got.items():
        s, past = rows[t][2], [sum(x[2]) for x in rows[:t]]
        if why == "record":
            assert not min(past) < sum(s) < max(past)
        elif why is None:
            assert t == 10 or min(past) < sum(s) < max(past)
    pool = spark.createDataFrame([([10, 21, 36, 51, 62],), ([1, 2, 3, 4, 20],), (rows[0][2],), ([1, 2, 3, 4, 5],)], "sorted array<int>")
    # Two rules on one feature hold together, whatever their order.
    for held in ([("g", 0.9, "pos1", 2, 20), ("g", 0.9, "pos1", 10, 30)], [("g", 0.9, "pos1", 10, 30), ("g", 0.9, "pos1", 2, 20)]):
        rule = spark.createDataFrame(held, "game string, mode double, feature string, lo int, hi int")
        assert [r.sorted for r in reduction.reduced(h, pool, rule).collect()] == [[10, 21, 36, 51, 62]]
    beyond = spark.createDataFrame([("g", 0.9, "pos1", 2, 20), ("g", 0.9, "pos1", 11, 30)], "game string, mode double, feature string, lo int, hi int")
    assert reduction.reduced(h, pool, beyond).count() == 0


def test_best_combinations_as_plain_loops(spark, fair):
    from math import log
    from statistics import fmean, pstdev

    scores = describe.frequency(fair).select("game", "n", F.col("rate").alias("score"))
    got = {}
    for r in combinations.best_combinations(scores, fair).collect():
        got.setdefault(r.game, []).append((r.place, list(r.numbers), r.score))
    k, d = fair.k, fair.d
    for game, found in got.items():
        draws = [r.sorted for r in fair.draws.where(F.col("game") == game).collect()]
        score = {r.n: r.score for r in scores.where(F.col("game") == game).collect()}
        n, hits = len(draws), {v: sum(v in s for s in draws) for v in score}
        together = lambda a, b: sum(a in s and b in s for s in draws)
        sums = [sum(s) for s in draws]
        odd = [sum(v % 2 for v in s) for s in draws]
        most_odd = max(odd.count(o) for o in range(d + 1))
        pool = sorted(score, key=lambda v: (-score[v], v))[:12]
        pair = {(a, b): log((together(a, b) + 0.75) / (hits[a] * hits[b] / n * (d - 1) * k / (d * (k - 1)) + 0.75)) for a, b in choices(sorted(pool), 2)}
        places = [[s[i] for s in draws] for i in range(d)]
        stats = [(fmean(p), pstdev(p), min(p), max(p)) for p in places]
        want = []
        for c in choices(sorted(pool), d):
            z = (sum(c) - fmean(sums)) / max(1, pstdev(sums))
            far = 0.0
            for v, (m, sd, least, top) in zip(c, stats, strict=True):
                far += max(0.0, abs(v - m) / sd - 1.5) ** 2 + 4 * (v < least or v > top)
            value = sum(score[v] for v in c) + 0.3 * fmean(pair[p] for p in choices(c, 2)) - 0.06 * z * z + 0.25 * log((odd.count(sum(v % 2 for v in c)) + 1) / (most_odd + 1)) - 0.12 * far
            want.append((-round(value, 9), list(c)))
        want.sort()
        assert [x[1] for x in sorted(found)] == [c for _, c in want[:8]]
        assert all(abs(x[2] + w[0]) < 1e-6 for x, w in zip(sorted(found), want, strict=False))
    none = combinations.best_combinations(scores, fair, accept=F.lit(False)).count()
    some = combinations.best_combinations(scores, fair, accept=F.get("numbers", F.lit(0)) % 2 == 1).collect()
    assert none == 8 * len(got) and all(r.numbers[0] % 2 == 1 for r in some)


def test_signals_of_the_next_draw_as_by_the_panel(spark, monkeypatch):
    planted = generated.planted(spark, 330)
    for h in (History(planted.draws.persist(), planted.k, planted.d, planted.ks), generated.fair(spark, 9)):
        want = {(r.game, r.n): r for r in signals.raw(h, signals.next_draw(h).select("game", "t", "dow")).collect()}
        with monkeypatch.context() as m:
            m.setattr(signals, "panel", lambda h: pytest.fail("the next draw needs no panel"))
            got = {(r.game, r.n): r for r in signals.raw(h).collect()}
        assert got.keys() == want.keys() and all(r.t == want[at].t and r.dow == want[at].dow for at, r in got.items())
        assert all(abs(r[k] - want[at][k]) < 1e-9 for at, r in got.items() for k in signals.KEYS), [(at, k) for at, r in got.items() for k in signals.KEYS if abs(r[k] - want[at][k]) > 1e-9][:5]
