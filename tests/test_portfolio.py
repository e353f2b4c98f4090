"""Portfolios against plain loops, counts against simulation, bonus numbers and learning against plain folds."""

import hashlib
import math
from itertools import combinations as choices
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.history import History
from drawlens.operators import bonus, learn, portfolio, signals
from drawlens.sources import generated

K, D = 20, 3


def u(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52)


def plain_pick(scores, used, fresh, shape, barred, accept, slot, best, tries, seed=1, game="g"):
    low, high = min(scores.values()), max(scores.values())
    weight = scores if low > 0 else {n: math.exp((s - high) / max(1e-9, high - low)) for n, s in scores.items()}
    free, held = [n for n in scores if n not in used], [n for n in scores if n in used]
    want = min(D, max(0, fresh), len(free))
    again = min(D - want, len(held))
    want = D - again
    order = lambda part: sorted(part, key=lambda n: (-scores[n], n))
    greedy = sorted(order(free)[:want] + order(held)[:again])
    shaped = lambda c: shape is None or (all(a <= x <= b for x, a, b in zip(c, *shape[:2], strict=True)) and shape[2] <= sum(c) <= shape[3])
    ok = lambda c: c not in barred and accept(c)
    if best and shaped(greedy) and ok(greedy):
        return greedy
    found, fallback = [], []
    for flat in (0,) if best else (0, 1):
        for t in range(1, tries + 1):
            key = lambda n: (-math.log(u(seed, game, slot, flat, t, n)) / (1 if flat else weight[n]), n)  # noqa: E731, B023
            c = sorted(sorted(free, key=key)[:want] + sorted(held, key=key)[:again])
            if shaped(c):
                value = round(sum(scores[n] for n in c), 12)
                fallback.append((-value, flat, t, c))
                if ok(c):
                    found.append((-value, flat, t, c))
    if best:
        return min(found)[3] if found else greedy
    if found:
        return min(found, key=lambda x: x[1:3])[3]
    return min(fallback)[3] if fallback else greedy


@pytest.mark.parametrize(("spread", "signed", "strict"), [(1.0, False, True), (0.5, True, True), (0.0, False, False), (1.0, False, None)])
def test_portfolio_against_plain_loops(spark, spread, signed, strict):
    scores = {n: (math.sin(n) if signed else 1 + n % 7) for n in range(1, K + 1)}
    draws = [("g", t, [1 + t, 5 + t, 12 + t]) for t in range(6)]
    h = History(spark.createDataFrame(draws, "game string, t long, sorted array<int>"), K, D, 4)
    shape = ([1, 4, 9], [9, 14, 20], 20, 45)
    if strict is None:  # nothing has this shape
        shape = ([20, 20, 20], [20, 20, 20], 60, 60)
    table = spark.createDataFrame([("g", *shape)], "game string, lo array<int>, hi array<int>, sum_lo int, sum_hi int") if strict is not False else None
    hold = spark.createDataFrame([("g", 1, [9, 2, 4], 3)], "game string, ticket int, numbers array<int>, special int")
    picks = spark.createDataFrame([("g", 1, 2, 0.4), ("g", 2, 3, 0.3)], "game string, place int, n int, probability double")
    accept = F.get("c", F.lit(0)) % 2 == 1
    got = portfolio.built(spark.createDataFrame([("g", n, float(s)) for n, s in scores.items()], "game string, n int, score double"), picks, h, 4, spread, hold, table, h.draws, accept, tries=40).collect()
    rows = {(r.kind, r.ticket): r for r in got}
    assert len(rows) == 12
    used, barred = {2, 4, 9}, [s for _, _, s in draws]
    fresh = portfolio.fresh_numbers(4, D, K, spread)
    assert sum(fresh) == portfolio.half_up(D + spread * (min(K, 4 * D) - D))
    assert rows["portfolio", 1].numbers == [2, 4, 9] and rows["portfolio", 1].special == 3
    limits = shape if table is not None else None
    for slot in range(1, 4):
        want = plain_pick(scores, used, fresh[slot], limits, barred, lambda c: c[0] % 2 == 1, slot, spread == 0, 40)
        assert rows["portfolio", slot + 1].numbers == want
        used |= set(want)
    top = plain_pick(scores, set(), D, limits, barred, lambda c: c[0] % 2 == 1, 4, True, 40)
    assert all(rows["concentrated", i].numbers == top and rows["concentrated", i].special == 2 for i in range(1, 5))
    specials = [rows["portfolio", i].special for i in range(2, 5)]
    assert specials == [2, 2, 2] if spread == 0 else sorted(specials) == [1, 2, 4]
    assert all(len(set(rows["quick", i].numbers)) == D and 1 <= rows["quick", i].special <= 4 for i in range(1, 5))


def test_counted_and_simulated_chances_agree(spark):
    held = [([1, 2, 3], 1), ([3, 4, 5], 2), ([9, 10, 11], 1)]
    tiers = [(3, False, 100.0), (2, True, 7.0), (1, True, 4.0)]
    tickets = spark.createDataFrame([("g", "a", n, s) for n, s in held], "game string, kind string, numbers array<int>, special int")
    exact = portfolio.scored(tickets, 12, 3, 4, tiers=tiers).first()
    wins = sum(any((len(set(c) & set(n)) == 3) or (len(set(c) & set(n)) in (1, 2) and s == b) for n, s in held) for c in choices(range(1, 13), 3) for b in range(1, 5))
    assert exact.exact and abs(exact.any_prize - wins / (comb(12, 3) * 4)) < 1e-12
    sets = tickets.groupBy("game", "kind").agg(F.collect_list(F.struct("numbers", "special")).alias("held"))
    guess = portfolio.simulated(sets, 12, 3, 4, trials=20_000, tiers=tiers).first()
    assert not guess.exact and abs(guess.any_prize - exact.any_prize) < 0.015 and abs(guess.best_match - exact.best_match) < 0.02
    wide = spark.createDataFrame([("g", "w", [3 * i + 1, 3 * i + 2, 3 * i + 3], 1) for i in range(20)], "game string, kind string, numbers array<int>, special int")
    r = portfolio.scored(wide, 60, 3, 4, trials=500).first()
    assert not r.exact and r.tickets == 20 and r.covered == 60


def plain_evaluation(z, hits_of, keys, chance, top, prior):
    """z: t -> key -> value by number; hits_of: t -> numbers. Weights from the draws before alone."""
    lam = 0.5 ** (1 / 80)
    ema, total, count, at_rank, points = {}, dict.fromkeys(keys, 0), 0, {}, {}
    skill = lambda: {k: min(ema.get(k, 0.0), total[k] / count - chance) if count else 0.0 for k in keys}

    def weights():
        s = skill()
        best = max(0.0, *s.values())
        raw = {k: max(0.0, s[k] - 0.35 * best) ** 2 for k in keys}
        trust = max(0.0, min(1.0, (best / (math.sqrt(max(0.05, chance)) / math.sqrt(max(1, count))) - 2) / 2.5))
        whole = sum(raw.values())
        return {k: (trust * raw[k] / whole + (1 - trust) / len(keys)) if whole > 1e-12 else 1 / len(keys) for k in keys}

    for t in sorted(hits_of):
        w = weights()
        score = {n: round(sum(w[k] * z[t][k][n] for k in keys), 12) for n in z[t][keys[0]]}
        order = sorted(score, key=lambda n: (-score[n], n))
        points[t] = order
        for i, n in enumerate(order):
            at_rank[i + 1] = at_rank.get(i + 1, 0) + (n in hits_of[t])
        for k in keys:
            h = sum(n in hits_of[t] for n in sorted(z[t][k], key=lambda n: (-z[t][k][n], n))[:top])
            x = h - chance
            ema[k] = x if k not in ema else lam * ema[k] + (1 - lam) * x
            total[k] += h
        count += 1
    return weights(), {k: total[k] / count for k in keys}, at_rank, points


def test_evaluation_as_a_fold(spark):
    h = generated.planted(spark, 150)
    keys = ["freqAll", "repeat", "window10"]
    h = History(cut(h.draws), h.k, h.d, h.ks)
    targets = h.draws.where("t >= 30").select("game", "t", "dow")
    rows = cut(signals.normalised(signals.raw(h, targets, keys), keys).select("game", "t", "n", "hit", *keys))
    z, hits = {}, {}
    for r in rows.collect():
        for k in keys:
            z.setdefault(r.t, {}).setdefault(k, {})[r.n] = r[k]
        hits.setdefault(r.t, set()).update({r.n} if r.hit else set())
    chance = 10 * h.d / h.k
    w, mean, at_rank, points = plain_evaluation(z, hits, keys, chance, 10, 30)
    out = learn.backtest(h, keys)
    for r in out["signals"].collect():
        assert abs(r.mean_hits - mean[r.key]) < 1e-12 and abs(r.weight - w[r.key]) < 1e-9 and abs(r.skill - mean[r.key] + chance) < 1e-12
    assert {r["rank"]: r.hits for r in out["ranks"].collect()} == at_rank
    got = {r.t: r for r in out["points"].collect()}
    for t, order in points.items():
        assert got[t].predicted == order[:10] and got[t].hits_pick == sum(n in hits[t] for n in order[: h.d])
    all_days = learn.summarised(out["points"], h).where("dow is null").first()
    assert all_days.draws == 120 and abs(all_days.ensemble10 - sum(r.hits10 for r in got.values()) / 120) < 1e-12
    # the regression, draw by draw
    scores = learn.gradient_scores(h, rows, keys)
    joined = rows.join(scores, ["game", "t", "n"])
    weight, seen, nats, logits = np.zeros(3), np.zeros(3), [], {}
    for t in sorted(hits):
        x = np.array([[z[t][k][n] for k in keys] for n in range(1, h.k + 1)])
        logit = x @ weight
        logits[t] = logit
        p = np.exp(logit) / np.exp(logit).sum()
        nats.append(sum(math.log(p[n - 1] * h.k) for n in hits[t]))
        g = len(hits[t]) * (p @ x) - sum(x[n - 1] for n in hits[t])
        seen += g * g
        weight = weight - 0.02 / np.sqrt(seen + 1e-8) * (g + 1e-3 * weight)
    for r in scores.where("n = 7").collect():
        assert abs(r.logit - logits[r.t][6]) < 1e-9
    r = learn.skill_nats(joined, h.k).first()
    assert r.draws == 120 and abs(r.nats - sum(nats) / 120) < 1e-9


def test_log_score_is_high_on_planted_draws_and_none_on_fair_ones(spark):
    keys = ["freqAll", "freqDow", "recencySlow", "zone", "repeat", "follower"]
    for h, test in ((generated.planted(spark), lambda x: x > 0.05), (generated.fair(spark, 700, seed=777), lambda x: abs(x) < 0.06)):
        h = History(cut(h.draws), h.k, h.d, h.ks)
        rows = cut(signals.normalised(signals.raw(h, h.draws.where("t >= 30").select("game", "t", "dow"), keys), keys).select("game", "t", "n", "hit", *keys))
        assert test(learn.skill_nats(rows.join(learn.gradient_scores(h, rows, keys), ["game", "t", "n"]), h.k).first().nats)


def test_bonus_signals_as_a_fold(spark, monkeypatch):
    monkeypatch.setattr(bonus, "BLOCK", 16)
    fair = generated.fair(spark, 130, games=2)
    special = F.when(F.col("t") % 11 != 5, (F.pmod(F.xxhash64("game", "t"), F.lit(6)) + 1).cast("int"))
    h = History(cut(fair.draws.withColumn("special", special)), fair.k, fair.d, 6)
    got = {(r.game, r.t, r.n): r for r in bonus.raw(h).collect()}
    draws = {}
    for r in h.draws.orderBy("game", "t").collect():
        draws.setdefault(r.game, []).append(r)
    ahead = {r.game: r for r in signals.next_draw(h).collect()}
    lam = 0.5 ** (1 / 25)
    for game, rows in draws.items():
        c, by_day, trans, last, gaps, ew, prev, n = [0] * 7, {}, {}, {}, {}, [0.0] * 7, 0, 0
        for r in [*rows, ahead[game]]:
            value = getattr(r, "special", None) if r.t < 130 else None
            if value is not None or r.t == 130:
                for v in range(1, 7):
                    x, base = got[game, r.t, v], (c[v] + 10 / 6) / (n + 10)
                    day = sum(by_day.get((r.dow, i), 0) for i in range(1, 7))
                    opp = sum(trans.get((prev, i), 0) for i in range(1, 7))
                    gap = sum(gaps[v]) / len(gaps[v]) if gaps.get(v) else 6.0
                    since = n - last[v] if v in last else n
                    want = (base, ew[v], (by_day.get((r.dow, v), 0) + 12 * base) / (day + 12), min(3.0, since / max(1, gap)), (trans.get((prev, v), 0) + 8 * base) / (opp + 8) if prev else base)
                    assert x.s == n and x["count"] == c[v] and x.since == since
                    assert all(abs(x[k] - y) < 1e-9 for k, y in zip(bonus.KEYS, want, strict=True)), (game, r.t, v, x, want)
            if value is not None:
                ew = [e * lam for e in ew]
                ew[value] += 1 - lam
                c[value] += 1
                by_day[r.dow, value] = by_day.get((r.dow, value), 0) + 1
                if value in last:
                    gaps.setdefault(value, []).append(n - last[value])
                last[value] = n
                if prev:
                    trans[prev, value] = trans.get((prev, value), 0) + 1
                prev, n = value, n + 1


def test_log_orders(spark):
    log = spark.createDataFrame(
        [("g", 1, [3, 4], [1, 2], 2, True, None, None), ("g", 2, [3], [9], 1, False, "low", True), ("g", 3, [3, 5], [1], 2, None, None, False), ("g", 4, [2, 9], [1, 2, 3], 0, False, "low", None)],
        "game string, t long, predicted array<int>, actual array<int>, hits10 long, pool_kept boolean, pool_cut_by string, bonus_hit boolean",
    )
    order = lambda by, falling: [r.t for r in learn.sorted_log(log, by, falling).orderBy("place").collect()]
    assert order("date", True) == [4, 3, 2, 1] and order("hits", True) == [3, 1, 2, 4] and order("hits", False) == [4, 2, 3, 1]
    assert order("top10", False) == [4, 2, 1, 3] and order("actual", False) == [3, 1, 4, 2] and order("bonus", True) == [2, 4, 3, 1] and order("pool", False) == [4, 2, 3, 1]


def test_barred_combinations_are_looked_up_and_not_carried(spark, monkeypatch):
    states, pick = [], portfolio.pick
    monkeypatch.setattr(portfolio, "pick", lambda state, *a: states.append(state) or pick(state, *a))
    h = History(spark.createDataFrame([("g", t, [1 + t % 9, 10 + t % 5, 16 + t % 4]) for t in range(50)], "game string, t long, sorted array<int>"), K, D, 4)
    scores = spark.createDataFrame([("g", n, 1.0 + n % 3) for n in range(1, K + 1)], "game string, n int, score double")
    picks = spark.createDataFrame([("g", 1, 2, 0.4)], "game string, place int, n int, probability double")
    rows = portfolio.built(scores, picks, h, 2, barred=h.draws, tries=30).where("kind <> 'quick'").collect()
    assert len(rows) == 4 and not {tuple(r.numbers) for r in rows} & {tuple(r.sorted) for r in h.draws.collect()}
    assert len(states) == 3 and all("barred" not in s.columns for s in states)


def test_bonus_evaluation_by_blocks_as_by_tables(spark, monkeypatch):
    monkeypatch.setattr(bonus, "BLOCK", 16)
    fair = generated.fair(spark, 130, games=2)
    special = F.when((F.col("t") % 11 != 5) & ((F.col("game") == "fair0") | (F.col("t") < 25)), (F.pmod(F.xxhash64("game", "t"), F.lit(6)) + 1).cast("int"))
    h = History(cut(fair.draws.withColumn("special", special)), fair.k, fair.d, 6)  # the second game has no draw to judge
    rows = cut(bonus.raw(h))
    tested = rows.where("hit is not null and t >= 30")
    z = signals.normalised(tested.unionByName(rows.where("hit is null and game = 'fair0'")).select("game", F.col("s").alias("t"), "n", "hit", *bonus.KEYS), bonus.KEYS)
    values = cut(signals.long(z, bonus.KEYS))
    hits, weighted, ranked = learn.evaluated(values.where("hit is not null"), 0.5, 3)
    with monkeypatch.context() as m:
        m.setattr(signals, "long", lambda *a: pytest.fail("no row for each number and signal"))
        got = bonus.backtest(h)
    same = lambda a, b: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.select(*b.columns).collect()) == sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect())
    assert same(got["signals"], learn.performance(hits, weighted, 0.5)) and got["signals"].count() == 5
    assert same(got["ranks"], learn.calibrated(ranked, 1 / 6, 25.0))
    best = {}
    for r in ranked.where("rank <= 3").join(tested.select("game", F.col("s").alias("t"), "n", F.col("t").alias("at")), ["game", "t", "n"]).collect():
        best.setdefault(r["at"], {})[r["rank"]] = (r.n, r.hit)
    points = {r.t: r for r in got["points"].collect()}
    assert points.keys() == best.keys() and all(p.picks == [best[t][i][0] for i in (1, 2, 3)] and p.top1 == best[t][1][1] and p.top3 == sum(x[1] for x in best[t].values()) for t, p in points.items())
    score = values.where("hit is null").join(weighted, ["game", "t", "key"]).groupBy("n").agg(F.round(F.sum(F.col("weight") * F.col("value")), 12).alias("s")).orderBy(F.col("s").desc(), "n").limit(4)
    facts = {r.n: r for r in rows.where("hit is null and game = 'fair0'").collect()}
    assert [(r.n, r["count"], r.since) for r in got["picks"].orderBy("place").collect()] == [(r.n, facts[r.n]["count"], facts[r.n].since) for r in score.collect()]


def test_the_walk_says_what_tables_say(spark, monkeypatch):
    monkeypatch.setattr(learn, "WALKED", 48)
    h = generated.planted(spark, 130)
    h = History(cut(h.draws), h.k, h.d, h.ks)
    ahead = signals.next_draw(h).select("game", "t", "dow")
    z = cut(signals.normalised(signals.raw(h, h.draws.where("t >= 30").select("game", "t", "dow").unionByName(ahead))).select("game", "t", "n", "hit", *signals.KEYS))
    # the signals, number by number
    rows = sorted(h.draws.collect(), key=lambda r: r.t)
    hit = np.array([[n in r.sorted for n in range(1, h.k + 1)] for r in rows] + [[False] * h.k], dtype=float)
    t, dow, drawn = np.arange(131), np.array([*[r.dow for r in rows], ahead.first().dow]), np.arange(131) < 130
    past = signals.Past(h.k, h.d)
    got = learn.deviations(np.concatenate([past.signals(t[a : a + 50], dow[a : a + 50], hit[a : a + 50], drawn[a : a + 50]) for a in (0, 50, 100)]))
    for r in z.collect():
        for i, key in enumerate(signals.KEYS):
            assert abs(got[r.t, r.n - 1, i] - r[key]) < 1e-6, (key, r.t, r.n, got[r.t, r.n - 1, i], r[key])
    # their evaluation, with the learned combination
    both = cut(z.join(learn.gradient_scores(h, z), ["game", "t", "n"]))
    with monkeypatch.context() as m:
        m.setattr(signals, "raw", lambda *a: pytest.fail("no row for each number"))
        out = learn.backtest(h)
        model = {r.n: r.mlModel for r in out["model"].collect()}
        points, worth, ranks, nats = (out[x].collect() for x in ("points", "signals", "ranks", "nats"))
    assert all(abs(model[r.n] - r.mlModel) < 1e-6 for r in both.where("hit is null").collect()) and len(model) == h.k
    seen = both.where("hit is not null")
    hits, weighted, ranked = learn.evaluated(signals.long(seen, [*signals.KEYS, learn.ML_KEY]), 10 * h.d / h.k, 10)
    want = {r.key: r for r in learn.performance(hits, weighted, 10 * h.d / h.k).collect()}
    assert len(worth) == 20 and all(abs(r[c] - want[r.key][c]) < 1e-6 for r in worth for c in ("mean_hits", "evaluated", "skill", "weight"))
    assert {(r["rank"], r.hits, r.evaluated) for r in ranks} == {(r["rank"], r.hits, r.evaluated) for r in learn.calibrated(ranked, h.d / h.k, 30.0).collect()}
    best = {r.t: r.p for r in ranked.where("rank <= 10").groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n"))), lambda x: x["n"]).alias("p")).collect()}
    assert {r.t: r.predicted for r in points} == best and all(r.hits10 == len(set(r.predicted) & set(rows[r.t].sorted)) for r in points)
    r = learn.skill_nats(seen, h.k).first()
    assert nats[0].draws == r.draws == 100 and abs(nats[0].nats - r.nats) < 1e-9


def test_similarity_looks_back_so_far_and_no_further():
    rng, k, d, back = np.random.default_rng(3), 20, 3, 40
    draws = [set((rng.choice(k, d, replace=False) + 1).tolist()) for _ in range(150)]
    hit, dow = np.array([[float(n in s) for n in range(1, k + 1)] for s in draws]), rng.integers(0, 7, 150)
    past = signals.Past(k, d, back, 5)
    got = np.concatenate([past.signals(np.arange(a, a + 30), dow[a : a + 30], hit[a : a + 30], np.ones(30, bool)) for a in range(0, 150, 30)])[:, :, signals.KEYS.index("similarity")]
    for t in range(8, 150):
        like = lambda u: round(0.55 * len(draws[t - 1] & draws[u - 1]) / d + 0.2 * (dow[t] == dow[u]) + 0.25 * max(0, 1 - abs(sum(draws[t - 1]) - sum(draws[u - 1])) / 50), 9)  # noqa: B023, E731
        best = sorted((-like(u), u) for u in range(max(1, t - back), t))[:5]
        whole = -sum(s for s, _ in best)
        assert all(abs(got[t, n - 1] - sum(-s for s, u in best if n in draws[u]) / whole) < 1e-7 for n in range(1, k + 1)), t
