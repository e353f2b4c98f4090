"""Bands, rules, modes and reductions against plain loops over small histories."""

import math
from itertools import combinations as choices
from math import comb

import pytest
from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.functions import shapes
from drawlens.history import History
from drawlens.operators import bands, combinations, constraints, reduction
from drawlens.sources import generated


@pytest.fixture(scope="module")
def fair(spark):
    h = generated.fair(spark, 400, games=1)
    return History(cut(h.draws), h.k, h.d, h.ks)


@pytest.fixture(scope="module")
def lab(spark, fair):
    universe, tested = cut(constraints.sample_universe(spark, fair.k, fair.d, n=600)), constraints.steps(fair)
    rules = cut(constraints.rules(fair, universe, tested))
    return universe, tested, rules, cut(constraints.modes(fair, universe=universe, tested=tested, all_rules=rules))


def plain_bands(values, base, top, tails):
    """The bands before each value and after the last, draw by draw over the whole histogram."""
    room, counts, out = top - base + 2, [0] * (top - base + 2), []
    for n, v in enumerate([*values, None]):
        row = []
        for a in tails:
            upto, lo, hi = 0, None, None
            for b in range(room):
                upto += counts[b]
                mass, grand = bands.UNIT * (upto * room + b + 1), (n + 1) * room
                lo = b if lo is None and mass > a * grand else lo
                hi = b if hi is None and mass >= (bands.UNIT - a) * grand else hi
            lo, hi = sorted((base + lo, base + hi))
            row.append((max(base, lo), min(top, hi)) if n else (base, top))
        out.append(row)
        if v is not None:
            counts[math.floor(v + 0.5) - base] += 1
    return out


@pytest.mark.parametrize("size", [16, 256])
def test_bands_as_a_fold(fair, size):
    tails = [5, 100, 300, 2500]
    values = cut(constraints.long(constraints.measured(fair)))
    got = bands.asof(values, fair.k, fair.d, tails, size).collect()
    whole = {r.feature: r for r in bands.whole(values, fair.k, fair.d, {f"x{i}": a for i, a in enumerate(tails)}).collect()}
    limits = shapes.bounds(fair.k, fair.d)
    assert {r.feature for r in got} == set(limits)
    for feature, (base, top) in limits.items():
        rows = sorted((r.t, r.v, [(b.lo, b.hi) for b in r.bands]) for r in got if r.feature == feature)
        assert [b for _, _, b in rows] == plain_bands([v for _, v, _ in rows[:-1]], base, top, tails), feature
        assert rows[-1][2] == [(whole[feature][f"x{i}_lo"], whole[feature][f"x{i}_hi"]) for i in range(len(tails))]


def test_rules_against_plain_loops(fair, lab):
    universe, tested, rules, _ = lab
    rows = constraints.by_rule(tested).where("feature in ('sum', 'dOdd', 'overlap10', 'sd') and alpha = 0.03").collect()
    draws = [r.sorted for r in fair.draws.orderBy("t").collect()]
    space = [r.sorted for r in universe.collect()]
    odd = lambda s: sum(x % 2 for x in s)
    sd = lambda s: math.sqrt(sum((x - sum(s) / 5) ** 2 for x in s) / 5)
    near = lambda x: math.floor(x + 0.5)
    law = lambda m, o: comb(m, o) * comb(69 - m, 5 - o) / comb(69, 5)
    share = {
        "sum": lambda t, lo, hi: sum(lo <= sum(s) <= hi for s in space) / len(space), "sd": lambda t, lo, hi: sum(lo <= near(sd(s)) <= hi for s in space) / len(space),
        "dOdd": lambda t, lo, hi: sum(lo <= odd(s) - odd(draws[t - 1]) <= hi for s in space) / len(space), "overlap10": lambda t, lo, hi: sum(law(len(set().union(*draws[t - 10 : t])), o) for o in range(lo, hi + 1)),
    }
    for rule in rules.where("feature in ('sum', 'dOdd', 'overlap10', 'sd') and alpha = 0.03").collect():
        own = sorted((r for r in rows if r.feature == rule.feature and r.v is not None), key=lambda r: r.t)
        held = [r.lo <= r.v <= r.hi for r in own]
        assert rule.steps == len(own) == 280 and abs(rule.survival - sum(held) / 280) < 1e-12
        assert abs(rule.recent_100 - sum(held[-100:]) / 100) < 1e-12 and abs(rule.first_half - sum(held[:140]) / 140) < 1e-12
        assert abs(rule.stability - (sum(held[140:]) - sum(held[:140])) / 140) < 1e-12
        want = sum(share[rule.feature](r.t, r.lo, r.hi) for r in own) / 280
        assert abs(rule.share - want) < 1e-9
        assert abs(rule.edge_z - (rule.survival - want) / math.sqrt(max(1e-12, want * (1 - want) / 280))) < 1e-6
    every = rules.orderBy("place").collect()
    assert len(every) == 136 and [r.place for r in every] == list(range(1, 137))
    assert all(r.usable >= s.usable for r, s in zip(every, every[1:], strict=False)) and not any(r.usable for r in every if r.feature in bands.CONDITIONAL)
    assert sum(r.proven for r in every) < 12  # of 136 on fair draws


def test_modes_against_plain_greedy(fair, lab):
    universe, tested, rules, modes = lab
    top = sorted((r for r in rules.collect() if r.usable), key=lambda r: (round(r.share, 9), r.feature, r.alpha))[:40]
    past = {}
    for r in constraints.by_rule(tested).where("v is not null").collect():
        past.setdefault((r.feature, r.alpha), {})[r.t - 120] = r.held
    cols = shapes.features(F.col("sorted"), fair.k, fair.d)
    space = universe.orderBy("id").select(*[c.cast("double").alias(n) for n, c in cols.items()]).collect()
    steps = {(r.feature, r.alpha): [past[r.feature, r.alpha][i] for i in range(140)] for r in top}
    inside = {(r.feature, r.alpha): [r.lo <= s[r.feature] <= r.hi for s in space] for r in top}
    for floor in constraints.MODES:
        ok, left, taken, keep0, room0 = [True] * 140, [True] * len(space), [], 1.0, 1.0
        while True:
            best = None
            for i, r in enumerate(top):
                name = (r.feature, r.alpha)
                if name in taken:
                    continue
                keep = sum(a and b for a, b in zip(ok, steps[name], strict=True)) / 140
                room = sum(a and b for a, b in zip(left, inside[name], strict=True)) / len(space)
                if keep >= floor and room0 - room > 1e-6:
                    gain = round((room0 - room) / max(1e-4, keep0 - keep), 9)
                    if best is None or gain > best[0]:
                        best = (gain, name, keep, room)
            if best is None:
                break
            _, name, keep0, room0 = best
            taken.append(name)
            ok, left = [a and b for a, b in zip(ok, steps[name], strict=True)], [a and b for a, b in zip(left, inside[name], strict=True)]
        got = modes.where(F.col("mode") == floor).orderBy("place").collect()
        assert [(r.feature, r.alpha) for r in got] == taken
        if got:
            assert abs(got[-1].survival - keep0) < 1e-12 and abs(got[-1].share - room0) < 1e-12


def test_mode_report_and_frontier(fair, lab):
    universe, tested, rules, modes = lab
    steps = {}
    for r in constraints.by_rule(tested).where("v is not null").collect():
        steps[r.feature, r.alpha, r.t - 120] = r
    cols = shapes.features(F.col("sorted"), fair.k, fair.d)
    space = universe.select(*[c.cast("double").alias(n) for n, c in cols.items()]).collect()

    def left(names, at):
        return sum(all(steps[n, a, at].lo <= s[n] <= steps[n, a, at].hi for n, a in names) for s in space) / len(space)

    for r in constraints.mode_report(fair, modes, universe, tested).collect():
        names = [(x.feature, x.alpha) for x in modes.where(F.col("mode") == r.mode).orderBy("place").collect()]
        ok = [all(steps[n, a, i].held for n, a in names) for i in range(280)]
        assert r.rules == len(names) and r.broken == 280 - sum(ok) and abs(r.survival - sum(ok) / 280) < 1e-12
        assert abs(r.holdout_survival - sum(ok[140:]) / 140) < 1e-12 and r.holdout_draws == 140
        stride = max(1, math.floor(280 / 450 + 0.5), math.floor(280 * len(names) / 3000 + 0.5))
        first, second = [left(names, i) for i in range(0, 140, stride)], [left(names, i) for i in range(140, 280, stride)]
        assert abs(r.share - (sum(first) + sum(second)) / (len(first) + len(second))) < 1e-9
        p = sum(second) / len(second)
        assert abs(r.holdout_edge_z - (r.holdout_survival - p) / math.sqrt(max(1e-12, p * (1 - p) / 140))) < 1e-6
    points = {r.rules: r for r in constraints.frontier(fair, universe, tested, rules).collect()}
    assert sorted(points) == list(range(13)) and points[0].share == 1 and points[0].survival == 1
    for r in points.values():
        assert r.dominated == any(q.survival >= r.survival and q.share < r.share for q in points.values())
    lost = constraints.eliminated(fair, modes, tested).where("mode = 0.68").orderBy("place").collect()
    assert len(lost) <= 25 and all(a.t < b.t for a, b in zip(lost, lost[1:], strict=False))


def test_ranks_and_pruned_members(spark):
    for k, d in ((9, 3), (12, 5), (7, 1)):
        every = combinations.subsets(spark, k, d).select("sorted", reduction.rank_of(F.col("sorted"), d).alias("r")).withColumn("back", reduction.unranked(F.col("r"), k, d)).collect()
        assert sorted(x.r for x in every) == list(range(comb(k, d))) and all(x.back == x.sorted for x in every)
    space = [list(c) for c in choices(range(1, 15), 4)]
    for bound in (9, 10, 23, 50, 51, 99):
        assert sorted(r.sorted for r in reduction.sums_at_most(spark, 14, 4, bound).collect()) == [c for c in space if sum(c) <= bound]
        assert sorted(r.sorted for r in reduction.sums_at_least(spark, 14, 4, bound).collect()) == [c for c in space if sum(c) >= bound]
    touching = lambda c: sum(b - a == 1 for a, b in zip(c, c[1:], strict=False))
    for pairs in (0, 1, 2, 3):
        assert sorted(r.sorted for r in reduction.touching_at_least(spark, 14, 4, pairs).collect()) == [c for c in space if touching(c) >= pairs]
    assert reduction.touching_at_least(spark, 69, 5, 3).count() == 8385


@pytest.mark.parametrize(("k", "d"), [(30, 4), (33, 5)])
def test_families_made_by_group_equal_a_scan(spark, k, d):
    members = reduction.family_members(spark, k, d)
    assert members.groupBy("family", "rank").count().where("count > 1").count() == 0
    got = {}
    for r in members.collect():
        got.setdefault(r.family, set()).add(tuple(r.sorted))
    tests = shapes.families(F.col("sorted"), k, d)
    low = (F.element_at("sorted", d - 1) <= 5) | (F.element_at("sorted", d) <= 9)
    rows = combinations.subsets(spark, k, d).select("sorted", *[tests[n].alias(n) for n in constraints.CUTS], low.alias("low")).collect()
    for name in [*constraints.CUTS, "low"]:
        assert got.get(name, set()) == {tuple(r.sorted) for r in rows if r[name]}, name


def test_ledger_against_a_scan(spark):
    k, d, bonus = 20, 4, 3
    rows = [("g", t, sorted([1 + t * 7 % 20, 1 + (t * 3 + 5) % 20, 1 + (t * 11 + 9) % 20, 1 + (t * t + 13) % 20])) for t in range(80)]
    rows = [(g, i, s) for i, (g, _, s) in enumerate(r for r in rows if len(set(r[2])) == 4)]
    h = History(spark.createDataFrame(rows, "game string, t long, sorted array<int>"), k, d, bonus)
    mode = spark.createDataFrame([("g", 0.9, "pos1", 1, 6), ("g", 0.9, "sum", 20, 60), ("g", 0.9, "sum", 25, 70)], "game string, mode double, feature string, lo int, hi int")
    worth = spark.createDataFrame([("g", 0.9, 0.8, 7)], "game string, mode double, share double, broken long")
    drawn = [tuple(s) for _, _, s in rows]
    least, most = min(map(sum, drawn)), max(map(sum, drawn))
    tests = shapes.families(F.col("sorted"), k, d)
    family = {tuple(r.sorted) for r in combinations.subsets(spark, k, d).where(" or ".join(["false"])).collect()}
    for r in combinations.subsets(spark, k, d).select("sorted", *[tests[n].alias(n) for n in constraints.CUTS]).collect():
        if any(r[n] for n in constraints.CUTS) or r.sorted[-2] <= 5 or r.sorted[-1] <= 9:
            family.add(tuple(r.sorted))
    for m, w, inside in ((None, None, lambda c: True), (mode, worth, lambda c: c[0] <= 6 and 25 <= sum(c) <= 60)):
        count = {2: 0, 3: 0, 4: 0}
        for c in choices(range(1, k + 1), d):
            place = 2 if c in set(drawn) else 3 if c in family else 4 if sum(c) <= least or sum(c) >= most else None
            if place and inside(c):
                count[place] += bonus
        got = {r.place: r for r in reduction.ledger(h, m, w).collect()}
        assert {p: r.removed for p, r in got.items() if p > 1} == count
        assert got[2].cost == len(drawn) - len(set(drawn)) and got[3].cost == sum(c in family for c in drawn) and got[4].cost == sum(sum(c) in (least, most) for c in drawn)
        start = comb(k, d) * bonus
        if m is not None:
            assert got[1].removed == round(start * 0.2) and got[1].cost == 7
        assert got[4].remaining == start - sum(r.removed for r in got.values())


def test_steps_are_kept_by_blocks_and_modes_are_chosen_without_the_driver(fair, lab, monkeypatch):
    _, tested, rules, modes = lab
    assert tested.count() == 34 and constraints.by_rule(tested).count() == 34 * 4 * (400 - constraints.WARM_UP + 1)  # a row for each feature and block, not for each draw
    some = rules.where("place <= 2").select("game", "feature", "alpha", "place")
    assert constraints.by_rule(tested, some).select("feature", "alpha", "place").distinct().count() == 2
    monkeypatch.setattr(type(fair.draws), "collect", lambda self: pytest.fail("rows go to the driver"))
    constraints.modes(fair, universe=lab[0], tested=tested, all_rules=rules)
