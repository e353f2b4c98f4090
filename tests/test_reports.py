"""Reports and small functions against plain versions."""

import datetime

import pytest
from pyspark.sql import functions as F

from drawlens.functions import dates, odds
from drawlens.history import History
from drawlens.operators import reports
from drawlens.sources import generated, text


@pytest.fixture(scope="module")
def fair(spark):
    h = generated.fair(spark, 300, games=2)
    return History(h.draws.persist(), h.k, h.d, h.ks)


def test_ticket_lab_against_plain_loops(spark, fair):
    rows = fair.draws.select("game", "t", "sorted", "special").orderBy("game", "t").collect()
    some = rows[17].sorted
    held = [("fair1", 1, list(some)[::-1], 3), ("fair1", 2, [1, 2, 3, 4, 5], None), ("fair1", 3, [1, 2, 3, 4, 5], 4), ("fair0", 4, [7, 20, 33, 50, 69], 900)]
    out = {r.ticket: r for r in reports.ticket_lab(spark.createDataFrame(held, "game string, ticket int, numbers array<int>, special int"), fair).collect()}
    assert len(out) == 4
    for game, ticket, numbers, special in held:
        own = [r for r in rows if r.game == game]
        r = out[ticket]
        shared = [len(set(x.sorted) & set(numbers)) for x in own]
        assert r.total == sum(numbers)
        assert abs(r.total_below - sum(sum(x.sorted) < sum(numbers) for x in own) / len(own)) < 1e-12
        odd = lambda a: sum(v % 2 for v in a)
        assert abs(r.odd_share - sum(odd(x.sorted) == odd(numbers) for x in own) / len(own)) < 1e-12
        assert r.pair_total == sum(m * (m - 1) // 2 for m in shared)
        assert r.best_overlap == max(shared) and r.three_up == sum(m >= 3 for m in shared)
        assert r.best_t == [x.t for x, m in zip(own, shared, strict=True) if m == max(shared)][:3]
        assert r.special_count == (None if special is None else sum(x.special == special for x in own))


def test_ticket_that_shares_nothing(spark):
    draws = spark.createDataFrame([("g", t, [1, 2, 3], 1, 0) for t in range(5)], "game string, t long, sorted array<int>, special int, dow int")
    r = reports.ticket_lab(spark.createDataFrame([("g", 1, [7, 8, 9], 1)], "game string, ticket int, numbers array<int>, special int"), History(draws, 12, 3, 4)).first()
    assert (r.best_overlap, r.best_t, r.pair_total, r.three_up, r.total_below, r.special_count) == (0, [0, 1, 2], 0, 0, 1.0, 5)


def test_slice_floors_against_plain_loops(fair, monkeypatch):
    monkeypatch.setattr(reports, "BLOCK", 64)
    rows = fair.draws.select("game", "t", "dow", "sorted").orderBy("t").collect()
    keys = {"pooled": lambda r: 0, "decade": lambda r: (r.sorted[0] - 1) // 10, "odd": lambda r: sum(v % 2 for v in r.sorted), "weekday": lambda r: r.dow}
    for r in reports.slice_floors(fair).where("slice <> 'bonus'").collect():
        facts = {}
        for name in ("pooled", r.slice):
            floor, broke, chances = {}, 0, 0
            for x in rows:
                if x.game == r.game:
                    k, v = keys[name](x), sum(x.sorted)
                    chances, broke = chances + (k in floor), broke + (k in floor and v < floor[k])
                    floor[k] = min(v, floor.get(k, v))
            facts[name] = (len(floor), chances, broke)
        assert (r.groups, r.chances, r.broke) == facts[r.slice]
        pooled = facts["pooled"][2] / facts["pooled"][1]
        assert abs(r.pooled_rate - pooled) < 1e-12
        assert r.rejected == (r.chances >= 100 and r.groups >= 2 and r.broke / r.chances > 1.5 * pooled)


def test_point_summary(spark, monkeypatch):
    monkeypatch.setattr(reports, "BLOCK", 4)
    hits = [0, 2, 1, 3, 0, 3, 1]
    points = spark.createDataFrame([("g", 30 + i, x, 1) for i, x in enumerate(hits)] + [("none", 30, 0, 0)], "game string, t long, hits10 long, baseline10 long")
    out = {r.game: r for r in reports.point_summary(points, recent=2).collect()}
    r = out["g"]
    assert (r.points, r.best, r.times, r.last_t, r.late10, r.late_baseline, r.recent10) == (7, 3, 2, 35, 7 / 4, 1.0, 2.0)
    assert (out["none"].best, out["none"].times, out["none"].last_t) == (0, 0, None)


def test_replay_reasons(spark):
    verdicts = [("g", True, None), ("g", False, "low"), ("g", False, "drawn"), ("g", False, "low"), ("kept", True, None)]
    out = reports.replay_reasons(spark.createDataFrame(verdicts, "game string, kept boolean, cut_by string")).orderBy("game", "place").collect()
    assert [(r.game, r.place, r.cut_by, r.draws, r.judged, r.held, r.held_rate) for r in out] == [("g", 1, "low", 2, 4, 1, 0.25), ("g", 2, "drawn", 1, 4, 1, 0.25), ("kept", 1, None, 0, 1, 1, 1.0)]


def test_empty_history(spark):
    empty = History(generated.fair(spark, 10, games=1).draws.where("false"))
    for f in (reports.companions, reports.calendar_rate, reports.slice_floors, reports.standing):
        assert f(empty).count() == 0


def test_texts(spark):
    row = spark.range(1).select(
        *[dates.money_text(F.lit(x)).alias(f"m{i}") for i, x in enumerate((1.254e9, 2.05e7, 1.5e8, 7400.0, 12.0))], dates.money_text(F.lit(2.05e9), words=True).alias("w"), dates.long_date(F.lit("2024-03-05").cast("date")).alias("d"),
        dates.days_since(F.lit("2024-03-05").cast("date"), F.lit("2024-03-06 12:00:00").cast("timestamp")).alias("s"), dates.days_since(F.lit(None).cast("date"), F.current_timestamp()).alias("never"),
        *[odds.edge_text(F.lit(p), 0.1).alias(f"e{i}") for i, p in enumerate((0.102, 0.12, 0.08))],
    ).first()
    assert list(row) == ["$1.25B", "$20.5M", "$150M", "$7K", "$12", "$2.05 Billion", "Mar 5, 2024", 1.5, float("inf"), "about chance", "+20% vs chance", "-20% vs chance"]
    assert abs(odds.position_interval(20, 4, 2, -3, 99) - 1) < 1e-12


def test_entries_and_published_histories(spark):
    typed = [([5, 1, 9], 3), ([5, 1], 3), ([5, None, 9], 3), ([5, 1, 99], 3), ([5, 5, 9], 3), ([5, 1, 9], None), ([5, 1, 9], 16)]
    df = spark.createDataFrame(typed, "numbers array<int>, special int").coalesce(1)
    found = [r[0] for r in df.select(text.entry_problem(F.col("numbers"), F.col("special"), 3, 20, True, 10)).collect()]
    assert found == [None, "another count of numbers", "a number is missing", "a number is above the pool", "a number comes twice", "the bonus number is missing", "the bonus number is too large"]
    day = datetime.date(2024, 1, 1)
    table = lambda *rows: spark.createDataFrame([(g, day, n) for g, n in rows], "game string, date date, numbers array<int>")
    old, built = table(("a", [1, 2]), ("a", [2, 1]), ("b", [3, 4])), table(("a", [9, 10]), ("b", [5, 6]), ("c", [7, 8]))
    assert sorted((r.game, r.numbers) for r in text.published(old, built).collect()) == [("a", [1, 2]), ("a", [2, 1]), ("b", [5, 6]), ("c", [7, 8])]
    assert {r.game: r.ascending for r in text.ascending_games(old).collect()} == {"a": False, "b": True}
