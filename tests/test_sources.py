"""Reading, merging and writing draws, and streams of them."""

import datetime
import json

from pyspark.sql import functions as F

from drawlens.sources import table, text
from drawlens.streaming import growing, state

LINES = ["Date | Day | N1 | N2 | N3 | N4 | N5", *[f"2024-01-{d:02d} | Mon | {d} | {d + 10} | {d + 20} | {d + 30} | {d + 38}" for d in range(1, 15)]]


def test_pasted_lines(spark):
    draws, errors = text.from_lines(spark, LINES, "g")
    assert draws.count() == 14 and errors.count() == 1  # the header row holds no date
    r = draws.orderBy("date").first()
    assert (r.date, r.dow, r.sorted) == (datetime.date(2024, 1, 1), 1, [1, 11, 21, 31, 39])


def test_csv_file_with_jackpots_and_bad_rows(spark, tmp_path):
    rows = ["date,n1,n2,n3,n4,n5,Pball,jackpot,winner location"]
    rows += [f"{d}/1/2024,{d},{d + 11},{d + 22},{d + 33},{d + 44},{d % 20 + 1},${d}.5 million,\"Town, {d}\"" for d in range(1, 21)]
    rows += ["21/1/2024,5,5,6,7,8,1,,", "x,1,2,3,4,5,6,,", "22/1/2024,1,2,z,4,5,6,,"]
    (tmp_path / "a.csv").write_text("\n".join(rows))
    draws, errors = text.read_delimited(spark, str(tmp_path / "a.csv"), "g")
    assert draws.count() == 20
    assert {r.error for r in errors.collect()} == {"a number comes twice", "no date", "a number is missing"}
    r = draws.where("date = '2024-01-03'").first()
    assert (r.special, r.jackpot, r.winner_location, r.numbers) == (4, 3.5e6, "Town, 3", [3, 14, 25, 36, 47])


def test_bonus_by_value():
    lines = [f"2024-02-{d:02d},{d},{d + 10},{d + 20},{d + 30},{d + 40},{(d * 7) % 19 + 1}" for d in range(1, 12)]
    layout = text.sniff(lines)
    assert layout.bonus == 6 and layout.numbers == [1, 2, 3, 4, 5] and not layout.header


def test_open_data_and_history_round_trip(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00", "1 2 3 4 5 6", None), ("2024-01-03", "9 8 7 6 6 1", None), ("bad", "1 2 3 4 5 6", None), (None, None, None)], "draw_date string, winning_numbers string, mega_ball string")
    draws = text.open_data(rows, "g", packed=True)
    assert [(r.sorted, r.special) for r in draws.collect()] == [([1, 2, 3, 4, 5], 6)]
    back = text.decode_history(text.encode_history(draws), "g")
    assert [r.asDict() for r in back.collect()] == [r.asDict() for r in draws.select(*back.columns).collect()]
    assert json.loads(text.encode_history(draws).first().row) == ["2024-01-01", "1", "2", "3", "4", "5", "6", "0", ""]
    assert text.decode_history(spark.createDataFrame([("nonsense",), ("[]",), (None,)], "row string"), "g").count() == 0


def test_merge_fills_and_adds(spark):
    a = text.from_lines(spark, LINES, "g")[0]
    b = a.withColumn("jackpot", F.lit(5.0)).unionByName(a.limit(1).withColumn("date", F.lit(datetime.date(2030, 1, 1))))
    m = text.merge(a, b)
    assert m.count() == 15 and m.where("added").count() == 1 and m.where("jackpot = 5.0").count() == 14
    again = text.merge(m.drop("added"), b)
    assert again.where("added").count() == 0 and again.count() == 15


def test_pages(spark):
    html = '<div id="next-drawing" data-drawdateutc="2024-01-04T03:59:00Z"><span class="game-jackpot-number">$1.2 Billion</span> cash $500.5 Million</div><div id="winning-numbers">$9 Million</div>'
    r = text.jackpot_pages(spark.createDataFrame([("p", html), ("q", "nothing")], "game string, html string")).collect()
    assert [(x.game, x.draw_date, x.jackpot, x.cash_value) for x in r] == [("p", datetime.date(2024, 1, 3), 1.2e9, 500.5e6)]
    body = json.dumps({"d": json.dumps({"Jackpot": {"NextPrizePool": 2e7, "NextCashValue": 1e7}, "NextDrawingDate": "2024-01-05T23:00:00"})})
    r = text.jackpot_payloads(spark.createDataFrame([("m", body), ("n", "{}")], "game string, body string")).collect()
    assert [(x.draw_date, x.jackpot) for x in r] == [(datetime.date(2024, 1, 5), 2e7)]


def test_streamed_merge(spark, tmp_path):
    draws = text.from_lines(spark, LINES, "g")[0]
    for part in (draws.where("day(date) < 8"), draws.where("day(date) >= 5")):
        part.write.mode("append").json(str(tmp_path / "in"))
        growing.merged_into(growing.follow(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert growing.current(spark, str(tmp_path / "table")).count() == 14


def test_stateful_counters(spark, tmp_path):
    text.from_lines(spark, LINES, "g")[0].write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = state.counted(growing.follow(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counters").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("counters").where("n = 31").first()
    assert (r.hits, r.draws) == (2, 14)


def lines_of(spark, lines, **more):
    return table.imported(spark.createDataFrame([(x,) for x in lines], "line string"), lines[:12], "g", **more)


def test_layout_is_found_from_all_rows(spark, tmp_path):
    # The first 12 rows show neither the order of days and months nor the bonus; most rows do.
    rows = [f"{1 + i % 12}/{1 + i % 12}/2023,{i % 7 + 1},{i % 7 + 12},{i % 7 + 23},{i % 7 + 34},{i % 7 + 52},{i % 7 + 60}" for i in range(12)]
    rows += [f"{13 + i % 15}/{1 + i % 12}/20{10 + i % 12},{1 + i % 7},{12 + i % 7},{23 + i % 7},{34 + i % 7},{45 + i % 7},{i % 19 + 1}" for i in range(60)]
    draws, errors, facts = lines_of(spark, rows)
    f = facts.first()
    assert (f.day_first, f["size"], f.has_bonus) == (True, 6, False)  # the first rows' last column is too large for a bonus
    draws, errors, facts = lines_of(spark, rows[12:])
    f = facts.first()
    assert (f.day_first, f["size"], f.has_bonus, f.errors) == (True, 5, True, 0) and draws.where("special is null").count() == 0
    assert lines_of(spark, rows[12:], bonus="no")[2].first()["size"] == 6 and lines_of(spark, rows[12:], size=4, bonus="no")[2].first().extra == 60
    text_ = "\n".join(rows[12:40]) + "\r" + "\r\n".join(rows[40:])
    (tmp_path / "x.csv").write_text(text_)
    assert table.read(spark, str(tmp_path / "x.csv"), "g")[2].first().rows == 60


def test_malformed_rows(spark):
    lines = ["A title", "Draw Date,Day,n1,n2,n3,n4,n5,pb_ball,Power Play Multiplier,Jackpot,jackpot_win_loc"]
    good = [f"2024-03-{d:02d},{datetime.date(2024, 3, d):%a},{d},{d + 10},{d + 20},{d + 30},{d + 38},{d % 20 + 1},{d % 5 + 2},$2{d} million,N/A" for d in range(1, 20)]
    bad = ['2024-04-01,Mon,1,2,3,4,5,6,2,$20 million,"Smith\'s 6"" Grocery, Ohio"', "2024-04-02,Wed,7,8,9,10,11,12", "2024-04-03,,10,20*,30,40,50,6,2,,", "2024-04-04,Thu,1,2,3", "not a date,,1,2,3,4,5,6", ",,1,2,3,4,5,6", "2024-04-05,Fri,x,2,3,4,5,6,2,,", "2024-04-06,Sat,1,2,3,4,5,6,3,,late,text", good[0]]
    draws, errors, facts = lines_of(spark, [*lines, *good, *bad])
    assert sorted(r.error for r in errors.collect()) == ["no date", "not a number", "text between numbers", "too few numbers"]
    f = facts.first()
    assert (f["size"], f.has_bonus, f.repeated, f.wrong_day) == (5, True, 1, 1) and draws.count() == 22
    r = draws.where("date = '2024-04-01'").first()
    assert (r.sorted, r.special, r.jackpot) == ([1, 2, 3, 4, 5], 6, 2e7) and r.winner_location.startswith("Smith's 6")
    assert draws.where("date = '2024-03-05'").first().jackpot == 25e6 and draws.where("winner_location is not null").count() <= 2
    empty = lines_of(spark, ["", " "])
    assert empty[0].count() == 0 and empty[2].first().rows == 0


def test_of_repeated_rows_the_least_line_stays(spark):
    head = ["Date,N1,N2,N3,N4,N5,Bonus,Jackpot"]
    rows = [f"2021-03-{1 + i % 28:02},{1 + i},{10 + i},{20 + i},{30 + i},{40 + i},{1 + i % 9},${amount}" for i in range(12) for amount in (900, 400, 700)]
    for order in (rows, rows[::-1]):
        lines = spark.createDataFrame([(x,) for x in [*head, *order]], "line string").repartition(5)
        draws, errors, facts = table.imported(lines, [*head, *rows[:5]], "g")
        assert [r.jackpot for r in draws.collect()] == [400.0] * 12 and errors.count() == 0 and facts.first().repeated == 24
