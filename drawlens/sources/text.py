"""Draws from delimited text, JSON rows and pages, and back to text.

A cell that holds no draw never fails a job: rows are split into draws and errors.
"""

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlens.functions.dates import date_of, instant, money

DELIMITERS = [",", "\t", ";", "|"]


@dataclass
class Layout:
    """Where things stand in a row: the separator, whether there is a header, columns by place, and how many main numbers there are."""

    separator: str
    header: bool
    date: int
    numbers: list[int]
    bonus: int | None
    jackpot: int | None
    location: int | None


def sniff(lines: list[str], bonus: str = "auto") -> Layout:
    """The layout of a file, from its first lines (a bounded sample). Separator: the candidate with the highest median count; header: the first row with two cells of words; the rest
    by the header's names, or else by values."""
    some = [x for x in lines if x.strip()][:12]
    median = lambda c: sorted(x.count(c) for x in some)[len(some) // 2] if some else 0
    separator = max(DELIMITERS, key=median)
    rows = [[c.strip() for c in row] for row in csv.reader(some, delimiter=separator, skipinitialspace=True)]
    words = lambda row: sum(any(ch.isalpha() for ch in c) and not any(ch.isdigit() for ch in c) for c in row)
    at = next((i for i, r in enumerate(rows[:3]) if len(r) > 1 and words(r) >= 2 and not any(c.isdigit() for c in r)), None)
    names = [c.lower() for c in rows[at]] if at is not None else []
    body = rows[at + 1 :] if at is not None else rows
    body = [r for r in body if len(r) > 2]
    width = max((len(r) for r in body), default=0)
    find = lambda *keys: next((i for i, n in enumerate(names) if any(k in n for k in keys)), None)
    location = find("location", "sold", "winner", "state")
    jackpot = next((i for i, n in enumerate(names) if "jackpot" in n and i != location), None)
    ignored = {i for i, n in enumerate(names) if any(k in n for k in ("multiplier", "cash", "power play", "megaplier"))} | {location, jackpot}
    numeric = [i for i in range(1, width) if i not in ignored and body and sum(r[i].isdigit() and len(r[i]) <= 3 for r in body if i < len(r)) > len(body) // 2]
    named = next((i for i, n in enumerate(names) if i in numeric and any(k in n for k in ("bonus", "ball", "pball", "special")) and not n[-1:].isdigit()), None)
    guess = None
    if bonus == "auto" and named is None and len(numeric) >= 6:
        full = [[int(r[i]) for i in numeric] for r in body if all(i < len(r) and r[i].isdigit() for i in numeric)]
        if len(full) >= 10:
            last, mains = max(r[-1] for r in full), max(max(r[:-1]) for r in full)
            even = sum(r[:-1] == sorted(r[:-1]) for r in full) >= 0.9 * len(full)
            breaks = sum(r[-1] < r[-2] for r in full) >= 0.3 * len(full)
            guess = numeric[-1] if last * 1.8 <= mains and last <= 45 and even and breaks else None
    picked = named if named is not None else guess
    return Layout(separator, at is not None, 0, [i for i in numeric if i != picked], picked, jackpot, location)


def read_delimited(spark: SparkSession, path: str, game: str, layout: Layout | None = None) -> tuple[DataFrame, DataFrame]:
    """(draws, errors) of delimited files. Only the first lines are read to find the layout; the rest is Spark's reader, which splits large files over tasks."""
    layout = layout or sniff([r.value for r in spark.read.text(path).limit(12).collect()])
    width = max([layout.date, *layout.numbers, layout.bonus or 0, layout.jackpot or 0, layout.location or 0]) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.csv(path, sep=layout.separator, header=layout.header, schema=schema, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    return validated(rows, game, layout)


def from_lines(spark: SparkSession, lines: list[str], game: str) -> tuple[DataFrame, DataFrame]:
    """(draws, errors) of pasted text."""
    layout = sniff(lines)
    width = max([layout.date, *layout.numbers, layout.bonus or 0, layout.jackpot or 0, layout.location or 0]) + 1
    text = spark.createDataFrame([(x,) for x in lines if x.strip()], "line string")
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)), {"sep": layout.separator, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return validated(text.select(cells.alias("c")).select("c.*"), game, layout)


def day_first(rows: DataFrame, column: str) -> bool:
    """Whether more cells have a first part above 12 than a second one."""
    part = lambda i: F.regexp_extract(column, r"^\s*([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]", i).try_cast("int")
    a, b = rows.agg(F.sum((part(1) > 12).cast("int")), F.sum((part(2) > 12).cast("int"))).first()
    return (a or 0) > (b or 0)


def validated(rows: DataFrame, game: str, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(draws, errors): rows with a date and distinct numbers in 1..999; of rows with the same date, numbers and bonus, one stays."""
    cell = lambda i: F.col(f"c{i}") if i is not None else F.lit(None).cast("string")
    whole = lambda c: F.when(F.regexp_like(c, F.lit(r"^\s*[0-9]{1,3}\s*$")), F.trim(c).try_cast("int"))
    date = date_of(cell(layout.date), day_first(rows, f"c{layout.date}"))
    numbers = F.array(*[whole(cell(i)) for i in layout.numbers])
    rows = rows.select(F.to_json(F.struct("*")).alias("source"), date.alias("date"), numbers.alias("numbers"), whole(cell(layout.bonus)).alias("special"), money(cell(layout.jackpot)).alias("jackpot"), cell(layout.location).alias("winner_location"))
    why = (
        F.when(F.col("date").isNull(), "no date")
        .when(F.exists("numbers", lambda x: x.isNull()), "a number is missing")
        .when(F.exists("numbers", lambda x: ~x.between(1, 999)), "a number is out of range")
        .when(F.size(F.array_distinct("numbers")) < F.size("numbers"), "a number comes twice")
    )
    rows = rows.withColumn("error", why)
    return shaped(rows.where("error is null"), game), rows.where("error is not null").select("source", "error")


def shaped(rows: DataFrame, game: str) -> DataFrame:
    """Draws (without t) from date, numbers, special, jackpot, winner_location, one for each identity."""
    out = rows.select(F.lit(game).alias("game"), "date", (F.dayofweek("date") - 1).alias("dow"), "numbers", F.array_sort("numbers").alias("sorted"), "special", "jackpot", "winner_location", F.lit(None).cast("double").alias("sales"))
    return out.dropDuplicates(["game", "date", "sorted", "special"])


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Draws of both, with `added`: of the same game, date, numbers and bonus the existing row stays, its nulls filled."""
    key = lambda d: d.withColumn("_key", F.concat_ws("|", "game", F.col("date").cast("string"), F.array_join("sorted", ","), F.coalesce(F.col("special").cast("string"), F.lit(""))))
    a, b = key(existing).alias("a"), key(incoming.dropDuplicates(["game", "date", "sorted", "special"])).alias("b")
    rows = a.join(b, "_key", "full")
    return rows.select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in existing.columns], F.col("a.game").isNull().alias("added"))


def attach_sales(draws: DataFrame, sales: DataFrame, order: str | None = None) -> DataFrame:
    """draws with sales by date (date, sales); of repeated dates the last stays, by `order`, a column of sales, or else by the rows' place in their source; only amounts above 0 count."""
    sales = sales if order else sales.withColumn("_place", F.monotonically_increasing_id())
    day = sales.where(F.col("sales") > 0).groupBy("date").agg(F.max_by("sales", order or "_place").alias("_sales"))
    return draws.join(day, "date", "left").withColumn("sales", F.coalesce("_sales", F.col("sales") if "sales" in draws.columns else F.lit(None).cast("double"))).drop("_sales")


def open_data(rows: DataFrame, game: str, packed: bool) -> DataFrame:
    """Draws from open-data rows (draw_date, winning_numbers, mega_ball). packed: the bonus is the sixth of winning_numbers. Bad rows are skipped."""
    parts = F.transform(F.split(F.trim("winning_numbers"), r"\s+"), lambda x: x.try_cast("int"))
    mains = F.slice(parts, 1, 5)
    special = F.get(parts, F.lit(5)) if packed else F.col("mega_ball").try_cast("int")
    out = rows.select(F.try_to_date(F.substring("draw_date", 1, 10), "yyyy-MM-dd").alias("date"), mains.alias("numbers"), special.alias("special"), F.lit(None).cast("double").alias("jackpot"), F.lit(None).cast("string").alias("winner_location"))
    good = F.col("date").isNotNull() & F.col("special").isNotNull() & (F.size("numbers") == 5) & F.forall("numbers", lambda x: x.isNotNull()) & (F.size(F.array_distinct("numbers")) == 5)
    return shaped(out.where(F.coalesce(good, F.lit(False))), game)


def encode_history(draws: DataFrame) -> DataFrame:
    """game, row: each draw as a JSON array of date, mains, bonus or 0, jackpot or 0, location or empty."""
    s = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    row = F.concat(F.array(F.col("date").cast("string")), F.transform("numbers", lambda x: x.cast("string")), F.array(s("special", "0"), s("jackpot", "0"), s("winner_location", "")))
    return draws.select("game", "date", F.to_json(row).alias("row"))


def decode_history(rows: DataFrame, game: str) -> DataFrame:
    """Draws from encode_history()'s rows; malformed rows are dropped."""
    a = rows.select(F.from_json("row", "array<string>").alias("a")).where(F.size("a") >= 8)
    mains = F.transform(F.slice("a", F.lit(2), F.size("a") - 4), lambda x: x.try_cast("int"))
    back = lambda i, t: F.element_at("a", i).try_cast(t)
    out = a.select(F.try_to_date(F.get("a", F.lit(0)), "yyyy-MM-dd").alias("date"), mains.alias("numbers"), F.nullif(back(-3, "int"), F.lit(0)).alias("special"), F.nullif(back(-2, "double"), F.lit(0.0)).alias("jackpot"), F.nullif(F.element_at("a", -1), F.lit("")).alias("winner_location"))
    return shaped(out.where(F.col("date").isNotNull() & F.forall("numbers", lambda x: x.isNotNull())), game)


def write_csv(draws: DataFrame, path: str) -> None:
    """Draws as CSV with a header, a column for each number; files as the draws are partitioned."""
    d = draws.select(F.max(F.size("numbers"))).first()[0] or 0
    draws.select("date", *[F.get("numbers", F.lit(i)).alias(f"n{i + 1}") for i in range(d)], "special", "jackpot", "winner_location").write.csv(path, header=True)


def jackpot_pages(pages: DataFrame, zone: str = "America/New_York", clock: str = "22:59") -> DataFrame:
    """pages (game, html) to game, draw_date, draw_instant, jackpot, cash_value: from the card of the next drawing; implausible entries (outside $1M to $5B, no date) are dropped."""
    card = F.regexp_extract("html", r'(?s)id="next-drawing".*?(?=id="[a-z-]*numbers"|$)', 0)
    amounts = F.regexp_extract_all(card, F.lit(r"(?i)\$[0-9][0-9.,]*\s*(?:billion|million|thousand)"), F.lit(0))
    at = F.try_to_timestamp(F.regexp_extract(card, r'data-drawdateutc="([^"]+)"', 1))
    printed = date_of(F.regexp_extract(card, r"((?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? [A-Z][a-z]{2,8} [0-9]{1,2},? [0-9]{4})", 1))
    rows = pages.select("game", F.coalesce(F.to_date(F.from_utc_timestamp(at, zone)), printed).alias("draw_date"), at.alias("_at"), money(F.get(amounts, F.lit(0))).alias("jackpot"), money(F.get(amounts, F.lit(1))).alias("cash_value"))
    rows = rows.withColumn("draw_instant", F.coalesce("_at", instant(F.col("draw_date"), clock, zone))).drop("_at")
    return rows.where(F.col("draw_date").isNotNull() & F.col("jackpot").between(1e6, 5e9))


def jackpot_payloads(rows: DataFrame) -> DataFrame:
    """rows (game, body) of double-encoded JSON {"d": "<json>"} to game, draw_date, jackpot, cash_value."""
    inner = F.from_json(F.get_json_object("body", "$.d"), "struct<Jackpot:struct<NextPrizePool:double,NextCashValue:double>,NextDrawingDate:string>")
    out = rows.select("game", inner.alias("x")).select("game", F.try_to_date(F.substring("x.NextDrawingDate", 1, 10), "yyyy-MM-dd").alias("draw_date"), F.col("x.Jackpot.NextPrizePool").alias("jackpot"), F.col("x.Jackpot.NextCashValue").alias("cash_value"))
    return out.where(F.col("draw_date").isNotNull() & F.col("jackpot").between(1e6, 5e9))


def latest_feed(old: DataFrame, new: DataFrame, today: Column) -> DataFrame:
    """game, draw_date, jackpot, cash_value: of each game the new entry, else the old one while its draw is to come."""
    a, b = new.alias("n"), old.where(F.col("draw_date") >= today).alias("o")
    return a.join(b, "game", "full").select("game", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("draw_date", "jackpot", "cash_value")])


def sized_games(draws: DataFrame) -> DataFrame:
    """game, d (the most frequent number of mains, ties to the larger), k, ks (largest numbers) and bonus_share."""
    size = draws.groupBy("game", F.size("sorted").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    modal = size.withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.col("c").desc(), F.col("d").desc()))).where("r = 1").select("game", "d")
    return draws.groupBy("game").agg(F.max(F.array_max("sorted")).alias("k"), F.max("special").alias("ks"), (F.count("special") / F.count(F.lit(1))).alias("bonus_share")).join(modal, "game").select("game", "d", "k", "ks", "bonus_share")


def ascending_games(draws: DataFrame) -> DataFrame:
    """game, ascending: whether every draw of a game lists its numbers in ascending order; places in source order mean something only where one does not."""
    return draws.groupBy("game").agg(F.bool_and(F.coalesce(F.col("numbers") == F.array_sort("numbers"), F.lit(False))).alias("ascending"))


def entry_problem(numbers: Column, special: Column, size: int, pool: int = 0, bonus: bool = False, most_special: int = 0) -> Column:
    """Why a draw typed in (numbers: array of int, null where a cell is no whole number) can't be taken; null if it can. A bonus number may be up to half above the largest seen."""
    why = F.when(F.size(numbers) != size, "another count of numbers").when(F.exists(numbers, lambda x: x.isNull() | (x < 1)), "a number is missing")
    if pool:
        why = why.when(F.exists(numbers, lambda x: x > pool), "a number is above the pool")
    why = why.when(F.size(F.array_distinct(numbers)) < size, "a number comes twice")
    if bonus:
        why = why.when(special.isNull() | (special < 1), "the bonus number is missing")
        why = why.when(special > 1.5 * most_special, "the bonus number is too large") if most_special else why
    return why


def published(old: DataFrame, built: DataFrame) -> DataFrame:
    """For each game the draws of `built` (with old's columns), unless `old` has more: a source with a bad day never shortens a published history."""
    count = lambda d, name: d.groupBy("game").agg(F.count(F.lit(1)).alias(name))
    sizes = count(old, "_old").join(count(built, "_new"), "game", "full")
    shorter = F.coalesce("_old", F.lit(0)) > F.coalesce("_new", F.lit(0))
    keep = lambda d, test: d.select(*old.columns).join(sizes.where(test).select("game"), "game", "left_semi").select(*old.columns)
    return keep(old, shorter).unionByName(keep(built, ~shorter))
