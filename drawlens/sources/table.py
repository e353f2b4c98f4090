"""Draws from delimited text of which nothing is known: what stands where is found from all rows, by aggregates, and rows that hold no draw become errors."""

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.functions.dates import date_of, money
from drawlens.sources.text import DELIMITERS, shaped

# How headers name columns, in the order in which they are asked; the sizes of draws; the bounds of a bonus column that is told by its values.
IGNORED = r"(?i)multiplier|multi(plier)?[\s_-]*$|[\s_-]multi\b|^multi\b|power[\s_-]*play|megaplier|cash[\s_-]*value"
LOCATION = r"(?i)winner|location|win[\s_-]*loc|won[\s_-]*(in|at|by)?\b|\bloc\b|city|\bstate\b|retailer|store"
JACKPOT = r"(?i)jackpot|annuity|grand[\s_-]*prize|top[\s_-]*prize|\bprize\b|advertised"
BONUS = r"(?i)p(ower)?[\s_-]?ball|pball|bonus|mega[\s_-]?ball|extra|star|lucky|\bpb\b|\bsb\b|ball\s*$"
DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
DAY_WORDS = [*DAYS, "sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "tues", "thur", "thurs"]
LEAST, MOST, SAMPLE, TOP, RATIO, LARGEST, EVEN, BREAKS = 4, 10, 10, 999, 1.8, 45, 0.9, 0.3
DATED = re.compile(r"^\s*([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}|[0-9]{4,6}$|([A-Za-z]{3,9},?\s+)?([A-Za-z]{3,9}\.?\s+[0-9]{1,2},?|[0-9]{1,2}\s+[A-Za-z]{3,9})\s+[0-9]{4})")


@dataclass
class Header:
    separator: str
    skipped: list[str]  # the header's line and those above it
    roles: dict[str, int]
    ignored: list[int]
    bonus: bool  # whether the header names the last column of numbers a bonus


def header_of(head: list[str]) -> Header:
    """The separator (of the candidates the one with the highest median count) and the header (a row of the first three with two cells of words) of the first lines of a file, 12 at most."""
    some = [x for x in head if x.strip()][:12]
    median = lambda c: sorted(x.count(c) for x in some)[len(some) // 2] if some else 0
    separator = max(DELIMITERS, key=median)
    rows = [[c.strip() for c in next(csv.reader([x], delimiter=separator))] for x in some[:3]]
    word = lambda c: bool(re.search(r"[A-Za-z]{2,}", c)) and c.lower() not in DAY_WORDS and not DATED.match(c)
    at = next((i for i, r in enumerate(rows) if sum(map(word, r)) >= 2), None)
    if at is None:
        return Header(separator, [], {}, [], False)
    roles: dict[str, int] = {}
    ignored = []
    for i, name in enumerate(rows[at]):
        if re.search(IGNORED, name):
            ignored.append(i)
        elif name and "location" not in roles and re.search(LOCATION, name) and not re.search(BONUS, name):
            roles["location"] = i
        elif name and "jackpot" not in roles and re.search(JACKPOT, name):
            roles["jackpot"] = i
    others = [name for i, name in enumerate(rows[at]) if name and i not in ignored and i not in roles.values()]
    return Header(separator, some[: at + 1], roles, ignored, bool(others and re.search(BONUS, others[-1])))


def _cells(lines: DataFrame, header: Header, width: int) -> DataFrame:
    """line, cells (trimmed, width of them, columns with a role blank), jackpot, location."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv("line", schema, {"sep": header.separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = lines.select("line", parsed.alias("c"))
    cell = lambda i: F.coalesce(F.trim(F.col(f"c.c{i}")), F.lit(""))
    lifted = {*header.ignored, *header.roles.values()}
    of = lambda role: cell(header.roles[role]) if header.roles.get(role, width) < width else F.lit("")
    none = F.regexp_like(of("location"), F.lit(r"(?i)^(n/?a|none|-{1,2})?$"))
    return rows.select("line", F.array(*[F.lit("") if i in lifted else cell(i) for i in range(width)]).alias("cells"), money(of("jackpot")).alias("jackpot"), F.when(~none, of("location")).alias("winner_location"))


def imported(lines: DataFrame, head: list[str], game: str, size: int = 0, bonus: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(draws, errors, facts) of lines (line) whose first ones are `head`. Expected are a date, perhaps a weekday, and numbers; columns of jackpots, places and multipliers are known by the header alone.

    First pass, over all rows: whether days come before months (a vote of dates that can only be read one way), the numbers of each row (text between numbers is an error, text behind them is not), how many numbers most rows have, and whether the last is a bonus: by the header, or because in rows of that many
    numbers it stays well below the others and breaks their order. Second pass: each row is cut to that many numbers and judged. `size` fixes the main numbers, `bonus` is auto, yes or no.
    errors: line, error. facts: one row: rows, day_first, size, has_bonus, errors, extra (rows with more numbers), repeated, wrong_day (the date wins), mixed (dates of both orders). The driver gets a few counts, never rows.
    """
    header = header_of(head)
    lines = lines.select("line").where((F.trim("line") != "") & ~F.col("line").isin(header.skipped or [""]))
    width = lines.agg(F.max(F.size(F.split("line", re.escape(header.separator))))).first()[0] or 1
    rows = _cells(lines, header, width).where(F.get("cells", F.lit(0)) != "")
    first = F.get("cells", F.lit(0))
    part = lambda i: F.regexp_extract(first, r"^([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})$", i).try_cast("int")
    votes = rows.agg(F.sum(((part(1) > 12) & (part(2) <= 12)).cast("int")).alias("d"), F.sum(((part(2) > 12) & (part(1) <= 12)).cast("int")).alias("m")).first()
    day_first, mixed = (votes.d or 0) > (votes.m or 0), bool(votes.d and votes.m)
    rows = rows.withColumn("date", date_of(first, day_first)).withColumn("rest", F.slice("cells", 2, max(1, width)))
    word = F.lower(F.get("rest", F.lit(0)))
    named = word.isin(DAY_WORDS)
    day = F.get(F.array(*[F.lit(x) for x in DAYS]), F.dayofweek("date") - 1)
    rows = rows.withColumn("wrong_day", F.coalesce(named & (F.substring(word, 1, 3) != day), F.lit(False))).withColumn("rest", F.when(F.coalesce(named, F.lit(False)), F.slice("rest", 2, max(1, width))).otherwise(F.col("rest")))
    filled = F.filter("rest", lambda c: c != "")
    rows = rows.withColumn("parts", F.transform(filled, lambda c: F.when(F.regexp_like(c, F.lit("^[0-9]{1,3}$")), c.cast("int"))))
    bad = F.array_position(F.transform("parts", lambda x: x.isNull()), F.lit(True))
    follows = F.exists(F.slice("parts", F.greatest(bad, F.lit(1)).cast("int"), F.size("parts") + 1), lambda x: x.isNotNull())
    why = F.when(F.col("date").isNull(), "no date").when(bad == 1, "not a number").when((bad > 1) & follows, "text between numbers")
    rows = rows.withColumn("error", why).withColumn("found", F.slice(F.array_compact("parts"), 1, MOST + 2)).select("line", "date", "found", "jackpot", "winner_location", "wrong_day", "error")
    good = rows.where("error is null")
    sizes = good.groupBy(F.size("found").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()  # 13 rows at most
    common = lambda cap: max(((sum(s.c for s in sizes if min(s.n, cap) == n), n) for n in {min(s.n, cap) for s in sizes}), default=(0, 0))[1]
    modal, has_bonus = common(MOST + 2), False
    if modal > LEAST and bonus != "no":
        has_bonus = bonus == "yes" or header.bonus
        if not has_bonus:
            mains, last = F.slice("found", 1, modal - 1), F.get("found", F.lit(modal - 1))
            even = F.array_sort(mains) == mains
            f = good.where(F.size("found") >= modal).agg(F.count(F.lit(1)).alias("n"), F.max(last).alias("last"), F.max(F.array_max(mains)).alias("mains"), F.sum(even.cast("int")).alias("even"), F.sum((even & (last < F.element_at(mains, -1))).cast("int")).alias("breaks")).first()
            has_bonus = f.n >= SAMPLE and f.last * RATIO <= f.mains and f.last <= LARGEST and f.even / f.n >= EVEN and f.breaks / f.n >= BREAKS
    size = size or common(MOST + has_bonus) - has_bonus
    needed = size + has_bonus
    numbers = F.slice("found", 1, max(size, 1))
    special = F.get("found", F.lit(needed - 1)) if has_bonus else F.lit(None).cast("int")
    later = (
        F.when(F.lit(not LEAST <= size <= MOST), "no such game")
        .when(F.size("found") < needed, "too few numbers")
        .when(F.exists(numbers, lambda x: ~x.between(1, TOP)) | F.coalesce(~special.between(1, TOP), F.lit(False)), "a number is out of range")
        .when(F.size(F.array_distinct(numbers)) < F.size(numbers), "a number comes twice")
    )
    rows = rows.withColumn("error", F.coalesce("error", later)).withColumn("extra", F.size("found") > needed).withColumn("numbers", numbers).withColumn("special", special)
    kept = rows.where("error is null")
    # Of rows with the same date, numbers and bonus the one with the least line stays, whatever the order in which they come.
    cells = ["date", "numbers", "special", "jackpot", "winner_location"]
    one = kept.groupBy("date", F.array_sort("numbers").alias("_s"), "special").agg(F.min_by(F.struct(*[F.col(c).alias(f"_{c}") for c in cells]), "line").alias("x"))
    draws = shaped(one.select(*[F.col(f"x._{c}").alias(c) for c in cells]), game)
    count = rows.agg(*[F.sum(c.cast("long")).alias(n) for n, c in {"errors": F.col("error").isNotNull(), "extra": F.col("error").isNull() & F.col("extra"), "wrong_day": F.col("wrong_day") & F.col("error").isNull()}.items()], F.count(F.lit(1)).alias("rows"))
    alike = kept.groupBy("date", F.array_sort("numbers").alias("s"), "special").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated"))
    facts = count.join(alike, F.lit(True)).select(F.lit(game).alias("game"), "rows", F.lit(bool(day_first)).alias("day_first"), F.lit(size).alias("size"), F.lit(bool(has_bonus)).alias("has_bonus"), "errors", "extra", "repeated", "wrong_day", F.lit(mixed).alias("mixed"))
    return draws, rows.where("error is not null").select("line", "error"), facts


def read(spark: SparkSession, path: str, game: str, size: int = 0, bonus: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """imported() from files; rows end at any of the three kinds of line ends. A quoted cell must not hold one."""
    lines = spark.read.text(path).select(F.explode(F.split("value", "\r")).alias("line"))
    return imported(lines, [r.line for r in lines.limit(12).collect()], game, size, bonus)


def odd_lines(draws: DataFrame, separator: Column | str = "|") -> DataFrame:
    """line: draws (t, date, sorted, special, jackpot) as rows of a sheet that people have typed: some with a number twice, a star, a missing or an additional cell, a number or date that can't be, the wrong weekday, and some twice."""
    odd, s = F.col("t") % 40, [F.get("sorted", F.lit(i)).cast("string") for i in range(5)]
    cell = [
        F.when(odd == 17, "31/31/2020").otherwise(F.date_format("date", "d/M/yyyy")), F.when(odd == 29, F.date_format(F.date_add("date", 1), "EEE")).otherwise(F.date_format("date", "EEE")),
        F.when(odd == 13, "0").otherwise(s[0]), s[1], F.when(odd == 7, F.concat(s[2], F.lit("*"))).otherwise(s[2]), s[3], F.when(odd == 3, s[3]).otherwise(s[4]),
        F.when(odd == 11, "").otherwise(F.col("special").cast("string")), F.concat(F.lit("$"), F.format_string("%.2f", F.col("jackpot"))), F.when(odd == 23, "9").otherwise(""),
    ]
    times = F.when(odd == 19, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return draws.select(F.concat_ws(separator, *cell).alias("line"), F.explode(times).alias("again")).select("line")


HEAD = ["Typed by hand", "Date|Day|N1|N2|N3|N4|N5|Pball|Jackpot|"]
