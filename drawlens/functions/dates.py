"""Dates, amounts and times in texts, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]  # fixed values


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.when(y.cast("int").between(1900, 2200), F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd"))


def date_of(text: Column, day_first: Column | bool = False) -> Column:
    """A date from a cell: a spreadsheet's serial number, ISO with or without a time, three numbers (a part above 12 decides what is the day, else day_first), Mon D, YYYY or D Mon YYYY; else null."""
    t = F.trim(text)
    day_first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    num = lambda pattern, i: F.regexp_extract(t, pattern, i).try_cast("int")
    serial = r"^([0-9]{4,6})(?:\.[0-9]+)?$"
    triple = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2}|[0-9]{4})(?:[ T].*)?$"
    iso = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?:[ T].*)?$"
    a, b, y = (num(triple, i) for i in (1, 2, 3))
    year = F.when(F.length(F.regexp_extract(t, triple, 3)) == 4, y).when(y < 50, 2000 + y).otherwise(1900 + y)
    is_day = F.when(a > 12, F.lit(True)).when(b > 12, F.lit(False)).otherwise(day_first)
    words = F.regexp_replace(F.regexp_replace(t, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), r"[,.]", "")
    month_first, day_word = r"^([A-Za-z]{3})[a-z]*\s+([0-9]{1,2})\s+([0-9]{4})", r"^([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\s+([0-9]{4})"
    months = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, i)])
    index = lambda x: F.try_element_at(months, F.lower(x))
    n = F.regexp_extract(t, serial, 1).try_cast("int")
    guard = lambda ok, value: F.when(ok, value)
    return F.coalesce(
        guard(F.regexp_like(t, F.lit(serial)) & n.between(6000, 110000), F.date_add(F.to_date(F.lit("1899-12-30")), n)),
        guard(F.regexp_like(t, F.lit(iso)), _date(num(iso, 1), num(iso, 2), num(iso, 3))),
        guard(F.regexp_like(t, F.lit(triple)), _date(year, F.when(is_day, b).otherwise(a), F.when(is_day, a).otherwise(b))),
        guard(F.regexp_like(words, F.lit(month_first)), _date(F.regexp_extract(words, month_first, 3), index(F.regexp_extract(words, month_first, 1)), F.regexp_extract(words, month_first, 2))),
        guard(F.regexp_like(words, F.lit(day_word)), _date(F.regexp_extract(words, day_word, 3), index(F.regexp_extract(words, day_word, 2)), F.regexp_extract(words, day_word, 1))),
    )


def money(text: Column) -> Column:
    """Dollars from a cell like $1.5 million, 20M or 1,000; null unless above 0."""
    pattern = r"(?i)^\s*\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|million|thousand|b|m|k)?\s*$"
    n = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    unit = F.lower(F.substring(F.regexp_extract(text, pattern, 2), 1, 1))
    value = n * F.when(unit == "b", 1e9).when(unit == "m", 1e6).when(unit.isin("k", "t"), 1e3).otherwise(1.0)
    return F.when(value > 0, value)


def instant(date: Column, clock: str, zone: str) -> Column:
    """The moment at which a clock in a zone shows a time (HH:MM) on a date."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", date.cast("string"), F.lit(clock)), "yyyy-MM-dd HH:mm"), zone)


def countdown(now: Column, then: Column) -> Column:
    """Days, hours, minutes and seconds to a moment, 0 once it is past."""
    s = F.greatest(F.lit(0), F.unix_timestamp(then) - F.unix_timestamp(now))
    return F.struct(F.floor(s / 86400).alias("days"), F.floor(s % 86400 / 3600).alias("hours"), F.floor(s % 3600 / 60).alias("minutes"), (s % 60).alias("seconds"))


def long_date(date: Column) -> Column:
    """A date as Mon D, YYYY."""
    return F.date_format(date, "MMM d, yyyy")


def days_since(date: Column, now: Column) -> Column:
    """Days, with their fraction, from the start of a date to a moment; infinity without a date."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(date.cast("timestamp"))) / 86_400e6, F.lit(float("inf")))


def money_text(amount: Column, words: bool = False) -> Column:
    """Dollars in short: $1.25B, $20.5M (no decimal from 100 million), $7K, $12; with words, $1.25 Billion, $20 Million."""
    fixed = lambda unit, digits: F.format_string(f"%.{digits}f", F.round(amount / unit, digits))
    millions = fixed(1e6, 0) if words else F.when(amount >= 1e8, fixed(1e6, 0)).otherwise(fixed(1e6, 1))
    names = (" Billion", " Million") if words else ("B", "M")
    text = F.when(amount >= 1e9, F.concat(fixed(1e9, 2), F.lit(names[0]))).when(amount >= 1e6, F.concat(millions, F.lit(names[1]))).when(amount >= 1e3, F.concat(fixed(1e3, 0), F.lit("K"))).otherwise(fixed(1.0, 0))
    return F.concat(F.lit("$"), text)
