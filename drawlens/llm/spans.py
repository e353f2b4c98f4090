"""Regular-expression matches with their places, by built-in functions only.

Spark's functions give the matches of a pattern and the pieces between them, both in order; running sums of their lengths
are the places, in code points. The sums are windows over the matches of one document and one kind, so that a text with very many
matches costs n log n.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "array<struct<kind:int,i:int,gap:int,left:string,found:string>>"


def parts(text: Column, kind: int, pattern: str, when: Column | None = None, left: int = 0) -> Column:
    """An array of the matches of pattern in text: kind, number, length of the gap before it, the last `left` characters of that gap, match.

    `when` is a cheap test that holds for every text with a match.
    """
    # Matches and gaps are zipped, so that each array is made once, not once for each match.
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.filter(F.arrays_zip(found.alias("found"), gaps.alias("gap")), lambda x: x["found"].isNotNull())
    near = (lambda g: F.right(g, F.lit(left))) if left else (lambda g: F.lit(None).cast("string"))
    each = F.transform(
        both,
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.char_length(x["gap"]).cast("int").alias("gap"), near(x["gap"]).alias("left"), x["found"].alias("found")),
    )
    has = F.regexp_like(text, F.lit(pattern))
    return F.when(has if when is None else when & has, each).otherwise(F.array().cast(PART))


def located(docs: DataFrame, text: str, found: list[Column], keep: list[str]) -> DataFrame:
    """One row for each match: _row (of the document), kind, i, start, end, left, found; at least one row for each document.

    `found` are columns made by parts(). The first row of a document carries a struct `_kept` of its columns `keep`; a document without
    a match has one row with kind null. A null text counts as empty; null or repeated identifiers do no harm, as rows are told apart by their place.
    """
    text_of = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[docs[c] for c in keep]).alias("_kept"), text_of.alias("_text"))
    rows = base.select("_row", "_kept", F.posexplode_outer(F.concat(*[f(F.col("_text")) if callable(f) else f for f in found])).alias("_at", "p"))
    rows = rows.select("_row", F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, F.col("_kept")).alias("_kept"), "p.*")
    own = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("found")
    return (
        rows.repartition("_row")
        .withColumn("end", F.sum(F.col("gap") + length).over(own).cast("int"))
        .withColumn("start", (F.col("end") - length).cast("int"))
    )


def gathered(rows: DataFrame) -> DataFrame:
    """One row for each document: `_kept`, the struct of its columns, and `spans`, an array of (start, kind, end, found, base) in that order.

    rows: of located(), with a boolean `base`; rows whose `base` is null are dropped from the array, never the document.
    """
    one = F.when(F.col("base").isNotNull(), F.struct("start", "kind", "end", "found", "base"))
    return rows.groupBy("_row").agg(F.max("_kept").alias("_kept"), F.array_sort(F.collect_list(one)).alias("spans")).drop("_row")


def columns_for(docs: DataFrame, text: str, keep: list[str] | None) -> list[str]:
    """The columns that a finder's result keeps beside its own `spans`: those asked for, or all but the text."""
    return [c for c in (docs.columns if keep is None else keep) if c != "spans" and (keep is not None or c != text)]


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
