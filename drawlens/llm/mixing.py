"""Mixing of sources to target weights, with weights that change while training goes on."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sources' weights in turn, and how often a source may be repeated at most.
WEIGHTS, MOST = (5, 2, 1), 3


def targets(sizes: DataFrame, source: str) -> DataFrame:
    """sizes (source, source_size) with weight and target: all sizes together, shared by weight, no target above MOST times its source's size.

    What a capped source leaves is shared again among the others by weight, until none is above: the sources in order of size by weight fill
    up first, and the level that the rest share comes from running sums. One row for each source; the sources are ordered in one task, as their
    number doesn't grow with the rows. Null is a source, the last one.
    """
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS)).cast("int"))
    cap = (F.col("source_size") * MOST).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("_cap", cap)
    order = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col(source).asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("_level", level)
    final = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("v")))).over(everything)["v"]
    return rows.withColumn("target", F.coalesce(F.least(final * F.col("weight"), F.col("_cap")), F.col("_cap"))).select(source, "source_size", "weight", "target")


def ramp(source_rank: Column, sources: Column) -> Column:
    """The slope of a source's weight over the run, between -0.5 and 0.5: the first sources fade, the last ones grow."""
    return F.when(sources > 1, source_rank.cast("double") / (sources - 1) - 0.5).otherwise(0.0)


def position(share: Column, slope: Column) -> Column:
    """The time, 0 to 1, at which a source has met `share` of its demand.

    A source's weight at time t is proportional to 1 + slope * (2t - 1), whose integral is t + slope * (t * t - t); this is its inverse.
    """
    a = 1 - slope
    root = F.sqrt(a * a + 4 * slope * share)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(2 * share / (a + root))


def mix(df: DataFrame, source: str, size: str, key: list[str], blocks: int = 1024) -> DataFrame:
    """Adds source_size, target, taken (words, repeats counted), position (0 to 1, of the row's first use; null if it isn't used) and positions (of all its uses, in turn).

    A source's rows stand in the order of a hash (md5) of `key`. Its target is laid along them again and again, at most MOST times: rows are
    taken whole, but for the row in which the target ends. So a source's taken words are its target, to a word, and no row is taken more than MOST times.
    Each use's words stand at known places of its source's demand, one lap behind those of the use before, and position() inverts the demand of the source's weight schedule.

    Running sums go over blocks of hash ranges, each block starting where those before it end; a source of most of the rows is spread over all its
    blocks. Rows equal in all of `key` are ordered at will, which changes nothing that can be seen. A null or negative size counts as 0; a null source is a source; an empty
    table gives an empty result. Columns of df that bear a name of the result are replaced.
    """
    made = {"source_size", "target", "taken", "position", "positions"}
    kept = [c for c in df.columns if c not in made]
    words = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    name = F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source)))  # a key that is never null
    df = df.select(F.struct(*[df[c] for c in kept]).alias("_kept"), words.alias("_words"), F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).cast("binary")).alias("_h"), F.struct(*key).alias("_ties"), name.alias("_source"))
    df = df.withColumn("_block", F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * blocks, 32).cast("int"))
    by_block = df.groupBy("_source", "_block").agg(F.sum("_words").alias("_sum"))
    at = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.select("_source", "_block", F.coalesce(F.sum("_sum").over(at), F.lit(0)).alias("_start"))
    plain = F.when(F.col("_source") != "", F.expr("substring(_source, 2)")).alias("_s")
    sizes = by_block.groupBy("_source").agg(F.sum("_sum").alias("source_size")).select(plain, "source_size")
    n = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = targets(sizes, "_s").withColumn("_slope", ramp(F.row_number().over(Window.orderBy(F.col("_s").asc_nulls_last())) - 1, F.count(F.lit(1)).over(n)))
    goal = goal.withColumn("_source", F.when(F.col("_s").isNull(), "").otherwise(F.concat(F.lit("="), F.col("_s"))))
    starts = starts.join(goal.select("_source", "source_size", "target", "_slope"), "_source")
    # The rows are dealt out once: the join and the running sums have the same key.
    own = Window.partitionBy("_source", "_block").orderBy("_h", "_ties").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.join(starts, ["_source", "_block"]).withColumn("_end", F.sum("_words").over(own))
    first = F.col("_start") + F.col("_end") - F.col("_words")
    whole = F.round("target").cast("long")

    def lap(k: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_words"), whole - k * F.col("source_size") - first))

    taken = sum((lap(k) for k in range(1, MOST)), lap(0)).cast("long")
    uses = [F.when(lap(k) > 0, position(F.least(F.lit(1.0), (first + k * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))), F.col("_slope"))) for k in range(MOST)]
    rows = rows.withColumn("taken", taken).withColumn("position", uses[0]).withColumn("positions", F.array_compact(F.array(*uses)))
    return rows.select(*[F.col(f"_kept.`{c}`").alias(c) for c in kept], "source_size", "target", "taken", "position", "positions")


def in_order(mixed: DataFrame, size: str | None = None) -> DataFrame:
    """One row for each use of a row by the mix, in order of its position: range partitions, each sorted. With `size`, the column that was mixed by, each use has its `words`, how many it takes."""
    made = {"position", "positions"} | ({"words"} if size else set())
    kept = [c for c in mixed.columns if c not in made]
    words = lambda i: F.least(F.col(size), F.col("taken") - i * F.col(size)) if size else F.lit(0)
    uses = mixed.select(F.struct(*[mixed[f"`{c}`"] for c in kept]).alias("_kept"), F.explode(F.transform("positions", lambda p, i: F.struct(p.alias("position"), words(i).cast("long").alias("words")))).alias("_use"))
    uses = uses.select(*[F.col(f"_kept.`{c}`").alias(c) for c in kept], "_use.position", *["_use.words"] * bool(size))
    return uses.repartitionByRange(F.col("position")).sortWithinPartitions("position")


def by_row(ordered: DataFrame, mixed: DataFrame, columns: list[str]) -> DataFrame:
    """columns (that tell the rows apart) of every row of the mix, with taken and position (of its first use) as the uses in order have them; 0 and null for rows without a use."""
    used = ordered.groupBy(*columns).agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    return used.unionByName(mixed.where(F.size("positions") == 0).select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("double").alias("position")))
