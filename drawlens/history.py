"""A draw history: the draws, their numbers one to a row, and the dense panel of draws by numbers.

Every operator works on all games at once: `game` leads each key, so a cluster spreads games, and numbers within a game, over its tasks.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered(draws: DataFrame, *order: str) -> DataFrame:
    """draws with t, the place of each in its game from 0. Places are running counts by date, then numbers within a date: no game is sorted in one task.

    draws must have `game` and `date`; `order` breaks ties within a date. Rows that agree in all of that are numbered at will.
    """
    by_date = draws.groupBy("game", "date").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("game").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_date.select("game", "date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("game", "date").orderBy(*order))
    return draws.withColumn("_within", within).join(starts, ["game", "date"]).withColumn("t", (F.col("_start") + F.col("_within") - 1).cast("long")).drop("_start", "_within")


BLOCK = 4096  # draws to a block, where a window goes over the draws of a game


def blocked(rows: DataFrame, back: int, size: int = BLOCK) -> DataFrame:
    """rows with block and edge: each row stands in the block of its t, and the last `back` of a block once more, as its edge, in the next.

    A window over ("game", "block") by t that looks back over `back` rows at most sees, for rows that are no edge, what it would see over the whole game, if t is gapless; no game is sorted in one task.
    """
    own = F.floor(F.col("t") / size)
    blocks = F.when(F.col("t") % size >= size - back, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("block", F.explode(blocks)).withColumn("edge", F.col("block") != own)


def gapless(rows: DataFrame, name: str = "i") -> DataFrame:
    """rows (game, t) with their place from 0, counted by blocks of t and then within each: no game is sorted in one task."""
    rows = rows.withColumn("_b", F.floor(F.col("t") / BLOCK))
    before = Window.partitionBy("game").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("game", "_b").agg(F.count(F.lit(1)).alias("_c")).select("game", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("game", "_b").orderBy("t"))).join(starts, ["game", "_b"]).withColumn(name, F.col("_s") + F.col("_r") - 1).drop("_b", "_s", "_r")


@dataclass
class History:
    """draws: game, t, date, dow (0 is Sunday), numbers, sorted, special, jackpot, winner_location, sales; k, d, ks: pool, numbers in a draw, bonus pool."""

    draws: DataFrame
    k: int = 69
    d: int = 5
    ks: int = 26

    @cached_property
    def hits(self) -> DataFrame:
        """One row for each number of each draw: game, t, dow, n."""
        return self.draws.select("game", "t", "dow", F.explode("sorted").alias("n"))

    @cached_property
    def sizes(self) -> DataFrame:
        """One row for each game: draws."""
        return self.draws.groupBy("game").agg(F.count(F.lit(1)).alias("draws"))

    @cached_property
    def numbers(self) -> DataFrame:
        """Every number of every game's pool, with the game's number of draws."""
        return self.sizes.select("game", "draws", F.explode(F.sequence(F.lit(1), F.lit(self.k))).alias("n"))

    @cached_property
    def grid(self) -> DataFrame:
        """Every draw by every number: game, t, dow, n, hit (0 or 1). One narrow pass, without a join."""
        return self.draws.select("game", "t", "dow", F.explode(F.sequence(F.lit(1), F.lit(self.k))).alias("n"), "sorted").select(
            "game", "t", "dow", "n", F.array_contains("sorted", F.col("n")).cast("int").alias("hit")
        )

    @cached_property
    def previous(self) -> DataFrame:
        """game, t, prev: the sorted numbers of the draw before t."""
        return self.draws.select("game", (F.col("t") + 1).alias("t"), F.col("sorted").alias("prev"))

    def until(self, column: str, last: int) -> DataFrame:
        """hits of the last `last` draws of each game, for a column of draws that counts them."""
        return self.hits.join(self.sizes, "game").where(F.col("t") >= F.col(column) - last)
