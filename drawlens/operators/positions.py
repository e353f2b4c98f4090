"""Order statistics: the numbers of a draw by their place in ascending order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlens.functions.odds import order_statistic
from drawlens.history import History


def placed(h: History) -> DataFrame:
    """game, t, position (from 1), v."""
    return h.draws.select("game", "t", F.posexplode("sorted").alias("position", "v")).withColumn("position", F.col("position") + 1)


def counts(h: History) -> DataFrame:
    """game, position, v, hits."""
    return placed(h).groupBy("game", "position", "v").agg(F.count(F.lit(1)).alias("hits"))


def profiles(h: History) -> DataFrame:
    """game, position, least, p25, median, p75, most: the smallest values whose cumulative share reaches each level."""
    rows = counts(h)
    run = F.sum("hits").over(Window.partitionBy("game", "position").orderBy("v"))
    total = F.sum("hits").over(Window.partitionBy("game", "position"))
    rows = rows.withColumn("share", run / total)
    at = lambda f: F.min(F.when(F.col("share") >= f, F.col("v")))
    return rows.groupBy("game", "position").agg(F.min("v").alias("least"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), F.max("v").alias("most"))


def theory(h: History) -> DataFrame:
    """position, v, p: the chance of each value at each place, of a fixed size (d * k rows)."""
    spark = h.draws.sparkSession
    rows = [(r, v, order_statistic(h.k, h.d, r, v)) for r in range(1, h.d + 1) for v in range(1, h.k + 1)]
    return spark.createDataFrame(rows, "position int, v int, p double")


def statistics(h: History) -> DataFrame:
    """game, position, draws, mean, sd (population), p10, p25, p50, p75, p90, distinct, expected, chi2, dof.

    Quantiles are the values at the floor of level times count in ascending order. chi2 is over values with an expectation of 5 at least.
    """
    rows = counts(h)
    by = Window.partitionBy("game", "position")
    rows = rows.withColumn("_run", F.sum("hits").over(by.orderBy("v"))).withColumn("_all", F.sum("hits").over(by))
    levels = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    index = {name: F.least(F.col("_all") - 1, F.floor(F.lit(f) * F.col("_all"))) for name, f in levels.items()}
    v = F.col("v") * F.col("hits")
    moments = rows.groupBy("game", "position").agg(
        F.sum("hits").alias("draws"), (F.sum(v) / F.sum("hits")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(v * F.col("v")) / F.sum("hits") - F.pow(F.sum(v) / F.sum("hits"), F.lit(2)))).alias("sd"), F.count(F.lit(1)).alias("distinct"),
        *[F.min(F.when(F.col("_run") > i, F.col("v"))).alias(n) for n, i in index.items()],
    )
    full = moments.select("game", "position", "draws").join(theory(h), "position").join(rows.select("game", "position", "v", "hits"), ["game", "position", "v"], "left")
    expected = F.col("draws") * F.col("p")
    miss = F.coalesce("hits", F.lit(0)) - expected
    fit = full.groupBy("game", "position").agg(
        F.sum(F.col("v") * F.col("p")).alias("expected"), F.sum(F.when(expected >= 5, miss * miss / expected)).alias("chi2"), F.greatest(F.lit(1), F.sum((expected >= 5).cast("long")) - 1).alias("dof")
    )
    return moments.join(fit, ["game", "position"])


def fit(h: History, numbers: list[int]) -> DataFrame:
    """game, position, v, below (share of draws strictly below), log_likelihood (each value seen once more), typical (within p10 and p90): for one ascending combination."""
    asked = h.draws.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(sorted(numbers))], "position int, value int")
    rows = counts(h).join(asked, "position").groupBy("game", "position", "value").agg(
        F.sum("hits").alias("draws"), F.sum(F.when(F.col("v") < F.col("value"), F.col("hits")).otherwise(0)).alias("under"), F.sum(F.when(F.col("v") == F.col("value"), F.col("hits")).otherwise(0)).alias("same")
    )
    rows = rows.join(statistics(h).select("game", "position", "p10", "p90"), ["game", "position"])
    return rows.select(
        "game", "position", F.col("value").alias("v"), (F.col("under") / F.col("draws")).alias("below"), F.log((F.col("same") + 1) / (F.col("draws") + h.k)).alias("log_likelihood"), F.col("value").between(F.col("p10"), F.col("p90")).alias("typical")
    )
