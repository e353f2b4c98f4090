"""Histories made by a seeded generator: fair ones, and one with planted structure."""

import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.history import History, ordered


def fair(spark: SparkSession, draws: int, k: int = 69, d: int = 5, games: int = 1, seed: int = 1, start: str = "2015-01-03", every: int = 3) -> History:
    """Fair histories of any number of games: a draw takes the d numbers with the least hashes, so every row is made where it is used."""
    ids = spark.range(draws * games).select((F.col("id") % games).cast("string").alias("g"), F.floor(F.col("id") / games).alias("i"))
    keys = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda v: F.struct(F.xxhash64(F.lit(seed), "g", "i", v).alias("h"), v.cast("int").alias("v")))
    numbers = F.transform(F.slice(F.array_sort(keys), 1, d), lambda x: x["v"])
    rows = ids.select(F.concat(F.lit("fair"), "g").alias("game"), F.col("i").alias("t"), F.date_add(F.to_date(F.lit(start)), (F.col("i") * every).cast("int")).alias("date"), numbers.alias("numbers"))
    rows = rows.withColumn("dow", F.dayofweek("date") - 1).withColumn("sorted", F.array_sort("numbers"))
    none = lambda t: F.lit(None).cast(t)
    return History(rows.withColumns({"special": none("int"), "jackpot": none("double"), "winner_location": none("string"), "sales": none("double")}), k, d, 0)


# Fixed values of the planted history: some numbers come more often all along, by a wave; some on Saturdays; some after others; and the last draw's.
SATURDAYS, FOLLOWERS = [5, 10, 15, 33, 40], {3: 33, 7: 21, 13: 28, 22: 11, 45: 46}
ON_SATURDAY, AGAIN, AFTER = 1.45, 1.55, 1.9


def planted(spark: SparkSession, draws: int = 715, seed: int = 0xC0FFEE, k: int = 49, d: int = 6) -> History:
    """Mondays, Wednesdays and Saturdays; numbers have uneven weights, some are likelier on Saturdays (x 1.45), so are the last draw's numbers (x 1.55) and the followers of some (x 1.9). Each draw
    depends on the one before, so the driver makes it; its size is a parameter."""
    rng = np.random.default_rng(seed)
    n = np.arange(1, k + 1)
    base = np.maximum(0.35, 1 + 0.32 * np.sin(1.7 * n) + 0.22 * np.cos(0.53 * n))
    day, last, rows = datetime.date(2022, 1, 3), [], []
    while len(rows) < draws:
        if day.weekday() in (0, 2, 5):
            w = base.copy()
            if day.weekday() == 5:
                w[[x - 1 for x in SATURDAYS if x <= k]] *= ON_SATURDAY
            w[last] *= AGAIN
            for x in last:
                if FOLLOWERS.get(x + 1, k + 1) <= k:
                    w[FOLLOWERS[x + 1] - 1] *= AFTER
            last = rng.choice(k, d, replace=False, p=w / w.sum()).tolist()
            rows.append((day, [x + 1 for x in last]))
        day += datetime.timedelta(days=1)
    df: DataFrame = spark.createDataFrame(rows, "date date, numbers array<int>").withColumn("game", F.lit("planted")).withColumn("dow", F.dayofweek("date") - 1).withColumn("sorted", F.array_sort("numbers"))
    none = lambda t: F.lit(None).cast(t)
    return History(ordered(df.withColumns({"special": none("int"), "jackpot": none("double"), "winner_location": none("string"), "sales": none("double")}), "date"), k, d, 0)
