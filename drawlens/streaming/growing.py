"""Draws that arrive over time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drawlens.sources.text import merge

DRAWS = "game string, date date, dow int, numbers array<int>, sorted array<int>, special int, jackpot double, winner_location string, sales double"


def follow(spark: SparkSession, incoming: str) -> DataFrame:
    """Draws from the JSON files that appear in a folder."""
    return spark.readStream.schema(DRAWS).json(incoming)


def merged_into(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into the table of draws as merge() does, and ends when nothing new is there.

    A batch is written beside the table and takes its place, so a batch that is run again after a failure gives the same table. Late draws are welcome: places in time are given
    when the table is read.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{table}/v{number + 1}"
        old = current(spark, table, number)
        batch = batch.select(*[f.name for f in old.schema.fields])
        merge(old, batch).drop("added").write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The table as of a version, or the newest: versions are folders v<number>; there may be none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()[1:]) for f in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    found = [v for v in found if version is None or v <= version]
    return spark.read.schema(DRAWS).parquet(f"{table}/v{max(found)}") if found else spark.createDataFrame([], DRAWS)


def mark_seen(draws: DataFrame, table: str) -> None:
    """Stores the last date of each game's draws as what has been seen, as a new version beside the old one; games without new draws keep theirs."""
    spark = draws.sparkSession
    old, version = _seen(spark, table)
    new = draws.groupBy("game").agg(F.max("date").alias("date"))
    both = old.unionByName(new).groupBy("game").agg(F.max("date").alias("date"))
    both.coalesce(1).write.parquet(f"{table}/v{version + 1}")  # a row for each game


def _seen(spark: SparkSession, table: str) -> tuple[DataFrame, int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()[1:]) for f in fs.listStatus(path)] if fs.exists(path) else []
    rows = spark.read.schema("game string, date date").parquet(f"{table}/v{max(found)}") if found else spark.createDataFrame([], "game string, date date")
    return rows, max(found, default=0)


def unseen(draws: DataFrame, table: str) -> DataFrame:
    """The draws after the date that mark_seen() stored for their game; all of a game that has none."""
    seen, _ = _seen(draws.sparkSession, table)
    rows = draws.join(seen.withColumnRenamed("date", "_seen"), "game", "left")
    return rows.where(F.col("_seen").isNull() | (F.col("date") > F.col("_seen"))).drop("_seen")


def hits_by_window(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of numbers by window of event time, of a stream or a table of draws with `ts`; rows later than `late` are left out of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.select("game", "ts", F.explode("sorted").alias("n")).groupBy("game", F.window("ts", width).alias("w"), "n").agg(F.count(F.lit(1)).alias("hits")).select("game", F.col("w.start").alias("start"), "n", "hits")
