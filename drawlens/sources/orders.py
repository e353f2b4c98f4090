"""A draw history derived from order tables: an order with five different parts, by remainder, is a draw."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlens.history import History, ordered

POOL, SIZE, BONUS = 69, 5, 26
_kept: dict[tuple[str, str], History] = {}


def draws_of_orders(orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    lines = lineitem.select("l_orderkey", (F.col("l_partkey") % POOL + 1).cast("int").alias("n")).distinct()
    own = Window.partitionBy("l_orderkey")
    place = F.row_number().over(own.orderBy((F.col("n") * 7919 + F.col("l_orderkey") * 31) % 10007, "n"))
    lines = lines.select("l_orderkey", "n", place.alias("_place"), F.count(F.lit(1)).over(own).alias("_size")).where((F.col("_size") >= SIZE) & (F.col("_place") <= SIZE))
    picked = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("n")).alias("sorted"))
    where = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = orders.join(picked, F.col("o_orderkey") == F.col("l_orderkey")).join(where, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = joined.select(
        F.lit("main").alias("game"),
        F.col("o_orderkey").alias("draw_key"),
        F.to_date("o_orderdate").alias("date"),
        F.col("sorted").alias("numbers"),
        "sorted",
        (F.col("o_custkey") % BONUS + 1).cast("int").alias("special"),
        F.col("o_totalprice").alias("jackpot"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("n_name")).alias("winner_location"),
    )
    return ordered(rows, "draw_key").withColumn("dow", F.dayofweek("date") - 1)


def sales_by_day(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """date, sales: the sums of what was sold on each order date."""
    return orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("l_extendedprice").alias("sales"))


def history(spark: SparkSession, sf_dir: str) -> History:
    """The history of a folder of tables. Its draws are kept in memory and on disk for the queries of one session that share them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        draws = draws_of_orders(table("orders"), table("lineitem"), table("customer"), table("nation"))
        _kept[key] = History(draws.persist(), POOL, SIZE, BONUS)
    return _kept[key]


def release() -> None:
    """Lets go of the draws that history() keeps."""
    while _kept:
        _kept.popitem()[1].draws.unpersist()
