"""Intermediate tables in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and the master is local, a temporary one. On a cluster there must be a folder that all machines share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("drawlens.scratch", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="drawlens-")
        spark.conf.set("drawlens.scratch", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and no executor's loss undoes it.

    The format is one whose writers and readers compress on the heap, so that many small files don't pile up native memory. `files`: at most so many, for a table that is known to be small.
    """
    spark = df.sparkSession
    df = df if files is None else df.coalesce(files)
    path = f"{folder(spark)}/drawlens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").orc(path)
    out = spark.read.schema(df.schema).orc(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote, once what was made of them is written itself. Other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
