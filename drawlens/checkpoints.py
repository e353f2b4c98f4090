"""Cutting a long plan: the rows go to the folder that driver and executors share."""

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from its checkpoint from then on. The folder is that of spark.checkpoint.dir; where it is unset, a temporary one on a local master, and an error on a cluster, whose machines share no such folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="drawlens-"))
    return df.checkpoint()
