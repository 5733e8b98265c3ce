"""Cut lineage through the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only where the session names no spark.checkpoint.dir and is local, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to spark.checkpoint.dir, so that a lost executor costs no rounds before this one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or LOCAL_FOLDER)
    return df.checkpoint()
