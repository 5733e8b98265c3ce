"""Helpers shared by the training-data operators: shared folders, cut lineage, Arrow batches."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, U+0009-U+000D and U+0020: what ``bytes.split()`` splits on.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Used only where the session names no spark.checkpoint.dir (local tests).
LOCAL_SHARED = "/tmp/checkpoints"

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_SHARED


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gossamer/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that was written.

    Cuts lineage without depending on an executor's own disk: a lost executor costs only
    the tasks that it was running.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession, rows_per_batch: int = 1000) -> None:
    """Bound Arrow batches (texts are long) and let workers import this package."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows_per_batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *filter(None, paths)])


def texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def map_arrow(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """``mapInArrow`` whose worker hands free memory back after each task, as workers live through many stages."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are; a null id names no document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        F.col("doc_id").isNotNull()
    )


def fold_of(column: str, folds: int):
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)
