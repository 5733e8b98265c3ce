"""Streaming forms: TTL de-duplication, tumbling counts, token buckets as keyed state."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; one under the temporary folder where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or os.path.join(tempfile.gettempdir(), 'checkpoints')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """node, msg_id, kind, ts (event time), seq from a file or folder of events as files appear."""
    schema = spark.read.parquet(path).schema
    # a pattern that matches the path alone, as a stream's plain path must be a folder
    pattern = f"{path[:-1]}[{path[-1]}]"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    return source.select(
        F.col("user_id").alias("node"),
        F.concat_ws("/", "event_type", "props").alias("msg_id"),
        F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def deduplicated(copies: DataFrame, ttl: str) -> DataFrame:
    """The first copy of each message at a node; a repeat within ``ttl`` of event time is dropped and the state then expires."""
    return copies.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["node", "msg_id"])


def tumbling_counts(copies: DataFrame, width: str, late: str) -> DataFrame:
    """kind, start, n for each window, once its watermark has passed."""
    counted = copies.withWatermark("ts", late).groupBy("kind", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("kind", F.col("w.start").alias("start"), "n")


def token_buckets(requests: DataFrame, key: str, rate_per_s: float, burst: float) -> DataFrame:
    """key, seq, allowed: one token per request from each key's bucket, held as state between micro-batches.

    Requests of a micro-batch are taken in order of (ts, seq); a key's state is two numbers.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (burst, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        allowed = []
        for ts in rows["ts"]:
            ms = ts.value // 1_000_000
            tokens = min(burst, tokens + (0 if at is None else (ms - at) / 1000 * rate_per_s))
            at = ms
            allowed.append(tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0
        state.update((float(tokens), int(at)))
        yield pd.DataFrame({key: k[0], "seq": rows["seq"], "allowed": allowed})

    return requests.groupBy(key).applyInPandasWithState(
        step, f"{key} long, seq long, allowed boolean", "tokens double, at long", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame) -> DataFrame:
    """Process what is there, write it out exactly once, and return the written table."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
