"""How the given tables stand for messages, peers, stores, queues and metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column):
    """Epoch milliseconds of a timestamp without time zone, read as UTC."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, msg_id (kind and payload), kind, payload, ts (ms), seq: copies of logical messages at nodes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("node"),
        F.concat_ws("/", "event_type", "props").alias("msg_id"),
        F.col("event_type").alias("kind"),
        F.col("props").alias("payload"),
        millis("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        "value",
    )


#: Message kind of an event type, and the tag of each kind.
KIND = {"view": "gossip", "click": "ihave", "signup": "graft", "purchase": "sync", "error": "prune"}

#: The same table for DuckDB.
MESSAGES_SQL = """
messages AS (
  SELECT user_id AS node, event_type || '/' || props AS msg_id, event_type AS kind, props AS payload,
    epoch_us(ts) // 1000 AS ts, event_id AS seq, value
  FROM events
)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, payload, ts, round: the messages of a store."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("payload"), F.col("doc_id").alias("ts"), (F.col("n_chars") % 8).alias("round")
    )


def replica(spark: SparkSession, sf_dir: str, without: int) -> DataFrame:
    return stored(spark, sf_dir).filter(F.col("id") % 10 != without)


STORED_SQL = "stored AS (SELECT doc_id AS id, text AS payload, doc_id AS ts, n_chars % 8 AS round FROM documents)"
REPLICAS_SQL = f"{STORED_SQL}, a AS (SELECT * FROM stored WHERE id % 10 <> 3), b AS (SELECT * FROM stored WHERE id % 10 <> 7)"


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, node: the members of each cluster."""
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("node"))


PEERS_SQL = "peers AS (SELECT s_nationkey AS cluster, s_suppkey AS node FROM supplier)"


def queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queue, class (0 critical to 3 low), seq, item."""
    o = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        (F.col("o_custkey") % 16).alias("queue"),
        F.least(digit - 1, F.lit(3)).alias("class"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
        F.col("o_orderkey").alias("item"),
    )


QUEUE_SQL = """
items AS (
  SELECT o_custkey % 16 AS queue, least(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1, 3) AS class,
    o_orderdate AS d, o_orderkey AS item
  FROM orders
)"""
