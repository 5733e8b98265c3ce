"""Line files: peer addresses and Prometheus exposition text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_peers(addresses: DataFrame, column: str, path: str) -> None:
    """One address a line; Spark's committer writes under temporary names and renames."""
    addresses.select(F.col(column).cast("string")).write.text(path)


def parse_peers(lines: DataFrame) -> DataFrame:
    """address of the lines (value) that hold one; blank lines, comments and malformed addresses are skipped."""
    address = F.trim("value")
    valid = address.rlike(r"^(\[[0-9A-Fa-f:.]+\]|\d{1,3}(\.\d{1,3}){3}):\d{1,5}$")
    return lines.select(address.alias("address")).filter(valid & ~F.col("address").startswith("#"))


def read_peers(spark: SparkSession, path: str) -> DataFrame:
    return parse_peers(spark.read.text(path))


def parse_metrics(lines: DataFrame) -> DataFrame:
    """metric, label, value, kind of exposition lines (value); comments and malformed lines are skipped."""
    line = F.trim("value")
    name = F.regexp_extract(line, r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1)
    label = F.nullif(F.regexp_extract(line, r"^[^{\s]+\{[^=}]+=\"([^\"]*)\"", 1), F.lit(""))
    number = F.regexp_extract(line, r"\s(\S+)$", 1).try_cast("double")
    kind = (
        F.when(F.col("metric").endswith("_total"), "counter")
        .when(F.col("metric").rlike("_(bucket|sum|count)$"), "histogram")
        .otherwise("gauge")
    )
    parsed = lines.filter(~line.startswith("#")).select(name.alias("metric"), label.alias("label"), number.alias("number"))
    return parsed.filter((F.col("metric") != "") & F.col("number").isNotNull()).withColumn("kind", kind)
