"""Predicates over errors and configurations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The errors that no retry mends; all others may pass.
PERMANENT = ["MessageTooLarge", "Config", "Shutdown", "Encode", "Decode"]

#: Configuration fields that must be above zero, in the order in which they are checked, and those checked only when set.
POSITIVE = [
    "eager_fanout",
    "lazy_fanout",
    "graft_timeout",
    "ihave_interval",
    "message_cache_max_size",
    "message_cache_ttl",
    "ihave_batch_size",
    "max_message_size",
]
POSITIVE_FINITE, BURST = "graft_rate_limit_per_second", "graft_rate_limit_burst"
POSITIVE_WHEN_SET = ["max_peers", "max_eager_peers", "max_lazy_peers"]


def error_kind(variant: Column) -> Column:
    return F.when(variant.isin(PERMANENT), "permanent").otherwise("transient")


def is_resource_exhausted(variant: Column, message: Column) -> Column:
    """Full queues, no peers, and channel errors that tell of capacity."""
    text = F.coalesce(message, F.lit(""))
    told = text.contains("full") | text.contains("capacity")
    return variant.isin("QueueFull", "NoPeers") | ((variant == "Channel") & told)


def config_error(fields: dict[str, Column]) -> Column:
    """The first failing check of a row's configuration as text; null where all hold. Fields that are not given are not checked."""
    failures = [F.when(fields[f] <= 0, f"{f} must be > 0") for f in POSITIVE if f in fields]
    if POSITIVE_FINITE in fields:
        rate = fields[POSITIVE_FINITE].cast("double")
        bad = (rate <= 0) | F.isnan(rate) | (F.abs(rate) == float("inf"))
        failures.append(F.when(bad, f"{POSITIVE_FINITE} must be positive and finite"))
    if BURST in fields:
        failures.append(F.when(fields[BURST] <= 0, f"{BURST} must be > 0"))
    failures += [F.when(fields[f] <= 0, f"{f} must be > 0 when set") for f in POSITIVE_WHEN_SET if f in fields]
    return F.coalesce(*failures, F.lit(None).cast("string"))
