"""Payload compression: a flag byte, then the compressed bytes only where they are fewer."""

from __future__ import annotations

import gzip
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bit 0 of the flag says compressed, bits 1 and 2 the algorithm (0 none, 1 gzip).
COMPRESSED, GZIP, LEAST = 1, 1, 256


def _pack(data: bytes) -> bytes:
    if len(data) >= LEAST:
        small = gzip.compress(data, 6, mtime=0)
        if len(small) < len(data):
            return bytes([COMPRESSED | GZIP << 1]) + small
    return b"\x00" + data


def _unpack(data: bytes) -> bytes | None:
    if not data:
        return b""
    flag, body = data[0], data[1:]
    if not flag & COMPRESSED:
        return body
    try:
        return gzip.decompress(body) if flag >> 1 & 3 == GZIP else None
    except (OSError, EOFError, zlib.error):
        return None


# Spark hands rows to these by the hundred; Arrow batches of 10,000 texts grow with the texts.


@F.udf(T.BinaryType(), useArrow=False)
def pack(payload):
    return None if payload is None else _pack(bytes(payload))


@F.udf(T.BinaryType(), useArrow=False)
def unpack(packed):
    """Null for an unknown algorithm or broken data."""
    return None if packed is None else _unpack(bytes(packed))
