"""Near-duplicate detection by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits; two of them link when at most 3 bits differ. Cut into 6 blocks,
3 differing bits leave 3 blocks untouched, so a linked pair agrees on one of the 20 choices
of 3 blocks: each fingerprint is keyed 20 times, by some 32 bits each, and only those that
share a key are compared.

Documents with equal fingerprints are one row from the start, so copies never meet in a
key. A key shared by many different fingerprints is split again: the pairs still to be
found agree on 3 of 6 blocks of the remaining bits, so its members are keyed 20 times by
some 16 bits more. Members of such a group differ in 18 bits at most: there are no more
than 262,144 of them, whatever the corpus holds, and a table of those values answers
which are within 3 bits. Every group thus has a bound without any cap, and each returns a spanning
forest of its links, never all its pairs.

Edge cases: a null or empty text has fingerprint zero and links like any other. Fewer than
three words make one shingle. Very long texts are hashed whole, shingles a chunk at a time. Rows without a doc_id are no documents. An empty table gives
an empty result. Other columns are ignored; of rows with an equal doc_id each is fingerprinted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import id_and_text, map_arrow, materialize, texts
from gossamer.llm.components import connected_components

#: Words of a shingle in the fingerprint, bits that linked fingerprints may differ by.
SHINGLE, MAX_BITS = 3, 3
#: Blocks a fingerprint is cut into; MAX_BITS fewer of them make a key.
BLOCKS = 6
#: Fingerprints that may share a key before it is split again.
SPLIT_OVER = 256
#: Shingles whose bits are unpacked at a time; rows of keys that are compared at a time.
CHUNK, AT_ONCE = 1 << 16, 1 << 17


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 (seed 42) of a text's lower-cased word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        starts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum([len(w) + 1 for w in words], out=starts[1:])
        ends = (starts[width:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t) for t in texts(batch, 1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long)."""
    return map_arrow(id_and_text(docs), _fingerprints, "doc_id long, fp long")


def _cuts(bits: list[int], blocks: int) -> list[int]:
    """Masks of ``blocks`` runs of the given bit positions."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]


def key_masks(free: int = (1 << 64) - 1, blocks: int = BLOCKS, differing: int = MAX_BITS) -> list[int]:
    """Every choice of blocks that ``differing`` bits leave untouched, as masks within ``free``."""
    cuts = _cuts([b for b in range(64) if free >> b & 1], blocks)
    return [sum(chosen) for chosen in combinations(cuts, blocks - differing)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _close_by_pairs(prints: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of fingerprints within their (neighbouring) groups: each with the next one, the one after it, and so on.

    What earlier steps have linked is not taken again, so a group of near copies gives as many links as members.
    """
    n = len(prints)
    parent, kept = list(range(n)), []
    root = np.arange(n)
    here = np.arange(n)
    for step in range(1, n):
        here = here[here + step < n]
        here = here[group[here] == group[here + step]]
        if not len(here):
            break
        close = here[np.bitwise_count(prints[here] ^ prints[here + step]) <= MAX_BITS]
        close = close[root[close] != root[close + step]]
        if len(close):
            kept += _forest(n, close.tolist(), (close + step).tolist(), parent)
            root = np.array(parent)
            while (root != root[root]).any():
                root = root[root]
    return kept


def _gather(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of ``values`` under ``mask``, moved together at the low end."""
    out, n = np.zeros(len(values), dtype=np.uint64), 0
    for b in range(64):
        if mask >> b & 1:
            out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(n)
            n += 1
    return out


def _forest(n: int, i, j, parent: list[int] | None = None) -> list[tuple[int, int]]:
    """Those links of (i, j) that join two parts of what was linked before."""
    parent = list(range(n)) if parent is None else parent

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(i, j):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _close_by_table(prints: np.ndarray, free: int) -> list[tuple[int, int]]:
    """Spanning links of fingerprints that differ only under ``free`` (18 bits at most), by looking up each near value."""
    width = free.bit_count()
    small = _gather(prints, free).astype(np.int64)
    at = np.full(1 << width, -1, dtype=np.int64)
    at[small] = np.arange(len(small))
    parent, kept = list(range(len(small))), []
    for k in range(1, MAX_BITS + 1):
        for flips in combinations(range(width), k):
            other = at[small ^ sum(1 << f for f in flips)]
            i = np.nonzero(other > np.arange(len(small)))[0]
            kept += _forest(len(small), i.tolist(), other[i].tolist(), parent)
    return kept


def _links_of(prints: np.ndarray, group: np.ndarray, free: np.ndarray) -> list[tuple[int, int]]:
    """Links of rows whose groups stand side by side: small groups together, each large one by a table of its free bits."""
    bounds = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(group)]])
    sizes = np.diff(bounds)
    found: list[tuple[int, int]] = []
    for i in np.nonzero(sizes > 4 * SPLIT_OVER)[0].tolist():
        own = np.unique(prints[bounds[i] : bounds[i + 1]])
        width = int(free[bounds[i]]) & (1 << 64) - 1
        if width.bit_count() > 20:
            raise ValueError("a key of this width must be split first")
        outside = own & np.uint64(~width & (1 << 64) - 1)
        for rest in np.unique(outside):  # one value, unless two keys have one hash
            part = own[outside == rest]
            found += [(part[a], part[b]) for a, b in _close_by_table(part, width)]
    small = np.repeat(sizes <= 4 * SPLIT_OVER, sizes)
    some, at = prints[small], group[small]
    return found + [(some[a], some[b]) for a, b in _close_by_pairs(some, at)]


def _group_links(batches):
    """Links within each key of a partition in order of keys (group, free, fp): batches are cut where a key ends."""
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> pa.RecordBatch:
        found = _links_of(rows[2].view(np.uint64), rows[0], rows[1]) if rows.shape[1] else []
        ends = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in range(3)]))
        if sum(x.shape[1] for x in held) < AT_ONCE or held[-1][0][0] == held[-1][0][-1]:
            continue
        rows = np.concatenate(held, axis=1)
        cut = int(np.searchsorted(rows[0] == rows[0][-1], True))
        held = [rows[:, cut:]]
        yield done(rows[:, :cut])
    if held:
        yield done(np.concatenate(held, axis=1))


def _links(keyed: DataFrame) -> DataFrame:
    """Links (u, v) within each group of (group, free, fp), whose sizes are bounded."""
    spark = keyed.sparkSession
    # a stated number of partitions, as adaptive execution would run these small rows in one task
    dealt = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "fp")
    return map_arrow(dealt, _group_links, "u long, v long")


def _keyed(prints: DataFrame, masks: list[int], free_of: int) -> DataFrame:
    """(k, part, free, fp): fp once per mask, ``part`` being the bits it must share."""
    choices = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("mask"), F.lit(_signed(free_of & ~m)).alias("free")) for k, m in enumerate(masks)]
    )
    return prints.select("fp", F.explode(choices).alias("c")).select(
        F.col("c.k").alias("k"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("part"), F.col("c.free").alias("free"), "fp"
    )


def links(prints: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """Spanning links (u, v) of distinct fingerprints ``fp``: what is within MAX_BITS is connected."""
    everything = (1 << 64) - 1
    first = _keyed(prints, key_masks(), everything)
    sizes = first.groupBy("k", "part").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes, "simhash-keys")
    held = first.join(sizes, ["k", "part"])
    # rows are dealt anew by a different key than the join's, so that a skewed join may be split; two keys of
    # one hash are compared together, which adds no false link as every pair is verified
    few = held.filter(F.col("n") <= split_over).select(F.xxhash64("k", "part", F.lit(1)).alias("group"), "free", "fp")
    near = _links(few)
    if not sizes.filter(F.col("n") > split_over).limit(1).count():
        return near
    many = held.filter(F.col("n") > split_over)
    branches = None
    for k, m in enumerate(key_masks()):
        free = everything & ~m
        inner = _keyed(many.filter(F.col("k") == k).select("fp"), [m | x for x in key_masks(free)], everything)
        branches = inner if branches is None else branches.union(inner)
    return near.union(_links(branches.select(F.xxhash64("part", "free").alias("group"), "free", "fp")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of every document."""
    prints = materialize(fingerprints(docs), "simhash-fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    parts = connected_components(links(classes.select("fp")))
    named = (
        parts.withColumnRenamed("node", "fp")
        .join(classes, "fp")
        .groupBy("component")
        .agg(F.min("least").alias("component_id"))
    )
    linked = parts.join(named, "component").select(F.col("node").alias("fp"), F.col("component_id"))
    final = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(materialize(final, "simhash-components"), "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
