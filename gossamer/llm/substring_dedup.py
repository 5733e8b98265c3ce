"""Removal of repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of ``WINDOW`` consecutive words of a document gets two rolling polynomial hashes
modulo 2^64 with different bases, so 128 bits tell windows apart. A window that occurs earlier, in a document with a
smaller id or further up in its own, is repeated; the words that repeated windows cover
are merged into maximal intervals and removed.

Most windows occur once, and it would be a waste to deal all of them out to learn that.
Each window names an anchor, the smallest hash of its runs of ``ANCHOR`` words: equal
windows have equal anchors, so a window whose anchor has one occurrence in the corpus
has one itself. Neighbouring windows share anchors, which makes them some eight times
fewer than windows. So anchors are counted first, and then the windows whose anchor
is repeated. The filter loses nothing: it is the windows' own count that decides.

A document equal to an earlier one, word for word, is removed whole by its digest; its
windows need no count, as the earlier document has them all. Counts are pre-aggregated,
windows are distinct in each document before they are dealt out, and only repeated hashes
are joined back. Digests of very many documents (``HOT``) are few, so they are broadcast, and a large
group of copies never meets in one task. Texts travel compressed.

Edge cases: a null or empty text has no words and nothing is removed (the digest is that of
the empty text). Texts shorter than a window lose nothing. A very long text is one row, whose windows are
hashed as arrays. Rows without a doc_id are no
documents; rows with an equal doc_id are not earlier than each other, whether their texts are equal or not, and each
is judged by its own words. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm.common import SPACE_CLASS, fresh_name, id_and_text, map_arrow, materialize, texts

WINDOW, ANCHOR = 20, 6
#: Copies of a text beyond which its digest is hot, and hot digests that are broadcast at most (a larger table has larger hot groups).
HOT, MOST_HOT = 1000, 100_000
#: Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
EMPTY = hashlib.sha256(b"").hexdigest()


class Rolling:
    """Hashes of all runs of words by prefix sums: sum of word j times B^j, shifted back by B^-i."""

    def __init__(self) -> None:
        self.powers = {b: (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)) for b in BASES}

    def _tables(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers[base]
        if len(up) < n:
            size = max(n, 2 * len(up), 4096)
            inverse = pow(base, -1, 1 << 64)
            up, down = (np.full(size, b, dtype=np.uint64) for b in (base, inverse))
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            self.powers[base] = up, down
        return up, down

    def sums(self, words: np.ndarray, base: int) -> np.ndarray:
        up, _ = self._tables(base, len(words) + 1)
        out = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[: len(words)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, base: int, length: int) -> np.ndarray:
        n = len(sums) - length
        _, down = self._tables(base, len(sums))
        return (sums[length:] - sums[:-length]) * down[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _anchors(rolling: Rolling, sums: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``anchor`` words, and of each window the smallest one in it (scrambled, so that it is spread evenly)."""
    grams = rolling.runs(sums, BASES[0], anchor)
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return grams, sliding_min(grams, window - anchor + 1)


def scan(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, sha256 of the joined words, anchors (twice those that occur again in the document)."""

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            counts, digests, found = [], [], []
            for t in texts(batch, 1):
                words = t.split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                if len(words) < window:
                    found.append(np.zeros(0, dtype=np.int64))
                    continue
                grams, least = _anchors(rolling, rolling.sums(word_hashes(words), BASES[0]), window, anchor)
                chosen = np.unique(least)
                grams.sort()
                again = np.searchsorted(grams, chosen, "right") - np.searchsorted(grams, chosen, "left") > 1
                found.append(np.concatenate([chosen, chosen[again]]).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int64())),
                ],
                names=["doc_id", "n_words", "digest", "anchors"],
            )

    return map_arrow(id_and_text(docs), run, "doc_id long, n_words long, digest binary, anchors array<long>")


def _packed(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, nth, and the text, compressed for the way."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            found = texts(batch, 1)
            digests = [hashlib.sha256(b" ".join(t.split())).digest() for t in found]
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array([pack.compress(t) for t in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "packed"])

    return _named(map_arrow(id_and_text(docs), run, "doc_id long, digest binary, packed binary"), names).drop("digest")


def _names(scanned: DataFrame) -> DataFrame:
    """doc_id, digest, nth of the texts that share a doc_id with other texts: normally none."""
    several = scanned.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id")
    texts_of = scanned.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct()
    return materialize(texts_of.withColumn("nth", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("digest"))), "substring-names")


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds nth, which with doc_id tells texts apart: 0 unless several have the doc_id."""
    return rows.join(names, ["doc_id", "digest"], "left").withColumn("nth", F.coalesce("nth", F.lit(0)))


def _windows(joined: DataFrame, window: int, anchor: int) -> DataFrame:
    """Windows with a repeated anchor (doc_id, nth, packed, anchors): hashes and starts of each one's first occurrence, and the starts of later ones."""
    schema = "doc_id long, nth int, h1 array<long>, h2 array<long>, at array<int>, again array<int>"

    def run(batches):
        rolling, unpack = Rolling(), zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for packed, anchors in zip(batch.column(2).to_pylist(), batch.column(3)):
                words = word_hashes(unpack.decompress(packed).split())
                sums = rolling.sums(words, BASES[0])
                _, least = _anchors(rolling, sums, window, anchor)
                wanted = np.unique(anchors.values.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
                at = np.nonzero(np.isin(least, wanted))[0]
                h1 = rolling.runs(sums, BASES[0], window)[at]
                h2 = rolling.runs(rolling.sums(words, BASES[1]), BASES[1], window)[at]
                # equal windows of one document side by side, the earliest first
                order = np.lexsort((at, h2, h1))
                a, b, p = h1[order], h2[order], at[order]
                new = np.ones(len(p), dtype=bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                for column, values in zip(out, (a[new].view(np.int64), b[new].view(np.int64), p[new].astype(np.int32), np.sort(p[~new]).astype(np.int32))):
                    column.append(values)
            lists = []
            for column, kind in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32())):
                ends = np.concatenate([[0], np.cumsum([len(x) for x in column])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(column) if column else [], kind)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "nth", "h1", "h2", "at", "again"])

    return map_arrow(joined, run, schema)


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal half-open intervals that windows at ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.sort(starts)
    breaks = np.nonzero(np.diff(starts) > window)[0]
    first = np.concatenate([[0], breaks + 1])
    last = np.concatenate([breaks, [len(starts) - 1]])
    return [(int(a), int(b) + window) for a, b in zip(starts[first], starts[last])]


def _cut(joined: DataFrame, window: int) -> DataFrame:
    """doc_id, nth, removed intervals and kept words of (doc_id, nth, packed, again, starts)."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            spans, kept, removed = [], [], []
            for packed, again, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                words = unpack.decompress(packed).split()
                gone = intervals(np.array((again or []) + (starts or []), dtype=np.int64), window)
                left, at = [], 0
                for a, b in gone:
                    left += words[at:a]
                    at = b
                left += words[at:]
                spans.append([{"start": a, "end": b} for a, b in gone])
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "nth", "n_removed", "removed", "kept_text"],
            )

    return map_arrow(joined, run, "doc_id long, nth int, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")


def copies_of_earlier(texts_of: DataFrame, hot: int = HOT, most_hot: int = MOST_HOT) -> DataFrame:
    """doc_id, nth of the texts (doc_id, nth, digest) that a smaller doc_id has too."""
    groups = texts_of.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    groups = materialize(groups.filter("least < most").drop("most"), "substring-digests")
    over = max(hot, (groups.agg(F.sum("n")).first()[0] or 0) // most_hot)
    # groups of over n / most_hot rows are fewer than most_hot, so these may be broadcast
    few = F.broadcast(groups.filter(F.col("n") > over).drop("n"))
    other = groups.filter(F.col("n") <= over).drop("n")
    found = texts_of.join(few, "digest").union(texts_of.join(few, "digest", "left_anti").join(other, "digest"))
    return found.filter(F.col("least") < F.col("doc_id")).select("doc_id", "nth").distinct()


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(facts, cuts): doc_id, nth, n_words, digest and copy of every document; packed text, again and starts of those to cut."""
    key = ["doc_id", "nth"]
    scanned = materialize(scan(docs, window, anchor), "substring-scan")
    names = _names(scanned)
    scanned = _named(scanned, names)
    copied = materialize(copies_of_earlier(scanned.filter(F.col("n_words") >= window).select("doc_id", "nth", "digest")), "substring-copies")
    first = scanned.select(*key, "anchors").join(copied, key, "left_anti").select(*key, F.explode("anchors").alias("anchor"))
    repeated = first.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    wanted = materialize(first.join(repeated, "anchor").groupBy(*key).agg(F.collect_set("anchor").alias("anchors")), "substring-anchors")
    windows = _windows(_packed(docs, names).join(wanted, key).select(*key, "packed", "anchors"), window, anchor)
    windows = materialize(windows, "substring-windows")
    single = windows.select(*key, F.explode(F.arrays_zip("h1", "h2", "at")).alias("w")).select(
        *key, F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"), F.col("w.at").alias("at")
    )
    earliest = (
        single.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most")
        .drop("most")
    )
    starts = (
        single.join(earliest, ["h1", "h2"])
        .filter(F.col("least") < F.col("doc_id"))
        .groupBy(*key)
        .agg(F.collect_set("at").alias("starts"))
    )
    places = windows.select(*key, "again").dropDuplicates(key).join(starts, key, "left").filter((F.size("again") > 0) | F.col("starts").isNotNull())
    places = materialize(places, "substring-places")
    cuts = _packed(docs, names).join(places, key).select(*key, "packed", "again", "starts")
    facts = scanned.select(*key, "n_words", "digest").join(copied.withColumn("copy", F.lit(True)), key, "left")
    return facts, cuts


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, removed intervals, kept_text, kept_sha256 and the words' own digest of every document.

    kept_text is null where nothing is removed: the text stands as it is. Where the whole
    text is removed it is empty.
    """
    facts, cuts = repeated_windows(docs, window, anchor)
    cut = materialize(_cut(cuts, window), "substring-cuts")
    joined = facts.join(cut.dropDuplicates(["doc_id", "nth"]), ["doc_id", "nth"], "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>"))).alias("removed"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(F.col("copy"), F.lit(EMPTY))
        .when(F.col("kept_text").isNotNull(), F.sha2(F.col("kept_text").cast("binary"), 256))
        .otherwise(F.lower(F.hex("digest")))
        .alias("kept_sha256"),
        "digest",
    )


def words_digest(text: Column) -> Column:
    """SHA-256 of a text's words joined by one space, as ``scan`` has it."""
    words = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS, " ")
    return F.unhex(F.sha2(F.trim(words).cast("binary"), 256))


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of ``docs``, all columns as they are but for ``text`` and, where there is one, ``n_chars``: repeated passages are cut out.

    Texts without such a passage stay as they are, and so do rows without a doc_id. Documents of which nothing is left go.
    """
    found = substring_dedup(docs, window, anchor).filter("n_removed > 0")
    facts = F.struct("kept_text", (F.col("n_removed") < F.col("n_words")).alias("some"))
    same, cut, key, digest = (fresh_name(docs, x) for x in ("same", "cut", "cut_id", "cut_digest"))
    found = found.select(F.col("doc_id").alias(key), F.col("digest").alias(digest), facts.alias(cut)).dropDuplicates([key, digest])
    found = materialize(found, "substring-found")
    marked = docs.withColumn(same, words_digest(F.col("text")))
    joined = marked.join(found, (F.col("doc_id").cast("long") == F.col(key)) & (F.col(same) == F.col(digest)), "left")
    kept = joined.filter(F.col(cut).isNull() | F.col(cut)["some"])
    text = F.coalesce(F.col(cut)["kept_text"], F.col("text"))
    size = F.when(F.col(cut)["kept_text"].isNotNull(), F.length(F.col(cut)["kept_text"]))
    changed = {"text": text} | ({"n_chars": F.coalesce(size, F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return kept.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in docs.columns])


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, i + k AS p FROM later, (SELECT unnest(range(20)) AS k) GROUP BY ALL),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
