"""Benchmark passages in documents, found by latent semantic retrieval.

Passages of the benchmark's items are TF-IDF rows, weighted by document frequencies over the
whole corpus; their leading right singular vectors, by a randomised SVD whose products
Spark's tasks compute and sum, span the latent space. Every passage of every document is
folded into it and compared with all item passages by cosine, against the
passage's full TF-IDF norm, so text that is about something else scores low. What can't
reach the threshold, as its words outside the benchmark carry too much weight, is not
multiplied out.

What the cosine loses, as words outside the benchmark weigh the more the larger the corpus and
the fewer words of a passage are the item's, a count finds: where a region holds ``COVERAGE`` of an
item in order, it holds as many of the item's words in any order. Places where it doesn't are the only
ones left out, so the candidates hold all that the verification accepts, whatever the corpus.

Candidates are then verified: an item is found where the longest common subsequence of its
words and the text around the passage covers ``COVERAGE`` of the item, and that of its
answer, the last line or sentence, ``ANSWER_COVERAGE`` of the answer. Word order and changed
words are thus allowed for up to that share, which catches paraphrases.

Items are taken in blocks of about ``BLOCK_WORDS`` words, few enough for the dimensions to hold
nearly all of their passages, and ``BLOCKS`` blocks share a reading of the documents: these bound
what is broadcast.

Edge cases: null or empty texts and items match nothing. An item of fewer than ``LEAST_WORDS``
words is found where all its words stand in a row, and nowhere else. Rows without a doc_id or item_id are
ignored; of equal item_ids each is searched. Empty tables give no hits. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import id_and_text, map_arrow, prepare, texts

#: Words of a passage, words from one to the next, cosine from which a passage is a candidate.
PASSAGE, STRIDE, COSINE = 24, 8, 0.45
#: Share of an item's words, and of its answer's, that the text must hold in order.
COVERAGE, ANSWER_COVERAGE, LEAST_WORDS = 0.7, 0.5, 8
#: Dimensions of a space, rounds of the SVD, words of a block of items, blocks that share a reading.
DIMENSIONS, ROUNDS, BLOCK_WORDS, BLOCKS = 384, 3, 8_000, 8
#: Words of a text whose passages are counted together.
REACH = 512
#: Rows of the summed products that travel together.
ROWS = 512

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


def answer_of(text: bytes) -> list[bytes]:
    """Words of an item's last line, or of its last sentence where it has one line."""
    lines = [x for x in text.split(b"\n") if words_of(x)]
    parts = lines if len(lines) > 1 else [x for x in re.split(rb"(?<=[.!?])\s+", text) if words_of(x)]
    return words_of(parts[-1]) if parts else []


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = where.get(w)
        if hit:
            both = row & hit
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def starts_of(n: int) -> np.ndarray:
    """First words of the passages of n words; the last one ends with the text."""
    return np.array([0]) if n <= PASSAGE else np.unique([*range(0, n - PASSAGE + 1, STRIDE), n - PASSAGE])


class Space:
    """What a block of items needs: words, weights, axes, and the items' own passages."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray):
        self.vocabulary, self.idf = vocabulary, idf
        self.outside = float(idf.max()) if len(idf) else 1.0
        self.axes = self.passages = self.item_of = None
        self.items: list[tuple[int, list[bytes], list[bytes]]] = []
        self.short: dict[bytes, list[tuple[int, list[bytes]]]] = {}

    def hold(self, items: list[tuple[int, list[bytes], list[bytes]]], short: list[tuple[int, list[bytes]]]) -> None:
        """Take the items: how often each has each of its words, and the short ones by their rarest word."""
        self.items = items
        bags = [np.unique(self.ids(w), return_counts=True) for _, w, _ in items]
        self.needed = np.array([math.ceil(COVERAGE * len(w)) for _, w, _ in items], dtype=np.int64)
        self.first = np.cumsum([0, *(len(b) for b, _ in bags)])
        self.bag_words = np.concatenate([b for b, _ in bags]) if bags else np.zeros(0, dtype=np.int64)
        self.bag_times = np.concatenate([t for _, t in bags]) if bags else np.zeros(0, dtype=np.int64)
        self.longest = max((len(w) for _, w, _ in items), default=0)
        for item_id, w in short:
            self.short.setdefault(max(w, key=lambda x: self.idf[self.vocabulary[x]]), []).append((item_id, w))

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter([get(w, -1) for w in words], dtype=np.int64, count=len(words))

    def rows(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF rows of passages, as (word ids, weights) of PASSAGE columns; a word of the vocabulary counts once.

        Words outside it count in the norm, each time. Unused columns have weight 0.
        """
        padded = np.concatenate([ids, np.full(PASSAGE, -2)])
        at = np.sort(padded[starts[:, None] + np.arange(PASSAGE)[None, :]], axis=1)
        counts = at >= 0
        counts[:, 1:] &= at[:, 1:] != at[:, :-1]
        outside = (at == -1).sum(axis=1)
        at = np.where(counts, at, 0)
        weights = np.where(counts, self.idf[at], 0.0)
        norms = np.sqrt((weights**2).sum(axis=1) + outside * self.outside**2)
        return at, weights / np.maximum(norms, 1e-12)[:, None]

    def fold(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Coordinates of rows in the space."""
        weights = weights.astype(np.float32)
        out = np.zeros((len(at), self.axes.shape[1]), dtype=np.float32)
        for c in np.nonzero(weights.any(axis=0))[0]:
            out += weights[:, c : c + 1] * self.axes[at[:, c]]
        return out

    def near(self, ids: np.ndarray, cosine: float = COSINE) -> list[tuple[int, int, float]]:
        """(first word, item, cosine) of the passages that are near one of an item's."""
        starts = starts_of(len(ids))
        if not len(ids) or not self.items:
            return []
        inside = np.where(ids >= 0, self.idf[ids] ** 2, 0.0)
        weight = np.where(ids >= 0, inside, self.outside**2)
        ends = np.minimum(starts + PASSAGE, len(ids))
        a, b = (np.concatenate([[0.0], np.cumsum(x)]) for x in (inside, weight))
        # a row's norm inside the vocabulary bounds its product with any unit vector, and these sums bound that norm
        able = (a[ends] - a[starts]) >= cosine**2 * (b[ends] - b[starts])
        starts = starts[able]
        if not len(starts):
            return []
        near = np.concatenate([self.fold(*self.rows(ids, starts[i : i + 512])) @ self.passages.T for i in range(0, len(starts), 512)])
        hits: dict[tuple[int, int], float] = {}
        for k, q in zip(*np.nonzero(near >= cosine)):
            key = (int(starts[k]), int(self.item_of[q]))
            hits[key] = max(hits.get(key, 0.0), float(near[k, q]))
        return [(s, i, c) for (s, i), c in hits.items()]

    def holding(self, words: list[bytes], ids: np.ndarray) -> list[tuple[int, int]]:
        """(first word, item) of every passage whose region may hold enough of an item: none that does is left out."""
        if not len(ids) or not self.items:
            return []
        out: list[tuple[int, int]] = []
        starts, size = starts_of(len(ids)), len(self.vocabulary)
        for group in np.split(starts, np.searchsorted(starts, np.arange(REACH, len(ids), REACH))):
            if not len(group):
                continue
            part = ids[max(0, group[0] - self.longest) : group[-1] + PASSAGE + self.longest]
            times = np.bincount(part[part >= 0], minlength=size)
            held = np.add.reduceat(np.minimum(times[self.bag_words], self.bag_times), self.first[:-1])
            for k in np.nonzero(held >= self.needed)[0].tolist():
                item, needed = self.items[k][1], self.needed[k]
                low, high = np.maximum(group - len(item), 0), np.minimum(group + PASSAGE + len(item), len(ids))
                own = np.zeros(size + 1, dtype=bool)
                own[self.bag_words[self.first[k] : self.first[k + 1]]] = True
                sums = np.concatenate([[0], np.cumsum(own[ids[low[0] : high[-1]]])])
                able = np.nonzero(sums[high - low[0]] - sums[low - low[0]] >= needed)[0]
                for run in np.split(able, np.nonzero(np.diff(able) > 1)[0] + 1):
                    # what all regions of a run hold together bounds what each holds
                    if len(run) and lcs_length(item, words[low[run[0]] : high[run[-1]]]) >= needed:
                        out += [(int(s), k) for s in group[run]]
        return out

    def cosines(self, ids: np.ndarray, places: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
        """(first word, item, cosine) of given places."""
        if not places:
            return []
        folded = self.fold(*self.rows(ids, np.array([s for s, _ in places])))
        return [(s, k, float((self.passages[self.item_of == k] @ x).max())) for (s, k), x in zip(places, folded)]

    def exact(self, words: list[bytes]) -> list[tuple]:
        """Short items whose words stand in a row, as verify() returns what it finds."""
        out: dict[int, tuple] = {}
        if self.short:
            for word in self.short.keys() & set(words):
                at = [i for i, w in enumerate(words) if w == word]
                for n, (item_id, item) in enumerate(self.short[word]):
                    back = item.index(word)
                    found = [i - back for i in at if i >= back and words[i - back : i - back + len(item)] == item]
                    if found:
                        out[word, n] = (item_id, 1.0, len(item), 1.0, 1.0, found[0])
        return list(out.values())

    def found(self, words: list[bytes], cosine: float = COSINE) -> list[tuple]:
        """All items that the words hold, as verify() returns them."""
        ids = self.ids(words)
        near = self.near(ids, cosine)
        known = {(s, k) for s, k, _ in near}
        counted = [x for x in self.holding(words, ids) if x not in known]
        return verify(words, near + self.cosines(ids, counted), self.items) + self.exact(words)


def _fit_part(space: Space, q: np.ndarray | None, docs: list[bytes], width: int, seed: int) -> np.ndarray:
    """This part's share of A^T A Q (of A^T G with a random G at first)."""
    size = len(space.vocabulary)
    out = np.zeros((size, width), dtype=np.float64)
    for n, text in enumerate(docs):
        words = words_of(text)
        if not words:
            continue
        at, weights = space.rows(space.ids(words), starts_of(len(words)))
        draw = np.random.default_rng([seed, n, len(words)])
        for columns, row in zip(at, weights):
            y = draw.standard_normal(width) if q is None else row @ q[columns]
            np.add.at(out, columns, row[:, None] * y[None, :])
    return out


def _summed(spark, rows: DataFrame, space: Space, q: np.ndarray | None, width: int) -> np.ndarray:
    """The products of all tasks, summed by blocks of rows; vocabulary x width numbers reach the driver."""
    shared = spark.sparkContext.broadcast((space, q))

    def run(batches):
        own, mine = shared.value
        total = None
        for k, batch in enumerate(batches):
            part = _fit_part(own, mine, texts(batch, 0), width, k)
            total = part if total is None else total + part
        if total is None:
            return
        blocks = range(0, len(total), ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int64()), pa.array([total[b : b + ROWS].tobytes() for b in blocks], pa.binary())],
            names=["at", "part"],
        )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in pdf["part"])
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0])], "part": [total.tobytes()]})

    found = map_arrow(rows, run, "at long, part binary").groupBy("at").applyInPandas(add, "at long, part binary").collect()
    out = np.zeros((len(space.vocabulary), width))
    for r in found:
        block = np.frombuffer(r["part"], dtype=np.float64).reshape(-1, width)
        out[r["at"] : r["at"] + len(block)] = block
    shared.unpersist()
    return out


def _frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each of the benchmark's words, and all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches):
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            for t in texts(batch, 1):
                seen.update(shared.value.intersection(words_of(t)))
                n += 1
        names = [*seen, b""]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([*seen.values(), n], pa.int64())], names=["word", "n"])

    found = map_arrow(id_and_text(docs), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(len(vocabulary)), 0
    for r in found:
        word = bytes(r["word"])
        if word:
            out[vocabulary[word]] = r["n"]
        else:
            total = r["n"]
    return out, total


def fit(spark, items: list[tuple[int, bytes]], idf_of: dict[bytes, float], dimensions: int = DIMENSIONS) -> Space:
    """The latent space of a block of items."""
    vocabulary: dict[bytes, int] = {}
    split = [(i, t, words_of(t)) for i, t in items]
    kept = [(i, t, w) for i, t, w in split if len(w) >= LEAST_WORDS]
    short = [(i, w) for i, _, w in split if 0 < len(w) < LEAST_WORDS]
    for words in [w for _, _, w in kept] + [w for _, w in short]:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    space = Space(vocabulary, np.array([idf_of[w] for w in vocabulary]))
    space.hold([(i, w, answer_of(t)) for i, t, w in kept], short)
    if not kept:
        return space
    rows = spark.createDataFrame([(bytearray(t),) for _, t, _ in kept], "text binary").repartition(4)
    width = min(dimensions + 16, len(vocabulary))
    q = None
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(_summed(spark, rows, space, q, width))
    product = q.T @ _summed(spark, rows, space, q, width)  # Q^T A^T A Q: its eigenvectors turn Q into singular vectors
    values, vectors = np.linalg.eigh((product + product.T) / 2)
    space.axes = (q @ vectors[:, np.argsort(-values)[:dimensions]]).astype(np.float32)
    folded = [space.fold(*space.rows(space.ids(w), starts_of(len(w)))) for _, w, _ in space.items]
    space.item_of = np.repeat(np.arange(len(folded)), [len(x) for x in folded])
    together = np.concatenate(folded)
    space.passages = together / np.maximum(np.linalg.norm(together, axis=1, keepdims=True), 1e-12)
    return space


def verify(words: list[bytes], near: list[tuple[int, int, float]], items: list) -> list[tuple]:
    """(item id, cosine, LCS words, coverage, answer coverage, first word) of the items found, best place of each."""
    best: dict[int, tuple] = {}
    for start, k, cosine in near:
        item_id, item, answer = items[k]
        region = words[max(0, start - len(item)) : start + PASSAGE + len(item)]
        common = lcs_length(item, region)
        if common < COVERAGE * len(item):
            continue
        share = lcs_length(answer, region) / len(answer)
        if share >= ANSWER_COVERAGE and (k not in best or (common, cosine) > (best[k][2], best[k][1])):
            best[k] = (item_id, cosine, common, common / len(item), share, start)
    return list(best.values())


HITS = "doc_id long, item_id long, cosine double, lcs_words long, coverage double, answer_coverage double, first_word long"


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[list[tuple[int, bytes]]]:
    """The stated set of items, in blocks."""
    rows = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .filter("item_id IS NOT NULL AND text IS NOT NULL")
        .orderBy("item_id", "text")
    )
    out: list[list[tuple[int, bytes]]] = []
    size = 0
    for r in rows.toLocalIterator():
        text = r["text"].encode()
        n = len(words_of(text))
        if not out or size + n > block_words:
            out.append([])
            size = 0
        out[-1].append((r["item_id"], text))
        size += n
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    spark = docs.sparkSession
    prepare(spark)
    hits = None
    blocks = blocks_of(benchmark)
    for first in range(0, len(blocks), BLOCKS):
        group = blocks[first : first + BLOCKS]
        vocabulary = {w: k for k, w in enumerate(sorted({w for items in group for _, t in items for w in words_of(t)}))}
        frequencies, n = _frequencies(docs, vocabulary)
        idf_of = dict(zip(vocabulary, (np.log((n + 1) / (frequencies + 1)) + 1).tolist()))
        shared = spark.sparkContext.broadcast([fit(spark, items, idf_of) for items in group])

        def run(batches, shared=shared):
            for batch in batches:
                out: list[tuple] = []
                for doc_id, t in zip(batch.column(0).to_pylist(), texts(batch, 1)):
                    words = words_of(t)
                    for space in shared.value:
                        out += [(doc_id, *x) for x in space.found(words, cosine)]
                columns = list(zip(*out)) if out else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in HITS.split(", ")]
                )

        found = map_arrow(id_and_text(docs), run, HITS)
        hits = found if hits is None else hits.union(found)
    return spark.createDataFrame([], HITS) if hits is None else hits


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
