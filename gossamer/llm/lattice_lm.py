"""Language-model scores by the marginal likelihood of a word's subword lattice.

The pieces of an existing vocabulary are the edges of a lattice over each word; a word's
probability is the sum over all its segmentations of the product of the pieces'
probabilities, by forward recursion in log space. A text is its words and then one end
piece. The available vocabulary is of the merge type, whose scores are ranks and no probabilities: they are read as
Zipf weights to start from, and re-estimated by expectation-maximization over the training words (a departure from
using existing scores as they are; ``rounds=0`` does that). Each
round adds up the expected uses of each piece over the whole table of distinct words, and
only those sums, one per piece of the vocabulary, reach the driver.

Words are counted over all documents, so the table of words grows with the corpus. The
most frequent words over all documents, held out or not, are broadcast with their scores, ``FREQUENT`` words and
``FREQUENT_BYTES`` bytes at most, bounds that the input cannot move; the others are joined, as none of them is
frequent enough to be a hot key.

Edge cases: a null or empty text is the end token alone. A very long text is counted word by word; a very long word
takes time and memory in proportion to its length. Without training documents every
count is zero, and the pieces keep their smoothed starting weights. Rows without a doc_id are no documents;
each of several rows with one doc_id is scored. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import fold_of, id_and_text, map_arrow, materialize, prepare, texts
from gossamer.llm.piece_codec import BYTE, NORMAL, SPACE, model_path

#: Words and bytes of words that may be broadcast, rounds of re-estimation, weight added to every piece.
FREQUENT, FREQUENT_BYTES, ROUNDS, SMOOTHING = 200_000, 1 << 25, 2, 0.1
#: Documents whose crc32 modulo FOLDS is HELD_OUT are not learned from.
FOLDS, HELD_OUT = 7, 2
#: Distinct words a task counts before it hands them on; words scored at a time.
FLUSH, AT_ONCE = 200_000, 20_000
MIX, BASE = 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15


class Vocabulary:
    """Pieces of a vocabulary file, looked up by rolling hashes of code points."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [p for p in model.pieces if p.type == NORMAL and SPACE not in p.piece[1:]]
        self.pieces = [p.piece for p in normal]
        scores = [p.score for p in normal]
        order = sorted(range(len(normal)), key=lambda i: -scores[i])
        rank = np.zeros(len(normal))
        rank[order] = np.arange(len(normal))
        #: ids: the pieces, then 256 bytes, then the end
        self.n = len(normal)
        self.end = self.n + 256
        start = np.concatenate([1 / (rank + 2), np.full(256, 1 / (self.n + 2)), [1 / 50]])
        self.start = np.log(start / start.sum())
        self.longest = max(map(len, self.pieces))
        self.power = np.cumprod(np.full(1, BASE, dtype=np.uint64))
        self._grow(4096)
        hashes = np.zeros(self.n, dtype=np.uint64)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by_length.setdefault(len(p), []).append(i)
        for length, ids in by_length.items():
            sums = self._sums(self._codes([self.pieces[i] for i in ids], length))
            hashes[ids] = self._runs(sums, length)[:, 0]
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two pieces have one hash")

    def _grow(self, n: int) -> None:
        up, down = (np.full(n, b, dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    @staticmethod
    def _codes(words: list[str], length: int) -> np.ndarray:
        """Code points, by way of UTF-32 as trailing NULs must stay."""
        return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        n = codes.shape[1]
        if n + 1 > len(self.up):
            self._grow(2 * n)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(MIX)
        sums = np.zeros((codes.shape[0], n + 1), dtype=np.uint64)
        np.cumsum(mixed * self.up[:n], axis=1, out=sums[:, 1:])
        return sums

    def _runs(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = sums.shape[1] - length
        return (sums[:, length:] - sums[:, :-length]) * self.down[:n]

    def edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length from 1, the piece ids that start at each place; -1 for none."""
        sums = self._sums(codes)
        out = []
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            h = self._runs(sums, length)
            at = np.minimum(np.searchsorted(self.sorted, h), self.n - 1)
            out.append(np.where(self.sorted[at] == h, self.order[at], -1))
        return out


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _byte_scores(codes: np.ndarray, at: tuple, own: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """Log probability of characters that are in no piece, as their UTF-8 bytes."""
    return np.array([sum(logp[own.n + b] for b in chr(c).encode("utf-8", "replace")) for c in codes[at].tolist()])


def lattice(words: list[str], own: Vocabulary, logp: np.ndarray, weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Natural-log marginal probability of each word (a space mark is put before it).

    With ``weights``, each piece's expected uses, times the word's weight, are added to
    ``expected`` by the backward recursion.
    """
    out = np.zeros(len(words))
    by_length: dict[int, list[int]] = {}
    marked = [SPACE + w for w in words]
    for i, w in enumerate(marked):
        by_length.setdefault(len(w), []).append(i)
    for length, members in by_length.items():
        step = max(1, 400_000 // length)
        for k in range(0, len(members), step):
            ids = members[k : k + step]
            out[ids] = _same_length([marked[i] for i in ids], length, own, logp, None if weights is None else weights[ids], expected)
    return out


def _same_length(words, length, own, logp, weights, expected) -> np.ndarray:
    codes = own._codes(words, length)
    edges = own.edges(codes)
    scores = [np.where(e >= 0, logp[e], -np.inf) for e in edges]
    bare = np.nonzero(edges[0] < 0)
    if len(bare[0]):
        scores[0][bare] = _byte_scores(codes, bare, own, logp)
    ahead = np.full((length + 1, len(words)), -np.inf)
    ahead[0] = 0
    for j in range(1, length + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - n] + scores[n - 1][:, j - n] for n in range(1, min(len(scores), j) + 1)])
    total = ahead[length]
    if weights is not None:
        behind = np.full((length + 1, len(words)), -np.inf)
        behind[length] = 0
        for j in range(length - 1, -1, -1):
            behind[j] = np.logaddexp.reduce([behind[j + n] + scores[n - 1][:, j] for n in range(1, min(len(scores), length - j) + 1)])
        for n, (e, s) in enumerate(zip(edges, scores), 1):
            uses = np.exp(ahead[: length - n + 1].T + s + behind[n:].T - total[:, None]) * weights[:, None]
            there = e >= 0
            expected += np.bincount(e[there], uses[there], minlength=len(expected))
            if n == 1:
                for r, c in zip(*(x.tolist() for x in bare)):
                    for b in chr(int(codes[r, c])).encode("utf-8", "replace"):
                        expected[own.n + b] += uses[r, c]
    return total


def count_words(docs: DataFrame) -> DataFrame:
    """word (lower-cased A-Z), c, its count in the training documents, and n, that in all documents."""

    def run(batches):
        training: Counter = Counter()
        others: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [*training, *others]
            c = [*training.values(), *[0] * len(others)]
            n = [*training.values(), *others.values()]
            training.clear()
            others.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"])

        for batch in batches:
            for t, fold in zip(texts(batch, 0), batch.column(1).to_pylist()):
                (others if fold == HELD_OUT else training).update(t.lower().split())
                if len(training) + len(others) > FLUSH:
                    yield flush()
        if training or others:
            yield flush()

    rows = id_and_text(docs).select("text", fold_of("doc_id", FOLDS).alias("fold"))
    return map_arrow(rows, run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def estimate(words: DataFrame, documents: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural-log probabilities of the pieces, the bytes and the end, from the table of words."""
    own = vocabulary(path)
    logp = own.start
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(logp)

        def run(batches, shared=shared):
            mine = vocabulary(path)
            expected = np.zeros(mine.end + 1)
            for table in _gathered(batches):
                lattice(table["word"].to_pylist(), mine, shared.value, table["c"].to_numpy().astype(np.float64), expected)
            used = np.nonzero(expected)[0]
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(expected[used])], names=["piece", "uses"])

        sums = map_arrow(words.filter("c > 0"), run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(own.end + 1, SMOOTHING)
        for r in sums:  # at most one row for each piece of the vocabulary
            uses[r["piece"]] += r["uses"]
        uses[own.end] += documents
        logp = np.log(uses / uses.sum())
        shared.unpersist()
    return logp


def _cutoff(words: DataFrame, most: int, most_bytes: int = FREQUENT_BYTES) -> int:
    """Smallest count of which at most ``most`` words and ``most_bytes`` bytes have as much, from the counts of counts (about the root of the corpus)."""
    rows = size = 0
    cut = 2**62
    counts = words.groupBy("n").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes"))
    for r in counts.orderBy(F.desc("n")).limit(most + 1).toLocalIterator():
        rows, size = rows + r["words"], size + r["bytes"]
        if rows > most or size > most_bytes:
            break
        cut = r["n"]
    return cut


def score_documents(docs: DataFrame, path: str | None = None, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    prepare(spark)
    path = path or model_path()
    words = materialize(count_words(docs), "lm-words")
    totals = words.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1))).first()
    ends = id_and_text(docs).filter(fold_of("doc_id", FOLDS) != HELD_OUT).count()
    n, v = (totals[0] or 0) + ends, (totals[1] or 0) + (ends > 0)
    logp = estimate(words, ends, path, rounds)
    shared = spark.sparkContext.broadcast(logp)
    below = math.log10(n + v + 1)

    def with_scores(batches):
        own = vocabulary(path)
        for table in _gathered(batches):
            found = lattice(table["word"].to_pylist(), own, shared.value) / math.log(10)
            base = np.log10(table["c"].to_numpy() + 1.0) - below
            yield from table.append_column("base", pa.array(base)).append_column("score", pa.array(found)).to_batches()

    scored = materialize(map_arrow(words, with_scores, "word string, c long, n long, base double, score double"), "lm-scores")
    cut = _cutoff(words, frequent)
    top = scored.filter(F.col("n") >= cut).select("word", "base", "score", (F.col("c") > 0).cast("int").alias("known")).toArrow()  # bounded by the cut
    table = dict(zip([w.encode() for w in top["word"].to_pylist()], zip(*(top[c].to_pylist() for c in ("base", "score", "known")))))
    held = spark.sparkContext.broadcast(table)
    end_base = math.log10(ends + 1) - below
    end_score = float(logp[-1] / math.log(10))

    def run(batches):
        frequent_words = held.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for t in texts(batch, 1):
                tokens = t.lower().split()
                known, base, score, rare = int(ends > 0), end_base, end_score, []
                for w, k in Counter(tokens).items():
                    found = frequent_words.get(w)
                    if found is None:
                        rare.append({"word": w.decode(), "k": k})
                    else:
                        base += k * found[0]
                        score += k * found[1]
                        known += k * found[2]
                for column, value in zip(out, (len(tokens) + 1, known, base, score, rare)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=["doc_id", "n_tokens", "n_known", "base", "score", "rare"]
            )

    rows = map_arrow(id_and_text(docs), run, "doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,k:long>>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-documents")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    joined = rare.join(scored.filter(F.col("n") < cut).drop("n"), "word").select(
        "row",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"),
        (F.col("k") * F.col("base")).alias("base"),
        (F.col("k") * F.col("score")).alias("score"),
    )
    whole = rows.select("row", "doc_id", "n_tokens", "n_known", "base", "score").union(joined).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")]
    )
    return whole.select(
        "doc_id",
        (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def op5_lattice_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
