"""Quality scores by voting of the nearest labelled documents in a latent-semantic space.

A document is a bag of terms: its words and its runs of three bytes, each hashed to one of ``TERMS``
features, and six levels that say how often its words and lines repeat, how many signs and capitals it
has and how long it is, which no bag of terms tells. Document frequencies are counted over the whole corpus. The
TF-IDF rows of a bounded sample of labelled documents give the latent space (truncated
SVD) and the labelled vectors, which are broadcast. Every document is then folded into the
space and compared with all labelled vectors by exact cosine products, a block of
documents at a time; the labels of its ``NEIGHBOURS`` nearest are weighted by similarity.
On held-out labels terms alone catch fewer low-quality documents than terms with levels (README).

Nothing but the text enters a score. Labels are learned only from rows outside fold 0.

Edge cases: a null or empty text has levels but no terms and is scored like any other. A very long text is
counted whole. Of neighbours that are equally near (to five digits) those with smaller doc_ids vote. Null labels and labels of unknown documents are
ignored; of several labels of one doc_id the smallest counts, once, for the smallest of its texts. Without any usable
label every score is 1.0 (nothing is rejected unlearned). Rows without a doc_id are no
documents; each of several rows with one doc_id is scored. Extra columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import fold_of, id_and_text, map_arrow, prepare, texts

#: Labelled documents that are learned from at most (those with the smallest hashes of their ids).
SAMPLE = 4096
#: Dimensions of the latent space, neighbours that vote, power of the similarity that weights a vote,
#: folds, score from which a document is accepted.
DIMENSIONS, NEIGHBOURS, POWER, FOLDS, ACCEPT = 48, 15, 32, 5, 0.3
#: Features of words, as many of runs of three bytes, then levels of six scales: words that repeat the one before,
#: signs, capitals, words and lines seen before, length. A level's part of the terms' norm, before its IDF.
TERMS, LEVELS, SCALES, PART = 1 << 12, 16, 6, 1 / 3 / 6**0.5
N_FEATURES = 2 * TERMS + SCALES * LEVELS
SIGNS = [bytes([b]) for b in b"#*$%&|<>!=_~^@{}[]"]
#: Documents that are folded together, and labelled rows that the driver spreads out at a time.
TOGETHER, SPREAD = 512, 64


def _level(share: float) -> int:
    """Level 0 for none; the others are finer for small shares."""
    return min(LEVELS - 1, 1 + int(share**0.5 * (LEVELS - 1))) if share > 0 else 0


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and weights of a text: logarithms of the terms' counts, and 1 for the six levels, which come last."""
    words = text.split()
    codes = np.frombuffer(text, dtype=np.uint8)
    of_words = np.fromiter(map(zlib.crc32, text.lower().split()), dtype=np.int64, count=len(words)) & TERMS - 1
    runs = codes.astype(np.uint32)
    runs = (runs[:-2] << 16 | runs[1:-1] << 8 | runs[2:]) * np.uint32(0x9E3779B1) >> np.uint32(20)
    counts = np.concatenate([np.bincount(of_words, minlength=TERMS), np.bincount(runs.astype(np.int64), minlength=TERMS)])
    ids = np.nonzero(counts)[0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = [
        sum(map(operator.eq, words, words[1:])) / max(1, len(words)),
        sum(map(text.count, SIGNS)) / max(1, len(words)),
        int(np.count_nonzero((codes >= 65) & (codes <= 90))) / max(1, len(text)),
        1 - len(set(words)) / max(1, len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
        min(LEVELS - 1, len(words).bit_length()) / LEVELS,
    ]
    levels = [2 * TERMS + k * LEVELS + _level(min(1.0, x)) for k, x in enumerate(shares)]
    return np.concatenate([ids, levels]), np.concatenate([np.log1p(counts[ids]), np.ones(SCALES)])


def _row(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and weights of a unit TF-IDF row."""
    ids, weights = found
    weights = weights * idf[ids]
    weights[:-SCALES] /= max(float(np.linalg.norm(weights[:-SCALES])), 1e-12)
    weights[-SCALES:] *= PART
    return ids, (weights / np.linalg.norm(weights)).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Rows as dense blocks of ``SPREAD``."""
    for k in range(0, len(rows), SPREAD):
        part = rows[k : k + SPREAD]
        out = np.zeros((len(part), N_FEATURES), dtype=np.float32)
        for row, (ids, weights) in zip(out, part):
            row[ids] = weights
        yield out


def latent_axes(rows: list[tuple[np.ndarray, np.ndarray]], dimensions: int = DIMENSIONS, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """Right singular vectors of ``rows`` by subspace iteration."""
    width = min(dimensions + 8, len(rows), N_FEATURES)
    q = np.random.default_rng(seed).standard_normal((N_FEATURES, width)).astype(np.float32)
    for _ in range(rounds):
        total = np.zeros_like(q)
        for block in _dense(rows):
            total += block.T @ (block @ q)
        q, _ = np.linalg.qr(total)
    _, _, vt = np.linalg.svd(np.concatenate([block @ q for block in _dense(rows)]), full_matrices=False)
    return (q @ vt.T)[:, : min(dimensions, width)].astype(np.float32)


def fold(rows: list[tuple[np.ndarray, np.ndarray]], axes: np.ndarray) -> np.ndarray:
    """Unit coordinates of rows in the latent space."""
    return _unit(np.array([weights @ axes[ids] for ids, weights in rows], dtype=np.float32).reshape(len(rows), axes.shape[1]))


def vote(block: np.ndarray, labelled: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by similarity; of equally near ones the first vote."""
    near = np.round((block @ labelled.T).astype(np.float64), 5)
    n = near.shape[1]
    k = min(neighbours, n)
    order = (near * 100_000).astype(np.int64) * n - np.arange(n)  # no two of a row are equal
    at = np.argpartition(-order, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, at, axis=1), 1e-6) ** POWER
    return (weight * labels[at]).sum(axis=1) / weight.sum(axis=1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and all documents; one row per feature reaches the driver."""

    def run(batches):
        total, n = np.zeros(N_FEATURES, dtype=np.int64), 0
        for batch in batches:
            for t in texts(batch, 1):
                total[features(t)[0]] += 1
                n += 1
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), -1]), pa.array([*total[ids].tolist(), n])], names=["feature", "n"])

    rows = map_arrow(id_and_text(docs), run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(N_FEATURES), 0
    for r in rows:
        if r["feature"] < 0:
            n = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return out, n


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, label: str = "quality") -> tuple:
    """(idf, axes, labelled vectors, their labels) from at most ``sample`` labelled documents outside fold 0, in order of doc_id."""
    frequencies, n = document_frequencies(docs)
    idf = np.log((n + 1) / (frequencies + 1)) + 1
    rows = id_and_text(docs)
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold_of("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
    chosen = usable.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            found = [features(t) for t in texts(batch, 2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([i.astype("<u2").tobytes() for i, _ in found], pa.binary()),
                    pa.array([w.astype("<f4").tobytes() for _, w in found], pa.binary()),
                ],
                names=["doc_id", "y", "ids", "weights"],
            )

    # the sample's bound is a parameter, so it may be broadcast
    texts_of = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    found = map_arrow(texts_of, run, "doc_id long, y int, ids binary, weights binary").toArrow()
    if not found.num_rows:
        return idf, None, None, None
    order = np.argsort(found["doc_id"].to_numpy()).tolist()
    known = found["y"].to_numpy()[order].astype(np.float64)
    bags = ((found["ids"][i].as_py(), found["weights"][i].as_py()) for i in order)
    rows = [_row((np.frombuffer(i, "<u2"), np.frombuffer(w, "<f4")), idf) for i, w in bags]
    del found
    axes = latent_axes(rows)
    return idf, axes, fold(rows, axes), known


def _scores(found: list[bytes], model: tuple) -> list[float]:
    """Scores of texts, a block at a time."""
    idf, axes, labelled, known = model
    if axes is None:
        return [1.0] * len(found)
    out: list[float] = []
    for k in range(0, len(found), TOGETHER):
        out += vote(fold([_row(features(t), idf) for t in found[k : k + TOGETHER]], axes), labelled, known).tolist()
    return out


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample, folds))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(texts(batch, 1), model.value), pa.float64())], names=["doc_id", "score"])

    return map_arrow(id_and_text(docs), run, "doc_id long, score double").select(
        "doc_id",
        (fold_of("doc_id", folds) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is accepted; one pass, no join. Rows without a doc_id go."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample, folds))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([x >= ACCEPT for x in _scores(texts(batch, at), model.value)], pa.bool_()))

    return map_arrow(docs.filter(F.col("doc_id").isNotNull()), run, docs.schema)


def op6_knn_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
