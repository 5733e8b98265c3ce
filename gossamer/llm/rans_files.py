"""Token ids in range-coded files: static rANS with shared tables, blocks, checkpoints, checksums.

A file holds the ids of consecutive documents. One frequency table, scaled to 2^TABLE_BITS,
is shared by all its blocks. Each block is coded on its own over interleaved lanes (lane l
of n holds ids l, l + n, ...), so numpy codes all lanes of all blocks of a file together, and a
reader may decode any one block alone: the index holds its first id's position, its byte
offset and a checksum, and a checkpoint of the lanes' states stands at its head. Documents
are an array of lengths in the head, so reading needs no separator.

Documents are dealt to partitions by ranges of doc_id and sorted there by Spark; each task
tokenizes its range and closes a file each FILE_TOKENS ids, which bounds memory. Files are written under
a temporary name and renamed; the manifest, written last, holds each file's count of ids,
and its running sum gives each document's start.

Edge cases: a null or empty text is the end id alone. A very long text is one document of one file, which is then
longer than others and held whole. Rows without a doc_id are no
documents; repeated doc_ids are kept, in any order among themselves. An empty table gives
an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.llm.common import fresh_path, id_and_text, map_arrow, prepare, texts
from gossamer.llm.warc import open_fs

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Ids of a block, lanes of a block, ids after which a file is closed.
BLOCK, LANES, FILE_TOKENS = 1 << 16, 64, 1 << 21
#: Files that a task reads one after another, where writers left more than one each.
FILES_A_TASK = 8
#: Frequencies of a table sum to 2^TABLE_BITS.
TABLE_BITS = 20
#: States of a lane live in [LOW, LOW * 2^32) and shift 32 bits at a time.
LOW = 1 << 31
MAGIC = b"GRNS0001"
#: Words that each of a worker's two tables holds, that go to the library at a time, and in one line. No result depends on them.
KEPT, ASKED, LINE = 650_000, 8192, 64
MANIFEST = "file string, part long, number long, first_doc long, last_doc long, documents long, tokens long, bytes long, sha_crc long"


# -- tokens --------------------------------------------------------------


class WordTokens:
    """Ids (little-endian unsigned 32-bit) of texts by the tokenizers library, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words. Only words that are not in the tables go to the library, each batch's once
    and many to a call, told apart by a mark that is a token of its own. There are two tables of
    KEPT words at most: when the younger one is full it becomes the older one, which is dropped.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        mark = self._ids(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.stops = {ord(c): struct.pack(f"<{len(x)}I", *x) for c in ".," for x in [self._ids(c)]}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        table, old = self.young, self.old
        # a stop or comma after an ASCII letter or digit is a token's end of its own, so the word before it is looked up alone
        ends = {w: w[:-1] for w in words if w[-1] in b".," and w[-2:-1].isalnum()}
        wanted = set(words).difference(ends)
        for base in ends.values():
            if base not in table:
                ids = old.get(base)
                if ids is None:
                    wanted.add(base)
                else:
                    table[base] = ids
        self._ask([w for w in wanted if w not in table])
        for w, base in ends.items():
            table[w] = table[base] + self.stops[w[-1]]

    def _ask(self, words: list[bytes]) -> None:
        table = self.young
        odd = {w for w in words if b"\x01" in w or b"<|" in w} if self.mark is not None else set(words)
        for w in odd:
            table[w] = struct.pack(f"<{len(ids)}I", *ids) if (ids := self._ids(w.decode())) else b""
        plain = [w for w in words if w not in odd]
        for k in range(0, len(plain), ASKED):
            part = plain[k : k + ASKED]
            asked = [f" {self.MARK} ".join([w.decode() for w in part[i : i + LINE]]) + f" {self.MARK}" for i in range(0, len(part), LINE)]
            # (the fast form leaves out the offsets, which are not needed)
            found = self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(x.ids for x in found), dtype="<u4")
            marks = np.nonzero(ids == self.mark)[0]
            if len(marks) != len(part):
                raise ValueError("the mark does not tell the words apart")
            raw, ends = ids.tobytes(), (4 * marks).tolist()
            table.update(zip(part, [raw[i + 4 : j] for i, j in zip([-4, *ends], ends)]))

    def batch(self, docs: list[bytes]) -> list[bytes]:
        # the tokenizer lower-cases all but its special tokens
        split = [(d if b"<|" in d else d.lower()).split() for d in docs]
        used = set().union(*split)
        if len(self.young) + len(used) > KEPT:
            self.old, self.young = self.young, {}
        table, old, new = self.young, self.old, []
        for w in used - table.keys():
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                table[w] = ids
        self._learn(new)
        return [b"".join(map(table.__getitem__, words)) for words in split]


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# -- the coder -----------------------------------------------------------


def frequencies(counts: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """Counts scaled to sum to 2^bits, at least 1 where there is a count."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    if int((counts > 0).sum()) > size:
        raise ValueError("more symbols than table slots")
    scaled = np.maximum(counts.astype(np.int64) * size // total, counts > 0).astype(np.int64)
    over = int(scaled.sum()) - size
    order = np.argsort(-scaled, kind="stable")
    if over < 0:
        scaled[order[0]] -= over
    while over > 0:  # take from the largest, never below 1
        take = np.minimum(scaled[order] - 1, -(-over // max(1, int((scaled > 1).sum()))))
        take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
        scaled[order] -= take
        over = int(scaled.sum()) - size
    return scaled


def encode_blocks(ids: np.ndarray, freq: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> list[bytes]:
    """Each block of ``ids`` on its own: the lanes' final states, then the lanes' words in reading order."""
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    freq = freq.astype(np.uint64)
    n_blocks = -(-len(ids) // block)
    steps = -(-block // lanes)
    grid = np.full((n_blocks * block,), -1, dtype=np.int64)
    grid[: len(ids)] = ids
    # step s of block b codes ids b * block + s * lanes + lane
    grid = np.pad(grid.reshape(n_blocks, block), ((0, 0), (0, steps * lanes - block)), constant_values=-1)
    grid = grid.reshape(n_blocks, steps, lanes)
    state = np.full((n_blocks, lanes), LOW, dtype=np.uint64)
    out = np.zeros((steps, n_blocks, lanes), dtype=np.uint32)
    wrote = np.zeros((steps, n_blocks, lanes), dtype=bool)
    shift, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    room = np.uint64(63 - TABLE_BITS)
    for s in range(steps - 1, -1, -1):
        sym = grid[:, s, :]
        there = sym >= 0
        if not there.any():
            continue
        safe = np.where(there, sym, 0)
        f = np.where(there, freq[safe], np.uint64(1))
        full = there & (state >= (f << room))
        out[s] = (state & low).astype(np.uint32)
        wrote[s] = full
        x = np.where(full, state >> shift, state)
        q = x // f
        coded = (q << np.uint64(TABLE_BITS)) + (x - q * f) + start[safe]
        state = np.where(there, coded, state)
    blocks = []
    for b in range(n_blocks):
        words = out[:, b, :][wrote[:, b, :]]  # in the order of steps, then lanes: how the decoder asks for them
        blocks.append(state[b].astype("<u8").tobytes() + words.astype("<u4").tobytes())
    return blocks


def decode_blocks(blocks: list[bytes], sizes: list[int], freq: np.ndarray, lanes: int = LANES) -> list[np.ndarray]:
    """The ids of blocks (any of a file's), ``sizes`` of them each."""
    if not blocks:
        return []
    slots = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.int32), freq)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    freq = freq.astype(np.uint64)
    n = len(blocks)
    state = np.stack([np.frombuffer(b, "<u8", lanes) for b in blocks])
    streams = [np.frombuffer(b, "<u4", offset=8 * lanes) for b in blocks]
    at = np.concatenate([[0], np.cumsum([len(x) for x in streams])[:-1]]).astype(np.int64)
    words = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
    steps = -(-max(sizes) // lanes)
    out = np.zeros((n, steps, lanes), dtype=np.int32)
    left = np.array(sizes)[:, None]
    lane = np.arange(lanes)[None, :]
    mask, bits = np.uint64((1 << TABLE_BITS) - 1), np.uint64(TABLE_BITS)
    for s in range(steps):
        there = s * lanes + lane < left
        slot = state & mask
        sym = slots[slot.astype(np.int64)]
        moved = freq[sym] * (state >> bits) + slot - start[sym]
        need = there & (moved < np.uint64(LOW))
        rank = np.cumsum(need, axis=1)
        index = np.where(need, at[:, None] + rank - 1, len(words) - 1)
        state = np.where(there, np.where(need, (moved << np.uint64(32)) | words[index], moved), state)
        at = at + rank[:, -1]
        out[:, s, :] = sym
    if (state != np.uint64(LOW)).any():
        raise ValueError("a block does not end in its first state")
    flat = out.reshape(n, -1)
    return [flat[i, :k] for i, k in enumerate(sizes)]


# -- files ---------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, dtype="<i8").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype="<i8")


def file_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Magic, head length, head (json), documents, table, block index, blocks."""
    counts = np.bincount(ids) if len(ids) else np.zeros(1, dtype=np.int64)
    freq = frequencies(counts)
    blocks = encode_blocks(ids, freq) if len(ids) else []
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)
    index = np.stack([offsets[:-1], offsets[1:] - offsets[:-1], np.array([zlib.crc32(b) for b in blocks], dtype=np.int64)]) if blocks else np.zeros((3, 0))
    parts = [_packed(doc_ids), _packed(lengths), _packed(freq), _packed(index.astype(np.int64))]
    head = json.dumps(
        {
            "tokens": len(ids), "block": BLOCK, "lanes": LANES, "bits": TABLE_BITS,
            "parts": [len(p) for p in parts], "crc": [zlib.crc32(p) for p in parts],
        }
    ).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts, *blocks])


def read_file(raw: bytes, wanted: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, lengths and ids of a file; ``wanted`` names blocks to decode, all by default."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<I", raw, len(MAGIC))
    at = len(MAGIC) + 4
    head = json.loads(raw[at : at + size])
    at += size
    parts = []
    for n, crc in zip(head["parts"], head["crc"]):
        part = raw[at : at + n]
        if zlib.crc32(part) != crc:
            raise ValueError("a part of the head does not match its checksum")
        parts.append(_unpacked(part))
        at += n
    doc_ids, lengths, freq, index = parts
    index = index.reshape(3, -1)
    blocks, sizes = [], []
    for b in wanted if wanted is not None else range(index.shape[1]):
        block = raw[at + int(index[0, b]) : at + int(index[0, b] + index[1, b])]
        if zlib.crc32(block) != index[2, b]:
            raise ValueError(f"block {b} does not match its checksum")
        blocks.append(block)
        sizes.append(min(head["block"], head["tokens"] - b * head["block"]))
    found = decode_blocks(blocks, sizes, freq, head["lanes"])
    return doc_ids, lengths, np.concatenate(found) if found else np.zeros(0, dtype=np.int32)


def _writer(folder_uri: str, tokenizer: str, file_tokens: int):
    end = struct.pack("<I", END_ID)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(folder_uri)
        context = TaskContext.get()
        own = word_tokens(tokenizer)
        docs: list[int] = []
        held: list[bytes] = []
        size, number = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs, held, size, number
            lengths = np.array([len(h) // 4 for h in held], dtype=np.int64)
            ids = np.frombuffer(b"".join(held), dtype="<u4").astype(np.int64)
            raw = file_bytes(np.array(docs, dtype=np.int64), lengths, ids)
            name = f"tokens-{context.partitionId():06d}-{number:05d}.rans"
            temporary = f"{folder}/_tmp-{context.stageId()}-{context.taskAttemptId()}-{name}"
            with fs.open_output_stream(temporary) as out:
                out.write(raw)
            fs.move(temporary, f"{folder}/{name}")
            row = (name, context.partitionId(), number, docs[0], docs[-1], len(docs), len(ids), len(raw), zlib.crc32(raw))
            docs, held, size, number = [], [], 0, number + 1
            kinds = [pa.string()] + [pa.int64()] * 8
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.batch(texts(batch, 1))):
                docs.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= file_tokens:
                    yield close()
        if docs:
            yield close()

    return write


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    file_tokens: int = FILE_TOKENS,
    partitions: int | None = None,
) -> DataFrame:
    """Write the ids of ``docs`` in ascending doc_id order into ``folder``; returns the committed manifest."""
    spark = docs.sparkSession
    prepare(spark, 500)
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    rows = id_and_text(docs)
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    manifest = map_arrow(dealt.sortWithinPartitions("doc_id"), _writer(folder, tokenizer or tokenizer_path(), file_tokens), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _reader(folder_uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(folder_uri)
        for batch in batches:
            for name, start, crc in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "sha_crc"))):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    raw = f.read()
                if zlib.crc32(raw) != crc:
                    raise ValueError(f"{name} does not match its checksum")
                doc_ids, lengths, ids = read_file(raw)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                for i in range(0, len(doc_ids), 500):
                    k = min(i + 500, len(doc_ids))
                    part = ids[ends[i] : ends[k]].astype("<u4")
                    at = (4 * (ends[i : k + 1] - ends[i])).astype(np.int32)
                    plain = pa.Array.from_buffers(pa.binary(), k - i, [None, pa.py_buffer(at), pa.py_buffer(part)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[i:k]), pa.array(start + ends[i:k]), pa.array(lengths[i:k]), plain],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return read


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the folder's files."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # running sums within each writer's files, and over the writers, one row each
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("files"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before(Window.orderBy("part")).alias("first"))
    files = manifest.withColumn("own", before(Window.partitionBy("part").orderBy("number"))).join(starts, "part")
    files = files.select("part", "number", "file", (F.col("first") + F.col("own")).alias("start"), "sha_crc")
    size = parts.agg(F.count("*").alias("parts"), F.sum("files").alias("files")).first()
    tasks = max(1, size["parts"], (size["files"] or 0) // FILES_A_TASK)
    return map_arrow(files.repartitionByRange(tasks, "part", "number"), _reader(folder), "doc_id long, start long, n_tokens long, ids binary")


def op7_rans(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "rans")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
