"""A deterministic, sharded WARC 1.1 writer and its reader.

Shards are ranges of the record key. Their bounds come from an exact histogram of payload
bytes over key ranges, refined where a range is heavy, so the same table gives the same
shards whatever the cluster does. Each shard is sorted by Spark and streamed by one task
into files that roll once their compressed size passes a limit; every record is a gzip
member of its own with regenerated headers and digests. A file is written under a
temporary name that holds the task attempt, then renamed; a retried task therefore
replaces a file by identical bytes. The manifest is a table written last, and readers open
only the files that it names.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the smallest
key is the response; the others are revisits that name it and carry its digest and length
instead of the payload.

Edge cases: a null html is an empty payload. A null url is written as an empty target.
Rows without a page_id are no records. Of rows with one page_id each is written, and the record
ids of all but the first carry a running number. An empty table gives an empty manifest and no files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.common import fresh_path, map_arrow, materialize, prepare, texts

#: Payload bytes that a shard should hold, compressed bytes after which a file rolls.
SHARD_BYTES, ROLL_BYTES = 64 << 20, 32 << 20
#: Ranges that the histogram may hold before light ones are merged: what the driver sees.
MAX_RANGES = 4096
#: Records carry the capture time that the writer is given, never the clock's.
CAPTURED = "2024-01-01T00:00:00Z"
LEVEL = 6

MANIFEST = "file string, shard long, records long, compressed_bytes long, sha256 string, first_id long, last_id long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int, repeat: int = 0) -> str:
    return f"urn:gossamer:page:{page_id}" + (f":{repeat}" if repeat else "")


def page_of(urn: str) -> int:
    return int(urn.strip("<>").split(":")[3])


def _headers(pairs: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs)
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def render(page_id: int, url: str, payload: bytes, refers_to: int | None, repeat: int = 0) -> bytes:
    """One record: an HTTP response, or a revisit that holds its HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    pairs = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_urn(page_id, repeat)}>"),
        ("WARC-Date", CAPTURED),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        pairs += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{record_urn(refers_to)}>"),
        ]
    return _headers(pairs, block)


class _File:
    """A file of one shard, under a temporary name until it is whole."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, number: int, attempt: str):
        self.fs, self.shard, self.name = fs, shard, f"part-{shard:06d}-{number:05d}.warc.gz"
        self.final, self.temporary = f"{folder}/{self.name}", f"{folder}/_tmp-{attempt}-{self.name}"
        self.out, self.sha = fs.open_output_stream(self.temporary, compression=None), hashlib.sha256()
        self.size, self.ids = 0, []
        self.count, self.first, self.last = 0, None, None
        info = "software: gossamer\r\nformat: WARC File Format 1.1\r\n".encode()
        self._put(
            _headers(
                [
                    ("WARC-Type", "warcinfo"),
                    ("WARC-Record-ID", f"<urn:gossamer:file:{self.name}>"),
                    ("WARC-Date", CAPTURED),
                    ("WARC-Filename", self.name),
                    ("Content-Type", "application/warc-fields"),
                ],
                info,
            )
        )

    def _put(self, record: bytes) -> None:
        member = gzip.compress(record, LEVEL, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, page_id: int, record: bytes) -> None:
        self._put(record)
        self.count, self.last = self.count + 1, page_id
        self.first = page_id if self.first is None else self.first

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.name, self.shard, self.count, self.size, self.sha.hexdigest(), self.first, self.last


def _writer(folder_uri: str, roll_bytes: int):
    """Streams sorted rows (page_id, kind, url, html, refers_to, shard) into files; roles (their html is the payload's hash) precede their pages."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(folder_uri)
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.taskAttemptId()}"
        current, number, done, last, repeat = None, 0, [], None, 0
        roles: tuple[int | None, dict[bytes, int]] = (None, {})  # of one page_id: payload hash to the page it repeats
        for batch in batches:
            ids, kinds, refers, shards = (batch.column(i).to_pylist() for i in (0, 1, 4, 5))
            urls, pages = texts(batch, 2), texts(batch, 3)
            for page_id, kind, least, shard, url, page in zip(ids, kinds, refers, shards, urls, pages):
                if kind == 0:
                    roles = roles if roles[0] == page_id else (page_id, {})
                    roles[1][page] = least
                    continue
                repeat = repeat + 1 if last == (shard, page_id) else 0
                if current and (current.shard != shard or current.size >= roll_bytes):
                    number = number + 1 if current.shard == shard else 0
                    done.append(current.close())
                    current = None
                if current is None:
                    number = 0 if last is None or last[0] != shard else number
                    current = _File(fs, folder, shard, number, attempt)
                refers_to = roles[1].get(hashlib.sha256(page).digest()) if roles[0] == page_id else None
                current.add(page_id, render(page_id, url.decode(), page, refers_to, repeat))
                last = (shard, page_id)
        if current:
            done.append(current.close())
        columns = list(zip(*done)) if done else [[]] * 7
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")]
        )

    return write


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """First page_id of each shard, from exact sums of bytes over key ranges. At most MAX_RANGES rows reach the driver."""
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    fixed: list[tuple[int, int]] = []  # (first id of a range, its bytes)
    open_ranges = [(low, high + 1)]
    while open_ranges:
        step = MAX_RANGES // len(open_ranges)
        width = [max(1, -(-(b - a) // step)) for a, b in open_ranges]
        where = F.coalesce(
            *[
                F.when((F.col("page_id") >= a) & (F.col("page_id") < b), F.lit(a) + F.floor((F.col("page_id") - a) / w).cast("long") * w)
                for (a, b), w in zip(open_ranges, width)
            ]
        )
        counted = sizes.select(where.alias("start"), "size").filter("start IS NOT NULL").groupBy("start").agg(F.sum("size").alias("bytes")).collect()
        following = []
        for r in counted:
            a, b, w = next((a, b, w) for (a, b), w in zip(open_ranges, width) if a <= r["start"] < b)
            if r["bytes"] > shard_bytes and w > 1:
                following.append((r["start"], min(b, r["start"] + w)))
            else:
                fixed.append((r["start"], r["bytes"]))
        # ranges refined at a time are few enough for the histogram to stay small
        open_ranges = following if len(following) <= MAX_RANGES // 4 else []
        fixed += [] if open_ranges else [(a, shard_bytes) for a, _ in following]
    bounds, held = [], shard_bytes + 1
    for start, size in sorted(fixed):
        if held and held + size > shard_bytes:
            bounds.append(start)
            held = 0
        held += size
    return bounds


def _shard_of(page_id, bounds: list[int], step: int = 64):
    """Number of the last bound that is not above page_id: first among every 64th bound, then within that run."""
    array = lambda x: F.array(*[F.lit(b).cast("long") for b in x])
    if not bounds:
        return F.lit(0).cast("long")
    below = lambda a: F.size(F.filter(a, lambda b: b <= page_id)) - 1
    head = below(array(bounds[::step]))
    runs = F.array(*[array(bounds[i : i + step]) for i in range(0, len(bounds), step)])
    return (head * step + below(F.element_at(runs, head + 1))).cast("long")


def write_warc(
    pages: DataFrame,
    folder: str,
    min_revisit: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files into ``folder``; returns the committed manifest."""
    spark = pages.sparkSession
    prepare(spark, 200)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.filter(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        payload.alias("html"),
    )
    facts = materialize(
        rows.select(
            "page_id", F.length("html").cast("long").alias("size"), F.unhex(F.sha2("html", 256)).alias("same")
        ),
        "warc-facts",
    )
    firsts = (
        facts.filter(F.col("size") >= min_revisit)
        .groupBy("same")
        .agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisits = facts.join(firsts, "same").filter(F.col("least") < F.col("page_id")).select("page_id", "same", "least")
    bounds = shard_bounds(facts.select("page_id", "size"), shard_bytes)
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    shard = _shard_of(F.col("page_id"), bounds)
    # a page's role travels beside it and sorts just before it, so the payloads are dealt once and never joined
    tagged = rows.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to")).union(
        revisits.select("page_id", F.lit(0), F.lit(None).cast("string"), "same", "least")
    )
    dealt = (
        tagged.withColumn("shard", shard)
        .repartitionById(max(1, len(bounds)), F.col("shard").cast("int"))
        .sortWithinPartitions("shard", "page_id", "kind", "url", "html")
    )
    manifest = map_arrow(dealt, _writer(folder, roll_bytes), MANIFEST)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-cased name) and block of every record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def _reader(folder_uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(folder_uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for headers, block in parse_records(io.BufferedReader(plain, 1 << 20)):
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        out.append(_decoded(headers, block))
                        held += len(block)
                        if held > 8 << 20:
                            yield _page_batch(out)
                            out, held = [], 0
                if out:
                    yield _page_batch(out)

    return read


PAGES = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _decoded(headers: dict[str, str], block: bytes) -> tuple:
    if f"sha1:{sha1_base32(block)}" != headers["warc-block-digest"]:
        raise ValueError(f"block digest of {headers['warc-record-id']} does not hold")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} does not hold")
    return (
        page_of(headers["warc-record-id"]),
        headers["warc-target-uri"],
        None if revisit else payload.decode(),
        size,
        digest,
        headers["warc-type"],
        page_of(headers["warc-refers-to"]) if revisit else None,
    )


def _page_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PAGES.split(", ")]
    )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest names, with digests verified; html is null in revisits."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = manifest.select("file").repartition(max(1, manifest.count()))
    return map_arrow(files, _reader(folder), PAGES)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = fresh_path(spark, "warc")
    write_warc(pages, folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
),
d AS (SELECT page_id, payload, octet_length(payload) AS size, sha1(payload) AS h, sha256(payload) AS same FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY same) AS least FROM d)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least < page_id THEN least END AS refers_to
FROM r
"""
