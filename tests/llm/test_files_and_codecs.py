"""Archives, token files and pieces against the libraries and round trips."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gossamer.llm import piece_codec, rans_files, warc

PAGES = "page_id long, url string, html string, kind int, shard string, refers_to string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 7, "x", "y") for i, u, h in rows], PAGES)


ROWS = [(5, "http://a/1", "<p>é"), (2, "http://a/2", "same"), (9, None, "same"), (7, "u", None), (1, "u\r\n", ""), (8, "u", "x" * 200_000), (3, "u", "same")]


@pytest.mark.parametrize("floor", [0, 5])
def test_warc_round_trip(spark, tmp_path, floor):
    warc.write_warc(pages(spark, ROWS), f"file://{tmp_path}/w", min_revisit=floor, shard_bytes=100, roll_bytes=300)
    got = {r["page_id"]: r for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert set(got) == {r[0] for r in ROWS}
    for i, _, h in ROWS:
        raw = (h or "").encode()
        least = min(j for j, _, x in ROWS if (x or "") == (h or ""))
        r = got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if least < i and len(raw) >= floor:
            assert (r["record_type"], r["refers_to"], r["html"]) == ("revisit", least, None)
        else:
            assert (r["record_type"], r["refers_to"], r["html"]) == ("response", None, h or "")


def test_warc_is_deterministic_and_leaves_no_temporary_files(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * (i % 50)) for i in range(300)]
    for name, df in (("a", pages(spark, rows)), ("b", pages(spark, rows[::-1]).repartition(5))):
        warc.write_warc(df, f"file://{tmp_path}/{name}", shard_bytes=20_000, roll_bytes=3000)
    files = lambda n: {p.name: p.read_bytes() for p in (tmp_path / n).glob("*.gz")}
    assert files("a") == files("b") and len(files("a")) > 3
    assert not list((tmp_path / "a").glob("_tmp*"))
    assert all(gzip.decompress(x).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for x in files("a").values())


def test_warc_empty_and_repeated_ids(spark, tmp_path):
    warc.write_warc(pages(spark, []), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0
    rows = [(1, "u", "a"), (4, "u", "b"), (4, "u", "a"), (4, "u", "a"), (4, "v", "c")]
    warc.write_warc(pages(spark, rows), f"file://{tmp_path}/r")
    got = sorted((r["page_id"], r["html"] or "", r["refers_to"] or 0) for r in warc.read_warc(spark, f"file://{tmp_path}/r").collect())
    assert got == [(1, "a", 0), (4, "", 1), (4, "", 1), (4, "b", 0), (4, "c", 0)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3 * rans_files.BLOCK // 2), st.integers(1, 49_408), st.integers(0, 9))
def test_rans_round_trip(n, symbols, seed):
    ids = np.minimum(np.random.default_rng(seed).zipf(1.2, n) - 1, symbols - 1).astype(np.int64)
    docs, lengths, back = rans_files.read_file(rans_files.file_bytes(np.array([seed]), np.array([n]), ids))
    assert docs.tolist() == [seed] and lengths.tolist() == [n] and (back == ids).all() and len(back) == n


def test_rans_blocks_alone_and_checksums():
    ids = np.random.default_rng(1).integers(0, 1000, 3 * rans_files.BLOCK + 5)
    raw = rans_files.file_bytes(np.array([1]), np.array([len(ids)]), ids)
    _, _, second = rans_files.read_file(raw, range(1, 2))
    assert (second == ids[rans_files.BLOCK : 2 * rans_files.BLOCK]).all()
    broken = bytearray(raw)
    broken[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans_files.read_file(bytes(broken))


def test_frequencies_sum():
    for counts in ([1], [5, 0, 3], [1] * 40_000 + [10**9], [10**12, 1, 1]):
        f = rans_files.frequencies(np.array(counts))
        assert f.sum() == 1 << rans_files.TABLE_BITS and all((a > 0) == (b > 0) for a, b in zip(counts, f))


DOCS = [(4, "The  Cat's \t <|endoftext|> sat"), (1, None), (9, "É́ ﬁ \x01 12 "), (7, ""), (3, "the cat " * 3000), (2, "\x85\xa0a\x1cb")]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(rans_files.tokenizer_path())
    df = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, start string")
    rans_files.write_tokens(df, f"file://{tmp_path}/t", file_tokens=50, partitions=3)
    got = {r["doc_id"]: r for r in rans_files.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    start = 0
    for i, t in sorted(DOCS):
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids)), i
        assert zlib.crc32(got[i]["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    rans_files.write_tokens(df.limit(0), f"file://{tmp_path}/none")
    assert rans_files.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


PARTS = [" ", "  ", "▁", "\n", "\t", "a", "e", "th", "the", "é", "中", "😀", "\x00", "<s>", "<0x0A>", "�", "er", " t", "23", ".", "́"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())


def test_pieces_equal_the_library(library):
    own, r = piece_codec.codec(piece_codec.model_path()), random.Random(1)
    for _ in range(4000):
        s = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
        ids = own.encode(s)
        assert ids == library.encode(s), repr(s)
        assert own.decode(ids) == library.decode(ids), repr(s)
        some = [r.randrange(32000) if r.random() < 0.5 else r.randrange(260) for _ in range(r.randint(0, 6))]
        assert own.decode(some) == library.decode(some), some


def test_compatibility_is_what_merging_says():
    own, r = piece_codec.codec(piece_codec.model_path()), random.Random(2)
    short = [t for t in own.splits if len(t) <= 5]
    for _ in range(3000):
        a, b = r.choice(short), r.choice(short)
        assert own._compatible(a, b) == (own._merged(a + b) == [a, b]), (a, b)


def test_encoded_documents(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, ids string")
    for r in piece_codec.digest_documents(df, with_ids=True).collect():
        t = dict(DOCS)[r["doc_id"]] or ""
        ids = library.encode(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_codec.digest_documents(df.limit(0)).count() == 0


def test_shard_of_many_bounds(spark):
    from bisect import bisect_right

    bounds = [0, *sorted(random.Random(3).sample(range(1, 5000), 200))]
    got = spark.range(0, 6000, 7).select("id", warc._shard_of(__import__("pyspark").sql.functions.col("id"), bounds).alias("s")).collect()
    assert all(r["s"] == bisect_right(bounds, r["id"]) - 1 for r in got)
