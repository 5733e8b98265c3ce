"""Quality rules, SimHash and substring dedup against plain Python."""

import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gossamer.llm import components, quality_rules, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, digest string, fp string"


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sample(seed, n=60, vocabulary=30):
    r = random.Random(seed)
    w = [f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(r.choice(w) for _ in range(r.choice([0, 1, 5, 19, 20, 21, 45, 90]))) for _ in range(n)]
    shared = " ".join(r.choice(w) for _ in range(27))
    texts += [texts[5], texts[7], shared, f"a b {shared} c d", f"{shared} {shared}", None, "", "  \n\t ", "x " * 400]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows


def test_measures(spark):
    rows = sample(1) + [(1000, "# a\n# a\n\n \nb"), (1001, "é ü " * 30)]
    got = {r["doc_id"]: r for r in quality_rules.measures(frame(spark, rows)).collect()}
    for i, t in rows:
        w = words(t)
        tri = list(zip(w, w[1:], w[2:]))
        covered = {k + j for k, g in enumerate(tri) if tri.count(g) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules_reject_symbols_and_keep_clean(spark):
    r = random.Random(2)
    clean = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(120))) for i in range(60)]
    junk = [(100 + i, " ".join(w + "###" for w in t.split())) for i, t in clean[:6]]
    got = {x["doc_id"]: x["kept"] for x in quality_rules.quality_rules(frame(spark, clean + junk + [(500, None)])).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk) and not got[500]


def test_quality_rules_empty_and_null_groups(spark):
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, "a " * 60, None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert quality_rules.quality_rules(rows).count() == 2


def brute_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbBÉé \n\t\x1c", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_components(prints):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates(spark):
    rows = sample(3)
    base = " ".join(f"t{i}" for i in range(300))
    rows += [(2000 + k, base.replace(f"t{k * 7} ", "changed ")) for k in range(12)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)


def test_links_of_a_hot_key(spark):
    """Many fingerprints around one center, so that keys are split again."""
    r = random.Random(4)
    center = r.getrandbits(64)
    prints = {center}
    while len(prints) < 500:
        x = center
        for _ in range(r.randint(1, 9)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    signed = [(simhash._signed(x),) for x in prints]
    df = spark.createDataFrame(signed, "fp long").distinct()
    parts = components.connected_components(simhash.links(df, split_over=16))
    got = {r["node"] & (1 << 64) - 1: r["component"] for r in parts.collect()}
    want = brute_components({x: x for x in prints})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == c) for c in set(m.values()))
    assert [g for g in groups(want) if len(g) > 1] == groups(got)


def test_close_by_table_equals_pairs():
    import numpy as np

    r = random.Random(5)
    free = sum(1 << b for b in range(3, 60, 4))
    fixed = r.getrandbits(64) & ~free
    prints = np.array(sorted({fixed | (r.getrandbits(64) & free) for _ in range(400)}), dtype=np.uint64)
    a = simhash._close_by_pairs(prints, np.zeros(len(prints)))
    b = simhash._close_by_table(prints, free)

    def parts(links):
        p = list(range(len(prints)))
        for x, y in links:
            x, y = p[x], p[y]
            p = [min(x, y) if z in (x, y) else z for z in p]
        return p

    assert parts(a) == parts(b)


@pytest.mark.parametrize("links,want", [([], {}), ([(1, 2), (2, 3), (5, 5), (9, 8)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8})])
def test_components(spark, links, want):
    got = components.connected_components(spark.createDataFrame(links, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_components_long_path(spark):
    r = random.Random(6)
    path = [(i, i + 1) for i in range(60)]
    r.shuffle(path)
    got = components.connected_components(spark.createDataFrame(path, "u long, v long")).collect()
    assert {x["component"] for x in got} == {0} and len(got) == 61


def brute_dedup(rows, n=20):
    earliest, gone = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone[i] = set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in earliest:
                gone[i] |= set(range(k, k + n))
            earliest.add(g)
    return {i: [x for k, x in enumerate(words(t)) if k not in gone[i]] for i, t in rows}


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_substring_dedup(spark, seed):
    rows = sample(seed)
    want = brute_dedup(rows)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        r = got[i]
        assert r["n_words"] == len(words(t)) and r["n_removed"] == len(words(t)) - len(want[i]), i
        assert r["kept_sha256"] == hashlib.sha256(" ".join(want[i]).encode()).hexdigest(), i
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]


def test_substring_dedup_empty_and_repeated_rows(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    t = " ".join(f"q{i}" for i in range(30))
    got = substring_dedup.substring_dedup(frame(spark, [(1, t), (1, t), (2, t)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 30)]


def test_substring_dedup_of_different_texts_with_one_doc_id(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(30)) for c in "qr")
    got = substring_dedup.substring_dedup(frame(spark, [(1, t), (2, t), (2, u), (3, f"{u} end")])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 30, 0), (2, 30, 0), (2, 30, 30), (3, 31, 30)]


def test_large_groups_of_copies(spark):
    """Hot digests are broadcast, the others joined; both find the same copies."""
    rows = [(i, 0, bytes([i % 7 if i % 3 else 9]) * 32) for i in range(400)]
    texts_of = spark.createDataFrame(rows, "doc_id long, nth int, digest binary")
    first = {}
    for i, _, d in rows:
        first.setdefault(d, i)
    want = sorted(i for i, _, d in rows if first[d] < i)
    for hot in (1, 60, 10_000):
        assert sorted(r["doc_id"] for r in substring_dedup.copies_of_earlier(texts_of, hot=hot).collect()) == want


def test_very_long_texts(spark):
    """Over 200,000 characters: every operator over documents reads them whole."""
    r = random.Random(11)
    long = " ".join(f"w{r.randrange(500)}" for _ in range(60_000))
    rows = [(1, long), (2, "start " + long), (3, "short")]
    got = {x["doc_id"]: x for x in quality_rules.measures(frame(spark, rows)).collect()}
    assert got[2]["n_words"] == 60_001
    assert {x["doc_id"]: x["fp"] & (1 << 64) - 1 for x in simhash.near_duplicates(frame(spark, rows)).collect()} == {i: brute_fingerprint(t) for i, t in rows}
    want = brute_dedup(rows)
    for x in substring_dedup.substring_dedup(frame(spark, rows)).collect():
        assert x["kept_sha256"] == hashlib.sha256(" ".join(want[x["doc_id"]]).encode()).hexdigest()


def test_cut_texts_keep_all_columns(spark):
    """Extra columns with the names that the operator uses, nulls, and repeated rows."""
    t = " ".join(f"q{i}" for i in range(30))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, n_removed int, kept_text string, digest string, cut int, cut_id int, same int"
    rows = [(i, x, None, "s", 7, 1, 2, "k", "d", 3, 4, 5) for i, x in [(1, t), (2, "a b " + t), (2, "a b " + t), (3, t), (4, None), (None, t), (5, "")]]
    docs = spark.createDataFrame(rows, schema)
    got = substring_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    found = sorted((x["doc_id"] or 0, x["text"], x["n_chars"], x["kept_text"]) for x in got.collect() if x["text"] is not None)
    assert found == [(0, t, 7, "k"), (1, t, 7, "k"), (2, "a b", 3, "k"), (2, "a b", 3, "k"), (5, "", 7, "k")]
    assert got.filter("text IS NULL").count() == 1


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_warc", "op9_substring_dedup"])
def test_queries_equal_their_sql(name, spark, duck):
    from gossamer.llm import queries
    from tests.conftest import SMALL, compare

    compare(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name]))
