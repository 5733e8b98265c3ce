"""Extraction, language model, classifier, decontamination and the pipeline against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gossamer.llm import decontaminate, html_extract, knn_quality, lattice_lm, piece_codec

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- extraction ----------------------------------------------------------

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>'
    '<a href="/x">Home page of all</a></ul></nav><!-- ad > --><div class="ad">Buy <b>now</b></div><article><h1>Ti&amp;tle</h1>'
    "<p><b>On&eacute;<p>two\n  <i>th</i>ree&nbsp;4<br>five<form>no</form><div class='comments x'>nice</div><aside>side</aside></article>"
    "<footer>&copy; all</footer></body></html>"
)


def test_article_of_a_page():
    assert html_extract.extract_host([PAGE]) == ["Ti&tle Oné two three 4 five"]


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("plain &lt;text", "plain <text"),
        ("<article>a<p>b<script>x", "a b"),
        ("<article>a<!-- never closed", "a"),
        ("<article>a <b", "a"),
        ("<main><p>x</p></div></span>y</main>z", "x y"),
        ('<div hidden>h</div><p title="a>b">q</p>', "q"),
        ('<body class="has-sidebar comments"><article class="post header">k<article class="comment">c</article></article>', "k"),
        ('<div class="page no-comments"><article>k</article><div id="cookie-notice">c</div></div>', "k"),
        ("<article>1 &lt; 2 <a href=x>l</a>.</article>", "1 < 2 l."),
    ],
)
def test_markup(page, text):
    assert html_extract.extract_host([page]) == [text]


def test_repeated_runs_leave_bodies_without_an_article():
    notice = "we use these little files to serve you better"
    body = lambda i: " ".join(f"own{i}x{k}" for k in range(12))
    pages = [f"<body><div>{notice}</div><p>{body(i)}</p><div>{notice} again</div></body>" for i in range(5)]
    assert html_extract.extract_host(pages) == [body(i) for i in range(5)]
    assert html_extract.extract_host(pages[:2])[0].startswith(notice)  # two pages are not enough to tell


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=6), st.integers(1, 4), st.integers(1, 3))
def test_repeated_tokens(pages, run, least):
    tokens, of = [], []
    for i, p in enumerate(pages):
        tokens += [*p, -1 - i]
        of += [i] * (len(p) + 1)
    where = {}
    for k in range(len(tokens) - run + 1):
        where.setdefault(tuple(tokens[k : k + run]), set()).add(of[k])
    want = [False] * len(tokens)
    for k in range(len(tokens) - run + 1):
        g = tuple(tokens[k : k + run])
        if len(where[g]) >= least and (least > 1 or min(g) >= 0):
            want[k : k + run] = [True] * run
    got = html_extract.repeated_tokens(np.array(tokens), np.array(of), run, least).tolist()
    if least > 1:
        assert got == want


def test_extract_text(spark):
    schema = "page_id long, url string, html string, text string, host string"
    rows = [(i, f"http://h{i % 2}/p", PAGE, "t", "h") for i in range(7)] + [(50, None, None, "t", "h"), (51, "no url", "<p>x", "t", "h"), (None, "u", "x", "t", "h")]
    got = {r["page_id"]: r for r in html_extract.extract_text(spark.createDataFrame(rows, schema), shard_tokens=20).collect()}
    assert len(got) == 9 and got[3]["text"] == "Ti&tle Oné two three 4 five" and got[50]["text"] == "" and got[51]["text"] == "x"
    assert html_extract.extract_text(spark.createDataFrame([], schema)).count() == 0


def test_extract_text_equals_the_plain_version(spark):
    """All pages of a table, host by host; a host in many shards gives the same texts."""
    source = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r["page_id"], "http://one.host/" + str(r["page_id"]), r["html"]) for r in source.collect()]
    article = {i: re.search("<article>(.*?)(?:</article>|<footer>|$)", h, re.S)[1] for i, _, h in rows}
    bare = [(10_000 + i, "http://two.host/", h.replace("article>", "div>")) for i, _, h in rows[:60]]
    want = dict(zip([i for i, _, _ in rows], html_extract.extract_host([h for _, _, h in rows])))
    want |= dict(zip([i for i, _, _ in bare], html_extract.extract_host([h for _, _, h in bare])))
    df = spark.createDataFrame(rows + bare, "page_id long, url string, html string")
    for shard_tokens in (400, 10**6):
        got = {r["page_id"]: r["text"] for r in html_extract.extract_text(df, shard_tokens=shard_tokens).collect()}
        assert got == want
    plain = {i: " ".join(html_extract._html.unescape(re.sub("<br>|</?p>|</?h1>", " ", a).replace("<b>", "").replace("</b>", "")).split()) for i, a in article.items()}
    assert {i: want[i] for i in plain} == plain  # the array alone removes the adverts beside the articles


def test_slots_decide_with_enough_pages():
    page = lambda i, beside: f"<body><div class=x>{beside}</div><article>text {i}</article></body>"
    own = [page(i, " ".join(f"own{i}x{k}" for k in range(8))) for i in range(60)]
    same = [page(i, f"see all our other offers of week {i % 20}") for i in range(60)]
    assert html_extract.extract_host(own)[7].startswith("own7x0") and html_extract.extract_host(own[:30])[7] == "text 7"
    assert html_extract.extract_host(same)[7] == "text 7"


def test_a_long_page_takes_linear_time():
    import time

    start = time.time()
    assert html_extract.extract_host(["<i>" * 300_000 + "x" + "</b>" * 300_000 + "y"]) == ["xy"]
    assert time.time() - start < 30


# -- language model ------------------------------------------------------


def brute_marginal(word, own, logp):
    """Sum over all segmentations, by recursion over pieces."""
    index = {p: i for i, p in enumerate(own.pieces)}
    word = lattice_lm.SPACE + word
    total = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - own.longest), j):
            piece = word[i:j]
            if piece in index:
                total[j] += total[i] * math.exp(logp[index[piece]])
            elif j == i + 1:
                total[j] += total[i] * math.exp(sum(logp[own.n + b] for b in piece.encode()))
    return math.log(total[-1])


def test_lattice():
    own = lattice_lm.vocabulary(piece_codec.model_path())
    some = ["the", "thering", "Ünïx", "a", "", "中文字", "x" * 70, "\x00", "▁", "reading,"]
    got = lattice_lm.lattice(some, own, own.start)
    assert np.allclose(got, [brute_marginal(w, own, own.start) for w in some])


def test_expected_uses_add_up():
    """The derivative of the log marginal in a piece's log probability is its expected use."""
    own = lattice_lm.vocabulary(piece_codec.model_path())
    expected = np.zeros(own.end + 1)
    lattice_lm.lattice(["there", "中€"], own, own.start, np.array([1.0, 2.0]), expected)
    for i in [*np.argsort(-expected)[:8], own.n + "€".encode()[0]]:
        moved = own.start.copy()
        moved[i] += 1e-5
        a, b = (lattice_lm.lattice(["there", "中€"], own, p) @ np.array([1.0, 2.0]) for p in (moved, own.start))
        assert abs((a - b) / 1e-5 - expected[i]) < 1e-3


def test_scores(spark):
    r = random.Random(1)
    w = ["the", "The", "reading", "é", "qqq", "中"] + [f"rare{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(w) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(100, None), (101, "")]
    for frequent in (5, 10**6):
        got = {x["doc_id"]: x for x in lattice_lm.score_documents(docs(spark, rows), frequent=frequent).collect()}
        train, ends = Counter(), 0
        lower = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for i, t in rows:
            if zlib.crc32(str(i).encode()) % 7 != 2:
                train.update(lower(t))
                ends += 1
        n, v = sum(train.values()) + ends, len(train) + 1
        for i, t in rows:
            x = got[i]
            base = sum(math.log10((train[k] + 1) / (n + v + 1)) for k in lower(t)) + math.log10((ends + 1) / (n + v + 1))
            assert x["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and x["train_tokens"] == n
            assert x["n_tokens"] == len(lower(t)) + 1 and x["n_known"] == sum(train[k] > 0 for k in lower(t)) + 1
            assert abs(x["base_score"] - base) < 1e-6 and x["score"] < 0
        scores = {i: got[i]["score"] for i in got} if frequent == 5 else scores
        assert all(abs(scores[i] - got[i]["score"]) < 1e-6 for i in got)  # broadcast or joined, the same
    own = lattice_lm.vocabulary(piece_codec.model_path())
    assert lattice_lm.score_documents(docs(spark, [])).count() == 0 and own.n > 30_000


def test_document_scores_are_sums_of_marginals(spark):
    """Scores of whole documents against recursion over pieces; words that occur in held-out documents alone are frequent here."""
    r = random.Random(3)
    out = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, " ".join(r.choice(["the", "tree", "Ünï", "in"]) for _ in range(9))) for i in range(2000, 2030)] + [(out, "unheard " * 500 + "of")]
    own = lattice_lm.vocabulary(piece_codec.model_path())
    d = docs(spark, rows)
    ends = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)
    logp = lattice_lm.estimate(lattice_lm.count_words(d), ends, piece_codec.model_path())
    marginal = {w: brute_marginal(w, own, logp) for _, t in rows for w in t.encode().lower().decode().split()}
    for frequent in (2, 10**6):
        for x in lattice_lm.score_documents(d.withColumn("row", d.n_chars).withColumn("word", d.lang), frequent=frequent).collect():
            tokens = dict(rows)[x["doc_id"]].encode().lower().decode().split()
            assert abs(x["score"] - (sum(marginal[w] for w in tokens) + logp[-1]) / math.log(10)) < 1e-6 * len(tokens)
            assert x["n_known"] == 1 + (len(tokens) if x["doc_id"] != out else 0)


# -- classifier ----------------------------------------------------------


def test_vote_is_exact():
    g = np.random.default_rng(1)
    labelled, block = (knn_quality._unit(g.standard_normal((n, 5)).astype(np.float32)) for n in (50, 20))
    labels = g.integers(0, 2, 50).astype(float)
    got = knn_quality.vote(block, labelled, labels, 7)
    for k in range(20):
        near = sorted(((float(block[k] @ labelled[j]), labels[j]) for j in range(50)), reverse=True)[:7]
        weights = [max(s, 1e-6) ** knn_quality.POWER for s, _ in near]
        assert abs(got[k] - sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)) < 1e-4


def test_held_out_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = knn_quality.score_quality(d, labels).join(labels, "doc_id").filter("held_out").collect()
    junk, good = ([r for r in rows if r["quality"] == q] for q in (0, 1))
    assert good and junk and sum(r["predicted"] for r in good) >= 0.98 * len(good)
    assert sum(1 - r["predicted"] for r in junk) >= 0.8 * len(junk)


def test_quality_without_labels_or_texts(spark):
    none = spark.createDataFrame([(1, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = knn_quality.score_quality(docs(spark, [(1, None), (2, ""), (2, "a b")]), none).collect()
    assert [r["score"] for r in got] == [1.0] * 3 and all(r["predicted"] == 1 for r in got)
    assert knn_quality.score_quality(docs(spark, []), none).count() == 0


def test_ties_are_settled_by_doc_id(spark):
    """Forty equal labelled texts of both labels: the fifteen with the smallest ids vote, whatever the rows' order."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:40]
    rows = [(i, "one and the same text") for i in ids] + [(999, "one and the same text")]
    labels = [(i, k % 2 if k < 15 else 1) for k, i in enumerate(ids)]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        random.Random(seed + 5).shuffle(labels)
        got = knn_quality.score_quality(docs(spark, rows).repartition(3), spark.createDataFrame([*labels, (ids[0], 1), (-5, 0)], "doc_id long, quality int")).collect()
        assert {round(x["score"], 6) for x in got} == {round(7 / 15, 6)}


def test_scores_equal_a_plain_version(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    idf, axes, _, _ = knn_quality.learn(d, labels)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    point = {r["doc_id"]: knn_quality.fold([knn_quality._row(knn_quality.features(r["text"].encode()), idf)], axes)[0] for r in d.collect()}
    known = sorted(i for i in point if y.get(i) is not None and zlib.crc32(str(i).encode()) % 5)
    for r in knn_quality.score_quality(d, labels).collect():
        near = sorted(((round(float(point[r["doc_id"]] @ point[i]), 5), -i) for i in known), reverse=True)[: knn_quality.NEIGHBOURS]
        weights = [max(s, 1e-6) ** knn_quality.POWER for s, _ in near]
        assert abs(r["score"] - sum(w * y[-i] for w, (_, i) in zip(weights, near)) / sum(weights)) < 0.02


# -- decontamination -----------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), st.lists(st.sampled_from([b"a", b"b", b"d"]), max_size=9))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.lcs_length(a, b) == table[-1][-1]


def test_leaks_are_found_and_others_left(spark):
    r = random.Random(1)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(3000)]
    text = lambda n: [r.choice(common) if r.random() < 0.4 else r.choice(rare) for _ in range(n)]
    items = [(k, " ".join(text(r.randint(15, 60)))) for k in range(30)]
    rows, want = [], set()
    for i in range(200):
        t = text(r.randint(0, 200))
        if i % 4 == 0:
            k = r.randrange(30)
            leak = items[k][1].upper().split()
            if i % 8 == 0:  # a paraphrase: one word in eight is another
                leak = [w if j % 8 else "other" for j, w in enumerate(leak)]
            at = r.randint(0, len(t))
            t[at:at] = leak
            want.add((i, k))
        rows.append((i, " ".join(t)))
    benchmark = spark.createDataFrame([*items, (77, None), (78, "short one")], "item_id long, text string")
    hits = decontaminate.find_leaks(docs(spark, rows + [(500, None), (501, "")]), benchmark).collect()
    got = {(h["doc_id"], h["item_id"]) for h in hits}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert decontaminate.find_leaks(docs(spark, rows), benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs(spark, []), benchmark).count() == 0


def test_retrieval_recall_against_brute_force(spark):
    """Passages near an item by full TF-IDF cosine are found in the latent space too."""
    d, b = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = decontaminate.blocks_of(b)[0]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, t in items for w in decontaminate.words_of(t)}))}
    frequencies, n = decontaminate._frequencies(d, vocabulary)
    space = decontaminate.fit(spark, items, dict(zip(vocabulary, (np.log((n + 1) / (frequencies + 1)) + 1).tolist())))
    dense = lambda at, w: np.array([np.bincount(a, x, minlength=len(space.vocabulary)) for a, x in zip(at, w)])
    own = np.concatenate([dense(*space.rows(space.ids(w), decontaminate.starts_of(len(w)))) for _, w, _ in space.items])
    found = wanted = 0
    for row in d.collect():
        ids = space.ids(decontaminate.words_of(row["text"].encode()))
        starts = decontaminate.starts_of(len(ids))
        exact = dense(*space.rows(ids, starts)) @ own.T >= 0.6
        near = {(int(starts[k]), int(space.item_of[q])) for k, q in zip(*np.nonzero(exact))}
        wanted += len(near)
        found += len(near & {(s, i) for s, i, _ in space.near(ids)})
    assert wanted > 20 and found >= 0.9 * wanted


# -- the pipeline --------------------------------------------------------


def test_pipeline_equals_plain_stages(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline
    import sentencepiece

    from tests.llm.test_quality_and_dedup import brute_components, brute_dedup, brute_fingerprint

    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in source.collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    accepted = {r["doc_id"] for r in knn_quality.score_quality(source, labels).filter("predicted = 1").collect()}
    rows = {i: t for i, t in rows.items() if i in accepted}
    parts = brute_components({i: brute_fingerprint(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if parts[i] == i}
    cut = brute_dedup(list(rows.items()))
    rows = {i: t if len(cut[i]) == len(words(t)) else " ".join(cut[i]) for i, t in rows.items() if cut[i] or not words(t)}
    items = [decontaminate.words_of(r["text"].encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    padded = {i: b" " + b" ".join(decontaminate.words_of(t.encode())) + b" " for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if not any(b" " + b" ".join(x) + b" " in padded[i] for x in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    want = {}
    for i, t in rows.items():
        ids = library.encode(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want


def test_stages_with_clashing_columns_nulls_and_repeated_rows(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    names = "n_words n_removed kept_text digest fp component_id least item_id label y score predicted cosine first_word same cut".split()
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in source]
    rows += [rows[0], (9001, None, None, None, None), (9002, "", "", "", 0), (None, "no id", "en", "s", 5), (9003, "very long " * 25_000, "en", "s", 250_000)]
    d = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], f"{DOCS}, {', '.join(f'{n} string' for n in names)}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.columns == d.columns and 0 < out.count() <= d.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() == len(rows) - 1


def test_stages_keep_the_columns_and_empty_tables(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    empty = docs(spark, []).withColumn("extra", __import__("pyspark").sql.functions.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, "/root/testdata/sf0.001")
        assert out.columns == empty.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0
