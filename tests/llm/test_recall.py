"""Operators against brute force where a bound or a threshold could lose results."""

import random

import pytest

from gossamer.llm import decontaminate, html_extract

DOCS = "doc_id long, text string"


# -- decontamination -----------------------------------------------------


def brute_leaks(text, items):
    """Items of which the region of some passage holds enough, by LCS with every region."""
    words, out = decontaminate.words_of(text.encode()), set()
    for k, t in items:
        item, answer = decontaminate.words_of(t.encode()), decontaminate.answer_of(t.encode())
        if len(item) < decontaminate.LEAST_WORDS:
            if any(words[i : i + len(item)] == item for i in range(len(words) - len(item) + 1)):
                out.add(k)
            continue
        for s in decontaminate.starts_of(len(words)).tolist():
            region = words[max(0, s - len(item)) : s + decontaminate.PASSAGE + len(item)]
            if decontaminate.lcs_length(item, region) >= decontaminate.COVERAGE * len(item):
                if decontaminate.lcs_length(answer, region) >= decontaminate.ANSWER_COVERAGE * len(answer):
                    out.add(k)
                    break
    return out


@pytest.mark.parametrize("size", [40, 400, 4000])
@pytest.mark.parametrize("share", [0.0, 0.15, 0.25])
def test_leaks_equal_brute_force(spark, size, share):
    """Short and changed items are found in corpora of any size, and what stands apart is not."""
    r = random.Random(size)
    item_words, others = [f"w{i}" for i in range(400)], [f"o{i}" for i in range(3000)]
    items = [(k, " ".join(r.choice(item_words) for _ in range(r.choice([8, 10, 12, 20, 40])))) for k in range(40)]
    items += [(100, "an exact few"), (101, "never there at all")]
    rows = []
    for i in range(size):
        t = [r.choice(others) for _ in range(r.choice([0, 5, 40, 900 if i < 20 else 90]))]
        if i < 40:
            leak = [w if r.random() >= share else r.choice(others) for w in items[i][1].split()]
            at = r.randint(0, len(t))
            t[at:at] = leak
        if i == 7:
            t += ["an", "Exact", "few."]
        rows.append((i, " ".join(t)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(h["doc_id"], h["item_id"]) for h in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), benchmark).collect()}
    assert got == {(i, k) for i, t in rows[:40] for k in brute_leaks(t, items)} and (7, 100) in got


# -- extraction ----------------------------------------------------------


@pytest.mark.parametrize("shard_pages", [4, 1000])
def test_a_host_is_one_whatever_its_shards(spark, shard_pages):
    """A notice on 3 of 60 pages goes, one on 2 stays, and a body copied under other menus stays."""
    notice, pair = "we use these little files to serve you better", "only two pages of this host say so here"
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(9))
    page = lambda text, menu: f"<body><nav>menu {menu}</nav>{text}</body>"
    texts = {i: own(i) for i in range(60)} | {i: own(100) for i in range(20, 24)}
    want = dict(texts) | {i: f"{texts[i]} {pair}" for i in (4, 5)}
    held = dict(want) | {i: f"{texts[i]}</p><p>{notice}" for i in (1, 2, 3)}
    rows = [(i, "http://h/p", page(f"<p>{held[i]}</p>", i)) for i in held]
    rows += [(200 + i, f"http://other{i}/p", page(f"<p>{notice}</p>", i)) for i in range(3)] + [(300, "http://h/a", "<article>kept</article>" + notice)]
    want |= {200 + i: notice for i in range(3)} | {300: "kept"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract_text(pages, shard_tokens=shard_pages).collect()} == want
