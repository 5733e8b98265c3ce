"""Main text of web pages by suffix arrays over each host's token streams.

The pages of a host share menus, notices, adverts and footers word for word. The visible tokens that no
article protects, of all a host's pages, are concatenated, with a separator of its own after each page, and their
suffixes are sorted by prefix doubling: suffixes that agree on ``MIN_RUN`` tokens become
neighbours, so runs of that length or more that occur on several distinct pages are
found, and every token that such a run covers is boilerplate. The order is taken no deeper than that length, as a longer
repeated run is covered by its parts.

Repetition can't tell all of it, so mark-up is a hint. What stands in an ``article`` or ``main`` element
is kept whole, since articles quote and copy one another. Elements and roles that are menus, headers,
footers, sidebars, forms, scripts or styles by definition, and reader comments (by class or id), which are unique like an
article, go. What is left stands beside an article, or on a page without one:

* On a page without an article the unique runs are kept: runs on ``MIN_PAGES`` pages of the host go.
* Beside an article, and where a class or id names an advert, notice and the like, a block is judged by its slot, the chain of
  containers that it stands in: the share of the slot's tokens, over the whole host, that repeat on another page. It counts against
  a prior of ``PRIOR`` pages of pure boilerplate: a slot whose text repeats goes, also on pages where its text happens to
  be unique, and a slot is kept, but for its repeated runs, once enough pages show that its text is their own.

A host may hold a third of all pages, so hosts are dealt out in shards of about
``SHARD_TOKENS`` tokens by a hash of the page. Each shard returns its distinct runs with the
pages that hold them, Spark sums these over the host, and the runs that repeat there go
back to the shards that have them: a page's text doesn't depend on how its host was dealt out. Pages with an article that are equal, block
for block, and pages without one whose undecided texts are equal, are one page to the counts, by the least of them, so a copied body isn't taken
for boilerplate.

Edge cases: a null html is an empty page; a null or unreadable url puts the page in the
group of pages without a host. Comments, tags and elements cut off by the page's end end
with it; end tags without a start are ignored. A ``header`` inside an article holds its title and is kept. A very long page is read
once, in time proportional to its length, and is a shard of its own. Rows without a page_id are no pages; repeated rows are extracted each,
and count as one page. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import map_arrow, materialize, prepare

#: Tokens of the shortest run that counts, distinct pages on which a run is boilerplate, tokens of a shard.
MIN_RUN, MIN_PAGES, SHARD_TOKENS = 6, 3, 20_000
#: Pages of boilerplate that a slot beside an article counts as from the start, share of repeated text from which it goes.
PRIOR, REPEATED_SHARE = 20, 0.3

#: Elements whose content is no article text, void elements, elements that end a block.
CHROME = frozenset(
    "head script style noscript template svg math nav header footer aside form button select option textarea "
    "iframe object embed canvas audio video dialog menu menuitem datalist fieldset".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Words in a class or id that mark reader comments, and that hint at other text beside an article.
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
HINT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs "
    "consent cookie cookies disclaimer dropdown footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promoted promotion related "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Those of them that count on an article element, prefixes that speak of a page's layout, containers that make a slot.
ARTICLE_HINT_WORDS = frozenset("ad ads advert promo related sponsored".split())
LAYOUT = ("has-", "with-", "no-", "without-")
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header main nav ol section table ul".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:_-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<loose_close>/?)(?P<loose>[a-z][a-z0-9:_-]*)[^<>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-z][a-z0-9:_-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

MAIN, FREE, DROPPED = 2, 1, 0


class Block(NamedTuple):
    """A block of text: what mark-up says of it, whether it hints at no article text, its slot, and its text."""

    role: int
    hinted: bool
    slot: int
    text: str


def _names(name: str, value: str) -> set[str]:
    """Words of a class or id; the page's own frame only says what it has or lacks."""
    if name in ("html", "body", "main"):
        return set()
    return {w for part in value.split() if not part.startswith(LAYOUT) for w in _WORD.findall(part)}


def _role(name: str, attributes: str, role: int, hinted: bool) -> tuple[int, bool, str]:
    """What an element's content is, whether it is hinted at, and its classes, given its parent's role."""
    if role == DROPPED or (name in CHROME and not (name == "header" and role == MAIN)):
        return DROPPED, False, ""
    label = ""
    if name in ("article", "main"):
        role = MAIN
    if attributes.strip(" /"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "").lower()
            if key in ("class", "id"):
                words = _names(name, value)
                label += "." + " ".join(sorted(words))
                if not words.isdisjoint(COMMENT_WORDS):
                    return DROPPED, False, ""
                if not words.isdisjoint(ARTICLE_HINT_WORDS if name == "article" else HINT_WORDS):
                    role, hinted = FREE, True
            elif key == "role":
                if value in CHROME_ROLES:
                    return DROPPED, False, ""
                if value == "main":
                    role = MAIN
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return DROPPED, False, ""
    return role, hinted, label


def _slot(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent} {label}") >> 1


def blocks(page: str) -> list[Block]:
    """The blocks in page order; references decoded, white space as one space."""
    out: list[Block] = []
    # name, role, hinted, slot and container's label of the open elements
    open_elements: list[tuple[str, int, bool, int, str]] = []
    names: Counter = Counter()
    outside = ("", FREE, False, 0, "")
    at, held = 0, []
    inner = outside

    def end_block() -> None:
        nonlocal held
        text = " ".join(_html.unescape("".join(held)).split())
        if text:
            out.append(Block(inner[1], inner[2], inner[3], text))
        held = []

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["loose"]
        if not name:
            continue
        name = name.lower()
        attributes = m["attributes"] or ""
        if m["close"] or m["loose_close"]:
            if name in BLOCK:
                end_block()
            if names[name]:
                while open_elements:
                    closed = open_elements.pop()[0]
                    names[closed] -= 1
                    if closed == name:
                        break
                after = open_elements[-1] if open_elements else outside
                if after[1:4] != inner[1:4]:
                    end_block()
                inner = after
            continue
        if name in BLOCK:
            end_block()
        if name in VOID or attributes.endswith("/"):
            continue
        role, hinted, label = _role(name, attributes, inner[1], inner[2])
        slot, label = inner[3], name + label
        if name in CONTAINERS and label != inner[4]:
            slot = _slot(slot, label)
        element = (name, role, hinted, slot, label if name in CONTAINERS else inner[4])
        if element[1:4] != inner[1:4]:
            end_block()
        open_elements.append(element)
        names[name] += 1
        inner = element
    if at < len(page):
        held.append(page[at:])
    end_block()
    return out


def repeated_tokens(tokens: np.ndarray, pages: np.ndarray, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens lie in a run of ``min_run`` or more that occurs on ``min_pages`` distinct pages.

    ``tokens`` are ids of the concatenated streams, each page's followed by a separator with
    an id of its own (negative); ``pages`` gives each token's page.
    """
    n = len(tokens)
    if n < min_run:
        return np.zeros(n, dtype=bool)
    rank, distinct = run_ranks(tokens, pages, min_run)
    starts = distinct[rank] >= min_pages
    starts[n - min_run + 1 :] = False
    return covered_by(starts, min_run)


def covered_by(starts: np.ndarray, min_run: int) -> np.ndarray:
    """Which tokens the runs at the given starts cover."""
    edge = np.zeros(len(starts) + min_run + 1, dtype=np.int64)
    at = np.nonzero(starts)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + min_run, -1)
    return np.cumsum(edge[: len(starts)]) > 0


def run_ranks(tokens: np.ndarray, pages: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's rank by its first ``min_run`` tokens, and the distinct pages of each rank."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    have = 1
    while have < min_run:
        step = min(have, min_run - have)
        after = np.full(n, -1, dtype=np.int64)
        after[:-step] = rank[step:]
        order = np.lexsort((after, rank))  # the suffixes by their first have + step tokens
        changed = np.ones(n, dtype=np.int64)
        a, b = rank[order], after[order]
        changed[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(changed) - 1
        have += step
    # suffixes of equal rank are neighbours in this order; count the distinct pages of each such group
    order = np.lexsort((pages, rank))
    r, p = rank[order], pages[order]
    new = np.ones(n, dtype=np.int64)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    return rank, np.bincount(r, weights=new, minlength=n).astype(np.int64)


def run_hashes(words: list[str], at: list[int], min_run: int) -> list[int]:
    """The runs that start at the given words, as signed 64-bit hashes."""
    return [x - (1 << 64) if (x := xxhash.xxh64_intdigest(" ".join(words[i : i + min_run]).encode("utf-8", "surrogatepass"))) >> 63 else x for i in at]


class Page(NamedTuple):
    """A page's blocks, and a digest that is equal for pages that are one to the counts: of all blocks, or of an undecided page's own."""

    found: list[Block]
    article: bool
    body: str


def read(page: str) -> Page:
    found = blocks(page)
    article = any(x.role == MAIN for x in found)
    own = [tuple(x) for x in found] if article else [(x.hinted, x.text) for x in found if x.role == FREE]
    return Page(found, article, hashlib.md5(repr(own).encode("utf-8", "surrogatepass")).hexdigest())


def stream_of(page: Page) -> tuple[str, list[tuple[int, int, int, bool, bool]]]:
    """The tokens that no article protects, and where each of their blocks stands: place, tokens, slot, whether it may be kept, the prior."""
    others = [(i, x) for i, x in enumerate(page.found) if x.role != MAIN]
    return " ".join(x.text for _, x in others), [(i, x.text.count(" ") + 1, x.slot, x.role == FREE, x.hinted or page.article) for i, x in others]


def shard_runs(streams: list[str], min_run: int = MIN_RUN) -> tuple[list[int], list[int]]:
    """The distinct runs of pages' token streams (tokens joined by a space), and how many of the pages hold each."""
    ids: dict[str, int] = {}
    words: list[str] = []
    stream: list[int] = []
    page_of: list[int] = []
    for i, page in enumerate(streams):
        own = page.split(" ")
        words += [*own, ""]
        stream += [*(ids.setdefault(w, len(ids)) for w in own), -1 - i]
        page_of += [i] * (len(own) + 1)
    tokens = np.array(stream, dtype=np.int64)
    if len(tokens) < min_run:
        return [], []
    rank, distinct = run_ranks(tokens, np.array(page_of, dtype=np.int64), min_run)
    ends = np.concatenate([[0], np.cumsum(tokens < 0)])
    whole = np.nonzero(ends[min_run:] == ends[:-min_run])[0]  # runs within one page
    _, first = np.unique(rank[whole], return_index=True)
    at = whole[first]
    return run_hashes(words, at.tolist(), min_run), distinct[rank[at]].tolist()


def judged(stream: str, lengths: list[int], pages: dict[int, int], min_run: int, min_pages: int) -> list[tuple[int, str]]:
    """For each block of a stream, its tokens that repeat on another page, and its text without boilerplate runs.

    ``pages``: the runs that repeat on the host, and on how many pages.
    """
    words = stream.split(" ")
    n = max(len(words) - min_run + 1, 0)
    held = np.zeros(len(words), dtype=np.int64)
    held[:n] = [pages.get(h, 0) for h in run_hashes(words, list(range(n)), min_run)]
    again, gone = covered_by(held >= 2, min_run), covered_by(held >= min_pages, min_run).tolist()
    out, at = [], 0
    for size in lengths:
        out.append((int(again[at : at + size].sum()), " ".join([w for w, g in zip(words[at : at + size], gone[at : at + size]) if not g])))
        at += size
    return out


def unique_slot(pages: int, tokens: int, repeated: int) -> bool:
    """Whether a slot's text is its pages' own: ``pages`` of them are weighed against the prior."""
    return (repeated / max(tokens, 1) * pages + PRIOR) / (pages + PRIOR) < REPEATED_SHARE


def extract_host(pages: list[str], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> list[str]:
    """Main texts of pages that are all of one host: what ``extract_text`` does with all hosts."""
    parsed = [read(p) for p in pages]
    distinct: dict[str, tuple] = {}
    for p in parsed:
        distinct[p.body] = min(distinct.get(p.body, (*stream_of(p), p.found)), (*stream_of(p), p.found))
    streams = {body: s for body, (s, _, _) in distinct.items() if s}
    repeated = dict(zip(*shard_runs(list(streams.values()), min_run)))
    slots: dict[int, list] = {}
    free = []
    for body, stream in streams.items():
        beside = distinct[body][1]
        for (at, size, slot, may_stay, prior), (again, kept) in zip(beside, judged(stream, [x[1] for x in beside], repeated, min_run, min_pages)):
            if may_stay:
                counts = slots.setdefault(slot, [set(), 0, 0])
                counts[0].add(body)
                counts[1] += size
                counts[2] += again
                free.append((body, at, slot, prior, kept))
    kept_of: dict[str, list[tuple[int, str]]] = {body: [(i, x.text) for i, x in enumerate(found) if x.role == MAIN] for body, (_, _, found) in distinct.items()}
    for body, at, slot, prior, kept in free:
        pages_of, tokens, again = slots[slot]
        if kept and (not prior or unique_slot(len(pages_of), tokens, again)):
            kept_of[body].append((at, kept))
    return [" ".join(text for _, text in sorted(kept_of[p.body])) for p in parsed]


PARSED = (
    "page_id long, url string, host string, body string, main array<struct<at:int,text:string>>, "
    "stream string, tokens int, beside array<struct<at:int,size:int,slot:long,free:boolean,prior:boolean>>"
)


def _parsed(batches):
    struct = pa.struct([("at", pa.int32()), ("text", pa.string())])
    beside = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("slot", pa.int64()), ("free", pa.bool_()), ("prior", pa.bool_())])
    for batch in batches:
        main, streams, sizes, rest, bodies = [], [], [], [], []
        for html in batch.column(2).to_pylist():
            page = read(html or "")
            main.append([{"at": i, "text": x.text} for i, x in enumerate(page.found) if x.role == MAIN])
            stream, others = stream_of(page)
            rest.append([dict(zip(("at", "size", "slot", "free", "prior"), x)) for x in others])
            streams.append(stream)
            sizes.append(sum(x[1] for x in others))
            bodies.append(page.body)
        columns = [pa.array(bodies, pa.string()), pa.array(main, pa.list_(struct)), pa.array(streams, pa.string()), pa.array(sizes, pa.int32()), pa.array(rest, pa.list_(beside))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *columns], names=["page_id", "url", "host", "body", "main", "stream", "tokens", "beside"])


def extract_text(pages: DataFrame, shard_tokens: int = SHARD_TOKENS, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url and text of every page."""
    spark = pages.sparkSession
    prepare(spark, 200)
    rows = pages.filter(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
    )
    parsed = materialize(map_arrow(rows, _parsed, PARSED), "parsed-pages")
    distinct = parsed.filter("tokens > 0").groupBy("host", "body").agg(F.min(F.struct("stream", "beside", "tokens")).alias("least"))
    distinct = materialize(distinct.select("host", "body", "least.*"), "distinct-pages")
    # (written out, its size is known: Spark broadcasts it below its threshold and joins it by shuffle above)
    large = materialize(distinct.groupBy("host").agg(F.sum("tokens").alias("n")).filter(F.col("n") > shard_tokens), "large-hosts")
    parts = F.coalesce(F.ceil(F.col("n") / shard_tokens), F.lit(1)).cast("long")
    dealt = distinct.join(large, "host", "left").withColumn("shard", F.pmod(F.xxhash64("body"), parts)).drop("n", "tokens")
    # a stated number of partitions, as adaptive execution would join these small rows in few tasks
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "shard")

    def runs_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        runs, held = shard_runs(pdf["stream"].tolist(), min_run)
        return pd.DataFrame({"host": key[0], "shard": key[1], "run": np.array(runs, dtype=np.int64), "n": np.array(held, dtype=np.int64)})

    def judge(key: tuple, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        pages_of = dict(zip(back["run"].tolist(), back["pages"].tolist()))
        out = []
        for body, stream, beside in zip(pdf["body"], pdf["stream"], pdf["beside"]):
            seen: set[int] = set()
            for x, (again, kept) in zip(beside, judged(stream, [x["size"] for x in beside], pages_of, min_run, min_pages)):
                if x["free"]:
                    out.append((key[0], body, x["at"], x["slot"], x["prior"], x["slot"] not in seen, x["size"], again, kept))
                    seen.add(x["slot"])
        return pd.DataFrame(out, columns=["host", "body", "at", "slot", "prior", "new", "size", "again", "kept"])

    runs = materialize(dealt.groupBy("host", "shard").applyInPandas(runs_of, "host string, shard long, run long, n long"), "shard-runs")
    repeated = runs.groupBy("host", "run").agg(F.sum("n").alias("pages")).filter("pages >= 2")
    back = runs.select("host", "shard", "run").join(repeated, ["host", "run"])
    schema = "host string, body string, at int, slot long, prior boolean, new boolean, size int, again int, kept string"
    free = materialize(dealt.groupBy("host", "shard").cogroup(back.groupBy("host", "shard")).applyInPandas(judge, schema), "free-blocks")
    slots = free.groupBy("host", "slot").agg(F.count_if("new").alias("pages"), F.sum("size").alias("tokens"), F.sum("again").alias("again"))
    share = (F.col("again") / F.greatest("tokens", F.lit(1)) * F.col("pages") + PRIOR) / (F.col("pages") + PRIOR)
    unique = materialize(slots.filter(share < REPEATED_SHARE).select("host", "slot"), "unique-slots")
    own = free.filter("NOT prior").union(free.filter("prior").join(unique, ["host", "slot"], "left_semi").select(free.columns))
    kept = own.filter("kept <> ''").groupBy("host", "body").agg(F.collect_list(F.struct("at", F.col("kept").alias("text"))).alias("more"))
    kept = materialize(kept, "kept-blocks")
    whole = F.concat("main", F.coalesce("more", F.array().cast("array<struct<at:int,text:string>>")))
    text = F.array_join(F.transform(F.array_sort(whole), lambda x: x["text"]), " ")
    return parsed.select("page_id", "url", "host", "body", "main").join(kept, ["host", "body"], "left").select("page_id", "url", text.alias("text"))


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
