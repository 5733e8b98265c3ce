"""Quality rules with thresholds that adapt to each language and source. [native]

The text is read once: every measure of a document is an expression over its words, so the
table of measures is as long as the corpus but only some 80 bytes a row. KLL quantile
sketches of the measures are built per (lang, source) and, because sketches merge, the
same binaries also give each language's and the whole corpus's quantiles, which stand in
for groups too small to trust. The thresholds are then joined back to the measures; no
text moves and no Python runs.

Rejection is by outer fences: a measure is out of line when it lies further than
``FENCE`` times the interquartile range beyond its group's quartile. A floor on that range
keeps groups of near-equal documents from turning tiny differences into outliers.

Edge cases: a null text has no words (n_words 0, base_failed). Null lang or source form a
group of their own. An empty table gives an empty result. Repeated rows are judged one by
one. Columns other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import SPACE_CLASS, materialize

#: Size of the KLL sketches: exact up to about this many rows, rank error under 0.1 % beyond.
SKETCH_K = 4096
#: A group with fewer base-passing documents than this borrows its language's thresholds.
MIN_GROUP = 200
#: Width of the fences in interquartile ranges.
FENCE = 6.0
#: Smallest interquartile range of each measure.
FLOORS = {"symbol_ratio": 0.005, "repeat_ratio": 0.08, "dup_line_ratio": 0.12, "mean_word_length": 0.3}
#: Measures of which small values are also out of line.
TWO_SIDED = ("mean_word_length",)

NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def _without(text: Column, characters: str) -> Column:
    """Plain replacements are byte searches that cost nothing where there is no match."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _window_hashes(words: str) -> Column:
    """A hash of every 3-word window, in order; empty for fewer words."""
    w = F.col(words)
    zipped = F.arrays_zip(w, F.slice(w, 2, F.size(w)), F.slice(w, 3, F.size(w)))
    return F.transform(F.slice(zipped, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x: F.xxhash64(x))


def _repeat_words(words: str, hashes: str) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Most texts repeat no window, which a hash set of the windows tells. For the rest, the
    upper bits of each hash are packed with the window's position and sorted as plain
    longs: equal windows are then neighbours, and their words are compared. n log n for
    any text, however long or repetitive.
    """
    w, h = F.col(words), F.col(hashes)
    low = F.when(F.size(h) < 2**16, F.lit(2**16 - 1)).otherwise(F.lit(2**31 - 1)).cast("long")
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

    def same(x: Column, y: Column) -> Column:
        i, j = (z.bitwiseAND(low).cast("int") for z in (x, y))
        return (x.bitwiseAND(F.bitwise_not(low)) == y.bitwiseAND(F.bitwise_not(low))) & (
            (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])
        )

    # an array of one binds the sorted array as a lambda variable, so that it is computed once a row
    positions = F.transform(
        F.array(packed),
        lambda s: F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, k: F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))
                    | F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)),
                ),
                lambda x: x.bitwiseAND(low).cast("int"),
            )
        ),
    )
    covered = F.transform(
        positions,
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered[0])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", text.alias("text"))
    cut = (
        base.withColumn("w", _words(F.col("text")))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE)))
        .withColumn("h", _window_hashes("w"))
    )
    long = lambda c: c.cast("long")
    counted = cut.select(
        "doc_id",
        "lang",
        "source",
        long(F.size("w")).alias("n_words"),
        long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words("w", "h").alias("n_repeat_words"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "word_chars").alias("symbol_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("word_chars", "n_words").alias("mean_word_length"),
    )


def sketches(measured: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One KLL sketch of each measure per (lang, source), over the documents that pass the base rules."""
    return (
        measured.filter(~F.col("base_failed"))
        .groupBy("lang", "source")
        .agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, k).alias(m) for m in FLOORS])
    )


def _fences(level: DataFrame, prefix: str, k: int) -> DataFrame:
    """Lower and upper fence of each measure from a level's sketches."""
    columns = [c for c in ("lang", "source") if c in level.columns]
    out = [F.col("n").alias(f"{prefix}_n")]
    for m, floor in FLOORS.items():
        low, high = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.25, 0.75))
        reach = FENCE * F.greatest(high - low, F.lit(floor))
        out += [(high + reach).alias(f"{prefix}_{m}_high"), (low - reach).alias(f"{prefix}_{m}_low")]
    return level.select(*columns, *out)


def thresholds(sketched: DataFrame, k: int = SKETCH_K, min_group: int = MIN_GROUP) -> DataFrame:
    """Fences per (lang, source), from the group's own sketches, else its language's, else all."""
    merge = lambda df, *by: df.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, k).alias(m) for m in FLOORS]
    )
    by_lang = merge(sketched, "lang")
    everywhere = _fences(merge(by_lang), "all", k)
    own = _fences(sketched, "own", k)
    lang = _fences(by_lang, "lang", k).withColumnRenamed("lang", "of_lang")
    # one row, so this join adds nothing to the number of groups
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left").join(everywhere, F.lit(True), "left")
    pick = lambda name: (
        F.when(F.col("own_n") >= min_group, F.col(f"own_{name}"))
        .when(F.col("lang_n") >= min_group, F.col(f"lang_{name}"))
        .otherwise(F.col(f"all_{name}"))
    )
    return joined.select(
        "lang", "source", *[pick(f"{m}_{side}").alias(f"{m}_{side}") for m in FLOORS for side in ("high", "low")]
    )


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Join the fences to the measures; ``kept`` is false outside them or where a base rule failed."""
    right = limits.withColumnRenamed("lang", "l_lang").withColumnRenamed("source", "l_source")
    joined = measured.join(
        right, F.col("lang").eqNullSafe(F.col("l_lang")) & F.col("source").eqNullSafe(F.col("l_source")), "left"
    )
    inside = F.lit(True)
    for m in FLOORS:
        inside = inside & (F.col(m) <= F.col(f"{m}_high"))
        if m in TWO_SIDED:
            inside = inside & (F.col(m) >= F.col(f"{m}_low"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def quality_rules(docs: DataFrame, k: int = SKETCH_K, min_group: int = MIN_GROUP) -> DataFrame:
    """Every document with its measures, base_failed and kept."""
    measured = materialize(measures(docs), "quality-measures")
    return judge(measured, thresholds(sketches(measured, k), k, min_group))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_DUCK_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_DUCK_FENCES = ",\n".join(
    f"quantile_disc({m}, 0.75) + {FENCE} * greatest(quantile_disc({m}, 0.75) - quantile_disc({m}, 0.25), {f}) AS {m}_high, "
    f"quantile_disc({m}, 0.25) - {FENCE} * greatest(quantile_disc({m}, 0.75) - quantile_disc({m}, 0.25), {f}) AS {m}_low"
    for m, f in FLOORS.items()
)
_DUCK_PICK = ",\n".join(
    f"CASE WHEN o.n >= {MIN_GROUP} THEN o.{m}_{s} WHEN l.n >= {MIN_GROUP} THEN l.{m}_{s} ELSE a.{m}_{s} END AS {m}_{s}"
    for m in FLOORS
    for s in ("high", "low")
)
_DUCK_INSIDE = " AND ".join(
    f"{m} <= {m}_high" + (f" AND {m} >= {m}_low" if m in TWO_SIDED else "") for m in FLOORS
)

#: Exact quantiles stand in for the sketches, which are exact at the size the oracle runs at.
ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_DUCK_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (
  SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
),
m0 AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)
),
m1 AS (
  SELECT * EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m0
),
m AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, word_chars / greatest(n_words, 1) AS mean_word_length
  FROM m1
),
ok AS (SELECT * FROM m WHERE NOT base_failed),
o AS (SELECT lang, source, count(*) AS n, {_DUCK_FENCES} FROM ok GROUP BY lang, source),
l AS (SELECT lang, count(*) AS n, {_DUCK_FENCES} FROM ok GROUP BY lang),
a AS (SELECT {_DUCK_FENCES} FROM ok),
t AS (SELECT o.lang, o.source, {_DUCK_PICK} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang, a)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({_DUCK_INSIDE}, false) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""
