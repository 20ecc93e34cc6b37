"""Quality rules by line-first cleaning, in DataFrame functions only.

Every line is judged alone (punctuation, navigation, boilerplate); failing lines are removed; a document that loses more
than a share of its characters is rejected, as is one that fails the base rules (too few words, too much repetition).

Defined cases: a null text counts as empty; an empty text has all statistics 0 and fails the base rule on words; repeated
rows and ties are judged row by row, each alike; texts of any length are judged whole; an empty table gives no rows; other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

SEPARATORS = "[\\x20\\x09-\\x0D]+"
SOLID = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_LOST = 0.5  # share of the characters in lines with a word
NAVIGATION = r"(?i)^\W*(home|about( us)?|contact( us)?|log ?in|log ?out|sign ?(in|up)|menu|search|next( page)?|prev(ious)?( page)?|skip to (main )?content|back to top|read more|share( this)?|site ?map)\W*$"
BOILERPLATE = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "we use cookies", "enable javascript"]
BOILERPLATE += ["lorem ipsum", "subscribe to our newsletter", "click here to", "copyright (c)", "©", "licensed under", "spdx-license-identifier"]
#: A line with this many symbols for each word, or this many bars, isn't prose.
SYMBOLS_A_WORD = 0.3
BARS = 3
#: Lines of at least so many words need a mark of punctuation somewhere.
LONG_LINE = 60
#: Repeated windows up to this many are looked up by scanning; more are found by sorting.
FEW = 32


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def _removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _has_boilerplate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(x)) for x in BOILERPLATE])


def line_fails(line: Column, boilerplate: Column | None = None) -> Column:
    """True for a line that any of the rules for lines rejects. Lines without a word pass. Cheap tests that most lines decide stand
    first. boilerplate: whether the line's text has any."""
    words = F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+"))
    symbols = F.length(line) - F.length(_removed(line, SYMBOLS))
    bars = F.length(line) - F.length(_removed(line, "|»•"))
    marked = line.rlike(f"[{SYMBOLS}»•]") & ((symbols > SYMBOLS_A_WORD * words) | (bars >= BARS) & (5 * bars >= words))
    endless = (F.length(line) >= 2 * LONG_LINE - 1) & ~line.rlike("[.,;:!?…。、]") & (words >= LONG_LINE)
    phrase = _has_boilerplate(line) if boilerplate is None else boilerplate & _has_boilerplate(line)
    return (marked | endless | phrase | line.rlike(NAVIGATION)) & line.rlike(SOLID)


def _covered(starts: Column) -> Column:
    """Words covered by three-word windows at these ascending starts."""
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(
        F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"), s.alias("last")),
            lambda a: a["n"],
        )
    )


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more column, `quality`: a struct of the statistics, the verdict and the cleaned text."""
    d = docs.withColumn("quality", F.struct(F.coalesce(F.col(text), F.lit("")).alias("t")))
    put = lambda d, **more: d.withColumn("quality", F.struct("quality.*", *[c.alias(k) for k, c in more.items()]))
    q = lambda k: F.col(f"quality.{k}")
    # inner columns live in one struct, so that no other column's name can clash
    d = put(d, w=_words(q("t")), lines=F.split(q("t"), "\n"), boilerplate=_has_boilerplate(q("t")))
    d = put(
        d,
        h=F.when(
            F.size(q("w")) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(q("w")) - 3), lambda i: F.xxhash64(F.get(q("w"), i), F.get(q("w"), i + 1), F.get(q("w"), i + 2))),
        ).otherwise(F.array().cast("array<long>")),
        has=F.filter(q("lines"), lambda x: x.rlike(SOLID)),
        good=F.filter(q("lines"), lambda x: ~line_fails(x, q("boilerplate"))),
    )
    d = put(d, s=F.when(F.size(F.array_distinct(q("h"))) < F.size(q("h")), F.sort_array(q("h"))).otherwise(F.array().cast("array<long>")))
    d = put(d, twice=F.array_distinct(F.filter(q("s"), lambda x, i: (i > 0) & (x == F.get(q("s"), i - 1)))))
    places = F.sequence(F.lit(0), F.size(q("h")) - 1)
    sorted_ = F.sort_array(F.transform(q("h"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = put(d, o=F.when(F.size(q("twice")) > FEW, sorted_))
    d = put(
        d,
        starts=F.when(F.size(q("twice")) == 0, F.array().cast("array<int>"))
        .when(F.size(q("twice")) <= FEW, F.filter(places, lambda i: F.array_contains(q("twice"), F.get(q("h"), i))))
        .otherwise(
            F.sort_array(
                F.transform(
                    F.filter(q("o"), lambda e, i: ((i > 0) & (e["x"] == F.get(q("o"), i - 1)["x"])) | (e["x"] == F.get(q("o"), i + 1)["x"])),
                    lambda e: e["i"],
                )
            )
        ),
    )
    words, letters = F.size(q("w")).cast("long"), F.length(F.array_join(q("w"), "")).cast("long")
    symbols = F.when(q("t").rlike(f"[{SYMBOLS}]"), F.length(q("t")) - F.length(_removed(q("t"), SYMBOLS))).otherwise(F.lit(0))
    repeated = _covered(q("starts")).cast("long")
    size = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    d = put(d, n_words=words, n_repeat_words=repeated, all_chars=size(q("lines")), good_chars=size(q("good")), text=F.array_join(q("good"), "\n"))
    failed = (q("n_words") < MIN_WORDS) | (100 * q("n_repeat_words") > MAX_REPEATED * q("n_words"))
    lost = (q("all_chars") - q("good_chars")) > MAX_LOST * q("all_chars")
    return d.withColumn(
        "quality",
        F.struct(
            q("n_words").alias("n_words"),
            letters.alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            (F.size(q("has")) - F.size(F.array_distinct(q("has")))).cast("long").alias("n_dup_lines"),
            q("n_repeat_words").alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & ~lost).alias("kept"),
            (F.size(q("lines")) - F.size(q("good"))).cast("long").alias("n_removed_lines"),
            q("text").alias("text"),
        ),
    )


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines"]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality(docs).select("doc_id", *[F.col(f"quality.{k}").alias(k) for k in FIELDS])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with failing lines removed from their texts and n_chars set anew."""
    holder = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    # a generator, so that the verdict is computed once and not again in a filter beneath
    kept = quality(holder).select("row", F.explode(F.filter(F.array("quality"), lambda q: q["kept"])).alias("quality"))
    columns = [F.col("quality.text") if c == "text" else F.length("quality.text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return kept.select(*[x.alias(c) for x, c in zip(columns, docs.columns, strict=True)])


_WS = "[\\x20\\x09-\\x0D]"
_LINE_FAILS = f"""(nw > 0 AND (length(line) - length(translate(line, '{SYMBOLS}', '')) > {SYMBOLS_A_WORD} * nw
   OR (length(line) - length(translate(line, '|»•', '')) >= {BARS} AND 5 * (length(line) - length(translate(line, '|»•', ''))) >= nw)
   OR regexp_matches(line, '{NAVIGATION}') OR {' OR '.join(f"contains(lower(line), '{x}')" for x in BOILERPLATE)}
   OR (nw >= {LONG_LINE} AND length(line) = length(translate(line, '.,;:!?…。、', '')))))"""
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3),
gg AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i+1], w[i+2], w[i+3]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM gg WHERE n > 1) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, len(list_filter(string_split_regex(line, '{_WS}+'), lambda x: x <> '')) AS nw FROM l0),
l2 AS (SELECT doc_id, line, nw, {_LINE_FAILS} AS bad FROM l1),
l AS (SELECT doc_id, count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS n_dup_lines, count(*) FILTER (bad) AS n_removed_lines,
  sum(length(line)) AS all_chars, coalesce(sum(length(line)) FILTER (bad), 0) AS lost FROM l2 GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WS}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(n_removed_lines AS BIGINT) AS n_removed_lines, all_chars, lost
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND NOT (lost > {MAX_LOST} * all_chars) AS kept, n_removed_lines
FROM f"""
