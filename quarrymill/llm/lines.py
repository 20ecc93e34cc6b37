"""Line dedup over overlapping windows of three consecutive lines.

Lines are the \\n-split parts of a text, trimmed; blank ones are passed over and always stay. A window is three consecutive
lines that aren't blank. A window whose lines also stand together earlier (smaller doc_id, or the same document and an
earlier line) is a repeat, and every line that a repeat covers goes; covered positions of overlapping repeats are merged.
Windows are judged on the input, not on what is left.

Rows: a window is one row of two 64-bit hashes and two integers, so texts cross the network once, for the last join. The
first place of each window is a minimum, which is combined before the shuffle; the hot windows of the join that follows
are split by adaptive execution.

Defined cases: a null text counts as empty and stays null where documents are returned; documents of fewer than three
lines lose nothing; null doc_ids come first in the order; rows that repeat a doc_id and text are one document and fare
alike; rows that share a doc_id but not the text are versions of one document, and what goes from one goes from each; of equal
windows the first in the order stays; texts of any length are read whole; an empty table gives no rows; other columns, whatever their
names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

BLANKS = " \t\r\x0b\x0c"
SPAN = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _solid(lines: Column) -> Column:
    """The lines that aren't blank: trimmed text t and index i."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(F.trim(x, F.lit(BLANKS)).alias("t"), i.alias("i"))), lambda e: e["t"] != "")


def _windows(solid: Column) -> Column:
    at = lambda j, k: F.get(solid, j + k)["t"]
    window = lambda j: F.struct(
        F.xxhash64(*[at(j, k) for k in range(SPAN)]).alias("h"), F.xxhash64(F.lit(SPAN), *[at(j, k) for k in reversed(range(SPAN))]).alias("g"), j.alias("at")
    )
    return F.when(F.size(solid) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(solid) - SPAN), window))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id and `starts`, the sorted first lines (counting solid lines only) of its repeated windows."""
    solid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _solid(_lines(F.col("text"))).alias("solid"))
    each = solid.select("doc_id", F.explode(_windows(F.col("solid"))).alias("w")).select("doc_id", "w.*")
    first = each.groupBy("h", "g").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max(F.struct("doc_id", "at")).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).select("h", "g", "first")
    later = each.join(first, ["h", "g"]).where(~F.struct("doc_id", "at").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with one more column, `lines`: a struct of counts and the text without repeated lines."""
    found = repeats(docs).select(F.col("doc_id").alias("__id"), "starts")
    d = docs.select(F.struct("*").alias("row")).join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("__id")), "left")
    none = F.array().cast("array<int>")
    d = d.select("row", F.coalesce("starts", none).alias("starts"), _lines(F.col("row.text")).alias("all"))
    d = d.select("row", "all", "starts", _solid(F.col("all")).alias("solid"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(SPAN)]))))
    d = d.select("row", "all", "starts", "solid", F.filter(covered, lambda j: j < F.size("solid")).alias("covered"))
    gone = F.transform("covered", lambda j: F.get(F.col("solid"), j)["i"])
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), gone), lambda i: F.get(F.col("all"), i))
    spans = F.size(F.filter("starts", lambda s, i: (i == 0) | (s > F.get(F.col("starts"), i - 1) + SPAN)))
    return d.select(
        "row",
        F.struct(
            F.size("all").cast("long").alias("n_lines"),
            F.size("covered").cast("long").alias("n_removed"),
            spans.cast("long").alias("n_spans"),
            F.when(F.size("covered") == 0, F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text"),
        ).alias("lines"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(read_documents(spark, sf_dir).select("doc_id", "text"))
    return d.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "lines.n_lines", "lines.n_removed", "lines.n_spans", F.sha2(F.encode("lines.text", "UTF-8"), 256).alias("kept_sha256")
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines removed from their texts and n_chars set anew."""
    put = {"text": F.when(F.col("row.text").isNotNull(), F.col("lines.text"))}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("row.text").isNotNull(), F.length("lines.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return dedup_lines(docs).select(*[put.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


_TRIM = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
e AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM l),
s AS (SELECT doc_id, i, trim(line, {_TRIM}) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM e WHERE trim(line, {_TRIM}) <> ''),
w AS (SELECT doc_id, j, t, lead(t, 1) OVER p AS t1, lead(t, 2) OVER p AS t2 FROM s WINDOW p AS (PARTITION BY doc_id ORDER BY j)),
r AS (SELECT doc_id, j, row_number() OVER (PARTITION BY t, t1, t2 ORDER BY doc_id, j) AS n FROM w WHERE t2 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, j + k AS j FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
x AS (SELECT e.doc_id, e.i, e.line, c.j IS NOT NULL AS gone, c.j FROM e LEFT JOIN s USING (doc_id, i) LEFT JOIN c ON c.doc_id = s.doc_id AND c.j = s.j),
n AS (SELECT doc_id, count(*) AS n_spans FROM (SELECT doc_id, j - lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS d FROM c) WHERE d IS NULL OR d > 1 GROUP BY doc_id)
SELECT x.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(coalesce(any_value(n_spans), 0) AS BIGINT) AS n_spans,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x LEFT JOIN n ON n.doc_id = x.doc_id GROUP BY x.doc_id"""
