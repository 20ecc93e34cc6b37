"""Is a document's text damaged, and which of its lines are only repeated: decisions before chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _seen(pages: DataFrame) -> DataFrame:
    """doc, line, seen: how often each stripped line that isn't blank is in a document."""
    lines = pages.select("doc", F.explode(F.transform(F.split("text", "\n"), X.strip)).alias("line")).where("line <> ''")
    return lines.groupBy("doc", "line").agg(F.count("*").alias("seen"))


def _repeated():
    """Whether a line is only repeated: on max(3, pages // 2) or more lines of a document of 3 pages or more."""
    return (F.col("pages") >= 3) & (F.col("seen") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2)))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """doc, line, seen: the stripped lines (of doc, page, text) that are only repeated."""
    pages_of = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages")).where("pages >= 3")
    return _seen(pages).join(pages_of, "doc").where(_repeated()).select("doc", "line", "seen")


def text_damage(pages: DataFrame) -> DataFrame:
    """doc, body (kept characters), letters (share of visible ones), misdecoded, damaged, short. Each distinct line is looked at once."""
    size = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages"), F.sum(F.length("text")).alias("length"), F.sum(F.regexp_count("text", F.lit("[\\u0080-\\u009F\\uFFFD]"))).alias("misdecoded"))
    kept = _seen(pages).join(size.select("doc", "pages"), "doc").where(~_repeated())
    of = lambda c: F.sum(F.col("seen") * F.length(c))
    letters, visible = F.regexp_replace("line", r"[^\p{L}]", ""), F.regexp_replace("line", r"(?U)[\s\x1c-\x1f]", "")
    body = kept.groupBy("doc").agg(of(F.col("line")).alias("body"), of(letters).alias("alpha"), of(visible).alias("visible"))
    d = size.join(body, "doc", "left").select(
        "doc",
        F.coalesce("body", F.lit(0)).alias("body"),
        F.when(F.coalesce("visible", F.lit(0)) == 0, 1.0).otherwise(F.col("alpha") / F.col("visible")).alias("letters"),
        "misdecoded",
        "pages",
        "length",
    )
    damaged = (F.col("body") / F.col("pages") < 40) | (F.col("letters") < 0.55) | (F.col("misdecoded") > 0.005 * F.greatest(F.lit(1), F.col("length")))
    return d.select("doc", "body", "letters", "misdecoded", damaged.alias("damaged"), (F.col("body") < 500).alias("short"))


def use_ocr(layer: DataFrame, ocr: DataFrame) -> DataFrame:
    """doc, use_ocr: from text_damage of the text layer, with the characters that OCR found (doc, text)."""
    found = ocr.groupBy("doc").agg(F.sum(F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]", ""))).alias("ocr"))
    return layer.join(found, "doc", "left").select("doc", (F.col("ocr").isNotNull() & (F.col("damaged") | F.col("short") & (F.col("ocr") >= 1.5 * F.col("body")))).alias("use_ocr"))


def repair_documents(docs: DataFrame) -> DataFrame:
    """Texts (doc, text) of which two Latin-1 bytes were read as one character are put right."""
    return docs.withColumn("text", X.repair(F.col("text")))
