"""Documents to chunks: plain text by headings and paragraphs, over-size windows, ids and context.

Every function takes and gives DataFrames; order is an explicit column (`index`).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

MOST_CHARS, OVERLAP, TARGET = 6000, 400, 200
CHUNK = "index int, section_path string, text string, token_count int"


def window_starts(length: Column, most: int = MOST_CHARS, overlap: int = OVERLAP) -> Column:
    """Where windows of a text start: 0, and each step on until the end is covered."""
    step = most - overlap
    last = F.ceil((length - most) / step).cast("int") * step
    return F.when(length > most, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array(F.lit(0)))


def window_chunks(docs: DataFrame, doc: str = "doc", text: str = "text", most: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of at most `most` characters, each `overlap` into the one before; blank ones go. No shuffle: a text's windows
    are numbered where it lies."""
    t = F.coalesce(F.col(text), F.lit(""))
    pieces = F.transform(window_starts(F.length(t), most, overlap), lambda s: F.struct(s.alias("start"), F.substr(t, s + 1, F.lit(most)).alias("text")))
    kept = F.filter(pieces, lambda p: X.strip(p["text"]) != "")
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(kept).alias("index", "w"))
    return rows.select("doc", "index", F.col("w.start").alias("start"), F.col("w.text").alias("text"), X.tokens(F.col("w.text")).alias("token_count"))


def with_ids(chunks: DataFrame) -> DataFrame:
    cid = X.chunk_id(F.col("doc"), F.col("index"))
    return chunks.withColumn("chunk_id", cid).withColumn("cite_hex", X.cite_hex(F.col("chunk_id")))


def renumber(chunks: DataFrame, order: list[Column], doc: str = "doc") -> DataFrame:
    """index anew from 0 within each document."""
    return chunks.withColumn("index", F.row_number().over(W.partitionBy(doc).orderBy(*order)) - 1)


def split_oversized(chunks: DataFrame, most: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks over the limit become windows; all are numbered anew."""
    pieces = F.transform(window_starts(F.length("text"), most, overlap), lambda s: F.struct(s.alias("start"), F.substr(F.col("text"), s + 1, F.lit(most)).alias("text")))
    kept = F.filter(pieces, lambda p: (F.size(pieces) == 1) | (X.strip(p["text"]) != ""))
    over = F.length("text") > most
    rows = chunks.withColumn("__w", F.explode(kept))
    rows = rows.withColumn("token_count", F.when(over, F.floor(F.length("__w.text") / 4).cast("int")).otherwise(F.col("token_count"))).withColumn("text", F.col("__w.text"))
    return renumber(rows, [F.col("index"), F.col("__w.start")]).drop("__w")


def chunks_of(text: str, target: int = TARGET):
    """(index, section path, body, tokens): headings by # form a stack; the text under each is packed up to the target."""
    index = 0
    for path, block in blocks(text):
        for part in pack(block, target):
            body = part if path == X.ROOT else f"{path}\n{part}"
            yield index, path, body, size(body)
            index += 1


def size(text: str) -> int:
    return max(1, len(text) // 4)


def heading(line: str) -> tuple[int, str] | None:
    """Level and words of a # heading."""
    marks = len(line) - len(line.lstrip("#"))
    rest = line[marks:]
    return (marks, rest.strip()) if 1 <= marks <= 6 and rest[:1].isspace() and rest.strip() else None


def blocks(text: str):
    """(section path, text) of each stretch between headings; stretches of white space are passed over."""
    stack: list[tuple[int, str]] = []
    held: list[str] = []

    def close():
        body = "\n".join(held).strip()
        held.clear()
        if body:
            yield " > ".join(t for _, t in stack) or X.ROOT, body

    for line in text.splitlines():
        found = heading(line)
        if found is None:
            held.append(line)
            continue
        yield from close()
        while stack and stack[-1][0] >= found[0]:
            stack.pop()
        stack.append(found)
    yield from close()


def pack(text: str, target: int):
    """The whole text if it fits; else paragraphs put together while they fit. A paragraph that is too long stays whole."""
    if size(text) <= target:
        yield text
        return
    held: list[str] = []
    total = 0
    for paragraph in paragraphs(text):
        n = size(paragraph)
        if held and total + n > target:
            yield "\n\n".join(held)
            held, total = [], 0
        held.append(paragraph)
        total += n
    if held:
        yield "\n\n".join(held)


def paragraphs(text: str):
    """Stretches between blank lines, stripped."""
    held: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            held.append(line)
        elif held:
            yield "\n".join(held).strip()
            held = []


def plain_chunks(docs: DataFrame, doc: str = "doc", text: str = "text", target: int = TARGET) -> DataFrame:
    """Chunks of plain texts. An Arrow batch of texts at a time; a text's chunks are numbered where it lies."""
    fields = T.StructType.fromDDL(CHUNK)

    @F.pandas_udf(T.ArrayType(fields))
    def chunked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(fields.names, r, strict=True)) for r in chunks_of(t or "", target)])

    return docs.select(F.col(doc).alias("doc"), F.inline(chunked(F.col(text))))


def with_context(chunks: DataFrame, title: str | None = None) -> DataFrame:
    """Each text starts with a line `title > section path`: blanks, the root and repeats of a part are left out, and so is the
    line where it would repeat the text's own first line."""
    parts = F.concat(F.array(F.lit(title or "").cast("string")), X.segments(F.col("section_path")))
    kept = F.filter(F.transform(parts, X.strip), lambda p: (p != "") & (p != X.ROOT))
    unlike = F.aggregate(kept, F.array().cast("array<string>"), lambda a, p: F.when(F.exists(a, lambda q: F.lower(q) == F.lower(p)), a).otherwise(F.concat(a, F.array(p))))
    line = F.array_join(unlike, " > ")
    own = F.substring_index("text", "\n", 1)
    return chunks.withColumn("text", F.when((line == "") | (line == own), F.col("text")).otherwise(F.concat(line, F.lit("\n"), F.when(own == F.col("section_path"), F.expr("substr(text, length(section_path) + 2)")).otherwise(F.col("text")))))


def drop_contents(chunks: DataFrame, labels: str = "labels", ratio: float = 1.0) -> DataFrame:
    """Without chunks of which that share of the items are lines of a contents list; 0 or less keeps all."""
    if ratio <= 0:
        return chunks
    n = F.size(labels)
    listed = F.size(F.filter(F.col(labels), lambda x: F.lower(x) == "document_index"))
    return chunks.where(~((n > 0) & (listed >= ratio * n)))


def drop_blank(chunks: DataFrame) -> DataFrame:
    return chunks.where(X.strip(F.coalesce(F.col("text"), F.lit(""))) != "")


def digest(chunks: DataFrame) -> DataFrame:
    """Chunks, those with regions, and distinct section paths; one row."""
    regions = F.col("regions").isNotNull() & (F.size("regions") > 0) if "regions" in chunks.columns else F.lit(False)
    path = F.countDistinct("section_path") if "section_path" in chunks.columns else F.lit(1).cast("long")
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(regions).alias("with_regions"), path.alias("section_paths"))
