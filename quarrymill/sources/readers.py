"""Documents from files and tables, and the strategies that make chunks of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.chunking import plain_chunks

BLOCKS = "doc string, pos int, label string, level int, text string"
#: Pages whose blocks a task holds at once.
PAGES = 200


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc (file name) and text of whole UTF-8 files, bad bytes replaced."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("doc"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def table_documents(df: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc and text of a table's rows."""
    return df.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text"))


def conversations(df: DataFrame) -> DataFrame:
    """One document for each conversation: its turns in order, `role: text` on a line each."""
    turn = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", turn.alias("said"))))
    return df.groupBy("conv_id").agg(turns.alias("turns")).select(F.col("conv_id").cast("string").alias("doc"), F.array_join(F.col("turns.said"), "\n").alias("text"))


#: Elements that begin a block, and the layout label of each.
LABELS = {"h1": "title", "h2": "section_header", "h3": "section_header", "h4": "section_header", "h5": "section_header", "h6": "section_header"}
LABELS |= {"li": "list_item", "table": "table", "pre": "code", "code": "code", "figcaption": "caption", "caption": "caption", "nav": "document_index"}
LABELS |= {"p": "text", "div": "text", "article": "text", "section": "text", "main": "text", "body": "text", "blockquote": "text", "td": "text", "th": "text"}
SILENT = {"script", "style", "noscript", "template", "head"}
FURNITURE = {"footer", "header", "aside"}


class _Blocks(HTMLParser):
    """Text of a page as blocks in order. Elements left open end where the next block begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, str]] = []
        self.now, self.level, self.held, self.silent = "text", 0, [], 0
        self.cells: list[list[str]] | None = None

    def close_block(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append((self.now, self.level, text))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "table" and self.cells is None:
            self.close_block()
            self.cells = []
        elif self.cells is not None:
            if tag == "tr":
                self.cells.append([])
            elif tag in ("td", "th"):
                (self.cells or self.cells.append([]) or self.cells)[-1].append("")
        elif tag == "br":
            self.held.append(" ")
        elif tag in LABELS or tag in FURNITURE:
            self.close_block()
            self.now, self.level = ("page_furniture", 0) if tag in FURNITURE else (LABELS[tag], int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.cells is not None:
            rows = [r for r in ([" ".join(c.split()) for c in row] for row in self.cells) if r]
            self.cells = None
            if rows:
                wide = max(map(len, rows))
                rows = [r + [""] * (wide - len(r)) for r in rows]
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                self.out.append(("table", 0, "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])))
        elif tag in LABELS or tag in FURNITURE:
            self.close_block()
            self.now, self.level = "text", 0

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.cells is None:
            self.held.append(data)
        elif self.cells and self.cells[-1]:
            self.cells[-1][-1] += data


#: An ampersand that begins no reference with a semicolon.
_OPEN = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)")


def html_items(html: str, bare: bool = True) -> list[tuple[str, int, str]]:
    """bare: references without their semicolon (`&amp` at a text's end) count, as in HTML; else they stay as they are."""
    p = _Blocks()
    p.feed((html or "") if bare else _OPEN.sub("&amp;", html or ""))
    p.close()
    p.close_block()
    return p.out


def html_blocks(pages: DataFrame, doc: str = "url", html: str = "html", bare: bool = True) -> DataFrame:
    """doc, pos, label, level, text: the blocks of each page in reading order. bare: see `html_items`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                rows = [(d, i, *x) for d, h in zip(part.column("doc").to_pylist(), part.column("html").to_pylist(), strict=True) for i, x in enumerate(html_items(h, bare))]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "pos", "label", "level", "text"])

    return pages.select(F.col(doc).cast("string").alias("doc"), F.col(html).alias("html")).mapInArrow(run, BLOCKS)


def section_paths(blocks: DataFrame) -> DataFrame:
    """Blocks with section_path: the headings above, by level; a heading stands under itself.

    One window over each document carries the last heading of every level forward; a heading of a higher level empties the
    lower ones.
    """
    from pyspark.sql import Window as W

    heads = (X.kind_for(F.col("label")) == "heading") & (X.strip(F.col("text")) != "")
    up_to = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    d, parts = blocks, []
    for k in range(1, 7):
        at = F.max(F.when(heads & (F.col("level") < k), F.col("pos"))).over(up_to)
        own = F.max(F.when(heads & (F.col("level") == k), F.struct("pos", "text"))).over(up_to)
        parts.append(F.when(own["pos"] > F.coalesce(at, F.lit(-1)), own["text"]))
    return d.withColumn("section_path", X.path_of(F.array_compact(F.array(*parts))))


def structural_chunks(blocks: DataFrame) -> DataFrame:
    """One chunk for each block that isn't blank: index, section_path, text, token_count (words), kind."""
    from pyspark.sql import Window as W

    d = section_paths(blocks).withColumn("text", X.visible_bullets(F.col("text"))).where(X.strip(F.col("text")) != "")
    index = F.row_number().over(W.partitionBy("doc").orderBy("pos")) - 1
    return d.select("doc", index.alias("index"), "section_path", "text", X.word_count(F.col("text")).alias("token_count"), X.kind_for(F.col("label")).alias("kind"))


def _structural(df: DataFrame, **options) -> DataFrame:
    return structural_chunks(df if "label" in df.columns else html_blocks(df, "doc", "text"))


def _plain(df: DataFrame, target_tokens: int = 200, **options) -> DataFrame:
    return plain_chunks(df, target=target_tokens)


def _layout(df: DataFrame, **options) -> DataFrame:
    from ..operators.layout import scan_layout

    return scan_layout(df, **options)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"plain_text": _plain, "structural": _structural, "pdf_layout": _layout}


def get_chunker(strategy: str) -> Callable[..., DataFrame]:
    if strategy == "markdown_render":
        raise NotImplementedError("markdown_render is declared but has no implementation")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return STRATEGIES[strategy]


def parse(df: DataFrame, strategy: str = "structural", **options) -> DataFrame:
    """Documents (doc, text) or layout items to chunks; nothing is stored."""
    return get_chunker(strategy)(df, **options)


def read_pages(fetch: Callable[[int, int], list], size: int = 5000) -> Iterator:
    """Rows of a source that gives pages: fetch(skip, limit), until a page is short. For sources that are no table; tables are read
    by Spark, in as many tasks as they have parts."""
    skip = 0
    while True:
        page = fetch(skip, size)
        yield from page
        if len(page) < size:
            return
        skip += size
