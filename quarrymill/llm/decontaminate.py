"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are lower-cased and runs of white space become one space. An item of m characters stands in a document if some
stretch of it is at most RATE * m edits away. By the q-gram lemma such a stretch shares at least m - Q + 1 - Q * e of the
item's q-grams with it, on diagonals that e edits can't spread further than e apart. So shared q-grams are counted in
overlapping bands of diagonals, each 2 (e + 1) wide, starting every e + 1; a region whose count meets the bound is verified
by alignment within its band. No stretch within the budget is missed.

Items are a stated query set: they are broadcast in blocks of at most BLOCK characters, whatever their number, and each
block passes over all documents; a document's q-grams are looked up in a bitmap first and in a sorted array then.

Items of fewer than Q characters have no q-gram; they are searched exactly, by their whole text, and must be bounded: where
an end of one is a letter or digit, so must the neighbour not be, unless one of the two is of a script without word spaces.

Defined cases: null and empty texts hold nothing; very long texts are searched whole; items without a character (or null) stand
nowhere; of several stretches of one item in a document the one with the fewest edits, then the first, is given; rows that repeat are
searched each for itself; a null doc_id is given back as null; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, read_documents, staged, texts
from .spans import grams

Q = 10
RATE = 0.08
#: Characters of the shortest item that is searched.
LEAST = 1
#: Characters of items in one broadcast.
BLOCK = 4_000_000
#: Characters of documents searched at once; shared q-grams looked at at once.
PIECE, HITS = 1 << 18, 1 << 20
_BITS = 22
_SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    return _SPACE.sub(" ", text.lower()).strip()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def budget(m: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed, no more than the lemma can filter for."""
    return max(0, min(int(rate * m), (m - q) // q - 1))


def hashed(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.uint64) + np.uint64(1))


@functools.cache
def _joins() -> np.ndarray:
    """Of each code point, if it runs on into a neighbour in one word: letters and digits of scripts with spaces between words."""
    out = np.array([chr(i).isalnum() for i in range(0x110000)])
    for a, z in ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1100, 0x1200), (0x1780, 0x1800), (0x2E80, 0xE000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x1B000, 0x1B170), (0x20000, 0x32000)):
        out[a:z] = False
    return out


class Short:
    """Items of fewer than q characters, by length: the sorted hashes of their whole texts."""

    def __init__(self, ids: list[int], texts_: list[str]):
        self.of: dict[int, tuple[np.ndarray, list[int], list[np.ndarray]]] = {}
        for m in sorted({len(t) for t in texts_}):
            own = [(grams(hashed(x), m)[0][0], i, x) for i, t in zip(ids, texts_, strict=True) if len(t) == m for x in (points(t),)]
            own.sort(key=lambda r: r[0])
            self.of[m] = (np.array([h for h, _, _ in own], np.uint64), [i for _, i, _ in own], [x for _, _, x in own])

    def search(self, doc_id: int | None, text: str) -> list[tuple]:
        """(doc_id, item_id, start, end, 0) of the first bounded place of each item."""
        out, x = [], points(text)
        joins = np.concatenate([[False], _joins()[x], [False]])
        apart = ~(joins[1:] & joins[:-1])  # a word may begin or end before character i
        for m, (keys, ids, own) in self.of.items():
            (h,) = grams(hashed(x), m)
            if not len(h):
                continue
            at = np.flatnonzero(apart[: len(h)] & apart[m : m + len(h)])
            left = np.searchsorted(keys, h[at])
            some = left < len(keys)
            at, left = at[some], left[some]
            same = keys[left] == h[at]
            first, k = np.unique(left[same], return_index=True)
            for p, j in zip(first.tolist(), at[same][k].tolist(), strict=True):
                out.extend((doc_id, ids[q], j, j + m, 0) for q in range(p, int(np.searchsorted(keys, keys[p], side="right"))) if (own[q] == x[j : j + m]).all())
        return out


class Items:
    """The q-grams of a block of items, ready for lookups; items that are too short for one are in `short`."""

    def __init__(self, ids: list[int], texts_: list[str], rate: float = RATE, q: int = Q):
        few = [(i, t) for i, t in zip(ids, texts_, strict=True) if len(t) < q]
        self.short = Short([i for i, _ in few], [t for _, t in few])
        ids, texts_ = ([x for x, t in zip(y, texts_, strict=True) if len(t) >= q] for y in (ids, texts_))
        self.ids, self.texts, self.q = ids, texts_, q
        self.sizes = np.array([len(t) for t in texts_], np.int64)
        self.edits = np.array([budget(len(t), rate, q) for t in texts_], np.int64)
        self.least = self.sizes - q + 1 - q * self.edits
        h = [grams(hashed(points(t)), q)[0] for t in texts_]
        item = np.repeat(np.arange(len(texts_)), [len(x) for x in h])
        at = np.concatenate([np.arange(len(x)) for x in h]) if h else np.empty(0, np.int64)
        flat = np.concatenate(h) if h else np.empty(0, np.uint64)
        o = np.argsort(flat, kind="stable")
        self.item, self.at = item[o], at[o]
        self.keys, self.first, self.count = np.unique(flat[o], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, number of the q-gram) of each shared q-gram."""
        where = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[where]), len(self.keys) - 1)
        same = self.keys[k] == h[where]
        return where[same], k[same]

    def hits(self, where: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, place in the item) of shared q-grams, about HITS at a time, however many items have one in common."""
        ends = np.cumsum(self.count[k])
        a = 0
        while a < len(k):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, side="right")))
            n = self.count[k[a:z]]
            entry = np.repeat(self.first[k[a:z]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield np.repeat(where[a:z], n), self.item[entry], self.at[entry]
            a = z


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits of item against a stretch of text whose alignment stays on diagonals low..high (text minus item place),
    and the end of the first such stretch. The stretch may start and end anywhere on them."""
    wide = high - low + 1
    far = len(item) + len(text) + 1
    at = np.arange(wide)
    row = np.where((at + low >= 0) & (at + low <= len(text)), 0, far)
    for i in range(1, len(item) + 1):
        j = at + low + i  # text characters used
        ok = (j >= 0) & (j <= len(text))
        c = np.where((j >= 1) & (j <= len(text)), text[np.clip(j - 1, 0, max(len(text) - 1, 0))] if len(text) else 0, 0xFFFFFFFF)
        best = np.minimum(row + (c != item[i - 1]), np.append(row[1:], far) + 1)
        best = np.where(ok, best, far)
        row = np.minimum(best, np.minimum.accumulate(best - at) + at)
        row = np.where(ok, row, far)
    k = int(np.argmin(row))
    return int(row[k]), k + low + len(item)


def regions(items: Items, bounds: np.ndarray, h: np.ndarray) -> set[tuple[int, int, int]]:
    """(document, item, band) of every band that meets its item's bound; h: q-gram hashes of documents laid end to end, which
    begin at bounds."""
    where, k = items.shared(h)
    found: set[tuple[int, int, int]] = set()
    if not len(where):
        return found
    many = len(items.ids)
    doc_of = lambda w: np.searchsorted(bounds, w, side="right") - 1
    # first how many q-grams each document shares with each item, then the bands of the pairs that share enough
    counted = [np.unique(doc_of(w) * many + item, return_counts=True) for w, item, _ in items.hits(where, k)]
    pairs, inverse = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
    enough = pairs[np.bincount(inverse, np.concatenate([c[1] for c in counted])) >= items.least[pairs % many]]
    if not len(enough):
        return found
    kept = []
    for w, item, at in items.hits(where, k):
        doc = doc_of(w)
        pair = doc * many + item
        i = np.minimum(np.searchsorted(enough, pair), len(enough) - 1)
        own = enough[i] == pair
        band = (w[own] - bounds[doc[own]] - at[own]) // (items.edits[item[own]] + 1)
        kept.append(np.stack([pair[own], band, at[own]], axis=1))
    # one q-gram place of the item counts once in a band
    one = np.concatenate(kept)
    rows = np.concatenate([one, one - np.array([0, 1, 0])])
    if len(rows):
        rows = np.unique(rows, axis=0)
        cut = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        size = np.diff(cut, append=len(rows))
        for k in cut[size >= items.least[rows[cut, 0] % len(items.ids)]].tolist():
            p, b = int(rows[k, 0]), int(rows[k, 1])
            found.add((p // len(items.ids), p % len(items.ids), b))
    return found


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_from", pa.int64()), ("end_at", pa.int64()), ("edits", pa.int64())])


def search(docs: list[tuple[int | None, str]], items: Items) -> list[tuple]:
    """(doc_id, item_id, low start, end, edits) of the items in these documents."""
    out = []
    held: list[tuple[int | None, str, np.ndarray]] = []
    size = 0

    def look() -> None:
        h = np.concatenate([g for _, _, g in held])
        sizes = np.array([len(g) for _, _, g in held], np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, band in sorted(regions(items, np.cumsum(sizes) - sizes, h)):
            e, item = int(items.edits[k]), items.texts[k]
            low = band * (e + 1)
            high = low + 2 * (e + 1) - 1
            text = held[d][1]
            a, z = max(0, low), min(len(text), high + len(item) + e + 1)
            exact = text.find(item, a, z)
            got = (0, a if exact < 0 else exact, exact + len(item)) if exact >= 0 else None
            if got is None:
                x = points(text[a:z])
                edits, end = banded(points(item), x, low - a - e, high - a + e)
                got = (edits, a, a + end) if edits <= e else None
            if got and got < best.get((d, k), (len(item) + 1,)):
                best[d, k] = got
        out.extend((held[d][0], items.ids[k], start, end, edits) for (d, k), (edits, start, end) in best.items())

    for doc_id, text in docs:
        if items.short.of:
            out.extend(items.short.search(doc_id, text))
        if not items.ids:
            continue
        (g,) = grams(hashed(points(text)), items.q)
        if len(g):
            held.append((doc_id, text, g))
            size += len(g)
        if size >= PIECE:
            look()
            held.clear()
            size = 0
    if held:
        look()
    return out


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = Q) -> DataFrame:
    """doc_id, item_id, start_from, end_at, edits: the items that stand in each document (places in the normalised text; the
    stretch ends at end_at and starts at start_from or later)."""
    spark = docs.sparkSession
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    d, found = texts(docs), None
    for block in _blocks(own):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, rate, q)
            for b in batches:
                if len(items.ids) or items.short.of:
                    got = search([(i, normal(t)) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)], items)
                    columns = zip(*got, strict=True) if got else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=_FOUND)

        one = d.mapInArrow(run, "doc_id long, item_id long, start_from long, end_at long, edits long")
        found = one if found is None else found.unionByName(one)
    return found


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of bounded size; one empty block if there are none. The driver holds one block at a time."""
    ids: list[int] = []
    kept: list[str] = []
    size, given = 0, False
    for r in items.toLocalIterator():
        t = normal(r["text"])
        if len(t) < LEAST:
            continue
        if size + len(t) > BLOCK and ids:
            yield ids, kept
            ids, kept, size, given = [], [], 0, True
        ids.append(r["item_id"])
        kept.append(t)
        size += len(t)
    if ids or not given:
        yield ids, kept


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (document, item) found; documents without an item have no row."""
    return matches(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; a doc_id on several rows goes if one of them holds an item. Null doc_ids are judged
    together."""
    bad = staged(matches(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n")), "contaminated").select(F.col("doc_id").alias("__id"))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti")
