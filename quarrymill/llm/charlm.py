"""Interpolated Kneser-Ney models over characters, in sorted hash arrays.

A text is lower-cased; letters are folded to SYMBOL bits, everything else is one space. A window of ORDER symbols is hashed to
one integer, the symbols side by side, so that contexts and shorter windows are bit operations. Windows are counted over all
texts given, summed per task before they are dealt, and all of them go into a model. It is in blocks of bounded size, of
windows whose third and fourth symbols are in one range; a block has all that the interpolation of its windows needs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 5
SYMBOL = 12
#: Windows of ORDER symbols, times classes, in a block of a model; windows of texts that are looked up in one block after another.
CELLS = 400_000
GROUP = 4_000_000
#: Distinct windows that a task holds before it sends them.
HELD = 1_000_000
_ONE = np.uint64(SYMBOL)
_MASK = [np.uint64((1 << SYMBOL * k) - 1) for k in range(ORDER + 1)]


@functools.cache
def _fold() -> np.ndarray:
    """Symbol of each code point: 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint16)
    letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
    out[letters] = np.where(letters < 4096, letters, 2048 + letters % 2048)
    return out


def symbols(text: str) -> np.ndarray:
    """Symbols of a text between ORDER - 1 spaces and one; empty if it has no letter."""
    s = _fold()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    s = s[keep]
    if not s.any():
        return s[:0]
    s = s[1:] if s[0] == 0 else s
    return np.concatenate([np.zeros(ORDER - 1, np.uint16), s, np.zeros(int(s[-1] != 0), np.uint16)])


def windows(s: np.ndarray) -> np.ndarray:
    n = len(s) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = s.astype(np.uint64)
    out = s[:n].copy()
    for k in range(1, ORDER):
        out = (out << _ONE) | s[k : k + n]
    return out


def count_windows(texts: DataFrame) -> DataFrame:
    """class (string), key, n of texts (class, text), over all of them."""
    schema = pa.schema([("class", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            if len(parts) == 1:
                return parts[0]
            k, i = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return k, np.bincount(i, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)

        def give(c: str) -> pa.RecordBatch:
            k, n = joined(held.pop(c))
            return pa.RecordBatch.from_arrays([pa.array([c] * len(k)), pa.array(k.astype(np.int64)), pa.array(n)], schema=schema)

        for b in batches:
            own: dict[str, list[np.ndarray]] = {}
            for c, t in zip(b.column("class").to_pylist(), b.column("text").to_pylist(), strict=True):
                own.setdefault(c, []).append(windows(symbols(t)))
            for c, w in own.items():
                held.setdefault(c, []).append(np.unique(np.concatenate(w), return_counts=True))
                if len(held[c]) > 8:
                    held[c] = [joined(held[c])]
                    if len(held[c][0][0]) > HELD:
                        yield give(c)
        for c in list(held):
            yield give(c)

    return texts.select("class", "text").mapInArrow(run, "class string, key long, n long").groupBy("class", "key").agg(F.sum("n").alias("n"))


def lower(counts: DataFrame, k: int) -> DataFrame:
    """class, key, n of the windows of k symbols that end those of k + 1 given (class, key): n counts their first symbols."""
    return counts.select("class", F.col("key").bitwiseAND(F.lit(int(_MASK[k]))).alias("key")).groupBy("class", "key").agg(F.count("*").alias("n"))


def collected(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per class, the sorted windows given and their counts."""
    t = counts.select("class", "key", "n").toArrow()
    classes = pa.chunked_array(t["class"].chunks, pa.string()).combine_chunks().dictionary_encode()
    code, key, n = classes.indices.to_numpy(), t["key"].to_numpy(), t["n"].to_numpy()
    out = {}
    for i, c in enumerate(classes.dictionary.to_pylist()):
        own = np.flatnonzero(code == i)
        own = own[np.argsort(key[own])]
        out[c] = (key[own].astype(np.uint64), n[own])
    return out


def pairs_of(keys: np.ndarray) -> np.ndarray:
    """Third and fourth symbols of windows of ORDER symbols, by which blocks are made."""
    return (keys >> _ONE) & _MASK[2]


def blocks(counts: DataFrame) -> tuple[list[str], np.ndarray, Iterator[Model]]:
    """Classes, first pairs of the blocks, and the blocks' models, one at a time, of staged counts (class, key, n)."""
    pair = F.shiftright("key", SYMBOL).bitwiseAND(F.lit(int(_MASK[2])))
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 1, -1):
        tables[k] = lower(tables[k + 1], k)
    seen: dict[str, dict[int, tuple[int, int]]] = {}
    for k in range(ORDER, 2, -1):
        for r in tables[k].groupBy("class").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect():
            seen.setdefault(r["class"], {})[k] = (r["one"], r["two"])
    low = {c: Kneser(k, n, (int((n == 1).sum()), int((n == 2).sum())), order=2) for c, (k, n) in collected(tables[2]).items()}
    classes, starts, size = sorted(low), [0], 0
    for r in counts.groupBy(pair.alias("pair")).agg(F.count_distinct("key").alias("w")).sort("pair").collect() if classes else ():
        cells = r["w"] * len(classes)
        if size and size + cells > CELLS:
            starts.append(r["pair"])
            size = 0
        size += cells

    def models() -> Iterator[Model]:
        none = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for a, z in zip(starts, [*starts[1:], 1 << 2 * SYMBOL], strict=True):
            own = collected(counts.where((pair >= a) & (pair < z)))
            yield Model({c: own.get(c, none) for c in classes}, seen, low)

    return classes, np.array(starts, np.uint64), models()


class Kneser:
    """One class: at each level, windows with discounted probabilities and contexts with the weight of the level below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, seen, order: int = ORDER, low: Kneser | None = None):
        """seen: numbers of windows seen once and twice at the top level; with `low`, the model of the levels below 3, those of
        all blocks at each level."""
        self.p: list = [None] * (order + 1)
        self.context: list = [None] * (order + 1)
        for k in range(order, 0, -1):
            if low and k == 2:
                self.p[1:3], self.context[1:3] = low.p[1:3], low.context[1:3]
                break
            one, two = seen[k] if low else seen if k == order else (int((counts == 1).sum()), int((counts == 2).sum()))
            d = one / (one + 2 * two) if one and two else 0.75
            d = min(max(d, 0.1), 0.9)
            h, first, kinds = np.unique(keys >> _ONE, return_index=True, return_counts=True)
            total = np.add.reduceat(counts, first)
            self.p[k] = (keys, np.maximum(counts - d, 0) / np.repeat(total, kinds))
            self.context[k] = (h, d * kinds / total)
            keys, counts = np.unique(keys & _MASK[k - 1], return_counts=True)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
        return i, table[i] == keys if len(table) else np.zeros(len(keys), bool)

    def weight(self, k: int, contexts: np.ndarray) -> np.ndarray:
        h, g = self.context[k]
        i, ok = self._find(h, contexts)
        return np.where(ok, g[i], 1.0) if len(h) else np.ones(len(contexts))

    def probability(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Interpolated probability of the last symbol of each window of k symbols."""
        if k == 0:
            return np.full(len(keys), 1.0 / (1 << SYMBOL))
        table, p = self.p[k]
        i, ok = self._find(table, keys)
        return (np.where(ok, p[i], 0.0) if len(p) else 0.0) + self.weight(k, keys >> _ONE) * self.probability(k - 1, keys & _MASK[k - 1])


class Model:
    """All classes in one: at each level the sorted windows of any class and their log probabilities in each."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]], seen: dict, low: dict[str, Kneser] | None = None):
        self.classes = sorted(counted)
        own = [Kneser(*counted[c], seen[c], low=low and low[c]) for c in self.classes]
        self.windows, self.contexts = {}, {}
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([m.p[k][0] for m in own]))
            self.windows[k] = (keys, np.log(np.stack([m.probability(k, keys) for m in own], axis=1)).astype(np.float32))
            h = np.unique(np.concatenate([m.context[k][0] for m in own]))
            self.contexts[k] = (h, np.log(np.stack([m.weight(k, h) for m in own], axis=1)).astype(np.float32))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of the last symbol of each window of ORDER symbols, in each class."""
        out = np.zeros((len(keys), len(self.classes)), np.float32)
        at, k = np.arange(len(keys)), ORDER
        while len(at) and k:
            table, lp = self.windows[k]
            i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            ok = table[i] == keys
            out[at[ok]] += lp[i[ok]]
            at, keys = at[~ok], keys[~ok]
            h, g = self.contexts[k]
            i = np.minimum(np.searchsorted(h, keys >> _ONE), len(h) - 1)
            known = h[i] == keys >> _ONE
            out[at[known]] += g[i[known]]
            keys, k = keys & _MASK[k - 1], k - 1
        out[at] -= np.float32(SYMBOL * np.log(2))
        return out


class Blocks:
    """A model in blocks, each broadcast by itself. A worker keeps a block if it is the only one; otherwise it reads one after
    another for each group of windows, and holds one at a time."""

    def __init__(self, classes: list[str], starts: np.ndarray, parts: list):
        self.classes, self.starts, self.parts = classes, starts, parts

    def part(self, i: int) -> Model:
        value = self.parts[i].value
        if len(self.parts) > 1:
            self.parts[i].__dict__.pop("_value", None)
        return value

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and nats for each symbol in each class."""
        n = np.zeros(len(texts), np.int64)
        nats = np.zeros((len(texts), len(self.classes)))
        held: list[np.ndarray] = []
        which: list[int] = []

        def flush() -> None:
            w, row = np.concatenate(held), np.repeat(which, [len(x) for x in held])
            block = np.searchsorted(self.starts, pairs_of(w), side="right") - 1
            for i in range(len(self.parts)):
                at = np.flatnonzero(block == i)
                model = self.part(i) if len(at) else None
                for a in range(0, len(at), 100_000):
                    some = at[a : a + 100_000]  # rows rise
                    first = np.flatnonzero(np.diff(row[some], prepend=-1))
                    nats[row[some[first]]] -= np.add.reduceat(model.log_probabilities(w[some]), first, axis=0, dtype=np.float64)
            held.clear()
            which.clear()

        size = 0
        for i, t in enumerate(texts):
            w = windows(symbols(t))
            n[i] = len(w)
            if len(w):
                held.append(w)
                which.append(i)
                size += len(w)
            if size > (GROUP if len(self.parts) > 1 else 100_000):
                flush()
                size = 0
        if held:
            flush()
        return n, nats / np.maximum(n, 1)[:, None]
