"""Windows of L consecutive symbols that stand earlier in the corpus, found exactly without a row for each window.

Runs. A text falls into runs of windows, each a stretch of text ("span") around a gram of k symbols. Equal windows must be in runs of
equal grams ("buckets") at the same place. Two choices give that. Content anchors: of the grams of a window, the one of least hash
(the leftmost of equals); consecutive windows share it, so a row suffices for each (L-k+2)/2 symbols. A difference cover (cover.py): a
sample of places of which any two equal windows share one.

Stage 1, per task: runs get the hash of their gram ("bucket") and of their whole span. Repeats within the task are settled
there; the others are dealt by bucket as packed columns. Stage 2 sorts one bucket range at a time. Equal spans: all but the
first are repeats. A bucket with different spans is a tie that the gram can't settle: its spans are asked for. Stage 3
reads the texts asked for, and settles their windows one by one by the hash of the whole window.

Hot groups. A span in a third of all documents leaves each task once. A bucket that has different spans within a task (a
common line amid different text) is dealt by span, with one marker row for the bucket, so no task meets all its spans; and
stage 3 deals by window, each distinct window leaving a task once.

Two unlike windows count as equal only if two hashes agree in both: anchor and span, or two hashes of the whole window that are made
in different ways (`grams`, `rolled`). No text is compared with another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, width
from .cover import cover_runs, named

NO_ID = np.iinfo(np.int64).max
#: Runs (or windows) that a task holds before it settles repeats among them and sends the rest.
FLUSH = 500_000
#: Symbols hashed at once: small enough for the processor's caches, below 2**21 for the packed positions.
BLOCK = 1 << 16
#: Over how many tasks the earlier rows of a probed bucket are dealt.
SALTS = 16
_POS = np.uint64((1 << 21) - 1)

RUNS, INTERVALS, REQUESTS, INDEX, PROBES = 0, 1, 2, 3, 4
ROWS = "p int, kind int, doc_id long, batch int, data binary"
_ROWS = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("batch", pa.int32()), ("data", pa.binary())])


# --- packed columns ---------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Values byte by byte: first bytes first. What is zero in all of them costs nothing when it is compressed."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def pack_columns(bucket, span, doc, start, n, flag) -> bytes:
    """Rows as one compressed value; (doc, start) order makes it small."""
    size = len(doc)
    doc_d, start_d = np.diff(doc, prepend=np.int64(0)), np.diff(start, prepend=np.int64(0))
    raw = b"".join([size.to_bytes(8, "little"), _planes(bucket), _planes(span), doc_d.astype("<i8").tobytes(), start_d.astype("<i8").tobytes(), n.astype(np.uint8).tobytes(), flag.astype(np.uint8).tobytes()])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_columns(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    size, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in ("<u8", "<u8", "<i8", "<i8", "u1", "u1"):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    for i in (0, 1):
        out[i] = np.ascontiguousarray(out[i].view(np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")
    out[2], out[3] = np.cumsum(out[2]), np.cumsum(out[3])
    return out


# --- runs -------------------------------------------------------------------------------------------------------------


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    z += y
    z *= np.uint64(0xD1342543DE82EF95)
    z ^= z >> np.uint64(29)
    return z


def grams(h: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, hashes of all grams of so many symbols; doublings are shared."""
    powers, step = [h], 1
    while step * 2 <= max(sizes) and len(powers[-1]) > step:
        powers.append(_joined(powers[-1][:-step], powers[-1][step:]))
        step *= 2
    out = []
    for k in sizes:
        n, done, value = len(h) - k + 1, 0, None
        for i in reversed(range(len(powers))):
            if n > 0 and k >> i & 1:
                part = powers[i][done : done + n]
                value = part if value is None else _joined(value, part)
                done += 1 << i
        out.append(value if n > 0 else np.empty(0, np.uint64))
    return out


_POWERS = [np.cumprod(np.full(1 << 16, 0xD6E8FEB86659FD93, np.uint64)), np.cumprod(np.full(1 << 16, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64))]


def rolled(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A second hash of 40 bits, made another way (a polynomial), of the windows that begin at these places."""
    while len(_POWERS[0]) < len(h):
        for i, p in enumerate(_POWERS):
            _POWERS[i] = np.concatenate([p, p * p[-1]])
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * _POWERS[0][: len(h)], out=sums[1:])
    return mix((sums[at + length] - sums[at]) * _POWERS[1][at]) & ~np.uint64((1 << 24) - 1)


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys."""
    n, m, step = len(key) - w + 1, key, 1
    while step * 2 <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[:n], m[w - step : w - step + n]) if w > step else m[:n]


def block_runs(h: np.ndarray, ok: np.ndarray, length: int, k: int):
    """Runs of the windows at which ok: first window, number of windows, bucket, span."""
    gram, window = grams(h, k, length)
    key = (gram & ~_POS) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_least(key, length - k + 1) & _POS).astype(np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(anchor))
    keep = ok[first]
    first, n = first[keep], n[keep]
    at = anchor[first]
    bucket = gram[at]
    span = mix(_joined(window[first], window[first + n - 1]) + (n * 512 + (at - first)).astype(np.uint64))
    return first, n, bucket, span


class Blocks:
    """Cuts texts into blocks of symbols and gives runs of their windows; with `white` (the white space among the symbols), those
    of a difference cover."""

    def __init__(self, length: int, k: int, white: np.ndarray | None = None):
        self.length, self.k, self.white = length, k, white
        self.clear()

    def clear(self) -> None:
        self.h: list[np.ndarray] = []
        self.meta: list[tuple[int, int, int]] = []
        self.size = 0

    def feed(self, doc: int, h: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs (doc, start, n, bucket, span) as blocks fill."""
        step = BLOCK * 8
        for a in range(0, max(len(h) - self.length + 1, 0), step):
            piece = h[a : a + step + self.length - 1]
            self.h.append(piece)
            self.meta.append((doc, a, len(piece)))
            self.size += len(piece)
            if self.size >= BLOCK:
                yield self.drain()

    def drain(self) -> tuple[np.ndarray, ...]:
        h = np.concatenate(self.h) if self.h else np.empty(0, np.uint64)
        sizes = np.array([m[2] for m in self.meta], np.int64)
        offset = np.cumsum(sizes) - sizes
        ok = np.ones(max(len(h) - self.length + 1, 0), bool)
        for o, s in zip(offset.tolist(), sizes.tolist(), strict=True):
            ok[max(o + s - self.length + 1, 0) : o + s] = False
        if not len(ok):
            first, n, bucket, span = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)] * 2
        elif self.white is None:
            first, n, bucket, span = block_runs(h, ok, self.length, self.k)
        else:
            first, n, bucket, span = self.sampled(h, ok, offset, sizes)
        of = np.searchsorted(offset, first, side="right") - 1
        doc = np.array([m[0] for m in self.meta], np.int64)[of] if self.meta else np.empty(0, np.int64)
        start = (first - offset[of] + np.array([m[1] for m in self.meta], np.int64)[of]) if self.meta else np.empty(0, np.int64)
        self.clear()
        return doc, start, n, bucket, span

    def sampled(self, h: np.ndarray, ok: np.ndarray, offset: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        white = h == self.white[0]
        for x in self.white[1:]:
            white |= h == x
        runs = cover_runs(white, ok, offset, sizes, self.length, self.k)
        hashes = dict(zip(sizes_ := [self.length, *{r[3] for r in runs}], grams(h, *sizes_), strict=True))
        window, out = hashes[self.length], []
        for first, n, at, k, salt in runs:
            bucket, span = named(hashes[k][at], window[first], window[first + n - 1], n, at - first, salt)
            out.append((first, n, bucket, span))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def _groups(first: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each group of rows, given which rows are the first of one."""
    start = np.flatnonzero(first)
    return list(zip(start.tolist(), np.append(start[1:], len(first)).tolist(), strict=True)) if len(start) else []


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


# --- settling ---------------------------------------------------------------------------------------------------------


def _repeats(bucket, span, doc, start, within: bool):
    """Order by (bucket, span, doc, start); which rows (in that order) repeat an earlier one; which begin a new span."""
    o = np.lexsort((start, doc, span, bucket))
    b, s, d, t = bucket[o], span[o], doc[o], start[o]
    new = np.ones(len(o), bool)
    new[1:] = (b[1:] != b[:-1]) | (s[1:] != s[:-1])
    lead = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    if within:
        gone = (d != d[lead][group]) | (t != t[lead][group])
    else:
        gone = d > d[lead][group]
    return o, gone, new


def range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges each is in, by bits 24 to 47: an anchor is the least of many hashes, so by their high bits most
    anchors would be in the first ranges, and some hashes have no lower bits."""
    return ((h >> np.uint64(24) & np.uint64((1 << 24) - 1)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def interval_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, p_of: int) -> list[tuple]:
    """A row for each document: its merged intervals."""
    if not len(doc):
        return []
    o = np.lexsort((start, doc))
    d, s, e = doc[o], start[o], end[o]
    rows = []
    for a, z in _groups(_changes(d)):
        ss, ee = s[a:z], np.maximum.accumulate(e[a:z])
        new = np.append(True, ss[1:] > ee[:-1])
        f = np.flatnonzero(new)
        pairs = np.stack([ss[f], ee[np.append(f[1:], len(ss)) - 1]], axis=1)
        rows.append((int(d[a]) % p_of, INTERVALS, int(d[a]), 0, pairs.astype("<i8").tobytes()))
    return rows


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def _emit_all(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 2000):
        yield _emit(rows[a : a + 2000])


def _dealt(p: np.ndarray, batch: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Packed rows for each (p, batch); columns are bucket, span, doc, start, n, flag."""
    o = np.lexsort((columns[3], columns[2], batch, p))
    p, batch, columns = p[o], batch[o], [c[o] for c in columns]
    return [(int(p[a]), RUNS, None, int(batch[a]), pack_columns(*[c[a:z] for c in columns])) for a, z in _groups(_changes(p, batch))]


def runs_of(texts: DataFrame, hashed: Callable[[], Callable[[str], np.ndarray]], length: int, k: int, parts: int, within: bool, bounds: list[int] = (), white: np.ndarray | None = None) -> DataFrame:
    """Stage 1. hashed() makes, on the worker, the function from a text to its symbols' hashes. bounds: first doc_id of each
    later batch. white: as for Blocks."""
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, blocks, held, size = hashed(), Blocks(length, k, white), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, start, n, bucket, span = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            o, gone, _ = _repeats(bucket, span, doc, start, within)
            doc, start, n, bucket, span = doc[o], start[o], n[o], bucket[o], span[o]
            yield from _emit_all(interval_rows(doc[gone], start[gone], start[gone] + n[gone] - 1 + length, parts))
            doc, start, n, bucket, span = (x[~gone] for x in (doc, start, n, bucket, span))
            first = np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]
            group = np.cumsum(first) - 1
            lead = np.flatnonzero(first)
            many = np.zeros(len(lead), bool)
            differs = np.append(False, (bucket[1:] == bucket[:-1]) & (span[1:] != span[:-1]))[: len(bucket)]
            many[group[differs]] = True
            flag = many[group]
            p = range_of(np.where(flag, span, bucket), parts)
            mark = lead[many]  # a marker (no windows) for each bucket that is dealt by span
            add = lambda x, y: np.concatenate([x, y])
            columns = [add(bucket, bucket[mark]), add(span, span[mark]), add(doc, doc[mark]), add(start, start[mark]), add(n, n[mark] * 0), add(flag, flag[mark])]
            p = add(p, range_of(bucket[mark], parts))
            yield from _emit_all(_dealt(p, np.searchsorted(edges, columns[2], side="right"), columns))

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for got in blocks.feed(NO_ID if doc is None else doc, of(text)):
                    held.append(got)
                    size += len(got[0])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        held.append(blocks.drain())
        yield from flush()

    return texts.mapInArrow(run, ROWS)


def _by_p(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each p, of a partition that is sorted by p."""
    now, rows = None, []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if r[0] != now and rows:
                yield now, rows
                rows = []
            now = r[0]
            rows.append(r)
    if rows:
        yield now, rows


def settle_range(p: int, group: list[tuple], length: int, within: bool, index: bool) -> Iterator[pa.RecordBatch]:
    """What the rows of one bucket range give: intervals, requests and (index) the rows that a later batch is held against. Rows of
    kind INDEX are earlier ones; they give requests only. PROBES are buckets of new rows that were dealt by span before: their earlier
    rows lie in any range (`flagged_requests`)."""
    yield from _emit_all([r for r in group if r[1] == INTERVALS])
    got = [(r[1], unpack_columns(r[4])) for r in group if r[1] != INTERVALS and r[4]]
    if not got:
        if index:
            yield _emit([(p, INDEX, None, 0, b"")])
        return
    bucket, span, doc, start, n, flag = (np.concatenate([c[i] for _, c in got]) for i in range(6))
    old = np.concatenate([np.full(len(c[0]), kind == INDEX) for kind, c in got])
    n = n.astype(np.int64)
    marker = n == 0
    real = np.flatnonzero(~marker)
    o, gone, new = _repeats(bucket[real], span[real], doc[real], start[real], within)
    at = real[o]
    out = at[gone & ~old[at]]
    yield from _emit_all(interval_rows(doc[out], start[out], start[out] + n[out] - 1 + length, 1))
    stay = at[~gone]
    b = bucket[stay]
    ties = np.append(False, (b[1:] == b[:-1]) & (span[stay][1:] != span[stay][:-1]))[: len(b)]
    tied = np.concatenate([b[ties], bucket[(flag > 0)]])
    if index:  # of ranges without a new row nothing is asked: their ties were settled when they were new
        tied = tied[np.isin(tied, bucket[~old])]
    asked = stay[np.isin(b, tied)]
    rows_, oo = [], np.lexsort((start[asked], doc[asked]))
    asked = asked[oo]
    for a, z in _groups(_changes(doc[asked])):
        s = start[asked[a:z]]
        rows_.append((p, REQUESTS, int(doc[asked[a]]), 0, np.stack([s, s + n[asked[a:z]]], axis=1).astype("<i8").tobytes()))
    yield from _emit_all(rows_)
    if index:
        probes = np.intersect1d(bucket[marker & old], bucket[~old])
        yield from _emit_all([(p, PROBES, None, 0, probes.astype("<u8").tobytes())] if len(probes) else [])
        keep = np.concatenate([stay[~old[stay]], np.flatnonzero(marker & ~old)])
        keep = keep[np.lexsort((start[keep], doc[keep], span[keep], bucket[keep]))]
        yield _emit([(p, INDEX, None, 0, pack_columns(bucket[keep], span[keep], doc[keep], start[keep], n[keep], flag[keep]) if len(keep) else b"")])


def flagged_requests(earlier: DataFrame, found: DataFrame) -> DataFrame:
    """Requests (doc_id, data) for the rows of earlier runs (INDEX) that were dealt by span and whose buckets are probed in found. Salted
    by document, so that a hot bucket is no single task's."""

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("data").to_pylist():
                bucket, _, doc, start, n, flag = unpack_columns(blob)
                at = np.flatnonzero((flag > 0) & (n > 0))
                for a in range(0, len(at), 100_000):
                    k = at[a : a + 100_000]
                    data = np.stack([start[k], start[k] + n[k]], axis=1).astype("<i8").tobytes()
                    data = pa.array([data[i : i + 16] for i in range(0, len(data), 16)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[k].view(np.int64)), pa.array((doc[k] % SALTS).astype(np.int32)), pa.array(doc[k]), data], names=["bucket", "salt", "doc_id", "data"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("data").to_pylist():
                x = np.frombuffer(blob, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, SALTS)), pa.array(np.tile(np.arange(SALTS, dtype=np.int32), len(x)))], names=["bucket", "salt"])

    old = earlier.where((F.col("kind") == INDEX) & (F.length("data") > 0)).select("data").mapInArrow(flagged, "bucket long, salt int, doc_id long, data binary")
    new = found.where(F.col("kind") == PROBES).select("data").mapInArrow(probed, "bucket long, salt int")
    return old.join(new, ["bucket", "salt"], "left_semi").select("doc_id", "data")


def settle_runs(rows: DataFrame, length: int, within: bool, index: bool = False) -> DataFrame:
    """Stage 2: each bucket range settled by itself."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, group in _by_p(batches):
            yield from settle_range(p, group, length, within, index)

    return rows.repartition(width(rows.sparkSession), "p").sortWithinPartitions("p").mapInArrow(settle, ROWS)


def by_document(rows: DataFrame, kind: int) -> DataFrame:
    own = rows.where(F.col("kind") == kind)
    return own.groupBy("doc_id").agg(F.collect_list("data").alias("data"))


def with_rows(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Texts (compressed while they are dealt) with their documents' rows: doc_id, packed, data."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("packed", pa.binary())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            doc = b.column("doc_id")
            packed = [z.compress(x.encode("utf-8", "surrogatepass")) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([doc, doc.fill_null(NO_ID), pa.array(packed, pa.binary())], schema=schema)

    left = texts.mapInArrow(squeeze, "doc_id long, key long, packed binary")
    right = rows.select(F.col("doc_id").alias("key"), "data")
    return left.join(right, "key", how).select("doc_id", "packed", "data")


def unsqueezed(packed) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=0) if packed else b""


def pairs(data: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(data or []), "<i8").reshape(-1, 2)


def settle_windows(asked: DataFrame, hashed: Callable[[], Callable[[str], np.ndarray]], length: int, parts: int, within: bool) -> DataFrame:
    """Stage 3: intervals of the windows asked for that repeat an earlier one."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size = hashed(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, start, h, g = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            o, gone, _ = _repeats(g, h, doc, start, within)
            doc, start, h, g = doc[o], start[o], h[o], g[o]
            yield from _emit_all(interval_rows(doc[gone], start[gone], start[gone] + length, parts))
            doc, start, h, g = doc[~gone], start[~gone], h[~gone], g[~gone]
            one = np.ones(len(h), np.uint8)
            yield from _emit_all(_dealt(range_of(g, parts), np.zeros(len(h), np.int64), [g, h, doc, start, one, one * 0]))

        for b in batches:
            for doc, packed, data in zip(*[b.column(c).to_pylist() for c in ("doc_id", "packed", "data")], strict=True):
                symbols = of(unsqueezed(packed).decode("utf-8", "surrogatepass"))
                spans = pairs(data)
                low = spans[:, 0]
                wanted = np.unique(np.concatenate([np.arange(a, z) for a, z in spans.tolist()] or [low]))
                wanted = wanted[wanted <= len(symbols) - length]  # another version of the document may be shorter
                (h,) = grams(symbols, length)
                held.append((np.full(len(wanted), NO_ID if doc is None else doc, np.int64), wanted, h[wanted], rolled(symbols, wanted, length)))
                size += len(wanted)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return settle_runs(asked.mapInArrow(windows, ROWS), length, within)


def removed(texts: DataFrame, intervals: DataFrame, columns: str, each: Callable[[bytes, np.ndarray], tuple]) -> DataFrame:
    """doc_id and what each(text as bytes, intervals) gives, for every document."""
    joined = with_rows(texts, intervals, "left")
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *each(unsqueezed(x), pairs(data))) for d, x, data in zip(*[b.column(c).to_pylist() for c in ("doc_id", "packed", "data")], strict=True)]
            kinds = [pa.int64(), *[pa.string() if c.split()[1] == "string" else pa.int64() for c in columns.split(", ")]]
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, f"doc_id long, {columns}")


def merge_pairs(x: np.ndarray, size: int) -> np.ndarray:
    """Maximal covered runs of half-open pairs, within size."""
    if not len(x):
        return x
    x = x[np.argsort(x[:, 0], kind="stable")]
    s, e = x[:, 0], np.minimum(np.maximum.accumulate(x[:, 1]), size)
    s, e = s[s < size], e[s < size]
    if not len(s):
        return np.empty((0, 2), np.int64)
    f = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return np.stack([s[f], e[np.append(f[1:], len(s)) - 1]], axis=1)
