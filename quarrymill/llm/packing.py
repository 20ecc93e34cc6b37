"""Vector best-fit packing of documents' tokens into sequences.

A bin (sequence) has three capacities: tokens, documents, and attention cost (the sum of squared lengths). Pieces are placed
in descending length; among the open bins that can take a piece under every capacity, the one whose residual vector, with
the piece inside, has the least weighted norm gets it ("norm"), or the one with the greatest weighted dot product of piece
and residual ("dot").

Since only a piece's length matters, the plan is made for the histogram of lengths (as many numbers as a sequence has
tokens, whatever the number of documents): bins in the same state are placed as one class with a multiplicity. The plan is a
few thousand rows at most. A piece gets its sequence from its number among the pieces of its length, which comes from
counts for each task and length, so no group of equal lengths meets in one task.

Limits on documents and attention bind only below the defaults: a sequence of 1,024 tokens can't hold more than 1,024 documents, nor cost
more than 1,024 squared. There the weights still choose among bins.

Defined cases: a null or empty text is the end id alone; very long texts are cut into pieces; other columns are not read; null doc_ids are packed like others; rows that repeat are packed
each for itself; ties in the plan go to the class opened first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, read_documents, staged, texts
from .encoding import encoder, tokenizer_path

CAPACITY = 1024
DOCUMENTS = 1024
ATTENTION = 1024 * 1024
WEIGHTS = (1.0, 0.05, 0.05)


def plan(counts: dict[int, int], capacity=CAPACITY, documents=DOCUMENTS, attention=ATTENTION, weights=WEIGHTS, rule="norm") -> list[tuple[int, dict[int, int]]]:
    """(number of bins, pieces of each length in each) for a histogram of lengths."""
    caps = np.array([capacity, documents, attention], float)
    w = np.array(weights)
    residual = np.zeros((0, 3))
    many: list[int] = []
    inside: list[dict[int, int]] = []

    def add(n: int, res: np.ndarray, pieces: dict[int, int]) -> None:
        nonlocal residual
        residual = np.vstack([residual, res])
        many.append(n)
        inside.append(pieces)

    for length in sorted(counts, reverse=True):
        left, item = counts[length], np.array([length, 1, length * length], float)
        assert (item <= caps).all(), f"a piece of {length} tokens fits no bin"
        while left:
            live = np.array(many, dtype=np.int64) > 0
            fits = np.flatnonzero(live & (residual >= item).all(axis=1)) if len(many) else np.empty(0, int)
            if len(fits):
                rest = residual[fits]
                score = (w * ((rest - item) / caps) ** 2).sum(axis=1) if rule == "norm" else -(w * (rest / caps) * (item / caps)).sum(axis=1)
                k = int(fits[np.argmin(score)])
                n, each = min(left, many[k]), 1
                if n == many[k]:  # all of them: as many pieces in each as fit, a best fit being still best when fuller
                    each = max(1, min(int((residual[k] // item).min()), left // n)) if rule == "norm" else 1
                many[k] -= n
                add(n, residual[k] - each * item, inside[k] | {length: inside[k].get(length, 0) + each})
                left -= n * each
            else:
                each = min(int((caps // item).min()), left)
                n = left // each
                add(n, caps - each * item, {length: each})
                left -= n * each
    return [(n, p) for n, p in zip(many, inside, strict=True) if n]


def slots(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number among its pieces, first sequence, pieces in each sequence, offset there), by first number."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, pieces in bins:
        at = 0
        for length in sorted(pieces, reverse=True):
            out.setdefault(length, []).append((used.get(length, 0), sequence, pieces[length], at))
            used[length] = used.get(length, 0) + n * pieces[length]
            at += length * pieces[length]
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


_PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "k")])
_COLUMNS = "doc_id long, piece long, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document, each with its task and its number among the pieces of its length there."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, own = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path, "bytes")
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), own.encode(b.column("text").to_pylist()), strict=True):
                ids += end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % capacity or capacity
                    rows.append((doc, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, int(seen[length])))
                    seen[length] += 1
                    at, piece = at + length, piece + 1
            columns = zip(*rows, strict=True) if rows else [[]] * len(_PIECE)
            yield batch(_PIECE, **dict(zip(_PIECE.names, map(list, columns), strict=True)))

    return texts(docs).mapInArrow(run, f"{_COLUMNS}, part long, k long")


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, **limits) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(cut(docs, path, end_id, capacity), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    per_task = staged(per_task, "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan(histogram, capacity=capacity, **limits))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    numbered = pieces.join(per_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")).hint("merge"), ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                table = where[n]
                row = table[np.searchsorted(table[:, 0], number[own], side="right") - 1]
                j = number[own] - row[:, 0]
                sequence[own] = row[:, 1] + j // row[:, 2]
                offset[own] = row[:, 3] + j % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    own = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("number"))
    return own.mapInArrow(place, f"{_COLUMNS}, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), 2)
