"""Substring dedup by bytes: every byte of a string of LENGTH bytes that also starts earlier goes.

Earlier means a smaller doc_id, or the same document and an earlier start. Strings are judged on the input.

Suffixes matter to a depth of LENGTH bytes, and only their equality does. A sample that covers them is ranked by names of bounded
prefixes, computed where its text is: one of GRAM bytes, by which it goes to a suffix bucket, and one of all the windows that it
stands for. A task sorts one bucket range at a time, so its memory is that of one range (spans.py). Of suffixes with equal names all
but the first repeat. Long ties, suffixes that share a bucket's prefix and differ later, are settled for each window by itself.

The sample is fixed by content (cover="content": about one place for 35 bytes) or a difference cover (cover="difference": cover.py,
about one for 14 bytes). Both give the same bytes; the second needs more disk than the check tool allows (README).

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; very long texts are cut into overlapping blocks, which
changes no result; null doc_ids come last in the order and are one document; rows that share a doc_id are versions of one document,
and what goes from one goes from each, where it has that place; of equal strings the first in the order stays; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import read_documents, staged, table_of_hashes, texts, width
from .spans import INTERVALS, REQUESTS, by_document, merge_pairs, removed, runs_of, settle_runs, settle_windows, with_rows

LENGTH = 100
GRAM = 32
_BYTES = table_of_hashes(256, 5)
WHITE = _BYTES[[*range(0x09, 0x0E), 0x20]]


def hashed_bytes():
    return lambda text: _BYTES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


def without(data: bytes, spans: np.ndarray) -> tuple[int, int, int, str]:
    spans = merge_pairs(spans, len(data))
    kept, at = [], 0
    for s, e in spans.tolist():
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    return len(data), int((spans[:, 1] - spans[:, 0]).sum()) if len(spans) else 0, len(spans), hashlib.sha256(b"".join(kept)).hexdigest()


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cover: str = "content") -> DataFrame:
    """doc_id and the intervals (lists of packed pairs) of its repeated bytes."""
    d = texts(docs)
    parts = 4 * width(d.sparkSession)
    settled = staged(settle_runs(runs_of(d, hashed_bytes, length, gram, parts, True, white=WHITE if cover == "difference" else None), length, True), "byte-runs")
    asked = with_rows(d, by_document(settled, REQUESTS), "inner")
    rest = settle_windows(asked, hashed_bytes, length, parts, True)
    return by_document(settled.where(settled.kind == INTERVALS).unionByName(rest), INTERVALS)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return removed(texts(docs), repeated_bytes(docs), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", without)
