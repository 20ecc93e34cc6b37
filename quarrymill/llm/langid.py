"""Language identification by Kneser-Ney character models: the language of least cross-entropy, with calibrated rejection.

Models learn from rows with a label whose crc32(doc_id) mod 4 is 0 or 1; rows of 3 calibrate; rows of 2 are held out. The
score is the share of calibration rows with as much evidence (log-likelihood ratio to the second language) that were right,
made monotonous; a text is `rejected` if its cross-entropy is above that of all but REJECT of the calibration rows.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any label everything is `und`; a null
doc_id belongs to the rows learned from; ties between languages go to the first in order of name; rows that repeat count as
often as they stand there; texts of any length are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charlm import Blocks, blocks, count_windows
from .common import read_documents, small_batches, staged

REJECT = 0.005
#: Bins of evidence, by powers of two from 2**-6 nats; bins of cross-entropy of a hundredth of a nat.
BINS = 24
UNKNOWN = "und"


def part(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def train(labelled: DataFrame) -> Blocks | None:
    """A model of texts (class, text), of all their windows."""
    classes, starts, models = blocks(staged(count_windows(labelled), "windows"))
    return Blocks(classes, starts, [labelled.sparkSession.sparkContext.broadcast(m) for m in models]) if classes else None


def scored(docs: DataFrame, model: Blocks | None) -> DataFrame:
    """docs without text, with lang_pred, cross_entropy and evidence."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            lang, best, evidence = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if m and texts:
                n, h = m.cross_entropy(texts)
                k = h.argmin(axis=1)
                lang = [m.classes[i] if size else UNKNOWN for i, size in zip(k.tolist(), n.tolist(), strict=True)]
                two = np.sort(h, axis=1)
                best = two[:, 0]
                evidence = n * (two[:, 1] - best) if h.shape[1] > 1 else n * 1.0
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(lang), pa.array(best), pa.array(evidence)], names=[*keep, "lang_pred", "cross_entropy", "evidence"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, lang_pred string, cross_entropy double, evidence double")


def monotonous(right: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Shares right / all (with one half added to each side), made to rise by pooling neighbours."""
    blocks: list[list[float]] = []
    for r, n in zip(right, all_, strict=True):
        blocks.append([r + 0.5, n + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            r1, n1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r1, blocks[-1][1] + n1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), r / n) for r, n, k in blocks])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("lang"), part(F.col("doc_id"), 4).alias("part"))
    small_batches(d.sparkSession)
    model = train(d.where("part IN (0, 1) AND lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").alias("class"), "text"))
    s = staged(scored(d, model), "languages")
    bin_ = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest("evidence", F.lit(2.0**-6)))) + 6)).cast("int")
    sure = s.where(f"part = 3 AND lang IS NOT NULL AND lang_pred <> '{UNKNOWN}'")
    right, all_ = np.zeros(BINS), np.zeros(BINS)
    for r in sure.groupBy(bin_.alias("bin")).agg(F.count_if(F.col("lang") == F.col("lang_pred")).alias("r"), F.count("*").alias("n")).collect():
        right[r["bin"]], all_[r["bin"]] = r["r"], r["n"]
    share = monotonous(right, all_)
    tally = {r["h"]: r["n"] for r in sure.groupBy(F.least(F.lit(2000), F.floor(100 * F.col("cross_entropy"))).alias("h")).agg(F.count("*").alias("n")).collect()}
    left, most = sum(tally.values()) * REJECT, 20.0
    for h in sorted(tally, reverse=True):
        left -= tally[h]
        most = (h + 1) / 100
        if left < 0:
            break
    known = F.col("lang_pred") != UNKNOWN
    return s.select(
        "doc_id",
        (F.col("part") == 2).alias("held_out"),
        "lang_pred",
        F.when(known, F.get(F.array(*[F.lit(float(x)) for x in share]), bin_)).otherwise(F.lit(0.0)).alias("score"),
        "cross_entropy",
        (~known | (F.col("cross_entropy") > most)).alias("rejected"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_documents(spark, sf_dir))
