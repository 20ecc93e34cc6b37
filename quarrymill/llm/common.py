"""Shared plumbing of the training-data operators: shared folders, staged tables, hashes of words."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold at most this many documents, so that long texts cannot swell one batch.
BATCH_ROWS = 1000
CACHED_WORDS = 150_000
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); on one machine, one under /tmp/checkpoints if unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or f"/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and executors may be lost."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long) and text (null: empty) of documents, whatever other columns there are."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


# --- hashing ----------------------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def table_of_hashes(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def word_list(text: str) -> list[str]:
    """Words [^\\x20\\x09-\\x0D]+ of a text. str.split() also splits at other white space, so only ASCII texts use it."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w for w in _SPLIT.split(text) if w]


def words_hashed(words: list[str], cache: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; the cache is emptied when it holds CACHED_WORDS words."""
    if len(cache) > CACHED_WORDS:
        cache.clear()
    out = np.empty(len(words), np.uint64)
    get = cache.get
    values = [get(w) for w in words]
    if None in values:
        import xxhash

        for i, v in enumerate(values):
            if v is None:
                w = words[i]
                v = cache.get(w)
                if v is None:
                    v = cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                values[i] = v
    out[:] = values
    return out
