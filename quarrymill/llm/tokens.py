"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank (0: most frequent), so that frequent ids take one byte. A control byte holds the lengths
less one of four ranks, two bits each; the ranks' bytes, low byte first, follow apart. Both directions are numpy: a control
byte selects a row of a table of byte masks, and one masked assignment moves all bytes.

A file ("shard") is MAGIC, then eight little-endian int64 (partition, number in the partition, ids before it in the
partition, documents, ids, control bytes, data bytes, version), the doc_ids (int64), their numbers of ids (int64), the
control bytes, the data bytes. `ranks.bin` has the id of each rank (uint32). Shards hold whole documents in ascending
doc_id order, about SHARD ids each; a file is written under another name first, then renamed, so a repeated task is harmless.

Defined cases: null and empty texts have no ids but the end id; a null doc_id comes last and is read back as null; documents
with one doc_id follow each other in the order of their ids' crc32 and number; an empty table gives no rows; a very long text makes a
longer file, since files hold whole documents; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, new_folder, read_documents, staged, texts, width
from .encoding import encoder, tokenizer_path

MAGIC = b"QMTOKENS"
#: Ids after which a shard is closed.
SHARD = 1_000_000
NO_ID = np.iinfo(np.int64).max

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
_MASKS = np.arange(4)[None, None, :] <= _LENGTHS[:, :, None]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks (uint32)."""
    ranks = ranks.astype("<u4")
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    full = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    full[: len(ranks)] = code
    four = full.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[_MASKS[control].reshape(-1, 4)[: len(ranks)]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[_MASKS[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def write_file(folder: str, name: str, data: bytes) -> None:
    """Write one file in a shared folder, whole or not at all."""
    if folder.startswith("file:") or "://" not in folder:
        local = folder.removeprefix("file://").removeprefix("file:")
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}.{os.getpid()}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{local}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/_{name}.{os.getpid()}") as f:
        f.write(data)
    store.move(f"{path}/_{name}.{os.getpid()}", f"{path}/{name}")


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("crc", pa.int64())])


def encoded(docs: DataFrame, path: str, kind: str, end_id: int, dtype: str = "<u4") -> DataFrame:
    """doc_id, n_tokens, ids (of dtype, with the end id) and their crc32."""
    end, size = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, kind, dtype)
        for b in batches:
            ids = [x + end for x in own.encode(b.column("text").to_pylist())]
            yield batch(_ENCODED, doc_id=b.column("doc_id"), n_tokens=[len(x) // size for x in ids], ids=ids, crc=[zlib.crc32(x) for x in ids])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, crc long")


def frequencies(ids: DataFrame, dtype: str = "<u4") -> np.ndarray:
    """Number of each id; as long as the vocabulary, whatever the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype))
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n
        yield pa.RecordBatch.from_pydict({"id": np.flatnonzero(total), "n": total[total > 0]})

    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"]] = rows["n"]
    return out


_WRITTEN = pa.schema([("partition", pa.int64()), ("n_tokens", pa.int64())])


def write_shards(ids: DataFrame, folder: str, dtype: str = "<u4") -> np.ndarray:
    """Write ranked shards in ascending doc_id order. Returns the ids before each partition."""
    number, item = frequencies(ids, dtype), np.dtype(dtype).itemsize
    id_of = np.lexsort((np.arange(len(number)), -number)).astype("<u4")
    rank_of = np.empty(len(id_of), "<u4")
    rank_of[id_of] = np.arange(len(id_of))
    write_file(folder, "ranks.bin", id_of.tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, shard, before, size = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int] = []
        held: list[bytes] = []

        def close() -> None:
            nonlocal shard, before, size, doc_ids, held
            if not doc_ids:
                return
            control, data = encode_ranks(rank_of[np.frombuffer(b"".join(held), dtype)])
            head = np.array([partition, shard, before, len(doc_ids), size, len(control), len(data), 1], "<i8").tobytes()
            counts = np.array([len(x) // item for x in held], "<i8").tobytes()
            write_file(folder, f"shard-{partition:06d}-{shard:06d}.qmt", MAGIC + head + np.array(doc_ids, "<i8").tobytes() + counts + control + data)
            shard, before, size, doc_ids, held = shard + 1, before + size, 0, [], []

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                doc_ids.append(NO_ID if d is None else d)
                held.append(x)
                size += len(x) // item
                if size >= SHARD:
                    close()
        close()
        yield batch(_WRITTEN, partition=[partition], n_tokens=[before])

    order = [F.col("doc_id").asc_nulls_last(), F.col("crc"), F.col("n_tokens")]
    dealt = ids.repartitionByRange(width(ids.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    totals = dealt.mapInArrow(write, "partition long, n_tokens long").groupBy("partition").agg(F.sum("n_tokens").alias("n")).collect()
    each = np.zeros(max((r["partition"] for r in totals), default=-1) + 1, np.int64)
    for r in totals:
        each[r["partition"]] = r["n"]
    return np.cumsum(each) - each


def read_ranks(spark: SparkSession, folder: str) -> np.ndarray:
    """The id of each rank; none where no document had an id."""
    row = spark.read.format("binaryFile").load(f"{folder}/ranks.bin").select("content").head()
    return np.frombuffer(row[0] if row and row[0] else b"", "<u4")


def read_shards(spark: SparkSession, folder: str, bases: np.ndarray, id_of: np.ndarray) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("content"):
                buf = x.as_buffer().to_pybytes()
                assert buf[:8] == MAGIC, "not a token file"
                partition, _, before, n_docs, n_ids, n_control, n_data, _ = np.frombuffer(buf, "<i8", 8, 8).tolist()
                at = 72
                docs = np.frombuffer(buf, "<i8", n_docs, at)
                counts = np.frombuffer(buf, "<i8", n_docs, at + 8 * n_docs)
                at += 16 * n_docs
                ids = id_of[decode_ranks(buf[at : at + n_control], buf[at + n_control : at + n_control + n_data], n_ids)].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield batch(schema, doc_id=pa.array(docs, mask=docs == NO_ID), start=bases[partition] + before + ends - counts, n_tokens=counts, ids_crc32=crc)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.qmt").load(folder).select("content")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtype = "<u2"  # 49,408 ids
    ids = staged(encoded(read_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), "words", 1, dtype), "token-ids")
    folder = new_folder(spark, "token-shards")
    bases = write_shards(ids, folder, dtype)
    return read_shards(spark, folder, bases, read_ranks(spark, folder))
