"""Substring dedup by words with a log-structured fingerprint index.

The index is a folder of runs and a numbered manifest that names those that count. A run is immutable: for each range of fingerprints
one row with the fingerprints of documents, sorted. It is a bucketed Parquet table, so that a range of every run is read where the range
of a new batch is: the batch is dealt by range, the runs are not dealt again. There, the batch is merge-joined with them: the runs' rows
of the batch's buckets are picked by one pass over both sorted columns. A span of words that stands in a run is a repeat; where only its
bucket does, the words themselves decide, window by window, before the batch is done (spans.py, stages 2 and 3). A bucket that a run
dealt by span, as many texts have it, is marked in its range; a batch that meets the mark asks for its rows in all ranges. Then the batch's
own fingerprints are the next run. Runs have levels: FANOUT of one level are merged into one of the next, so a batch is held against a
number of runs that grows with the logarithm of the batches, and a fingerprint is rewritten as often.

Batches come in ascending order of doc_id. A word goes if a window of LENGTH words that covers it also starts in a document with a
smaller doc_id. Windows are judged on the input. A fingerprint stands for a run of windows around a content anchor, with the hashes of
the anchor and of all words of the run; unlike words count as equal only if both agree. For windows, see `spans.rolled`.

Defined cases: a null text has no words; texts of fewer than LENGTH words lose nothing; very long texts are cut into overlapping blocks,
which changes no result; null doc_ids come last in the order and are one document; rows that share a doc_id are versions of one
document, and what goes from one goes from each; of equal windows in one document none goes for the other; kept words are joined by one
space; an empty table gives no rows, and an empty batch an empty run; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, read_documents, texts, width, word_list, words_hashed
from .spans import INDEX, INTERVALS, NO_ID, REQUESTS, ROWS, _by_p, _emit, by_document, flagged_requests, merge_pairs, pack_columns, removed, runs_of, settle_range, settle_windows, unpack_columns, with_rows
from .tokens import write_file

LENGTH = 50
GRAM = 20
#: Batches of the query, by ranges of doc_id; runs of one level that are merged.
BATCHES = 3
FANOUT = 2
#: How fingerprints are dealt over ranges (spans.range_of), which holds for an index as long as it lives.
LAYOUT = 2


def hashed_words():
    cache: dict[str, int] = {}
    return lambda text: words_hashed(word_list(text), cache)


def sorted_columns(tables: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sorted columns of several runs as those of one; the sort is stable, so it merges."""
    columns = [np.concatenate(c) for c in zip(*tables, strict=True)]
    o = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    return [c[o] for c in columns]


class Index:
    """Opens the index in a folder, or begins one there."""

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM):
        self.spark, self.path = spark, path
        self.about = self._last() or {"version": 0, "layout": LAYOUT, "length": length, "gram": gram, "parts": 4 * width(spark), "buckets": width(spark), "runs": []}
        assert (self.about["length"], self.about["gram"]) == (length, gram), "the index was made for other windows"
        assert self.about.get("layout") == LAYOUT, "the index was made with other ranges"

    def _last(self) -> dict | None:
        """The newest manifest."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(f.getPath().getName() for f in store.listStatus(folder)) if store.exists(folder) else []
        names = [n for n in names if n.startswith("manifest-")]
        if not names:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).head()[0])

    def _save(self, runs: list[dict]) -> None:
        self.about = self.about | {"version": self.about["version"] + 1, "runs": runs}
        write_file(self.path, f"manifest-{self.about['version']:010d}.json", json.dumps(self.about).encode())

    def _write(self, rows: DataFrame) -> str:
        """rows (of ROWS) as a table in buckets of p; the name of its folder."""
        name = f"run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.about["buckets"], "p").sortBy("p").saveAsTable(name)
        return name

    def table(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # it was written in another session
            self.spark.sql(f"CREATE TABLE {name} ({ROWS.replace(' int', ' INT').replace(' long', ' BIGINT').replace(' binary', ' BINARY')}) USING parquet LOCATION '{self.path}/{name}' CLUSTERED BY (p) SORTED BY (p) INTO {self.about['buckets']} BUCKETS")
        return self.spark.table(name)

    def _joined(self, runs: list[dict]) -> DataFrame:
        """p, run0, run1, ...: each range of these runs; a join of buckets, without an exchange."""
        out = None
        for i, r in enumerate(runs):
            own = self.table(r["folder"]).where(F.col("kind") == INDEX).select("p", F.col("data").alias(f"run{i}"))
            out = own if out is None else out.join(own.hint("merge"), "p")
        return out

    def add(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """Rows (INTERVALS) of what a batch of texts (doc_id, text) repeats. history: texts in which all earlier documents and the
        batch's are; of them, those are read whose words have to decide."""
        a = self.about
        rows = runs_of(batch, hashed_words, a["length"], a["gram"], a["parts"], False)
        every = self.spark.range(a["parts"]).select(F.col("id").cast("int").alias("p"), F.lit(INTERVALS).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(-1).alias("batch"), F.lit(b"").alias("data"))
        dealt, runs, length = rows.unionByName(every).repartition(a["buckets"], "p"), a["runs"], a["length"]

        def settled(p: int, group: list[tuple]) -> Iterator[pa.RecordBatch]:
            yield from settle_range(p, [r for r in group if r[3] >= 0], length, False, True)

        if runs:

            def merge(left: pa.Table, right: pa.Table) -> pa.Table:
                group = list(zip(*[left.column(c).to_pylist() for c in ("p", "kind", "doc_id", "batch", "data")], strict=True))
                p = (left if left.num_rows else right).column("p")[0].as_py()
                own = [unpack_columns(r[4])[0] for r in group if r[1] not in (INTERVALS, INDEX) and r[4]]
                buckets = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
                for i in range(len(runs)):
                    for blob in right.column(f"run{i}").to_pylist() if right.num_rows else []:
                        columns = unpack_columns(blob) if blob else None
                        if columns is None or not len(buckets):
                            continue
                        k = np.minimum(np.searchsorted(buckets, columns[0]), len(buckets) - 1)
                        at = np.flatnonzero(buckets[k] == columns[0])
                        if len(at):
                            group.append((p, INDEX, None, 0, pack_columns(*[c[at] for c in columns])))
                out = list(settled(p, group))
                return pa.Table.from_batches(out) if out else pa.Table.from_batches([_emit([])])

            out = dealt.groupBy("p").cogroup(self._joined(runs).groupBy("p")).applyInArrow(merge, ROWS)
        else:

            def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for p, group in _by_p(batches):
                    yield from settled(p, group)

            out = dealt.sortWithinPartitions("p").mapInArrow(first, ROWS)
        name = self._write(out)
        self._save([*runs, {"folder": name, "level": 0}])
        found = self.table(name)
        requests = found.where(F.col("kind") == REQUESTS)
        for r in runs:
            more = flagged_requests(self.table(r["folder"]), found)
            requests = requests.unionByName(more.select(F.lit(0).alias("p"), F.lit(REQUESTS).alias("kind"), "doc_id", F.lit(0).alias("batch"), "data"))
        asked = with_rows(history, by_document(requests, REQUESTS), "inner")
        rest = settle_windows(asked, hashed_words, a["length"], a["buckets"], False)
        self.compact()
        return found.where(F.col("kind") == INTERVALS).unionByName(rest.where(F.col("kind") == INTERVALS))

    def compact(self) -> None:
        """Merge runs while FANOUT of them share a level."""
        while True:
            runs = self.about["runs"]
            level = next((x for x in sorted({r["level"] for r in runs}) if sum(r["level"] == x for r in runs) >= FANOUT), None)
            if level is None:
                return
            own = [r for r in runs if r["level"] == level]
            many = len(own)

            def merge(batches: Iterator[pa.RecordBatch], many=many) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for p, *blobs in zip(b.column("p").to_pylist(), *[b.column(f"run{i}").to_pylist() for i in range(many)], strict=True):
                        tables = [unpack_columns(x) for x in blobs if x]
                        yield _emit([(p, INDEX, None, 0, pack_columns(*sorted_columns(tables)) if tables else b"")])

            name = self._write(self._joined(own).mapInArrow(merge, ROWS))
            self._save([*[r for r in runs if r not in own], {"folder": name, "level": level + 1}])


def without(data: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    words = word_list(data.decode("utf-8", "surrogatepass"))
    spans = merge_pairs(spans, len(words))
    kept, at = [], 0
    for s, e in spans.tolist():
        kept += words[at:s]
        at = e
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()


def repeated_words(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id and the intervals (lists of packed pairs) of its repeated words: documents in so many batches, by ranges of doc_id."""
    d = texts(docs)
    spark = d.sparkSession
    index, found = Index(spark, new_folder(spark, "fingerprints"), length, gram), None
    bounds = d.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    key, edges = F.coalesce("doc_id", F.lit(NO_ID)), [None, *sorted({int(x) for x in bounds}), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = d if low is None else d.where(key >= low)
        batch, history = (x if high is None else x.where(key < high) for x in (batch, d))
        own = index.add(batch, history)
        found = own if found is None else found.unionByName(own)
    return by_document(found, INTERVALS)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return removed(texts(docs), repeated_words(docs), "n_words long, n_removed long, kept_sha256 string", without)
