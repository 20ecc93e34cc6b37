"""A stream of document changes kept in step with the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.engine import Providers, ingest_all
from ..plans.pipeline import Judge, Pipeline


def follow(changes: DataFrame, path: str, pipeline: Pipeline, checkpoint: str, providers: Providers | None = None, layers: str | None = None, judge: Judge | None = None, **trigger):
    """Start a query that commits each micro-batch of changes (doc, text, change, ordinal) as one: the last change of a document in
    a batch counts. Every step of the pipeline runs (see `ingest_all`); what suspends a run stops the query. A batch that is run again
    gives the same corpus, since a document is put in the place of what it was."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest_all(batch.sparkSession, path, pipeline, batch, providers, layers, judge)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changes_of(events: DataFrame, keep: str = "1 hour") -> DataFrame:
    """Latest change for each document of an event stream (ts, doc, change), late ones within `keep` counted."""
    return events.withWatermark("ts", keep).groupBy(F.window("ts", keep), "doc").agg(F.max_by("change", "ts").alias("change"), F.max("ts").alias("ts")).select("doc", "change", "ts")
