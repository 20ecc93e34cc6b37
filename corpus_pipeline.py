"""The pipeline from documents to training sequences: each stage works on what its predecessor kept.

For all stages: an empty table gives an empty one; columns that the stage doesn't name, whatever they are called, stay as they are; texts
of any length are taken whole. Each docstring says what becomes of nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.common import read_documents, staged
from quarrymill.llm.decontaminate import drop_contaminated
from quarrymill.llm.encoding import tokenizer_path
from quarrymill.llm.lines import drop_repeated_lines
from quarrymill.llm.neardup import keep_one
from quarrymill.llm.packing import pack_documents
from quarrymill.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail. Null and empty texts have too few words and go; rows that repeat are judged
    alike, each by itself, and so are null doc_ids."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of windows that stand earlier; no document goes. Of equal windows the one of the smallest doc_id, then
    the first line, stays. Null texts stay null; null doc_ids come first and count as one document; rows that share a doc_id are versions
    of one document, which lose the same lines."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id. Null and empty texts are like no other and stay, as
    do null doc_ids. Of rows that share a doc_id the one whose text comes first stays; a doc_id is linked if any of its texts is."""
    return keep_one(docs, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; null and empty items stand nowhere; a doc_id on
    several rows goes if one of them holds an item, and null doc_ids are judged together."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, and where each stands in its sequence. Null and empty texts are the end id alone; rows that
    repeat and null doc_ids are packed each for itself; which of equal pieces stands where is not fixed."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Shingle sets, alignment and a tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
