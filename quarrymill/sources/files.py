"""Small files in any store that Spark reaches, written whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_small(spark: SparkSession, path: str) -> str | None:
    """The file's text; None if there is no such file."""
    fs, p = _place(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def replace_small(spark: SparkSession, path: str, text: str) -> None:
    """Put text in the place of a file: written beside it, then renamed over it."""
    fs, p = _place(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex[:12]}")
    out = fs.create(new, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(new, p, options)


def create_small(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet: written beside it, then renamed. False if another was there first."""
    fs, p = _place(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex[:12]}")
    out = fs.create(new, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(new, p, options)
    except Exception as e:
        fs.delete(new, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def remove_tree(spark: SparkSession, path: str) -> None:
    fs, p = _place(spark, path)
    fs.delete(p, True)


def list_folders(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def list_small(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    fs, p = _place(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix) and not s.getPath().getName().startswith("."))
