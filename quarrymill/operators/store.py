"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that this process has staged, in order.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this application under /tmp/checkpoints, on one machine only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or f"/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, fields: str) -> DataFrame:
    """A table of these fields without rows, which the optimizer knows to have none."""
    kinds = T.StructType.fromDDL(fields)
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])


def staged_so_far() -> int:
    return len(_made)


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Remove what was staged since a mark (`staged_so_far`); nothing may be read from it any more."""
    from ..sources.files import remove_tree

    while len(_made) > since:
        remove_tree(spark, _made.pop())
