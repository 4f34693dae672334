"""Cutting long lineage without losing it to a dead executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which a cluster's machines share; where that is unset, a folder of this machine if all tasks run on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lastleg-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def units(spark: SparkSession) -> int:
    """Partitions for work that is heavy for its bytes; an explicit number is not merged into fewer when the bytes are few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read again: computed once, and a lost executor costs a re-read."""
    path = f"{shared_folder(frame.sparkSession)}/lastleg-cut-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
