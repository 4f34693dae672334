"""Bounded samples of labelled documents, and the task that fits a classifier on them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import texts_of


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, train: Column) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` documents of each class, taken in the order of a hash of the id.

    Labels choose the ids first; the ids, of which there are 2 * per_class at
    most, are then the small side of a broadcast join, so texts aren't shuffled.
    An id that several rows have gives one of them, that of the least text hash.
    Labels that contradict each other for one id, and null labels, aren't used.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    present = docs.select(F.col("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    known = known.join(present, "doc_id", "left_semi")
    ids = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select(F.col("doc_id").alias("__id"), "y")
        ids = some if ids is None else ids.unionByName(some)
    ids = docs.sparkSession.createDataFrame(ids.collect(), "__id bigint, y int")  # 2 * per_class rows at most
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("k"), F.col("text"), F.col("y"))).alias("r"))
    return one.select("doc_id", "r.text", "r.y")


def fit_in_task(sample: DataFrame, fit: Callable[[list[tuple[int, bytes, int]]], Any]) -> Any:
    """``fit`` of the rows (id, text or bytes, label) of a bounded sample, in the order of their ids; None without rows.

    One task gathers the rows and trains, in an executor's memory; the driver gets the model alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(b.column(0).to_pylist(), texts_of(b, b.schema.names[1]), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(sorted(rows)))], type=pa.binary())})

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else None
