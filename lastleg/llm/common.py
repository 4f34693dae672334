"""Helpers shared by the training-data operators.

Python stages are ``mapInArrow`` functions over record batches: they hold one
batch and a bounded word cache, never a whole partition. Intermediate tables
are written to the folder named by ``spark.checkpoint.dir``, which the driver
and all executors share, so a lost executor costs only a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a per-worker word cache may hold before it is emptied.
CACHE_ENTRIES = 300_000

#: Rows of one key that a task takes whatever their share of all rows.
LEAST_HOT = 1000

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of this machine's if all tasks run on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lastleg-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lastleg/{name}-{uuid.uuid4().hex}"


class Written:
    """Intermediate tables in the shared folder, dropped together once their readers are done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        for path in self.paths[: len(self.paths) - keep]:
            remove(self.spark, path)
        self.paths = self.paths[len(self.paths) - keep :]


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what runs in here as soon as it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def map_batches(df: DataFrame, fn: Callable[[dict], Iterable[pa.RecordBatch | dict]], schema: str, rows: int = 1000) -> DataFrame:
    """``fn`` gets slices of at most ``rows`` rows as record batches and yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for got in fn(batch.slice(at, rows)):
                    yield to_batch(got, target)

    return df.mapInArrow(run, out)


def to_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in target:
        x = columns[field.name]
        arrays.append(x.cast(field.type) if isinstance(x, pa.Array) else pa.array(x, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of every text; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(column))
    return [b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def unique_sorted(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of whole texts: as many as the input has splits, and not under the session's number."""
    return max(partitions(df.sparkSession), df.rdd.getNumPartitions())


def hot_bound(spark: SparkSession, rows: int) -> int:
    """Rows of one key above which it is hot. At most 4 x partitions keys of ``rows`` rows can be."""
    return max(LEAST_HOT, rows // (4 * partitions(spark)))


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner", count: str = "n_rows") -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key) without a task that holds a hot key.

    ``table`` has in ``count`` how many of the ``total`` rows of ``rows`` have
    its key. Keys above ``hot_bound`` are so few (4 x partitions) that they are
    broadcast; their rows are dealt over as many salts as they exceed the bound,
    and their row of ``table`` is repeated for each salt. All rows then meet by
    one shuffle join. The count is dropped; ``how`` is inner or left.
    """
    bound = hot_bound(rows.sparkSession, total)
    if total <= bound:
        return rows.join(table.drop(count), keys, how)
    hot = table.where(F.col(count) > bound).select(*keys, F.ceil(F.col(count) / bound).cast("bigint").alias("__salts"))
    if not hot.limit(1).count():
        return rows.join(table.drop(count), keys, how)
    others = [c for c in rows.columns if c not in keys]
    own = F.coalesce(F.pmod(F.xxhash64(*others), F.col("__salts")), F.lit(0))
    salted = rows.join(F.broadcast(hot), keys, "left").select(*rows.columns, own.alias("__salt"))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col(count) / bound).cast("bigint"), F.lit(1).cast("bigint")) - 1))
    spread = table.select(*[c for c in table.columns if c != count], salts.alias("__salt"))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")
