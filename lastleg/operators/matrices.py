"""Travel matrices as tables of cells, and the checks that their inputs pass.

A provider turns pairs of points into ways and times; great-circle ways with a
detour are at hand, a table of cells from a road network is another. A
problem's square is assembled from blocks of points, so that no task holds a
whole one, and can be kept in a cache addressed by its content.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastleg.functions.geo import haversine_m


@dataclass(frozen=True)
class GreatCircle:
    """Great-circle ways times a detour, at one speed."""

    speed_kmh: float
    detour: float = 1.3

    def cells(self, pairs: DataFrame) -> DataFrame:
        km = haversine_m(F.col("lat_o"), F.col("lon_o"), F.col("lat_d"), F.col("lon_d")) / 1000 * self.detour
        return pairs.select("problem_id", "o", "d", km.alias("km"), (km / self.speed_kmh * 60).alias("minutes"))


@dataclass(frozen=True)
class Table:
    """Cells (problem_id, o, d, km, minutes) of a road network; pairs that it lacks have null ways."""

    frame: DataFrame

    def cells(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("problem_id", "o", "d").join(self.frame, ["problem_id", "o", "d"], "left")


def _end(points: DataFrame, side: str) -> DataFrame:
    return points.select("problem_id", F.col("k").alias(side), F.col("lat").alias(f"lat_{side}"), F.col("lon").alias(f"lon_{side}"))


def square(points: DataFrame, provider, block: int = 200) -> DataFrame:
    """Cells between all points (problem_id, k, lat, lon) of each problem.

    A point goes into a row of blocks as an origin and into a column of blocks
    as a destination; pairs meet in their block, whatever a problem's size.
    """
    of = F.floor(F.col("k") / block)
    sizes = points.groupBy("problem_id").agg((F.floor(F.max("k") / block)).alias("__last"))
    across = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last").cast("bigint")))
    spread = points.join(sizes, "problem_id").withColumn("__own", of).withColumn("__other", across)
    left = spread.select("problem_id", F.col("k").alias("o"), F.col("lat").alias("lat_o"), F.col("lon").alias("lon_o"), F.col("__own").alias("__row"), F.col("__other").alias("__column"))
    right = spread.select("problem_id", F.col("k").alias("d"), F.col("lat").alias("lat_d"), F.col("lon").alias("lon_d"), F.col("__other").alias("__row"), F.col("__own").alias("__column"))
    return provider.cells(left.join(right, ["problem_id", "__row", "__column"]))


def rectangular(sources: DataFrame, targets: DataFrame, provider) -> DataFrame:
    """Cells from every source to every target of its problem."""
    return provider.cells(_end(sources, "o").join(_end(targets, "d"), "problem_id"))


class Cache:
    """Matrices in the shared folder, under the hash of their points and provider; one that was not written whole is made again."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        from lastleg.operators.lineage import shared_folder

        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/lastleg-matrices"

    def key(self, points: DataFrame, provider) -> str:
        """A hash of all points, whatever their order, and of the provider."""
        row = F.xxhash64("problem_id", "k", F.round("lat", 6), F.round("lon", 6)).cast("decimal(38,0)")
        n, total = points.agg(F.count("*"), F.sum(row)).first()
        import hashlib

        return hashlib.sha256(f"{n}|{total}|{provider!r}".encode()).hexdigest()

    def square(self, points: DataFrame, provider, block: int = 200) -> DataFrame:
        path = f"{self.folder}/{self.key(points, provider)}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):  # the mark of a whole write
            square(points, provider, block).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def applies(model: Column, named: Sequence[str]) -> Column:
    """Whether a setting holds for a model: it is named, or none is."""
    return model.isin(*named) if named else F.lit(True)


def checked_demand(raw: DataFrame, names: dict[str, str], scenario: str) -> DataFrame:
    """Columns renamed, demand as a number: rows without one go; one that is not positive, or another scenario, fails the query."""
    frame = raw.withColumnsRenamed(names).withColumn("demand", F.col("demand").try_cast("double"))
    fine = F.when(F.col("demand") <= 0, F.raise_error(F.lit("demand must be positive"))).when(F.col("scenario") != scenario, F.raise_error(F.lit(f"the scenario is not {scenario}"))).otherwise(F.col("demand"))
    return frame.where(F.col("demand").isNotNull()).withColumn("demand", fine).select(*names.values())


def candidates(records: DataFrame, codes: Sequence[int]) -> DataFrame:
    """Records of the allowed services with valid coordinates."""
    valid = ~F.isnan("lat") & ~F.isnan("lon") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return records.where(F.col("code").isin(*codes) & F.coalesce(valid, F.lit(False)))


def is_true(x: Column) -> Column:
    """A flag given as text."""
    return F.lower(F.trim(x)).isin("1", "true", "yes", "y", "si", "sí")


def projected(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns in order and of the given types; those that are absent come as null, others go."""
    return frame.select(*((F.col(f"`{c}`") if c in frame.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
