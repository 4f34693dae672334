"""Traffic reference profiles from sensor readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPEED_MIN = 5.0


def valid_readings(readings: DataFrame, first_hour: int = 7, last_hour: int = 20) -> DataFrame:
    """Readings without error, both measures non-negative, inside the day's hours, with weekday and 15-minute slot."""
    ok = (F.col("read_error") == "N") & (F.col("intensity") >= 0) & (F.col("occupancy") >= 0) & F.hour("ts").between(first_hour, last_hour)
    slot = (F.hour("ts") * 60 + F.floor(F.minute("ts") / 15) * 15).cast("int")
    return readings.where(ok).select("*", F.weekday("ts").alias("weekday"), slot.alias("slot"))


def frequencies(valid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A frequency table with running and whole counts: partial sums first, then a window over distinct values only."""
    counts = valid.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("__n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("__upto", upto).withColumn("__total", F.sum("__n").over(group))


def nearest_ranks(valid: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles: the least value that reaches a share of the count."""
    table = frequencies(valid, keys, value)
    return table.groupBy(*keys).agg(*(F.min(F.when(F.col("__upto") >= F.ceil(F.col("__total") * s), F.col(value))).alias(name) for name, s in shares.items()))


def interpolated(table: DataFrame, value: str, share: float) -> Column:
    """The quantile between the two values around its rank, from a frequency table."""
    rank = share * (F.col("__total") - 1)
    below, above = F.floor(rank), F.ceil(rank)
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col(value)))
    return at(below) + (at(above) - at(below)) * F.max(rank - below)


def median(valid: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the median of a column; the distinct values of one measure are few."""
    return frequencies(valid, [], value).agg(F.round(interpolated(valid, value, 0.5), 6).alias(name))


def profile(valid: DataFrame) -> DataFrame:
    """Counts, means and quartiles by weekday and slot; the quartiles from a frequency table, so no task holds a group's readings."""
    keys = ["weekday", "slot"]
    speed = F.when(F.col("speed") >= SPEED_MIN, F.col("speed"))
    parts = valid.groupBy(*keys, "intensity").agg(F.count("*").alias("__n"), F.sum(speed).alias("__speed"), F.count(speed).alias("__fast"))
    group = Window.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy("intensity").rowsBetween(Window.unboundedPreceding, 0))
    table = parts.withColumn("__upto", upto).withColumn("__total", F.sum("__n").over(group))
    quartiles = [F.round(interpolated(table, "intensity", p / 100), 6).alias(f"p{p}") for p in (25, 50, 75)]
    mean = F.round(F.sum(F.col("intensity") * F.col("__n")) / F.sum("__n"), 6).alias("mean_intensity")
    fast = F.sum("__fast")
    return table.groupBy(*keys).agg(F.sum("__n").alias("n"), mean, *quartiles, fast.alias("n_speed"), F.round(F.sum("__speed") / F.nullif(fast, F.lit(0)), 6).alias("mean_speed"))


def frequency_quantiles(valid: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Discrete quantiles from a frequency table and its running sum: the least value that reaches the share."""
    counts = valid.groupBy("weekday", "intensity").agg(F.count("*").alias("n"))
    running = Window.partitionBy("weekday").orderBy("intensity").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(Window.partitionBy("weekday")))
    return upto.groupBy("weekday").agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") >= F.col("total") * s, F.col("intensity"))).alias(f"q{round(100 * s)}") for s in shares))


def two_step_means(valid: DataFrame) -> DataFrame:
    """Daily partial sums, then the final mean: what month-wise passes keep between them."""
    partial = valid.groupBy("sensor_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("intensity").alias("s"))
    return partial.groupBy("sensor_id").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_intensity"))
