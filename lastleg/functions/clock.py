"""Clock times and weekdays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def parse_clock(x: Column) -> Column:
    return F.split(x, ":")[0].cast("int") * 60 + F.split(x, ":")[1].cast("int")


def in_interval(t: Column, start: Column, end: Column) -> Column:
    """Half-open; a start after the end wraps midnight, equal ends mean the whole day."""
    return F.when(start == end, F.lit(True)).when(start < end, (t >= start) & (t < end)).otherwise((t >= start) | (t < end))


def minutes(text: str) -> int:
    """Minutes of a clock time HH:MM."""
    hours, _, rest = text.partition(":")
    return 60 * int(hours) + int(rest)


def timeline(arcs: Column, start: float, service: float, intervals: list[tuple[int, int, float]]) -> Column:
    """struct(clock, base, adjusted) at the end of a route: each arc's minutes times the multiplier of the time at which it starts, then service."""

    def step(t: Column, m: Column) -> Column:
        factor = F.lit(1.0)
        for a, b, x in intervals:
            factor = F.when((t["clock"] >= a) & (t["clock"] < b), x).otherwise(factor)
        return F.struct((t["clock"] + m * factor + service).alias("clock"), (t["base"] + m).alias("base"), (t["adjusted"] + m * factor).alias("adjusted"))

    return F.aggregate(arcs, F.struct(F.lit(start).alias("clock"), F.lit(0.0).alias("base"), F.lit(0.0).alias("adjusted")), step)


DAYS = ("all", "weekday", "weekend", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def checked_intervals(raw: DataFrame, profile: str) -> DataFrame:
    """Timed multipliers of a profile (id, zone, days, start_min, end_min, multiplier); a bad clock time, day or multiplier fails the query."""
    from lastleg.functions.text import zone_key

    def checked(x: Column, fine: Column, what: str) -> Column:
        return F.when(F.coalesce(fine, F.lit(False)), x).otherwise(F.raise_error(F.concat(F.lit(f"no {what}: "), F.coalesce(x.cast("string"), F.lit("null")))))

    def time(c: str) -> Column:
        return parse_clock(checked(F.col(c), F.col(c).rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "clock time"))

    days, factor = F.lower(F.trim("day_of_week")), F.col("multiplier").try_cast("double")
    return raw.where(F.lower(F.trim("profile")) == profile).select(
        F.col("id").cast("bigint").alias("id"), zone_key(F.col("zone")).alias("zone"), checked(days, days.isin(*DAYS), "day").alias("days"), time("start_time").alias("start_min"), time("end_time").alias("end_min"), checked(factor, factor > 0, "multiplier").alias("multiplier")
    )
