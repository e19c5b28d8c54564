"""First too-long wait per key, without sorting a key's rows in one task.

Two times in the same bucket of width ``gap`` are less than ``gap`` apart, so only the
first and last time of each bucket matter. The table shrinks to one row per key and
bucket before anything is ordered, and buckets are compared within groups of buckets
first, then between neighbouring groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKETS_PER_GROUP_BITS = 12


def _waits(
    buckets: DataFrame, partition: list[str], by: str, limit_us: int
) -> DataFrame:
    previous = F.lag("_last").over(Window.partitionBy(*partition).orderBy(by))
    return buckets.select("*", previous.alias("_previous")).where(
        F.col("_first") - F.col("_previous") > limit_us
    )


def bucket_times(times: DataFrame, keys: list[str], ts: str, gap_us: int) -> DataFrame:
    """One row per key and bucket: first and last time (microseconds) and row count."""
    width = F.lit(gap_us).cast("bigint")
    bucket = F.call_function("div", F.col("_us") - F.pmod("_us", width), width)
    return (
        times.where(F.col(ts).isNotNull())
        .select(*keys, F.unix_micros(ts).alias("_us"))
        .groupBy(*keys, bucket.alias("_bucket"))
        .agg(
            F.min("_us").alias("_first"),
            F.max("_us").alias("_last"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )


def first_wait(times: DataFrame, keys: list[str], ts: str, gap_us: int) -> DataFrame:
    """Per key with a wait longer than the gap: ``last_before``, the time the wait began."""
    buckets = bucket_times(times, keys, ts, gap_us).withColumn(
        "_group", F.shiftright("_bucket", _BUCKETS_PER_GROUP_BITS)
    )
    groups = buckets.groupBy(*keys, "_group").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    inside = _waits(buckets, [*keys, "_group"], "_bucket", gap_us).select(*keys, "_previous")
    between = _waits(groups, keys, "_group", gap_us).select(*keys, "_previous")
    return (
        inside.unionByName(between)
        .groupBy(*keys)
        .agg(F.timestamp_micros(F.min("_previous")).alias("last_before"))
    )


def sessions(times: DataFrame, keys: list[str], ts: str, gap_us: int) -> DataFrame:
    """Runs of rows no wait in which is longer than the gap: ``first_ts, last_ts, rows``.

    Sessions are merged from the per-bucket rows, each as long as its own rows and the gap.
    """
    reach = F.concat((F.col("_last") - F.col("_first") + gap_us).cast("string"), F.lit(" microseconds"))
    return (
        bucket_times(times, keys, ts, gap_us)
        .withColumn("_ts", F.timestamp_micros("_first"))
        .groupBy(*keys, F.session_window("_ts", reach).alias("_session"))
        .agg(
            F.timestamp_micros(F.min("_first")).alias("first_ts"),
            F.timestamp_micros(F.max("_last")).alias("last_ts"),
            F.sum("_rows").alias("rows"),
        )
        .drop("_session")
    )


def interval_micros(text: str) -> int:
    """Microseconds of a day-time interval such as '15 seconds' or '1 hour'."""
    number, unit = text.split()
    factor = {
        "microsecond": 1,
        "millisecond": 1_000,
        "second": 1_000_000,
        "minute": 60_000_000,
        "hour": 3_600_000_000,
        "day": 86_400_000_000,
    }[unit.rstrip("s")]
    return int(number) * factor
