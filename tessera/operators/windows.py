"""Windowed states over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(value: Column, keys: list[str], order: list) -> Column:
    """The last value that was not null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def recent_count(flag: Column, keys: list[str], order: list, k: int) -> Column:
    """How many of the last k rows, this one included, have the flag."""
    return F.sum(flag.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k - 1), 0))


def activity(rows: DataFrame, key: str, ts: str, value: str, high: float, low: float, k: int, least: int, gap_seconds: int) -> DataFrame:
    """rows with voice (two thresholds with hold), active (least of the last k) and segment (a new one after a silent gap)."""
    order = [ts, "event_id"]
    v = F.when(F.col(value) >= high, 1).when(F.col(value) <= low, 0)
    r = rows.withColumn("voice", F.coalesce(carried(v, [key], order), F.lit(0)))
    r = r.withColumn("active", recent_count(F.col("voice") == 1, [key], order, k) >= least)
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    last_active = F.last(F.when(F.col("active"), seconds), ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("active") & (last_active.isNull() | (seconds - last_active > gap_seconds))
    r = r.withColumn("_o", opens.cast("int"))
    return r.withColumn("segment", F.when(F.col("active"), F.sum("_o").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))).drop("_o")


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
