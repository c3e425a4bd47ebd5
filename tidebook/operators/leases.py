"""Leases that renewals extend: when each was valid, which are open at a time, and when a line opens and closes.

A renewal sets a lease's expiry, so a lease is valid from a renewal to its expiry or the next renewal.  Stretches
are found inside slices of time first, one row each, and joined at the slices' borders, so a key with most of
the renewals is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.asof import latest

#: Seconds that a renewal holds a lease.
HOLD = 120
#: Days of renewals that one window goes through.
SLICE_DAYS = 7


def _joined(parts: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Stretches (start, end) of which one begins before, or when, the one before ends become one."""
    w = Window.partitionBy(*keys, *within).orderBy("start", "end")
    begins = F.when(F.lag("end").over(w) >= F.col("start"), 0).otherwise(1)
    numbered = parts.withColumn("begins_", begins).withColumn("stretch_", F.sum("begins_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.max_by("end", F.struct("start", "end"))
    return numbered.groupBy(*keys, *within, "stretch_").agg(F.min("start").alias("start"), last.alias("end"), F.sum("renewals").alias("renewals")).drop("stretch_", *within)


def valid_intervals(renewals: DataFrame, keys: list[str], at: str = "at", expires: str = "expires_at") -> DataFrame:
    """(keys, start, end, renewals): the stretches over which each lease was valid, the end left out.

    A renewal may shorten a lease.  Of renewals at one time the longest counts.  Rows without a time or expiry do nothing.
    """
    held = renewals.where(F.col(at).isNotNull() & F.col(expires).isNotNull())
    first = held.groupBy(*keys, F.col(at).alias("start")).agg(F.max(expires).alias("end"), F.count("*").alias("renewals"))
    slice_ = F.floor(F.unix_date(F.to_date("start")) / SLICE_DAYS)
    parts = _joined(first.withColumn("slice_", slice_), keys, ["slice_"])
    return _joined(parts, keys, []).where(F.col("end") > F.col("start"))


def line_changes(intervals: DataFrame, line: str) -> DataFrame:
    """(line, at, status): a line is active while any lease of it is valid; rows where that changes.

    Openings and endings at one time are one change, so a line that one lease hands to another stays open.
    """
    ends = intervals.select(line, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("by")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("by")))).alias("x"))
    steps = ends.groupBy(line, "x.at").agg(F.sum("x.by").alias("by")).where("by <> 0")
    w = Window.partitionBy(line).orderBy("at")
    now = F.sum("by").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = steps.withColumn("now", now).withColumn("before", F.col("now") - F.col("by"))
    status = F.when((F.col("before") == 0) & (F.col("now") > 0), "active").when((F.col("before") > 0) & (F.col("now") == 0), "expired")
    return held.withColumn("status", status).where("status IS NOT NULL").select(line, "at", "status")


def open_leases(renewals: DataFrame, keys: list[str], now: str, at: str = "at", expires: str = "expires_at") -> DataFrame:
    """(keys, at, expires): the leases that are valid at a time, with their last renewal up to it."""
    moment = F.lit(now).cast("timestamp_ntz")
    last = latest(renewals.where(F.col(at) <= moment), keys, [at, expires], [at, expires])
    return last.where(F.col(expires) > moment)
