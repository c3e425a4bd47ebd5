"""Point-in-time operators over bitemporal facts: what was known on a date about which period.

Facts have sid, concept, period_start, period_end, filed_at, value, provider.  A figure filed on a date is known from
that date on; the newest period wins, and of one period the newest filing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.asof import asof
from tidebook.operators.screens import known_on

STALE_DAYS = 455
#: Periods up to these lengths in days are quarters, and interim ones; longer ones are annual.
QUARTER_DAYS, INTERIM_DAYS = 130, 300


def scope_of(start: Column, end: Column) -> Column:
    """instant, quarter, interim or annual, by the length of the period."""
    days = F.datediff(end, start)
    return F.when(start.isNull(), "instant").when(days <= QUARTER_DAYS, "quarter").when(days <= INTERIM_DAYS, "interim").otherwise("annual")


def ratio(n: Column, d: Column, scale: float = 1.0) -> Column:
    """n over d; null unless the denominator is positive."""
    return F.when(d > 0, n / d * scale)


def preferred(facts: DataFrame, primary: str = "sec") -> DataFrame:
    """Facts of the primary provider, and of others where an instrument has no primary fact of the concept."""
    own = facts.where(F.col("provider") == primary)
    rest = facts.where(F.col("provider") != primary).join(own.select("sid", "concept").distinct(), ["sid", "concept"], "left_anti")
    return own.unionByName(rest)


def versions(facts: DataFrame) -> DataFrame:
    """One row per instrument, concept, period and filing date: the largest by start and value."""
    best = F.max(F.struct("period_start", "value"))
    return facts.groupBy("sid", "concept", "period_end", "filed_at").agg(best.alias("b")).select("sid", "concept", "period_end", "filed_at", "b.period_start", "b.value")


def steps(facts: DataFrame) -> DataFrame:
    """The step function of what is known: from ``filed_at`` on, this period and value (repeats dropped)."""
    w = Window.partitionBy("sid", "concept").orderBy("filed_at", "period_end")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = versions(facts).withColumn("k", F.max(F.struct("period_end", "filed_at", "period_start", "value")).over(run))
    per_day = known.groupBy("sid", "concept", "filed_at").agg(F.max("k").alias("k"))
    before = F.lag("k").over(Window.partitionBy("sid", "concept").orderBy("filed_at"))
    return per_day.withColumn("before", before).where(~F.col("k").eqNullSafe(F.col("before"))).select(
        "sid", "concept", "filed_at", F.col("k.period_end").alias("period_end"), F.col("k.value").alias("value")
    )


def value_on(asked: DataFrame, facts: DataFrame, on: str, concept: str, stale_days: int = STALE_DAYS) -> DataFrame:
    """``asked`` (with sid and a date column) with value and period_end of the concept as known on the date."""
    of = steps(facts.where(F.col("concept") == concept)).drop("concept")
    return asof(asked, of, ["sid"], on, "filed_at", ["value", "period_end"], tolerance_days=stale_days)


def history(facts: DataFrame, on: str, n: int) -> DataFrame:
    """The last n periods known on a date, each with the value filed last by then."""
    known = versions(facts).where(F.col("filed_at") <= F.lit(on).cast("date"))
    best = known.groupBy("sid", "concept", "period_end").agg(F.max_by(F.struct("value", "filed_at"), "filed_at").alias("b"))
    order = F.row_number().over(Window.partitionBy("sid", "concept").orderBy(F.desc("period_end")))
    return best.withColumn("back", order).where(F.col("back") <= n).select("sid", "concept", "period_end", "b.value", "b.filed_at", "back")


def screen(facts: DataFrame, members: DataFrame, on: str, low: float, high: float, stale_days: int = STALE_DAYS) -> DataFrame:
    """Members with revenue per unit as known on a date: value, status against [low, high], and rank.

    Unknown is not failed: a member without the figures has status unknown and ranks last.
    """
    measured = members.join(known_on(facts, on, ("revenue", "quantity"), stale_days), "sid", "left")
    measured = measured.withColumn("metric", F.round(ratio(F.col("revenue"), F.col("quantity")), 6))
    status = F.when(F.col("metric").isNull(), "unknown").when(F.col("metric").between(low, high), "passed").otherwise("failed")
    order = Window.partitionBy("universe").orderBy(F.desc_nulls_last("metric"), "sid")
    return measured.withColumn("status", status).withColumn("place", F.row_number().over(order)).select("universe", "sid", "metric", "status", "place")
