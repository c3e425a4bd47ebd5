"""Screens over many metrics, published figures with a staleness of their own, coverage, and fundamental conditions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Concepts that are stocks: they have no period, and are asked for as of an instant.
INSTANT_CONCEPTS = ("quantity", "equity", "debt")


@dataclass(frozen=True)
class Constraint:
    """A metric and its bounds; a missing bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None

    def status(self) -> Column:
        """unknown without a value, else passed or failed."""
        value, within = F.col(self.metric), F.lit(True)
        if self.low is not None:
            within = within & (value >= self.low)
        if self.high is not None:
            within = within & (value <= self.high)
        return F.when(value.isNull(), "unknown").when(within, "passed").otherwise("failed")


def parse_constraints(text: str | None, known: Iterable[str]) -> list[Constraint]:
    """Constraints of ``metric:low:high,...``; an empty bound is open, and anything else that is odd is an error."""
    found, names = [], set(known)
    for clause in filter(None, (c.strip() for c in (text or "").split(","))):
        metric, *bounds = (p.strip() for p in clause.split(":"))
        if len(bounds) != 2:
            raise ValueError(f"not of the form metric:low:high: {clause}")
        if metric not in names:
            raise ValueError(f"no such metric: {metric}")
        low, high = (float(b) if b else None for b in bounds)
        if low is not None and high is not None and low > high:
            raise ValueError(f"nothing lies within {clause}")
        found.append(Constraint(metric, low, high))
    return found


def known_on(facts: DataFrame, on: str, concepts: Iterable[str], stale_days: int | None = None, by: tuple[str, ...] = ("sid",)) -> DataFrame:
    """One row per ``by`` with a column per concept: the figure of the newest period known on the date, unless stale.

    One aggregate that is combined before its shuffle: of what was filed by the date, the newest period wins, then the
    newest filing.  A newest figure that is stale is unknown, even if an older period was restated since.
    """
    date = F.lit(on).cast("date")
    best = F.struct("period_end", "filed_at", "period_start", "value")
    columns = []
    for concept in concepts:
        top = F.max(F.when(F.col("concept") == concept, best))
        fresh = F.datediff(date, top["filed_at"]) <= stale_days if stale_days is not None else F.lit(True)
        columns.append(F.when(fresh, top["value"]).alias(concept))
    return facts.where(F.col("filed_at") <= date).groupBy(*by).agg(*columns)


def screen_many(members: DataFrame, measured: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Members with their metrics, the number of constraints of each status, and whether all passed."""
    metrics = list(dict.fromkeys(c.metric for c in constraints))
    joined = members.join(measured.select("sid", *metrics), "sid", "left")
    states = [c.status() for c in constraints]
    counted = [sum((F.when(s == k, 1).otherwise(0) for s in states), F.lit(0)).alias(k) for k in ("passed", "failed", "unknown")]
    return joined.select("*", *counted).withColumn("accepted", F.col("passed") == len(constraints))


@dataclass(frozen=True)
class Published:
    """A figure that a vendor publishes: where it is, how old it may be, and whether only positive ones mean anything."""

    concept: str
    max_stale_days: int
    positive_only: bool = False


def published_on(facts: DataFrame, on: str, metrics: dict[str, Published], provider: str = "vendor") -> DataFrame:
    """sid and a column per metric: the provider's newest filing by the date that is not older than the metric allows.

    The oldest date that any metric allows bounds the scan; each metric keeps its own.
    """
    date = F.lit(on).cast("date")
    oldest = max(m.max_stale_days for m in metrics.values())
    near = facts.where((F.col("provider") == provider) & F.col("filed_at").between(F.date_sub(date, oldest), date) & F.col("concept").isin(sorted({m.concept for m in metrics.values()})))

    def value(m: Published) -> Column:
        own = (F.col("concept") == m.concept) & (F.datediff(date, F.col("filed_at")) <= m.max_stale_days)
        top = F.max(F.when(own, F.struct("filed_at", "period_end", "value")))["value"]
        return F.when(top > 0, top) if m.positive_only else top

    return near.groupBy("sid").agg(*[value(m).alias(name) for name, m in metrics.items()])


def coverage(measured: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """Per metric the number of rows that have it, and of all rows."""
    names = list(metrics)
    counts = measured.agg(F.count("*").alias("of"), *[F.count(m).alias(m) for m in names])
    listed = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("known")) for m in names]))
    return counts.select("of", listed.alias("x")).select("x.metric", "x.known", "of")


def default_scope(concept: Column) -> Column:
    """The scope in which a concept is asked for by default: a stock as of an instant, a flow by the year."""
    return F.when(concept.isin(*INSTANT_CONCEPTS), "instant").otherwise("annual")


def leverage(debt: Column, equity: Column) -> Column:
    """Debt to equity; 0 without debt, and null unless equity is positive: negative equity is no low leverage."""
    return F.when(equity > 0, F.when(debt == 0, 0.0).otherwise(debt / equity))


def crossings(series: DataFrame, threshold: float, above: bool, bullish: bool, by: str = "sid", at: str = "filed_at") -> DataFrame:
    """Dates on which a step series crosses a threshold upwards (or downwards): by, at, direction, trigger."""
    before = F.lag("value").over(Window.partitionBy(by).orderBy(at))
    up, down = (F.col("before") <= threshold) & (F.col("value") > threshold), (F.col("before") >= threshold) & (F.col("value") < threshold)
    crossed = series.withColumn("before", before).where(up if above else down)
    return crossed.select(by, at, F.lit(1 if bullish else -1).alias("direction"), F.col("value").alias("trigger"))


def finite(df: DataFrame) -> DataFrame:
    """The same rows with undefined and infinite numbers as null."""
    return df.select(*[F.when(~(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
