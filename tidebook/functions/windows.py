"""Window-expression indicators over one ordered series per symbol.

Each returns a Column of the same length as the series, null while its window is not full.  They compose: the argument
may be any Column over the bars.  All of them share the window ``partition by symbol order by time``, so Spark sorts
once for any number of indicators.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SESSIONS_PER_YEAR = 252


def series(by: str = "symbol", time: str = "d") -> WindowSpec:
    """The window that all indicators of a series share."""
    return Window.partitionBy(by).orderBy(time)


def _full(x: Column, n: int, w: WindowSpec, value: Column) -> Column:
    return F.when(F.count(x).over(w.rowsBetween(1 - n, 0)) == n, value)


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the last n values."""
    return _full(x, n, w, F.avg(x).over(w.rowsBetween(1 - n, 0)))


def rolling_max(x: Column, n: int, w: WindowSpec) -> Column:
    """Largest of the last n values."""
    return _full(x, n, w, F.max(x).over(w.rowsBetween(1 - n, 0)))


def rolling_min(x: Column, n: int, w: WindowSpec) -> Column:
    """Smallest of the last n values."""
    return _full(x, n, w, F.min(x).over(w.rowsBetween(1 - n, 0)))


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    """Population deviation of the last n values."""
    return _full(x, n, w, F.stddev_pop(x).over(w.rowsBetween(1 - n, 0)))


def bollinger(x: Column, n: int, k: float, w: WindowSpec) -> tuple[Column, Column, Column]:
    """Lower, middle and upper band."""
    mid, dev = sma(x, n, w), rolling_std(x, n, w)
    return mid - k * dev, mid, mid + k * dev


def zscore(x: Column, n: int, w: WindowSpec) -> Column:
    """Distance from the mean in deviations; null without deviation."""
    dev = rolling_std(x, n, w)
    return F.when(dev > 0, (x - sma(x, n, w)) / dev)


def true_range(h: Column, low: Column, c: Column, w: WindowSpec) -> Column:
    """The day's range, widened to the close before."""
    before = F.lag(c).over(w)
    return F.coalesce(F.greatest(h - low, F.abs(h - before), F.abs(low - before)), h - low)


def stochastic(h: Column, low: Column, c: Column, n: int, w: WindowSpec) -> Column:
    """Place of the close in the range of the last n bars, in percent; null for no range."""
    top, bottom = rolling_max(h, n, w), rolling_min(low, n, w)
    return F.when(top > bottom, 100 * (c - bottom) / (top - bottom))


def roc(x: Column, n: int, w: WindowSpec) -> Column:
    """Change against n bars before, in percent; null for base 0."""
    base = F.lag(x, n).over(w)
    return F.when(base != 0, 100 * (x - base) / base)


def pct_change(x: Column, n: int, w: WindowSpec) -> Column:
    """Relative change against n bars before."""
    base = F.lag(x, n).over(w)
    return F.when(base != 0, x / base - 1)


def obv(c: Column, v: Column, w: WindowSpec) -> Column:
    """Running volume, signed by the direction of the close."""
    sign = F.coalesce(F.signum(c - F.lag(c).over(w)), F.lit(0.0))
    return F.sum(sign * v).over(w.rowsBetween(Window.unboundedPreceding, 0))


def donchian(h: Column, low: Column, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """Highest high and lowest low of the n bars before this one."""
    prior = w.rowsBetween(-n, -1)
    full = F.count(h).over(prior) == n
    return F.when(full, F.max(h).over(prior)), F.when(full, F.min(low).over(prior))


def realised_volatility(c: Column, n: int, w: WindowSpec, periods: int = SESSIONS_PER_YEAR) -> Column:
    """Population deviation of the last n simple returns, per year."""
    return rolling_std(pct_change(c, 1, w), n, w) * math.sqrt(periods)


def anchored_vwap(h: Column, low: Column, c: Column, v: Column, w: WindowSpec) -> Column:
    """Running mean of the typical price, weighted by volume; null until there is volume."""
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    volume = F.sum(v).over(run)
    return F.when(volume > 0, F.sum((h + low + c) / 3 * v).over(run) / volume)


def mean_to_date(x: Column, w: WindowSpec) -> Column:
    """Running mean."""
    return F.avg(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def crosses(x: Column, w: WindowSpec) -> Column:
    """1 where x turns positive, -1 where it turns negative, else null."""
    before = F.lag(x).over(w)
    return F.when((before <= 0) & (x > 0), 1).when((before >= 0) & (x < 0), -1)
