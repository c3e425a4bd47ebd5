"""Trades, equity and performance figures as window and aggregate plans.

The long-only book holds one sleeve of capital per symbol: a bullish signal opens, the next bearish one closes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPITAL = 100_000.0
LEAST_PAIRS = 60


def pair_trades(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Round trips: symbol, entry_d, entry_price, exit_d, exit_price, return_pct, is_open.

    ``signals`` has symbol, d, direction (1 or -1, one a day).  Signals on days without a bar do nothing.  Of runs of
    equal signals only the first counts; a first bearish one has nothing to close.
    """
    w = Window.partitionBy("symbol").orderBy("d")
    priced = signals.select("symbol", "d", "direction").join(bars.select("symbol", "d", "c"), ["symbol", "d"])
    turns = priced.withColumn("before", F.lag("direction").over(w)).where(~F.col("direction").eqNullSafe(F.col("before")))
    paired = turns.withColumn("exit_d", F.lead("d").over(w)).withColumn("exit_c", F.lead("c").over(w)).where("direction = 1")
    last = bars.groupBy("symbol").agg(F.max_by("c", "d").alias("last_c"))
    exit_price = F.coalesce("exit_c", "last_c")
    return paired.join(last, "symbol").select(
        "symbol",
        F.col("d").alias("entry_d"),
        F.col("c").alias("entry_price"),
        "exit_d",
        exit_price.alias("exit_price"),
        (exit_price / F.col("c") - 1).alias("return_pct"),
        F.col("exit_d").isNull().alias("is_open"),
    )


def sleeves(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Value of one unit in each symbol's sleeve on each of its bars: symbol, d, value."""
    w = Window.partitionBy("symbol").orderBy("d")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = trades.select("symbol", F.col("entry_d").alias("d"), F.col("entry_price").alias("in_price"))
    closed = trades.where("NOT is_open").select("symbol", F.col("exit_d").alias("d"), (F.col("exit_price") / F.col("entry_price")).alias("gain"))
    marked = bars.select("symbol", "d", "c").join(opened, ["symbol", "d"], "left").join(closed, ["symbol", "d"], "left")
    # on the day of exit the position is still held; its gain is realised from the next bar on
    state = (
        marked.withColumn("realised", F.coalesce(F.product("gain").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
        .withColumn("n_in", F.count("in_price").over(run))
        .withColumn("n_out", F.coalesce(F.count("gain").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("held_at", F.last("in_price", ignorenulls=True).over(run))
    )
    value = F.when(F.col("n_in") > F.col("n_out"), F.col("realised") * F.col("c") / F.col("held_at")).otherwise(F.col("realised"))
    return state.select("symbol", "d", value.alias("value"))


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Value of one unit held from each symbol's first bar."""
    first = F.first("c").over(Window.partitionBy("symbol").orderBy("d"))
    return bars.select("symbol", "d", (F.col("c") / first).alias("value"))


def combine(values: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Equal sleeves over all dates, each carried forward: d, equity.

    Dates are numbered, and each bar is written out up to its symbol's next bar, so a carried value is summed as it
    is; before its first bar a sleeve holds its unit.
    """
    # one row per date: a window without a key is bounded by the calendar
    days = values.select("d").distinct().withColumn("day", F.row_number().over(Window.orderBy("d")))
    total = days.agg(F.max("day").alias("days")).crossJoin(values.select("symbol").distinct().agg(F.count("*").alias("n")))  # one row
    w = Window.partitionBy("symbol").orderBy("d")
    placed = values.join(days, "d").crossJoin(F.broadcast(total)).withColumn("until", F.coalesce(F.lead("day").over(w) - 1, F.col("days")))
    carried = placed.select("value", "n", F.explode(F.sequence("day", "until")).alias("day"))
    per_day = carried.groupBy("day", "n").agg(F.sum("value").alias("s"), F.count("*").alias("started"))
    book = F.lit(capital) * (F.col("s") + F.col("n") - F.col("started")) / F.col("n")
    return per_day.join(days, "day").select("d", book.alias("equity"))


def drawdowns(equity: DataFrame, base: float = CAPITAL) -> DataFrame:
    """Fall from the highest mark so far, the capital included: d, equity, drawdown."""
    run = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.greatest(F.max("equity").over(run), F.lit(base))
    return equity.withColumn("drawdown", F.least(F.col("equity") / peak - 1, F.lit(0.0)))


def returns(equity: DataFrame, base: float = CAPITAL) -> DataFrame:
    """Daily returns from the capital on: d, r; a zero base has none."""
    before = F.coalesce(F.lag("equity").over(Window.orderBy("d")), F.lit(base))
    return equity.withColumn("before", before).where("before <> 0").select("d", (F.col("equity") / F.col("before") - 1).alias("r"))


def sharpe(r: str = "r") -> Column:
    """Yearly ratio of mean to sample deviation; null for fewer than two returns or none of them moving."""
    dev = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (dev > 0), F.avg(r) / dev * math.sqrt(252))


def summary(equity: DataFrame, trades: DataFrame, base: float = CAPITAL) -> DataFrame:
    """One row: total return, drawdown, Sharpe, trades, win rate."""
    total = drawdowns(equity, base).agg((F.max_by("equity", "d") / base - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"))
    ratio = returns(equity, base).agg(sharpe().alias("sharpe"))
    done = trades.where("NOT is_open")
    won = done.agg(F.count("*").alias("n_trades"), F.avg(F.when(F.col("return_pct") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return total.crossJoin(ratio).crossJoin(won)  # three single rows


def regression(strategy: DataFrame, benchmark: DataFrame, base: float = CAPITAL) -> DataFrame:
    """Alpha, beta, R2, correlation, tracking error and information ratio on common dates; null below 60 pairs."""
    pairs = returns(strategy, base).withColumnRenamed("r", "y").join(returns(benchmark, base).withColumnRenamed("r", "x"), "d")
    enough = lambda c: F.when(F.count("*") >= LEAST_PAIRS, c)
    gap = F.col("y") - F.col("x")
    year = 252
    te = F.stddev_samp(gap)
    return pairs.agg(
        F.count("*").alias("n"),
        enough(F.regr_intercept("y", "x") * year).alias("alpha"),
        enough(F.regr_slope("y", "x")).alias("beta"),
        enough(F.regr_r2("y", "x")).alias("r2"),
        enough(F.corr("y", "x")).alias("correlation"),
        enough(te * math.sqrt(year)).alias("tracking_error"),
        enough(F.when(te > 0, F.avg(gap) / te * math.sqrt(year))).alias("information_ratio"),
    )
