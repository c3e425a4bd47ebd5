"""Corporate actions: back-adjustment of prices by later splits and dividends.

An action takes effect on the first bar at or after its ex-date and scales the bars before that.  The factor of a bar
is the product of the factors of later bars: a window product over the bars that have factors, carried to the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.asof import asof

#: Up to so many actions are broadcast to the bars; more of them meet the bars in a shuffle.
FEW = 100_000
MODES = {"split_dividend": ("split", "dividend"), "split": ("split",), "none": ()}


def effective(actions: DataFrame, bars: DataFrame, mode: str = "split_dividend") -> DataFrame:
    """Actions of the mode with the bar they take effect on; those on no bar, or on the first, are left out.

    An action that is there twice takes effect twice.
    """
    wanted = actions.where(F.col("action_type").isin(*MODES[mode]) if MODES[mode] else F.lit(False))
    copies = Window.partitionBy(*wanted.columns).orderBy(F.lit(0))
    wanted = wanted.withColumn("copy_", F.row_number().over(copies))  # so that grouping keeps equal actions apart
    if wanted.limit(FEW + 1).count() <= FEW:
        # the bar before the first one at or after a date is the last one before the date: one aggregate serves both
        keys = [F.col(c) for c in wanted.columns]
        near = bars.select("symbol", "d", "c").join(F.broadcast(wanted), "symbol")
        after, before = F.when(F.col("d") >= F.col("ex_date"), F.col("d")), F.when(F.col("d") < F.col("ex_date"), F.col("d"))
        found = near.groupBy(*keys).agg(F.min(after).alias("bar_d"), F.max_by("c", before).alias("before_c"), F.max(before).alias("before_d"))
        return found.where(F.col("bar_d").isNotNull() & F.col("before_d").isNotNull() & F.col("before_c").isNotNull()).drop("before_d", "copy_")
    w = Window.partitionBy("symbol").orderBy("d")
    numbered = bars.select("symbol", "d", F.lag("c").over(w).alias("before_c"))
    found = asof(wanted, numbered.withColumn("bar_d", F.col("d")), ["symbol"], "ex_date", "d", ["bar_d", "before_c"], forward=True)
    return found.where(F.col("before_c").isNotNull()).drop("d_matched", "copy_")


def factors(actions: DataFrame, bars: DataFrame, mode: str = "split_dividend") -> DataFrame:
    """Per symbol and bar with actions: the price and volume factor that its actions lay on all bars before."""
    acting = effective(actions, bars, mode)
    ratio = F.col("split_ratio")
    # splits come first, so a dividend paid on the same bar is per new share
    splits = acting.where("action_type = 'split'").groupBy("symbol", "bar_d").agg(F.product("split_ratio").alias("ratio"))
    own = acting.join(splits, ["symbol", "bar_d"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    close = F.col("before_c")
    price = F.when(F.col("action_type") == "split", 1 / ratio).otherwise((close - F.col("dividend") * F.col("ratio")) / close)
    volume = F.when(F.col("action_type") == "split", ratio).otherwise(1.0)
    return own.withColumn("p", price).withColumn("q", volume).groupBy("symbol", F.col("bar_d").alias("d")).agg(F.product("p").alias("p"), F.product("q").alias("q"))


def adjust(bars: DataFrame, actions: DataFrame, mode: str = "split_dividend") -> DataFrame:
    """Bars with adjusted prices and volume; raw_close keeps the close as traded."""
    # products over the few bars that have factors, then one as-of pass over the bars
    onwards = Window.partitionBy("symbol").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = factors(actions, bars, mode).select("symbol", F.col("d").alias("from_d"), F.product("p").over(onwards).alias("pf"), F.product("q").over(onwards).alias("qf"))
    joined = asof(bars, of, ["symbol"], "d", "from_d", ["pf", "qf"], strict=True, forward=True)
    scaled = joined.withColumn("pf", F.coalesce("pf", F.lit(1.0))).withColumn("qf", F.coalesce("qf", F.lit(1.0)))
    return scaled.select(
        "symbol", "d", *[(F.col(x) * F.col("pf")).alias(x) for x in "ohlc"], F.rint(F.col("v") * F.col("qf")).cast("long").alias("v"), F.col("c").alias("raw_close")
    )
