"""Portfolio targets per rebalance date, as windows: eligibility, raw weights, caps with redistribution, and orders.

The capped split has a closed form on the weights in falling order: the first *k* names are at the cap, where *k* is
the least number for which the next name's share of what is left does not exceed the cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("equal_active", "signal_strength", "signal_inverse_volatility")


def capped_split(raw: DataFrame, by: list[str], weight: str, total: float, cap: float) -> DataFrame:
    """Add ``share``: ``total`` in proportion to ``weight`` (at least 0), none above ``cap``; what cannot be placed is left over."""
    down = Window.partitionBy(*by).orderBy(F.desc(weight), "symbol")
    rest = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = F.row_number().over(down) - 1
    here = raw.withColumn("before_", before).withColumn("rest_", F.sum(weight).over(rest))
    left = F.greatest(F.lit(total) - cap * F.col("before_"), F.lit(0.0))
    own = F.when((F.col(weight) > 0) & (F.col("rest_") > 0), left * F.col(weight) / F.col("rest_")).otherwise(0.0)
    tested = here.withColumn("over_", (F.col(weight) > 0) & (own > cap))
    # names before the first that fits are at the cap; from there on all are split in proportion
    whole = Window.partitionBy(*by)
    k = F.coalesce(F.min(F.when(~F.col("over_"), F.col("before_"))).over(whole), F.count("*").over(whole))
    sized = tested.withColumn("k_", k)
    tail = F.sum(F.when(F.col("before_") >= F.col("k_"), F.col(weight)).otherwise(0.0)).over(whole)
    remaining = F.greatest(F.lit(total) - cap * F.col("k_"), F.lit(0.0))
    share = (
        F.when(F.col("before_") < F.col("k_"), cap)
        .when((F.col(weight) > 0) & (tail > 0), remaining * F.col(weight) / tail)
        .otherwise(0.0)
    )
    return sized.withColumn("share", share).drop("before_", "rest_", "over_", "k_")


def target_weights(
    signals: DataFrame,
    mode: str,
    exposure: float = 1.0,
    min_score: float = 0.0,
    max_positions: int | None = None,
    cap: float = 1.0,
) -> DataFrame:
    """Signed weights per date: d, symbol, weight (null where excluded), excluded (the reason or null).

    ``signals`` has d, symbol, direction (1 or -1), score, volatility.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    score, vol = F.col("score"), F.col("volatility")
    reason = F.when(score.isNull() | F.isnan(score) | (score <= 0) | (score > 1), "invalid_score").when(score < min_score, "min_score")
    raw = {"equal_active": F.lit(1.0), "signal_strength": score}.get(mode, F.when(vol > 0, score / vol))
    if mode == "signal_inverse_volatility":
        reason = reason.when(vol.isNull() | F.isnan(vol) | (vol <= 0) | (vol == float("inf")), "no_volatility")
    judged = signals.withColumn("excluded", reason).withColumn("raw", F.when(F.col("excluded").isNull(), raw))
    if max_positions is not None:
        place = F.row_number().over(Window.partitionBy("d").orderBy(F.col("excluded").isNotNull(), F.desc("score"), "symbol"))
        late = F.col("excluded").isNull() & (place > max_positions)
        judged = judged.withColumn("late_", late).withColumn("excluded", F.when(F.col("late_"), "max_positions").otherwise(F.col("excluded"))).drop("late_")
    kept = capped_split(judged.where("excluded IS NULL"), ["d"], "raw", exposure, cap)
    out = kept.select("d", "symbol", (F.col("direction") * F.col("share")).alias("weight"), "excluded")
    return out.unionByName(judged.where("excluded IS NOT NULL").select("d", "symbol", F.lit(None).cast("double").alias("weight"), "excluded"))


def rebalance(targets: DataFrame, held: DataFrame, threshold: float, max_turnover: float) -> DataFrame:
    """Trades toward the targets: d, symbol, delta.

    Changes below the threshold are left, unless they close a position; if the turnover of a date is above its
    maximum, all changes but closings are scaled down to fit.
    """
    both = targets.where("weight IS NOT NULL").select("d", "symbol", "weight").join(held, ["d", "symbol"], "full")
    weight, own = F.coalesce("weight", F.lit(0.0)), F.coalesce("held", F.lit(0.0))
    moved = both.withColumn("delta", weight - own).withColumn("closing", (weight == 0) & (own != 0))
    wanted = moved.where(F.col("closing") | (F.abs("delta") >= threshold)).where("delta <> 0")
    day = Window.partitionBy("d")
    must = F.sum(F.when(F.col("closing"), F.abs("delta")).otherwise(0.0)).over(day)
    free = F.sum(F.when(~F.col("closing"), F.abs("delta")).otherwise(0.0)).over(day)
    scale = F.when(free > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), max_turnover - must) / free)).otherwise(1.0)
    return wanted.withColumn("delta", F.when(F.col("closing"), F.col("delta")).otherwise(F.col("delta") * scale)).select("d", "symbol", "delta", "closing")


def schedule(days: DataFrame, every: str) -> DataFrame:
    """Days with ``due``: whether a daily, weekly (ISO) or monthly rebalance falls on them (the first day of a period)."""
    w = Window.partitionBy("symbol").orderBy("d")
    if every == "daily":
        return days.withColumn("due", F.lit(True))
    period = F.date_trunc("week" if every == "weekly" else "month", "d")
    return days.withColumn("p_", period).withColumn("due", ~F.col("p_").eqNullSafe(F.lag("p_").over(w))).drop("p_")
