"""As-of joins without range joins: both sides are stacked, and a window carries the last right row forward.

One shuffle on the key and one sort by time serve any number of right rows per key, and no pair of rows is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    values: list[str],
    tolerance_days: int | None = None,
    strict: bool = False,
    forward: bool = False,
) -> DataFrame:
    """Left rows with the ``values`` of the last right row at or before (``strict``: before) their time.

    ``forward`` takes the first right row at or after instead.  Beyond ``tolerance_days`` the values are null.  Right
    rows must be unique by key and time.  The matched time comes along as ``<right_on>_matched``.
    """
    payload = F.struct(F.col(right_on).alias("t_"), *[F.col(v) for v in values])
    l_side = left.withColumn("r_", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)).withColumn("at_", F.col(left_on))
    # at equal times the right row comes first, unless the match must be strictly earlier
    l_side = l_side.withColumn("side_", F.lit(0 if strict != forward else 1))
    r_side = right.select(*by, F.col(right_on).alias("at_"), payload.alias("r_"), F.lit(1 if strict != forward else 0).alias("side_"))
    both = l_side.withColumn("left_", F.lit(True)).unionByName(r_side, allowMissingColumns=True)
    keys = Window.partitionBy(*by)
    if forward:
        w = keys.orderBy("at_", "side_").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        found = both.withColumn("m_", F.first("r_", ignorenulls=True).over(w))
    else:
        w = keys.orderBy("at_", "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn("m_", F.last("r_", ignorenulls=True).over(w))
    found = found.where("left_")
    if tolerance_days is not None:
        gap = F.abs(F.datediff(F.col("at_"), F.col("m_.t_")))
        found = found.withColumn("m_", F.when(gap <= tolerance_days, F.col("m_")))
    return found.select(*left.columns, *[F.col(f"m_.{v}").alias(v) for v in values], F.col("m_.t_").alias(f"{right_on}_matched"))


def latest(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Per key the values of the row of the highest order; a partial aggregate combines before the shuffle."""
    top = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*by).agg(top.alias("top_")).select(*by, *[F.col(f"top_.{v}").alias(v) for v in values])
