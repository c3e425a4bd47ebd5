"""Running totals and maxima over an ordered table without a task that sees all of it.

The order is cut into slices at quantiles of its first column.  A slice's rows are summed up by an aggregate (combined before
the shuffle), the few totals of a key are added up in an array, and a window inside each slice goes on from there.
So a table without a key, or one key with most rows, is spread over as many tasks as there are slices.  Rows with
equal values of the first column share a slice.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accuracy of the quantiles; it changes how even the slices are, never a result.
ACCURACY = 10_000
SLICE = "slice_"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400
    seconds = day + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return micros(F.col(column)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    return F.col(column).cast("double")


def sliced(df: DataFrame, by: str, slices: int | None = None) -> DataFrame:
    """``df`` with the number of each row's slice: 0 for null, then in the order of the column."""
    if not isinstance(df.schema[by].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{by} is neither a number nor a time")
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / n for k in range(1, n)]
    at = df.select(_number(df, by).alias("x"))
    bounds = at.agg(F.percentile_approx("x", shares, ACCURACY).alias("q")).first()["q"] if shares else None  # n - 1 numbers
    inner = sorted({float(b) for b in bounds or ()})
    if not inner:
        return df.withColumn(SLICE, F.lit(1))
    cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="at_", outputCol="in_", handleInvalid="keep")
    numbered = cut.transform(df.withColumn("at_", F.coalesce(_number(df, by), F.lit(0.0))))
    return numbered.withColumn(SLICE, F.when(F.col(by).isNull(), 0).otherwise(F.col("in_").cast("int") + 1)).drop("at_", "in_")


def running(df: DataFrame, order: list[str], totals: dict[str, tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """Append running totals, the row's own value included: name to ("sum", "max" or "count", column).

    ``df`` comes from ``sliced`` by the first column of ``order`` (or one that rises with it) and keeps its slice number; ``order``
    settles ties.  Each key of ``by`` has totals of its own.  Nulls add nothing.
    """
    by = list(by or ())
    own = {"sum": F.sum, "max": F.max, "count": F.count}
    fields = [kind for kind, _ in totals.values()]
    part = df.groupBy(*by, SLICE).agg(*[own[kind](c).alias(f"t{i}_") for i, (kind, c) in enumerate(totals.values())])
    row = F.struct(SLICE, *[f"t{i}_" for i in range(len(fields))])
    parts = part.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("parts_"))  # at most a row a slice

    def before(i: int, kind: str) -> Column:
        earlier = F.transform(F.slice("parts_", 1, F.col("at_")), lambda p: p[f"t{i}_"])
        return F.array_max(earlier) if kind == "max" else F.aggregate(earlier, F.lit(None).cast(df_types[i]), lambda a, x: F.coalesce(a + x, a, x))

    df_types = [part.schema[f"t{i}_"].dataType for i in range(len(fields))]
    offsets = parts.select("*", F.posexplode(F.col(f"parts_.{SLICE}")).alias("at_", SLICE)).select(
        *by, SLICE, *[before(i, kind).alias(f"b{i}_") for i, kind in enumerate(fields)]
    )
    within = Window.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = df.select("*", *[own[kind](c).over(within).alias(f"w{i}_") for i, (kind, c) in enumerate(totals.values())])
    met = _with_offsets(inside, offsets, by)
    found = []
    for i, (name, kind) in enumerate(zip(totals, fields, strict=True)):
        a, b = F.col(f"b{i}_"), F.col(f"w{i}_")
        found.append((F.greatest(a, b) if kind == "max" else F.coalesce(a + b, a, b)).alias(name))
    return met.select(*df.columns, *found)


def _with_offsets(df: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    """Join on key and slice; null keys meet null keys."""
    keys = [*by, SLICE]
    right = offsets.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], *[c for c in offsets.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= df[k].eqNullSafe(right[f"k{i}_"])
    # without a key there is one row a slice
    return df.join(right if by else F.broadcast(right), same)
