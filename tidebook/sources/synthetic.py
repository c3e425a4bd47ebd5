"""Seeded bars for fixtures, as a plan: no rows are drawn on the driver, and any partitioning gives the same bars.

Uniform numbers come from one multiplicative congruential step on symbol, day and seed; two of them make a normal one.
Symbols take turns between a random walk with drift and reversion to a mean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 42
PRIME, FACTOR = 2**31 - 1, 48271
DRIFT, NOISE, REVERSION = 0.0002, 0.01, 0.8


def _uniform(symbol: Column, day: Column, k: int, seed: int) -> Column:
    start = F.pmod(symbol * 104_729 + day * 7919 + k * 15_485_863 + seed * 1_299_709 + 1, F.lit(PRIME))
    once = F.pmod(start * FACTOR, F.lit(PRIME))
    return (F.pmod(once * FACTOR, F.lit(PRIME)) + 1) / float(PRIME + 1)


def bars(spark: SparkSession, symbols: tuple[str, ...], days: int, seed: int = SEED) -> DataFrame:
    """symbol, day, o, h, l, c, v for days 0 .. days-1 of each symbol."""
    grid = spark.range(len(symbols) * days).select((F.col("id") / days).cast("long").alias("s"), (F.col("id") % days).alias("day"))
    u = [_uniform(F.col("s"), F.col("day"), k, seed) for k in range(3)]
    normal = F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1])
    walk = Window.partitionBy("s").orderBy("day")
    drawn = grid.withColumn("z", normal).withColumn("w", u[2])
    summed = drawn.withColumn("x", F.when(F.col("s") % 2 == 0, F.sum(DRIFT + NOISE * F.col("z")).over(walk)).otherwise(NOISE * (F.col("z") + REVERSION * F.coalesce(F.lag("z").over(walk), F.lit(0.0)))))
    priced = summed.withColumn("c", 100 * F.exp("x")).withColumn("o", F.coalesce(F.lag("c").over(walk), F.lit(100.0)))
    span = 1 + NOISE * F.col("w")
    name = F.element_at(F.array(*[F.lit(x) for x in symbols]), (F.col("s") + 1).cast("int"))
    values = {"o": F.col("o"), "h": F.greatest("o", "c") * span, "l": F.least("o", "c") / span, "c": F.col("c")}
    return priced.select(name.alias("symbol"), "day", *[F.round(v, 4).alias(k) for k, v in values.items()], (1000 + F.floor(9000 * F.col("w"))).cast("long").alias("v"))


def _sql(symbols: tuple[str, ...], days: int, seed: int = SEED) -> str:
    uniform = lambda k: f"(((s * 104729 + day * 7919 + {k * 15_485_863 + seed * 1_299_709 + 1}) % {PRIME} * {FACTOR} % {PRIME} * {FACTOR} % {PRIME}) + 1) / {float(PRIME + 1)}"
    named = ", ".join(f"({i}, '{x}')" for i, x in enumerate(symbols))
    return f"""WITH g AS (SELECT s, day, sqrt(-2 * ln({uniform(0)})) * cos(2 * pi() * {uniform(1)}) AS z, {uniform(2)} AS w FROM range({len(symbols)}) a(s), range({days}) b(day)),
 x AS (SELECT *, CASE WHEN s % 2 = 0 THEN sum({DRIFT} + {NOISE} * z) OVER p ELSE {NOISE} * (z + {REVERSION} * coalesce(lag(z) OVER p, 0.0)) END AS x FROM g WINDOW p AS (PARTITION BY s ORDER BY day)),
 y AS (SELECT *, 100 * exp(x) AS c, coalesce(lag(100 * exp(x)) OVER (PARTITION BY s ORDER BY day), 100.0) AS o FROM x)
 SELECT symbol, day, round(o, 4) AS o, round(greatest(o, c) * (1 + {NOISE} * w), 4) AS h, round(least(o, c) / (1 + {NOISE} * w), 4) AS l, round(c, 4) AS c, CAST(1000 + floor(9000 * w) AS BIGINT) AS v FROM y JOIN (VALUES {named}) t(k, symbol) ON s = k"""


SQL = _sql(("AAA", "BBB", "CCC"), 500)
