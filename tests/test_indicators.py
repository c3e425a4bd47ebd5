"""Indicators on short series with known values, and plain loops as a second opinion for the recurrences."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import recurrences as R
from tidebook.functions import windows as W

DAY = dt.date(2024, 1, 1)
BARS = "symbol string, d date, o double, h double, l double, c double, v long"


def bars_of(spark, closes, symbol="A", spread=1.0, volume=100):
    rows = [(symbol, DAY + dt.timedelta(i), c, c + spread, c - spread, c, volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def column(df, name):
    return [r[name] for r in df.orderBy("d").select(name).collect()]


def test_sma_has_nulls_during_warm_up(spark):
    df = bars_of(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).withColumn("x", W.sma(F.col("c"), 3, W.series()))
    assert column(df, "x") == [None, None, 2.0, 3.0, 4.0]


def test_channel_excludes_today(spark):
    top, bottom = W.donchian(F.col("h"), F.col("l"), 2, W.series())
    df = bars_of(spark, [1.0, 5.0, 3.0, 9.0]).withColumns({"top": top, "bottom": bottom})
    assert column(df, "top") == [None, None, 6.0, 6.0] and column(df, "bottom") == [None, None, 0.0, 2.0]


def test_zscore_is_null_without_spread(spark):
    df = bars_of(spark, [2.0, 2.0, 2.0, 4.0]).withColumn("x", W.zscore(F.col("c"), 3, W.series()))
    assert column(df, "x")[:3] == [None, None, None]
    assert column(df, "x")[3] == pytest.approx((4 - 8 / 3) / math.sqrt(8 / 9))


def test_first_true_range_is_high_minus_low(spark):
    df = bars_of(spark, [10.0, 20.0]).withColumn("x", W.true_range(F.col("h"), F.col("l"), F.col("c"), W.series()))
    assert column(df, "x") == [2.0, 11.0]


def test_obv_and_change(spark):
    w = W.series()
    df = bars_of(spark, [1.0, 2.0, 2.0, 1.0]).withColumns({"obv": W.obv(F.col("c"), F.col("v"), w), "p": W.pct_change(F.col("c"), 2, w)})
    assert column(df, "obv") == [0, 100, 100, 0] and column(df, "p") == [None, None, 1.0, -0.5]


def alike(got, want, rel=1e-9):
    """Equal nulls, and numbers equal up to rounding."""
    assert [x is None for x in got] == [x is None for x in want]
    assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None], rel=rel)


def wilder(values, n):
    """Seed mean of the first n, then (before * (n - 1) + x) / n."""
    out, now = [None] * len(values), None
    for i, x in enumerate(values):
        if i == n - 1:
            now = sum(values[:n]) / n
        elif i >= n:
            now = (now * (n - 1) + x) / n
        out[i] = now
    return out


def walk(seed, n=120):
    rng, c, out = random.Random(seed), 100.0, []
    for _ in range(n):
        c = max(1.0, c + rng.gauss(0, 2))
        out.append(c)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recurrences_equal_plain_loops(spark, seed):
    closes = walk(seed)
    df = bars_of(spark, closes)
    n, alpha, want, now = 20, 2 / 21, [], None
    for i, c in enumerate(closes):
        now = None if i < n - 1 else sum(closes[:n]) / n if i == n - 1 else now + alpha * (c - now)
        want.append(now)
    alike(column(R.ema(df, "c", 20), "ema"), want, 1e-12)

    change = [b - a for a, b in zip(closes, closes[1:], strict=False)]
    up, down = wilder([max(x, 0.0) for x in change], 14), wilder([max(-x, 0.0) for x in change], 14)
    rsi = [None] + [None if u is None else 100 - 100 / (1 + u / d) if d else 100.0 if u else 50.0 for u, d in zip(up, down, strict=True)]
    alike(column(R.rsi(df), "rsi"), rsi)

    ranges = [max(2.0, abs(c + 1 - p), abs(c - 1 - p)) for p, c in zip(closes, closes[1:], strict=False)]
    alike(column(R.atr(df), "atr"), [None, *wilder(ranges, 14)])


def test_flat_series(spark):
    df = bars_of(spark, [7.0] * 40)
    assert set(column(R.rsi(df), "rsi")[14:]) == {50.0}
    assert column(R.adx(df), "adx")[:27] == [None] * 27


def test_ema_of_two_symbols_and_short_series(spark):
    df = bars_of(spark, [1.0, 2.0, 3.0]).unionByName(bars_of(spark, [5.0], symbol="B"))
    rows = {(r.symbol, r.d): r.ema for r in R.ema(df, "c", 2).collect()}
    assert rows["A", DAY] is None and rows["A", DAY + dt.timedelta(1)] == 1.5 and rows["B", DAY] is None
    assert rows["A", DAY + dt.timedelta(2)] == pytest.approx(1.5 + 2 / 3 * 1.5)
