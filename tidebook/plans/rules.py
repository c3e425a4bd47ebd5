"""Signal rule queries over the daily bars, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import rules as S
from tidebook.plans import indicators as I
from tidebook.sources import views as V


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("trigger", F.round("trigger", 6))


def _query(name: str, **params):
    return lambda spark, sf_dir: _rounded(S.events(V.daily_bars(spark, sf_dir), name, **params))


GOLDEN = {"name": "golden", "left": {"kind": "sma", "n": 10}, "right": {"kind": "sma", "n": 30}, "when": "crosses_above", "direction": 1}
CALM = {"name": "calm", "left": {"kind": "zscore", "n": 20}, "right": [-0.5, 0.5], "when": "enters_zone", "direction": 1}


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = V.daily_bars(spark, sf_dir)
    return _rounded(S.configured(bars, GOLDEN).unionByName(S.configured(bars, CALM)))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.run_rules(V.daily_bars(spark, sf_dir), ["sma_crossover", "breakout", "volume_spike"])
    return found.groupBy("symbol", "rule", "direction").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


QUERIES = {
    "r01_sma_crossover": _query("sma_crossover"),
    "r02_rsi_threshold": _query("rsi_threshold", high=52.0, low=48.0),
    "r03_breakout": _query("breakout"),
    "r04_ema_crossover": _query("ema_crossover"),
    "r05_adx_trend": _query("adx_trend"),
    "r06_macd_crossover": _query("macd_crossover"),
    "r07_macd_slope": _query("macd_slope"),
    "r08_roc_momentum": _query("roc_momentum"),
    "r09_stochastic_threshold": _query("stochastic_threshold"),
    "r09_stochastic_smoothed": _query("stochastic_threshold", use_d=True),
    "r10_bollinger_reversion": _query("bollinger_reversion"),
    "r11_zscore_reversion": _query("zscore_reversion"),
    "r12_rsi_zone": _query("rsi_zone"),
    "r13_donchian_breakout": _query("donchian_breakout"),
    "r14_volume_spike": _query("volume_spike"),
    "r26_configured_rules": _custom,
    "r29_batch_runner": _batch,
}

_W = "w AS (PARTITION BY symbol ORDER BY d)"


def _w(n: int) -> str:
    return f"w{n} AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _p(n: int) -> str:
    return f"p{n} AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _select(source: str, name: str, up: str, down: str, trigger: str) -> str:
    """Events of a table whose rows have the values that the conditions name (pX: the value of the bar before)."""
    return f"""SELECT symbol, d, '{name}' AS rule, direction, round(CAST(trigger AS DOUBLE), 6) AS trigger, d AS data_window_end
 FROM (SELECT symbol, d, CASE WHEN {up} THEN 1 WHEN {down} THEN -1 END AS direction, {trigger} AS trigger FROM {source}) WHERE direction IS NOT NULL"""


def _values(columns: str, *windows: str) -> str:
    """WITH bars and a table y of computed columns."""
    return f"WITH {V.SQL_BARS_D}, y AS (SELECT *, {columns} FROM bars_d WINDOW {', '.join([_W, *windows])})"


def _lagged(*names: str) -> str:
    return ", z AS (SELECT *, " + ", ".join(f"lag({n}) OVER w AS p{n}" for n in names) + f" FROM y WINDOW {_W})"


def _mean(n: int, x: str = "c") -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN avg({x}) OVER w{n} END"


_CROSS = ("px <= 0 AND x > 0", "px >= 0 AND x < 0")
_K = "CASE WHEN count(h) OVER w14 = 14 AND max(h) OVER w14 > min(l) OVER w14 THEN 100 * (c - min(l) OVER w14) / (max(h) OVER w14 - min(l) OVER w14) END"
_SMOOTH = f"WITH {V.SQL_BARS_D}, k AS (SELECT *, {_K} AS k FROM bars_d WINDOW {_w(14)}), y AS (SELECT *, {_mean(3, 'k')} AS x FROM k WINDOW {_w(3)})"
_MACD = f"{I.SQL_MACD}, y AS (SELECT symbol, d, macd_hist, macd_hist AS x FROM macd)"
_SLOPE = f"{I.SQL_MACD}, y AS (SELECT symbol, d, macd_hist, macd_hist - lag(macd_hist) OVER w AS x FROM macd WINDOW {_W})"
_RSI = f"{I.SQL_RSI}, y AS (SELECT symbol, d, rsi AS x FROM rsi)"
_EMA = f"WITH RECURSIVE {V.SQL_BARS_D}{I.recursion('f', 'bars_d', 'c', 12, 'ema')}{I.recursion('s', 'bars_d', 'c', 26, 'ema')}, y AS (SELECT symbol, d, f - s AS x FROM f_r JOIN s_r USING (symbol, d))"
_DEV = "stddev_pop(c) OVER w20"
_Z = f"CASE WHEN count(c) OVER w20 = 20 AND {_DEV} > 0 THEN (c - avg(c) OVER w20) / {_DEV} END"
_SMA_EVENTS = _values(f"{_mean(20)} - ({_mean(50)}) AS x", _w(20), _w(50)) + _lagged("x")
_BREAK = _values("CASE WHEN count(h) OVER p20 = 20 THEN max(h) OVER p20 END AS top, CASE WHEN count(h) OVER p20 = 20 THEN min(l) OVER p20 END AS bottom", _p(20))
_SPIKE = _values("v / CASE WHEN count(v) OVER p20 = 20 THEN avg(v) OVER p20 END AS ratio", _p(20))
_NEVER = "false"



ORACLES = {
    "r01_sma_crossover": f"{_SMA_EVENTS} " + _select("z", "sma_crossover", *_CROSS, "x"),
    "r02_rsi_threshold": _RSI + _lagged("x") + _select("z", "rsi_threshold", "NOT (px > 52 AND x <= 52) AND px < 48 AND x >= 48", "px > 52 AND x <= 52", "x"),
    "r03_breakout": _BREAK + _select("y", "breakout", "c > top", "c < bottom", "c"),
    "r04_ema_crossover": _EMA + _lagged("x") + _select("z", "ema_crossover", *_CROSS, "x"),
    "r05_adx_trend": I.SQL_ADX + " " + _select("adx", "adx_trend", "adx > 25", _NEVER, "adx"),
    "r06_macd_crossover": _MACD + _lagged("x") + _select("z", "macd_crossover", *_CROSS, "x"),
    "r07_macd_slope": _SLOPE + _lagged("x") + _select("z", "macd_slope", "px <= 0 AND x > 0 AND macd_hist < 0", "px >= 0 AND x < 0 AND macd_hist > 0", "x"),
    "r08_roc_momentum": _values("CASE WHEN lag(c, 12) OVER w <> 0 THEN 100 * (c - lag(c, 12) OVER w) / lag(c, 12) OVER w END AS x") + _lagged("x")
    + _select("z", "roc_momentum", "px <= 5 AND x > 5", "px >= -5 AND x < -5", "x"),
    "r09_stochastic_threshold": _values(f"{_K} AS x", _w(14)) + _lagged("x") + _select("z", "stochastic_threshold", "px < 20 AND x >= 20", "px > 80 AND x <= 80", "x"),
    "r09_stochastic_smoothed": _SMOOTH + _lagged("x") + _select("z", "stochastic_threshold", "px < 20 AND x >= 20", "px > 80 AND x <= 80", "x"),
    "r10_bollinger_reversion": _values(f"{_mean(20)} - 2 * {_DEV} AS low, {_mean(20)} + 2 * {_DEV} AS high", _w(20)) + _lagged("c", "low", "high")
    + _select("z", "bollinger_reversion", "pc < plow AND c >= low", "pc > phigh AND c <= high", "c"),
    "r11_zscore_reversion": _values(f"{_Z} AS x", _w(20)) + _lagged("x") + _select("z", "zscore_reversion", "px < -2 AND x >= -2", "px > 2 AND x <= 2", "x"),
    "r12_rsi_zone": _RSI + " " + _select("y", "rsi_zone", "x BETWEEN 0 AND 50", _NEVER, "x"),
    "r13_donchian_breakout": _values(
        "CASE WHEN count(h) OVER p20 = 20 THEN max(h) OVER p20 END AS top, CASE WHEN count(l) OVER p10 = 10 THEN min(l) OVER p10 END AS bottom", _p(20), _p(10)
    )
    + _select("y", "donchian_breakout", "c > top", "c < bottom", "c"),
    "r14_volume_spike": _SPIKE + _select("y", "volume_spike", "ratio >= 1.5", _NEVER, "ratio"),
    "r26_configured_rules": _values(f"{_mean(10)} AS fast, {_mean(10)} - ({_mean(30)}) AS x, {_Z} AS zs", _w(10), _w(30), _w(20))
    + f", z AS (SELECT *, lag(x) OVER w AS px, lag(zs BETWEEN -0.5 AND 0.5) OVER w AS pin FROM y WINDOW {_W}) "
    + _select("z", "golden", _CROSS[0], _NEVER, "fast")
    + " UNION ALL "
    + _select("z", "calm", "zs BETWEEN -0.5 AND 0.5 AND NOT pin", _NEVER, "zs"),
    "r29_batch_runner": f"""WITH {V.SQL_BARS_D}, e AS ({_SMA_EVENTS.replace('WITH ' + V.SQL_BARS_D + ', y AS', 'WITH y AS')} {_select('z', 'sma_crossover', *_CROSS, 'x')}
 UNION ALL {'(' + _BREAK.replace('WITH ' + V.SQL_BARS_D + ', y AS', 'WITH y AS') + _select('y', 'breakout', 'c > top', 'c < bottom', 'c') + ')'}
 UNION ALL {'(' + _SPIKE.replace('WITH ' + V.SQL_BARS_D + ', y AS', 'WITH y AS') + _select('y', 'volume_spike', 'ratio >= 1.5', _NEVER, 'ratio') + ')'})
 SELECT symbol, rule, direction, count(*) AS n, min(d) AS first, max(d) AS last FROM e GROUP BY ALL""",
}
