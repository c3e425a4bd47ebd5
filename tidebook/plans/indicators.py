"""Indicator queries over the daily bars, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import recurrences as R
from tidebook.functions import windows as W
from tidebook.sources import views as V

#: Added before rounding to means of prices in cents, whose exact values may end in a 5 right where they are rounded:
#: engines add such numbers in different orders, and the last bit would decide.
OFF_TIE = 0.00000003


class Bars:
    """The columns of a bar and the window of its series, for building expressions once a session exists."""

    def __init__(self):
        self.o, self.h, self.l, self.c, self.v = (F.col(x) for x in "ohlcv")
        self.w = W.series()


def _query(build: Callable[[Bars], dict[str, Column]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = build(Bars())
        return V.daily_bars(spark, sf_dir).select("symbol", "d", *[F.round(c, 6).alias(k) for k, c in columns.items()])

    return run


def _sql(select: str, windows: str = "", with_: str = "") -> str:
    """Select over bars_d with named windows: w (whole series order), and wN for the last N bars, pN for the N before."""
    return f"WITH {V.SQL_BARS_D}{with_} SELECT symbol, d, {select} FROM bars_d WINDOW w AS (PARTITION BY symbol ORDER BY d), run AS (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING){windows}"


def _last(*ns: int) -> str:
    return "".join(f", w{n} AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns)


def _full(n: int, x: str, value: str) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {value} END"


def _stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bars()
    k = V.daily_bars(spark, sf_dir).withColumn("k", W.stochastic(b.h, b.l, b.c, 14, b.w))
    return k.select("symbol", "d", F.round("k", 6).alias("k"), F.round(W.sma(F.col("k"), 3, b.w), 6).alias("pct_d"))


def _volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bars()
    r = V.daily_bars(spark, sf_dir).withColumn("r", W.pct_change(b.c, 1, b.w))
    return r.select("symbol", "d", F.round(W.rolling_std(F.col("r"), 20, b.w) * math.sqrt(W.SESSIONS_PER_YEAR), 6).alias("volatility"))


def _obv(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bars()
    signed = V.daily_bars(spark, sf_dir).withColumn("s", F.coalesce(F.signum(b.c - F.lag(b.c).over(b.w)), F.lit(0.0)) * b.v)
    return signed.select("symbol", "d", F.sum("s").over(b.w.rowsBetween(W.Window.unboundedPreceding, 0)).alias("obv"))


def _recurrent(build, *names: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(V.daily_bars(spark, sf_dir)).select("symbol", "d", *[F.round(n, 6).alias(n) for n in names])

    return run


QUERIES = {
    "i01_sma": _query(lambda b: {"sma": W.sma(b.c, 20, b.w)}),
    "i03_rolling_max": _query(lambda b: {"top": W.rolling_max(b.c, 20, b.w)}),
    "i04_rolling_min": _query(lambda b: {"bottom": W.rolling_min(b.c, 20, b.w)}),
    "i07_rolling_std": _query(lambda b: {"std": W.rolling_std(b.c, 20, b.w)}),
    "i08_bollinger": _query(lambda b: dict(zip(("lower", "middle", "upper"), W.bollinger(b.c, 20, 2.0, b.w), strict=True))),
    "i09_zscore": _query(lambda b: {"z": W.zscore(b.c, 20, b.w)}),
    "i10_true_range": _query(lambda b: {"tr": W.true_range(b.h, b.l, b.c, b.w)}),
    "i13_stochastic": _stochastic,
    "i14_roc": _query(lambda b: {"roc": W.roc(b.c, 12, b.w)}),
    "i16_obv": _obv,
    "i17_donchian": _query(lambda b: dict(zip(("top", "bottom"), W.donchian(b.h, b.l, 20, b.w), strict=True))),
    "i18_realised_volatility": _volatility,
    "i20_anchored_vwap": _query(lambda b: {"vwap": F.round(W.anchored_vwap(b.h, b.l, b.c, b.v, b.w) + OFF_TIE, 3)}),
    "i21_mean_to_date": _query(lambda b: {"mean": F.round(W.mean_to_date(b.c, b.w) + OFF_TIE, 3)}),
    "i23_pct_change": _query(lambda b: {"change": W.pct_change(b.c, 5, b.w)}),
    "i02_rsi": _recurrent(R.rsi, "rsi"),
    "i05_ema": _recurrent(lambda df: R.ema(df, "c", 20), "ema"),
    "i06_macd": _recurrent(R.macd, "macd", "macd_signal", "macd_hist"),
    "i12_atr": _recurrent(R.atr, "atr"),
    "i15_adx": _recurrent(R.adx, "plus_di", "minus_di", "adx"),
}


def recursion(name: str, source: str, x: str, n: int, kind: str) -> str:
    """Recursive SQL for an exponential or Wilder average of column x of a table with symbol and d."""
    step = f"r.{name} + 2.0 / ({n} + 1) * (s.x - r.{name})" if kind == "ema" else f"(r.{name} * ({n} - 1) + s.x) / {n}"
    return f""", {name}_s AS (SELECT symbol, d, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM {source} WHERE {x} IS NOT NULL),
{name}_r AS (SELECT symbol, CAST({n} AS BIGINT) AS i, max(CASE WHEN i = {n} THEN d END) AS d, avg(x) AS {name} FROM {name}_s WHERE i <= {n} GROUP BY symbol HAVING count(*) = {n}
 UNION ALL SELECT s.symbol, s.i, s.d, {step} FROM {name}_r r JOIN {name}_s s ON s.symbol = r.symbol AND s.i = r.i + 1)"""


_STEPS = """, step AS (SELECT *, lag(c) OVER w AS pc, h - lag(h) OVER w AS up, lag(l) OVER w - l AS down FROM bars_d WINDOW w AS (PARTITION BY symbol ORDER BY d)),
moved AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr, CASE WHEN pc IS NOT NULL THEN greatest(c - pc, 0) END AS gain,
 CASE WHEN pc IS NOT NULL THEN greatest(pc - c, 0) END AS loss, CASE WHEN pc IS NOT NULL THEN CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END END AS pm,
 CASE WHEN pc IS NOT NULL THEN CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END END AS mm FROM step)"""
_RECURSIVE = f"WITH RECURSIVE {V.SQL_BARS_D}"

SQL_RSI = f"""{_RECURSIVE}{_STEPS}{recursion("g", "moved", "gain", 14, "wilder")}{recursion("ls", "moved", "loss", 14, "wilder")}
, rsi AS (SELECT symbol, d, CASE WHEN ls = 0 THEN CASE WHEN g = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + g / ls) END AS rsi FROM g_r JOIN ls_r USING (symbol, d))"""
SQL_MACD = f"""{_RECURSIVE}{recursion("f", "bars_d", "c", 12, "ema")}{recursion("sl", "bars_d", "c", 26, "ema")}
, line AS (SELECT symbol, d, f - sl AS x FROM f_r JOIN sl_r USING (symbol, d)){recursion("sg", "line", "x", 9, "ema")}
, macd AS (SELECT b.symbol, b.d, b.c, line.x AS macd, sg AS macd_signal, line.x - sg AS macd_hist FROM bars_d b LEFT JOIN line USING (symbol, d) LEFT JOIN sg_r USING (symbol, d))"""
SQL_ATR = f"""{_RECURSIVE}{_STEPS}{recursion("atr", "moved", "tr", 14, "wilder")}"""
SQL_ADX = f"""{_RECURSIVE}{_STEPS}{recursion("str", "moved", "tr", 14, "wilder")}{recursion("sp", "moved", "pm", 14, "wilder")}{recursion("sm", "moved", "mm", 14, "wilder")}
, di AS (SELECT symbol, d, CASE WHEN str > 0 THEN 100 * sp / str ELSE 0.0 END AS plus_di, CASE WHEN str > 0 THEN 100 * sm / str ELSE 0.0 END AS minus_di
 FROM str_r JOIN sp_r USING (symbol, d) JOIN sm_r USING (symbol, d)),
dx AS (SELECT symbol, d, CASE WHEN plus_di + minus_di > 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) ELSE 0.0 END AS x FROM di)
{recursion("adx", "dx", "x", 14, "wilder")}, adx AS (SELECT b.symbol, b.d, plus_di, minus_di, adx FROM bars_d b LEFT JOIN di USING (symbol, d) LEFT JOIN adx_r USING (symbol, d))"""

_std = "stddev_pop(c) OVER w20"
ORACLES = {
    "i01_sma": _sql(f"round({_full(20, 'c', 'avg(c) OVER w20')}, 6) AS sma", _last(20)),
    "i03_rolling_max": _sql(f"round({_full(20, 'c', 'max(c) OVER w20')}, 6) AS top", _last(20)),
    "i04_rolling_min": _sql(f"round({_full(20, 'c', 'min(c) OVER w20')}, 6) AS bottom", _last(20)),
    "i07_rolling_std": _sql(f"round({_full(20, 'c', _std)}, 6) AS std", _last(20)),
    "i08_bollinger": _sql(
        ", ".join(f"round({_full(20, 'c', f'avg(c) OVER w20 {s}')}, 6) AS {n}" for n, s in (("lower", f"- 2 * {_std}"), ("middle", ""), ("upper", f"+ 2 * {_std}"))),
        _last(20),
    ),
    "i09_zscore": _sql(f"round(CASE WHEN count(c) OVER w20 = 20 AND {_std} > 0 THEN (c - avg(c) OVER w20) / {_std} END, 6) AS z", _last(20)),
    "i10_true_range": _sql("round(coalesce(CASE WHEN lag(c) OVER w IS NOT NULL THEN greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) END, h - l), 6) AS tr"),
    "i13_stochastic": f"""WITH {V.SQL_BARS_D}, k AS (SELECT symbol, d, CASE WHEN count(h) OVER w14 = 14 AND max(h) OVER w14 > min(l) OVER w14
 THEN 100 * (c - min(l) OVER w14) / (max(h) OVER w14 - min(l) OVER w14) END AS k FROM bars_d WINDOW w14 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
 SELECT symbol, d, round(k, 6) AS k, round(CASE WHEN count(k) OVER w3 = 3 THEN avg(k) OVER w3 END, 6) AS pct_d FROM k
 WINDOW w3 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "i14_roc": _sql("round(CASE WHEN lag(c, 12) OVER w <> 0 THEN 100 * (c - lag(c, 12) OVER w) / lag(c, 12) OVER w END, 6) AS roc"),
    "i16_obv": f"""WITH {V.SQL_BARS_D}, s AS (SELECT symbol, d, coalesce(CAST(sign(c - lag(c) OVER (PARTITION BY symbol ORDER BY d)) AS DOUBLE), 0) * v AS s FROM bars_d)
 SELECT symbol, d, sum(s) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING) AS obv FROM s""",
    "i17_donchian": _sql(
        "round(CASE WHEN count(h) OVER p20 = 20 THEN max(h) OVER p20 END, 6) AS top, round(CASE WHEN count(h) OVER p20 = 20 THEN min(l) OVER p20 END, 6) AS bottom",
        ", p20 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
    ),
    "i18_realised_volatility": f"""WITH {V.SQL_BARS_D}, r AS (SELECT symbol, d, CASE WHEN lag(c) OVER w <> 0 THEN c / lag(c) OVER w - 1 END AS r FROM bars_d WINDOW w AS (PARTITION BY symbol ORDER BY d))
 SELECT symbol, d, round(CASE WHEN count(r) OVER w20 = 20 THEN stddev_pop(r) OVER w20 * sqrt(252) END, 6) AS volatility FROM r
 WINDOW w20 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "i20_anchored_vwap": _sql(f"round(sum((h + l + c) / 3 * v) OVER run / sum(v) OVER run + {OFF_TIE}, 3) AS vwap"),
    "i21_mean_to_date": _sql(f"round(avg(c) OVER run + {OFF_TIE}, 3) AS mean"),
    "i23_pct_change": _sql("round(CASE WHEN lag(c, 5) OVER w <> 0 THEN c / lag(c, 5) OVER w - 1 END, 6) AS change"),
    "i02_rsi": f"{SQL_RSI} SELECT b.symbol, b.d, round(rsi, 6) AS rsi FROM bars_d b LEFT JOIN rsi USING (symbol, d)",
    "i05_ema": f"{_RECURSIVE}{recursion('ema', 'bars_d', 'c', 20, 'ema')} SELECT b.symbol, b.d, round(ema, 6) AS ema FROM bars_d b LEFT JOIN ema_r USING (symbol, d)",
    "i06_macd": f"{SQL_MACD} SELECT symbol, d, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd_hist, 6) AS macd_hist FROM macd",
    "i12_atr": f"{SQL_ATR} SELECT b.symbol, b.d, round(atr, 6) AS atr FROM bars_d b LEFT JOIN atr_r USING (symbol, d)",
    "i15_adx": f"{SQL_ADX} SELECT symbol, d, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di, round(adx, 6) AS adx FROM adx",
}
