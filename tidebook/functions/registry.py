"""Registry of indicators by name and version: what they are called with, how many bars they need, how they scale.

An indicator is a function of (DataFrame, **parameters) that appends its columns.  Declarations are checked when they
are made: a name and version can be declared once, parameters need defaults inside their bounds, and the declared
lookback must grow no slower than the largest length among the parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import recurrences as R
from tidebook.functions import windows as W

SCALES = ("price", "scale_free", "bounded", "volume")


@dataclass(frozen=True)
class Param:
    """A parameter with its default and bounds."""

    default: float
    low: float
    high: float

    def check(self, name: str, value: float) -> None:
        """An error unless the value is of the default's kind and inside the bounds."""
        if isinstance(self.default, int) and not isinstance(value, int):
            raise ValueError(f"{name} must be a whole number")
        if not self.low <= value <= self.high:
            raise ValueError(f"{name}={value} is not within {self.low} and {self.high}")


@dataclass(frozen=True)
class Indicator:
    """A declared indicator."""

    name: str
    version: tuple[int, ...]
    scale: str
    params: dict[str, Param]
    columns: tuple[str, ...]
    lookback: Callable[..., int]
    run: Callable[..., DataFrame]

    def __call__(self, bars: DataFrame, **given) -> DataFrame:
        """Bars with the indicator's columns."""
        for name, value in given.items():
            if name not in self.params:
                raise ValueError(f"{self.name} has no parameter {name}")
            self.params[name].check(name, value)
        return self.run(bars, **{**{k: p.default for k, p in self.params.items()}, **given})


INDICATORS: dict[str, dict[tuple[int, ...], Indicator]] = {}


def register_indicator(name: str, version: str, scale: str, columns: tuple[str, ...], lookback: Callable[..., int], **params: Param):
    """Declare an indicator; its declaration is checked at once."""
    number = tuple(map(int, version.split(".")))
    if scale not in SCALES:
        raise ValueError(f"scale of {name} is none of {SCALES}")
    if number in INDICATORS.get(name, {}):
        raise ValueError(f"{name} {version} exists")
    for k, p in params.items():
        p.check(k, p.default)
    lengths = [p for p in params.values() if isinstance(p.default, int)]
    for end in ("low", "high"):
        if lengths and lookback(**{k: getattr(p, end) if p in lengths else p.default for k, p in params.items()}) < max(getattr(p, end) for p in lengths):
            raise ValueError(f"lookback of {name} is shorter than its longest window")

    def add(run):
        INDICATORS.setdefault(name, {})[number] = Indicator(name, number, scale, params, columns, lookback, run)
        return run

    return add


def indicator(name: str, version: str | None = None) -> Indicator:
    """The declared indicator of a version, or of the highest one by number."""
    known = INDICATORS.get(name)
    if not known:
        raise KeyError(f"no indicator {name}; there are {', '.join(sorted(INDICATORS))}")
    return known[tuple(map(int, version.split(".")))] if version else known[max(known)]


def _length(default: int) -> Param:
    return Param(default, 2, 1000)


@register_indicator("sma", "1.0.0", "price", ("sma",), lambda n: n, n=_length(20))
def _sma(bars, n):
    return bars.withColumn("sma", W.sma(F.col("c"), n, W.series()))


@register_indicator("rsi", "1.0.0", "bounded", ("rsi",), lambda n: n + 1, n=_length(14))
def _rsi(bars, n):
    return R.rsi(bars, "c", n)


@register_indicator("ema", "1.0.0", "price", ("ema",), lambda n: n, n=_length(20))
def _ema(bars, n):
    return R.ema(bars, "c", n)


@register_indicator("macd", "1.0.0", "price", ("macd", "macd_signal", "macd_hist"), lambda fast, slow, signal: max(fast, slow) + signal - 1, fast=_length(12), slow=_length(26), signal=_length(9))
def _macd(bars, fast, slow, signal):
    return R.macd(bars, "c", fast, slow, signal)


@register_indicator("atr", "1.0.0", "price", ("atr",), lambda n: n + 1, n=_length(14))
def _atr(bars, n):
    return R.atr(bars, n)


@register_indicator("adx", "1.0.0", "bounded", ("plus_di", "minus_di", "adx"), lambda n: 2 * n, n=_length(14))
def _adx(bars, n):
    return R.adx(bars, n)
