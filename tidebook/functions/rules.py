"""Causal signal rules: a rule turns bars into events (symbol, d, rule, direction, trigger, data_window_end).

An event of day d uses bars up to d only, and says so in data_window_end.  Direction is 1 or -1; filters emit 1 on
every day whose condition is defined and true.  Rules are registered with their roles and default parameters, and
``lookback`` tells how many bars a symbol needs before the batch runner considers it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions import recurrences as R
from tidebook.functions import windows as W


@dataclass(frozen=True)
class Rule:
    """A registered rule: how to build direction and trigger on bars, and what it needs."""

    name: str
    roles: tuple[str, ...]
    build: Callable[..., tuple[DataFrame, Column, Column]]
    defaults: dict = field(default_factory=dict)
    lookback: Callable[..., int] = lambda **_: 1

    def params(self, **given) -> dict:
        """Defaults overlaid by the given parameters; unknown names are refused."""
        unknown = set(given) - set(self.defaults)
        if unknown:
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        return {**self.defaults, **given}


RULES: dict[str, Rule] = {}


def rule(name: str, *roles: str, lookback: Callable[..., int], **defaults):
    """Register a rule; a name can be registered once."""

    def add(build):
        if name in RULES:
            raise ValueError(f"rule {name} exists")
        RULES[name] = Rule(name, roles, build, defaults, lookback)
        return build

    return add


def events(bars: DataFrame, name: str, **given) -> DataFrame:
    """The events of one rule; symbols with fewer bars than its lookback have none."""
    own = RULES[name]
    p = own.params(**given)
    enough = bars.withColumn("bars_", F.count("*").over(W.Window.partitionBy("symbol"))).where(F.col("bars_") >= own.lookback(**p)).drop("bars_")
    df, direction, trigger = own.build(enough, **p)
    found = df.withColumn("direction", direction.cast("int")).withColumn("trigger", trigger.cast("double"))
    return found.where(F.col("direction").isNotNull()).select(
        "symbol", "d", F.lit(name).alias("rule"), "direction", "trigger", F.col("d").alias("data_window_end")
    )


def fired(bars: DataFrame, wanted: list[tuple[str, dict]]) -> DataFrame:
    """Bars (symbol, d) with what rules say on each: columns ``dir0``, ``trig0`` and so on, in the order of ``wanted``.

    All rules are columns of one plan over the bars, and all their recurrences are found in one pass.  Symbols with fewer
    bars than a rule's lookback have no direction of it.
    """
    built = [(RULES[name], RULES[name].params(**given)) for name, given in wanted]
    gathering = R.Gathering(bars)
    gathering.collect([lambda df, own=own, p=p: own.build(df, **p) for own, p in built])
    df = gathering.bars.withColumn("bars_", F.count("*").over(W.Window.partitionBy("symbol")))
    kept = df.columns
    for k, (own, p) in enumerate(built):
        with gathering.answers():
            df, direction, trigger = own.build(df, **p)
        enough = F.col("bars_") >= own.lookback(**p)
        df = df.withColumn(f"dir{k}", F.when(enough, direction).cast("int")).withColumn(f"trig{k}", trigger.cast("double"))
        kept = [*kept, f"dir{k}", f"trig{k}"]
        df = df.select(*kept)
    return df.select("symbol", "d", *[c for c in kept if c.startswith(("dir", "trig"))])


def run_rules(bars: DataFrame, names: list[str]) -> DataFrame:
    """The events of several rules with their default parameters."""
    found = [events(bars, n) for n in names]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_c, _h, _l, _v = (lambda: F.col("c")), (lambda: F.col("h")), (lambda: F.col("l")), (lambda: F.col("v"))


def _before(x: str) -> Column:
    return F.lag(x).over(W.series())


@rule("sma_crossover", "entry", "exit", lookback=lambda fast, slow: slow + 1, fast=20, slow=50)
def _sma_crossover(df, fast, slow):
    w = W.series()
    df = df.withColumn("x", W.sma(_c(), fast, w) - W.sma(_c(), slow, w))
    return df, W.crosses(F.col("x"), w), F.col("x")


@rule("ema_crossover", "entry", "exit", lookback=lambda fast, slow: slow + 1, fast=12, slow=26)
def _ema_crossover(df, fast, slow):
    df = R.recur(df, [("f", "ema", "c", fast), ("s", "ema", "c", slow)]).withColumn("x", F.col("f") - F.col("s"))
    return df, W.crosses(F.col("x"), W.series()), F.col("x")


@rule("rsi_threshold", "entry", "exit", lookback=lambda n, high, low: n + 2, n=14, high=70.0, low=30.0)
def _rsi_threshold(df, n, high, low):
    df = R.rsi(df, "c", n)
    r, before = F.col("rsi"), _before("rsi")
    return df, F.when((before > high) & (r <= high), -1).when((before < low) & (r >= low), 1), r


@rule("breakout", "entry", "exit", lookback=lambda n: n + 1, n=20)
def _breakout(df, n):
    top, bottom = W.donchian(_h(), _l(), n, W.series())
    df = df.withColumn("top", top).withColumn("bottom", bottom)
    return df, F.when(_c() > F.col("top"), 1).when(_c() < F.col("bottom"), -1), _c()


@rule("adx_trend", "filter", lookback=lambda n, least: 2 * n + 1, n=14, least=25.0)
def _adx_trend(df, n, least):
    return R.adx(df, n), F.when(F.col("adx") > least, 1), F.col("adx")


@rule("macd_crossover", "entry", "exit", lookback=lambda fast, slow, signal: slow + signal, fast=12, slow=26, signal=9)
def _macd_crossover(df, fast, slow, signal):
    df = R.macd(df, "c", fast, slow, signal)
    return df, W.crosses(F.col("macd_hist"), W.series()), F.col("macd_hist")


@rule("macd_slope", "entry", "exit", lookback=lambda fast, slow, signal, with_sign: slow + signal + 2, fast=12, slow=26, signal=9, with_sign=True)
def _macd_slope(df, fast, slow, signal, with_sign):
    df = R.macd(df, "c", fast, slow, signal).withColumn("slope", F.col("macd_hist") - _before("macd_hist"))
    turn = W.crosses(F.col("slope"), W.series())
    df = df.withColumn("turn", turn)
    hist, turn = F.col("macd_hist"), F.col("turn")
    if with_sign:  # a turn up counts below zero, a turn down above it
        turn = F.when((turn == 1) & (hist < 0), 1).when((turn == -1) & (hist > 0), -1)
    return df, turn, F.col("slope")


@rule("roc_momentum", "entry", "exit", lookback=lambda n, up, down: n + 2, n=12, up=5.0, down=-5.0)
def _roc_momentum(df, n, up, down):
    df = df.withColumn("roc", W.roc(_c(), n, W.series()))
    r, before = F.col("roc"), _before("roc")
    return df, F.when((before <= up) & (r > up), 1).when((before >= down) & (r < down), -1), r


@rule("stochastic_threshold", "entry", "exit", lookback=lambda n, smooth, high, low, use_d: n + smooth, n=14, smooth=3, high=80.0, low=20.0, use_d=False)
def _stochastic_threshold(df, n, smooth, high, low, use_d):
    w = W.series()
    df = df.withColumn("k", W.stochastic(_h(), _l(), _c(), n, w))
    df = df.withColumn("x", W.sma(F.col("k"), smooth, w) if use_d else F.col("k"))
    x, before = F.col("x"), _before("x")
    return df, F.when((before < low) & (x >= low), 1).when((before > high) & (x <= high), -1), x


@rule("bollinger_reversion", "entry", "exit", lookback=lambda n, k: n + 1, n=20, k=2.0)
def _bollinger_reversion(df, n, k):
    low, _, high = W.bollinger(_c(), n, k, W.series())
    df = df.withColumn("low", low).withColumn("high", high)
    c, before = _c(), _before("c")
    up = (before < _before("low")) & (c >= F.col("low"))
    return df, F.when(up, 1).when((before > _before("high")) & (c <= F.col("high")), -1), c


@rule("zscore_reversion", "entry", "exit", lookback=lambda n, least: n + 1, n=20, least=2.0)
def _zscore_reversion(df, n, least):
    df = df.withColumn("z", W.zscore(_c(), n, W.series()))
    z, before = F.col("z"), _before("z")
    return df, F.when((before < -least) & (z >= -least), 1).when((before > least) & (z <= least), -1), z


@rule("rsi_zone", "filter", lookback=lambda n, low, high: n + 1, n=14, low=0.0, high=50.0)
def _rsi_zone(df, n, low, high):
    return R.rsi(df, "c", n), F.when(F.col("rsi").between(low, high), 1), F.col("rsi")


@rule("donchian_breakout", "entry", "exit", lookback=lambda up, down: max(up, down) + 1, up=20, down=10)
def _donchian_breakout(df, up, down):
    w = W.series()
    df = df.withColumn("top", W.donchian(_h(), _l(), up, w)[0]).withColumn("bottom", W.donchian(_h(), _l(), down, w)[1])
    return df, F.when(_c() > F.col("top"), 1).when(_c() < F.col("bottom"), -1), _c()


@rule("volume_spike", "filter", lookback=lambda n, times: n + 1, n=20, times=1.5)
def _volume_spike(df, n, times):
    prior = W.series().rowsBetween(-n, -1)
    mean = F.when(F.count("v").over(prior) == n, F.avg("v").over(prior))
    df = df.withColumn("ratio", F.try_divide(_v().cast("double"), mean))
    return df, F.when(F.col("ratio") >= times, 1), F.col("ratio")


# Configured rules: operands by kind, comparators by name.
OPERANDS: dict[str, Callable[..., Column]] = {
    "price": lambda w, n=0: F.col("c"),
    "sma": lambda w, n=20: W.sma(F.col("c"), n, w),
    "high": lambda w, n=20: W.donchian(F.col("h"), F.col("l"), n, w)[0],
    "low": lambda w, n=20: W.donchian(F.col("h"), F.col("l"), n, w)[1],
    "roc": lambda w, n=12: W.roc(F.col("c"), n, w),
    "zscore": lambda w, n=20: W.zscore(F.col("c"), n, w),
    "std": lambda w, n=20: W.rolling_std(F.col("c"), n, w),
    "change": lambda w, n=1: W.pct_change(F.col("c"), n, w),
    "volume": lambda w, n=0: F.col("v").cast("double"),
}


def configured(bars: DataFrame, config: dict) -> DataFrame:
    """Events of a rule given as data: ``{"name", "left": {kind, n}, "right": {kind, n} | level, "when", "direction"}``.

    ``when`` is crosses_above, crosses_below, enters_zone or exits_zone (zones: ``right`` is [low, high]).
    """
    w = W.series()
    df = bars.withColumn("left_", OPERANDS[config["left"]["kind"]](w, **{k: v for k, v in config["left"].items() if k == "n"}))
    right = config["right"]
    if isinstance(right, dict):
        df = df.withColumn("right_", OPERANDS[right["kind"]](w, **{k: v for k, v in right.items() if k == "n"}))
    elif isinstance(right, (int, float)):
        df = df.withColumn("right_", F.lit(float(right)))
    if config["when"] in ("crosses_above", "crosses_below"):
        df = df.withColumn("x_", F.col("left_") - F.col("right_"))
        wanted = 1 if config["when"] == "crosses_above" else -1
        hit = W.crosses(F.col("x_"), w) == wanted
    else:
        df = df.withColumn("in_", F.col("left_").between(*right))
        now, before = F.col("in_"), F.lag("in_").over(w)
        hit = now & ~before if config["when"] == "enters_zone" else ~now & before
    return (
        df.withColumn("hit_", hit)
        .where("hit_")
        .select("symbol", "d", F.lit(config["name"]).alias("rule"), F.lit(config["direction"]).alias("direction"), F.col("left_").alias("trigger"), F.col("d").alias("data_window_end"))
    )
