"""Recurrent indicators: exponential and Wilder averages, and what is built on them.

A value depends on the one before through an affine step, now = a * before + b * x.  Steps compose, so a series is
taken in blocks, all of which are stepped through at once as if each began at zero, and only the blocks' ends are carried on
one by one.  All recurrent columns of a query are found in one pass over a
symbol's rows; what is not recurrent (differences, ranges, ratios) stays in window expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions import windows as W

#: Output column, recurrence ("ema" or "wilder"), input column or a function of all columns so far, length.
Spec = tuple[str, str, "str | Callable[[dict[str, np.ndarray]], np.ndarray]", int]
BLOCK = 64


@dataclass
class Carried:
    """Where an average stands after some values, so that it goes on as if it had seen them all at once.

    ``waiting`` holds the values in a row before the seed, ``before`` the distance from the seed at the beginning of the
    present block, ``own`` what the ``at`` values of the block have added since; ``ended`` is set by a hole.
    """

    waiting: list[float] = field(default_factory=list)
    seed: float | None = None
    before: float = 0.0
    own: float = 0.0
    at: int = 0
    ended: bool = False


def affine(x: np.ndarray, a: float, b: float, carried: Carried) -> np.ndarray:
    """The values of now = a * before + b * x from where ``carried`` stands, which is moved on.

    Blocks are counted from the first value ever, and every step is taken value by value across blocks, so the result
    has the same bits wherever the series is cut.
    """
    if not len(x):
        return np.zeros(0)
    end = carried.at + len(x)
    blocks = -(-end // BLOCK)
    steps = np.zeros(blocks * BLOCK)
    steps[carried.at : end] = b * x
    steps = steps.reshape(blocks, BLOCK)
    own, now = np.zeros((blocks, BLOCK)), np.zeros(blocks)
    for k in range(BLOCK):
        if k == carried.at:
            now[0] = carried.own
        now = a * now + steps[:, k]
        own[:, k] = now
    powers = np.float64(a) ** np.arange(1, BLOCK + 1)
    before = np.empty(blocks + 1)
    before[0] = carried.before
    for k in range(blocks):
        before[k + 1] = own[k, -1] + powers[-1] * before[k]
    values = (own + np.outer(before[:-1], powers)).ravel()[carried.at : end]
    last = end % BLOCK
    carried.at, carried.own = last, float(own[-1, last - 1]) if last else 0.0
    carried.before = float(before[-2] if last else before[-1])
    return values


def average(values: np.ndarray, n: int, kind: str, carried: Carried | None = None) -> np.ndarray:
    """Undefined until n values in a row are there; then seeded by their mean.  A hole ends it.

    With ``carried`` the series goes on from there, and the state is moved on.
    """
    state = carried or Carried()
    out = np.full(len(values), np.nan)
    if state.ended or not len(values):
        return out
    first = 0
    if state.seed is None:
        joined = np.concatenate([state.waiting, values])
        there = ~np.isnan(joined)
        full = np.flatnonzero(np.convolve(there, np.ones(n, dtype=int))[: len(joined)] == n)
        if not len(full):
            holes = np.flatnonzero(~there)
            state.waiting = joined[holes[-1] + 1 if len(holes) else 0 :].tolist()
            return out
        start = int(full[0])
        state.seed, state.waiting = float(joined[start - n + 1 : start + 1].mean()), []
        first = start - (len(joined) - len(values)) + 1
        out[first - 1] = state.seed
    holes = np.flatnonzero(np.isnan(values[first:]))
    end = first + int(holes[0]) if len(holes) else len(values)
    state.ended = end < len(values)
    a, b = (1 - 2.0 / (n + 1), 2.0 / (n + 1)) if kind == "ema" else ((n - 1) / n, 1.0 / n)
    # as a + b = 1, distances from the seed follow the same steps, and a flat series stays exactly flat
    out[first:end] = state.seed + affine(values[first:end] - state.seed, a, b, state)
    return out


class Gathering:
    """Recurrent columns that several builders ask for, found in one pass over the bars.

    ``collect`` runs the builders, which make plans and no jobs, to learn what they ask for, with empty columns in place of the
    answers; ``bars`` then has all that was asked for, and under ``answers`` the same builders, in the same order, read it
    from there.  A recurrence of a column of the bars that was asked for before is not found again.
    """

    def __init__(self, bars: DataFrame):
        self.base, self._bars = list(bars.columns), bars
        self._specs: list[Spec] = []
        self._known: dict[tuple, str] = {}
        self._calls: list[dict[str, str]] = []
        self._turn: int | None = None

    def collect(self, builders: Sequence[Callable[[DataFrame], object]]) -> None:
        for build in builders:
            with _answering(self):
                build(self._bars)

    @property
    def bars(self) -> DataFrame:
        self._turn = 0
        return recur(self._bars, self._specs).select(*self.base, *[s[0] for s in self._specs]) if self._specs else self._bars

    def answers(self):
        """Context in which builders get what was found."""
        return _answering(self)

    def _recur(self, df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
        if self._turn is not None:
            named = self._calls[self._turn]
            self._turn += 1
            return df.withColumns({name: F.col(out) for name, out in named.items()})
        named: dict[str, str] = {}
        for name, kind, source, n in specs:
            key = (kind, source, n)
            if isinstance(source, str) and source in self.base and key in self._known:
                named[name] = self._known[key]
                continue
            out = f"out{len(self._specs)}_"
            if callable(source):
                source = lambda known, find=source, of=dict(named): find({k: known[v] for k, v in of.items()})
            elif source in self.base:
                self._known[key] = out
            else:  # a column that the builder made: kept under a name of its own
                df, source = df.withColumn(f"in{out}", F.col(source)), f"in{out}"
            self._specs.append((out, kind, source, n))
            named[name] = out
        self._bars = df.select(*self.base, *[s[2] for s in self._specs if isinstance(s[2], str) and s[2] not in self.base])
        self._calls.append(named)
        return df.withColumns({name: F.lit(None).cast("double") for name in named})


_gathering: ContextVar[Gathering | None] = ContextVar("gathering", default=None)


@contextmanager
def _answering(gathering: Gathering):
    token = _gathering.set(gathering)
    try:
        yield
    finally:
        _gathering.reset(token)


def recur(df: DataFrame, specs: Sequence[Spec], by: str = "symbol", time: str = "d") -> DataFrame:
    """Append recurrent columns, each series in the order of its time; undefined values are null."""
    if (gathering := _gathering.get()) is not None:
        return gathering._recur(df, specs)
    fields = [*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name, *_ in specs]]
    wanted = {source for _, _, source, _ in specs if isinstance(source, str)} & set(df.columns)

    def run(group):
        import pyarrow as pa

        group = group.sort_by(time)
        known = {c: group.column(c).to_numpy().astype(np.float64) for c in wanted}
        for name, kind, source, n in specs:
            known[name] = average(known[source] if isinstance(source, str) else source(known), n, kind)
            group = group.append_column(name, pa.array(known[name], pa.float64(), from_pandas=True))
        return group

    return df.groupBy(by).applyInArrow(run, T.StructType(fields))


def ema(df: DataFrame, x: str, n: int, out: str = "ema", **keys) -> DataFrame:
    """Exponential average, seeded by the mean of the first n values."""
    return recur(df, [(out, "ema", x, n)], **keys)


def macd(df: DataFrame, x: str = "c", fast: int = 12, slow: int = 26, signal: int = 9, **keys) -> DataFrame:
    """Columns macd, macd_signal, macd_hist."""
    line = ("macd_signal", "ema", lambda known: known["fast_"] - known["slow_"], signal)
    found = recur(df, [("fast_", "ema", x, fast), ("slow_", "ema", x, slow), line], **keys)
    found = found.withColumn("macd", F.col("fast_") - F.col("slow_")).select(*df.columns, "macd", "macd_signal")
    return found.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(df: DataFrame, x: str = "c", n: int = 14, out: str = "rsi", by: str = "symbol", time: str = "d") -> DataFrame:
    """Wilder's relative strength; 100 without losses, 50 if nothing moved."""
    step = F.col(x) - F.lag(x).over(W.series(by, time))
    moves = df.withColumn("gain_", F.greatest(step, step * 0)).withColumn("loss_", F.greatest(-step, step * 0))
    found = recur(moves, [("up_", "wilder", "gain_", n), ("down_", "wilder", "loss_", n)], by=by, time=time)
    up, down = F.col("up_"), F.col("down_")
    value = F.when(down == 0, F.when(up == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide(up, down)))
    return found.withColumn(out, F.when(up.isNotNull(), value)).drop("gain_", "loss_", "up_", "down_")


def atr(df: DataFrame, n: int = 14, out: str = "atr", by: str = "symbol", time: str = "d") -> DataFrame:
    """Wilder average of the true range from the second bar on."""
    w = W.series(by, time)
    ranged = df.withColumn("tr_", F.when(F.lag("c").over(w).isNotNull(), W.true_range(F.col("h"), F.col("l"), F.col("c"), w)))
    return recur(ranged, [(out, "wilder", "tr_", n)], by=by, time=time).drop("tr_")


def adx(df: DataFrame, n: int = 14, by: str = "symbol", time: str = "d") -> DataFrame:
    """Columns plus_di, minus_di, adx."""
    w = W.series(by, time)
    up, down = F.col("h") - F.lag("h").over(w), F.lag("l").over(w) - F.col("l")
    moved = (
        df.withColumn("tr_", F.when(F.lag("c").over(w).isNotNull(), W.true_range(F.col("h"), F.col("l"), F.col("c"), w)))
        .withColumn("pm_", F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)))
        .withColumn("mm_", F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)))
    )

    def directed(known: dict[str, np.ndarray]) -> np.ndarray:
        """100 * |plus - minus| / (plus + minus), where the range, and then the sum, is positive; else 0."""
        span = known["str_"]
        with np.errstate(divide="ignore", invalid="ignore"):
            plus, minus = (np.where(span > 0, 100 * known[c] / span, np.where(span == 0, 0.0, np.nan)) for c in ("spm_", "smm_"))
            total = plus + minus
            return np.where(total > 0, 100 * np.abs(plus - minus) / total, np.where(total == 0, 0.0, np.nan))

    found = recur(moved, [*[(f"s{c}", "wilder", c, n) for c in ("tr_", "pm_", "mm_")], ("adx", "wilder", directed, n)], by=by, time=time)
    span = F.col("str_")
    plus, minus = (F.when(span > 0, 100 * F.try_divide(F.col(c), span)).otherwise(F.when(span == 0, 0.0)) for c in ("spm_", "smm_"))
    return found.select(*df.columns, plus.alias("plus_di"), minus.alias("minus_di"), "adx")
