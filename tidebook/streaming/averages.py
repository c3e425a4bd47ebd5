"""Moving averages that go on from micro-batch to micro-batch: what Spark keeps for a symbol is where its series stands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebook.functions.recurrences import Carried, average

ROWS = "symbol string, d date, atr double, ema double"
_AVERAGE = "{0}_waiting array<double>, {0}_seed double, {0}_before double, {0}_own double, {0}_at int, {0}_ended boolean"
STATE = f"last date, close double, {_AVERAGE.format('atr')}, {_AVERAGE.format('ema')}"


def incremental(bars: DataFrame, atr: int = 14, ema: int = 20) -> DataFrame:
    """Average true range and exponential average of closes of a stream of bars: symbol, d, atr, ema.

    The values have the bits of the batch columns over all bars, wherever the stream is cut into batches.  A symbol's
    bars of one batch are sorted in one task.  Bars of a day that the symbol is past are ignored, as are those without
    a day; of several bars of a day in a batch the one of the smallest close stays.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, close, kept = (None, None, [Carried(), Carried()])
        if state.exists:
            last, close, *rest = state.get
            kept = [Carried(list(w), s, b, o, a, e) for w, s, b, o, a, e in (rest[:6], rest[6:])]
        new = pd.concat(list(frames)).dropna(subset="d").sort_values(["d", "c"]).drop_duplicates("d")
        if last is not None:
            new = new[new["d"] > last]
        if not len(new):
            return
        h, low, c = (new[x].to_numpy(dtype=np.float64) for x in ("h", "l", "c"))
        before = np.concatenate([[np.nan if close is None else close], c[:-1]])
        ranges = np.where(np.isnan(before), np.nan, np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before))))
        found = [average(ranges, atr, "wilder", kept[0]), average(c, ema, "ema", kept[1])]
        fields = [x for k in kept for x in (k.waiting, k.seed, k.before, k.own, k.at, k.ended)]
        state.update((new["d"].iloc[-1], None if np.isnan(c[-1]) else float(c[-1]), *fields))
        yield pd.DataFrame({"symbol": key[0], "d": new["d"], "atr": found[0], "ema": found[1]})

    return bars.select("symbol", "d", "h", "l", "c").groupBy("symbol").applyInPandasWithState(run, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)
