"""Averages that are carried on have the same bits as those of the whole series, wherever it is cut."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from tidebook.functions import recurrences as R
from tidebook.sources import views as V
from tidebook.streaming import averages as A
from tidebook.streaming import ticks as T


def plain(values, n, kind):
    """One value after the other."""
    out, row, now, ended = [], [], None, False
    a = 2 / (n + 1) if kind == "ema" else 1 / n
    for x in values:
        if ended or np.isnan(x):
            ended = ended or now is not None
            row, now = [], None
        elif now is None:
            row.append(x)
            now = sum(row) / n if len(row) == n else None
        else:
            now += a * (x - now)
        out.append(np.nan if now is None else now)
    return np.array(out)


def series(seed, n, holes=()):
    rng = np.random.default_rng(seed)
    values = np.round(100_000 + rng.normal(0, 30_000, n).cumsum(), 2)
    values[list(holes)] = np.nan
    return values


@pytest.mark.parametrize("kind", ["ema", "wilder"])
@pytest.mark.parametrize("holes", [(), (0,), (3, 9), (150,), (0, 1, 2)])
def test_every_cut_gives_the_same_bits(kind, holes):
    values = series(len(holes), 200, holes)
    whole = R.average(values, 14, kind)
    np.testing.assert_allclose(whole, plain(values, 14, kind), rtol=1e-9)
    for cut in range(201):
        state = R.Carried()
        parts = np.concatenate([R.average(values[:cut], 14, kind, state), R.average(values[cut:], 14, kind, state)])
        assert parts.tobytes() == whole.tobytes(), cut


@pytest.mark.parametrize("seed", range(20))
def test_many_cuts_give_the_same_bits(seed):
    rng = random.Random(seed)
    values = series(seed, 700)
    cuts = sorted(rng.randrange(701) for _ in range(rng.choice([3, 40, 300])))
    state, parts = R.Carried(), []
    for a, b in zip([0, *cuts], [*cuts, 700], strict=True):
        parts.append(R.average(values[a:b], 20, "ema", state))
    assert np.concatenate(parts).tobytes() == R.average(values, 20, "ema").tobytes()


def test_a_stream_has_the_bits_of_the_batch(spark, small, tmp_path):
    bars = V.daily_bars(spark, small).where("d < DATE'1997-01-01'").persist()
    days = sorted(r.d for r in bars.select("d").distinct().collect())
    cuts = [days[0], days[5], days[6], days[len(days) // 2], days[-1] + dt.timedelta(1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        # the day before comes again, and is ignored
        part = bars.where((bars.d >= a - dt.timedelta(1)) & (bars.d < b))
        part.write.mode("append").parquet(str(tmp_path / "log"))
        got = T.to_folder(A.incremental(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "log"))), str(tmp_path / "out"))
    want = R.recur(R.atr(bars), [("ema", "ema", "c", 20)]).select("symbol", "d", "atr", "ema")
    assert sorted(map(tuple, got.select("symbol", "d", "atr", "ema").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.where("atr IS NOT NULL").count() > 100


def test_odd_bars(spark, tmp_path):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    rows = [("a", day(i), 2.0, 1.0, 1.5) for i in range(30)] + [("a", None, 9.0, 9.0, 9.0), ("a", day(3), 9.0, 9.0, 9.0), ("b", day(0), None, None, None), (None, day(1), 1.0, 1.0, 1.0)]
    schema = "symbol string, d date, h double, l double, c double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "log"))
    got = T.to_folder(A.incremental(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))), str(tmp_path / "out")).collect()
    assert len(got) == 32 and {r.atr for r in got if r.symbol == "a"} == {None, 1.0} and {r.ema for r in got if r.symbol == "b"} == {None}
