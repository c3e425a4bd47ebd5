"""Constraint grammar, indicator registry, sinks that run a batch again, block recurrences against a plain walk."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebook.functions import recurrences as R
from tidebook.functions import registry as G
from tidebook.operators import screens as X
from tidebook.streaming import ticks as T


def test_constraints():
    assert X.parse_constraints(" a:1:2, b::3.5 ,c:-1:,", ("a", "b", "c")) == [X.Constraint("a", 1.0, 2.0), X.Constraint("b", None, 3.5), X.Constraint("c", -1.0, None)]
    assert X.parse_constraints(None, ()) == X.parse_constraints(" ", ()) == []
    for bad in ("a:1", "z:1:2", "a:x:2", "a:3:2", "a:1:2:3"):
        with pytest.raises(ValueError):
            X.parse_constraints(bad, ("a",))


def test_screen_without_constraints_accepts_all(spark):
    members = spark.createDataFrame([(1,), (2,)], "sid long")
    rows = X.screen_many(members, spark.createDataFrame([(1, 5.0)], "sid long, a double"), []).collect()
    assert [r.accepted for r in rows] == [True, True]


def test_leverage_and_published(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0.0, 5.0), (2, 1.0, 5.0), (3, 0.0, -5.0), (4, None, 5.0), (5, 1.0, None)], "k int, debt double, equity double")
    assert [r.x for r in rows.orderBy("k").select(X.leverage(F.col("debt"), F.col("equity")).alias("x")).collect()] == [0.0, 0.2, None, None, None]


def test_a_newest_figure_that_is_stale_is_unknown(spark):
    facts = spark.createDataFrame(
        [(1, "a", "2020-01-01", "2020-03-31", "2020-04-01", 1.0), (1, "a", "2019-01-01", "2019-12-31", "2020-12-01", 2.0)],
        "sid long, concept string, period_start string, period_end string, filed_at string, value double",
    ).selectExpr("sid", "concept", "to_date(period_start) AS period_start", "to_date(period_end) AS period_end", "to_date(filed_at) AS filed_at", "value")
    assert X.known_on(facts, "2020-12-31", ["a"], 60).first().a is None
    assert X.known_on(facts, "2020-12-31", ["a"]).first().a == 1.0
    assert X.known_on(facts, "2020-03-01", ["a"]).count() == 0


def test_registry(spark):
    assert G.indicator("macd").columns == ("macd", "macd_signal", "macd_hist") and G.indicator("sma", "1.0.0").lookback(n=7) == 7
    with pytest.raises(KeyError):
        G.indicator("none")
    with pytest.raises(ValueError):
        G.indicator("sma")(None, n=1)
    with pytest.raises(ValueError):
        G.indicator("sma")(None, n=2.5)
    with pytest.raises(ValueError):
        G.indicator("sma")(None, m=3)
    for odd in (dict(name="sma", version="1.0.0", scale="price", lookback=lambda n: n), dict(name="q", version="1.0.0", scale="none", lookback=lambda n: n), dict(name="q", version="1.0.0", scale="price", lookback=lambda n: 5)):
        with pytest.raises(ValueError):
            G.register_indicator(columns=("x",), n=G.Param(20, 2, 100), **odd)(None)
    G.register_indicator("own", "1.9.0", "price", ("x",), lambda n: n, n=G.Param(3, 2, 9))(lambda bars, n: bars)
    G.register_indicator("own", "1.10.0", "price", ("x",), lambda n: n, n=G.Param(3, 2, 9))(lambda bars, n: bars)
    assert G.indicator("own").version == (1, 10, 0)
    bars = spark.createDataFrame([("s", i, float(i)) for i in range(5)], "symbol string, d int, c double")
    assert [r.sma for r in G.indicator("sma")(bars, n=3).orderBy("d").collect()] == [None, None, 1.0, 2.0, 3.0]


def walk(values, n, kind):
    """Step by step."""
    out, held, now = [np.nan] * len(values), [], None
    for i, x in enumerate(values):
        if now is not None:
            if np.isnan(x):
                break
            now = now + 2.0 / (n + 1) * (x - now) if kind == "ema" else (now * (n - 1) + x) / n
        elif np.isnan(x):
            held = []
        else:
            held.append(x)
            if len(held) == n:
                now = sum(held) / n
        out[i] = np.nan if now is None else now
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.just(float("nan"))), max_size=300), st.integers(1, 30), st.sampled_from(["ema", "wilder"]))
def test_blocks_equal_a_walk(values, n, kind):
    assert np.allclose(R.average(np.array(values, dtype=float), n, kind), walk(values, n, kind), rtol=1e-9, atol=1e-6, equal_nan=True)


def test_a_batch_that_is_run_again_is_not_doubled(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("s", 1.0), ("s", 2.0)], "symbol string, price double").write.parquet(source)
    stream = spark.readStream.schema("symbol string, price double").parquet(source)
    out = str(tmp_path / "out")
    assert T.to_folder(stream, out).count() == 2
    commits = tmp_path / "out" / "checkpoint" / "commits"
    for f in commits.iterdir():  # the batch was written, but its commit was lost
        f.unlink()
    assert T.to_folder(stream, out).count() == 2
