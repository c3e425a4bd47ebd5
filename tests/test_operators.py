"""Market operators on hand-made rows: as-of joins, facts, actions, rules, composition, trades, allocation, streams."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import rules as S
from tidebook.operators import actions as C
from tidebook.operators import allocation as A
from tidebook.operators import facts as P
from tidebook.operators import performance as B
from tidebook.operators.asof import asof
from tidebook.plans.strategy import TEMPLATES, Component, Strategy, compose
from tidebook.sources import sinks as K
from tidebook.sources import views as V
from tidebook.streaming import ticks as T

DAY = dt.date(2024, 1, 1)
day = lambda i: DAY + dt.timedelta(i)
FACTS = "sid long, concept string, period_start date, period_end date, filed_at date, value double, provider string"
BARS = "symbol string, d date, o double, h double, l double, c double, v long"


def series(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, day(i), c, c, c, c, 100) for i, c in enumerate(closes)], BARS)


def test_asof_backward_strict_forward_and_stale(spark):
    left = spark.createDataFrame([("a", day(i)) for i in (0, 5, 9, 40)] + [("b", day(5))], "k string, t date")
    right = spark.createDataFrame([("a", day(5), 1.0), ("a", day(8), 2.0)], "k string, u date, x double")
    values = lambda **kw: [r.x for r in asof(left, right, ["k"], "t", "u", ["x"], **kw).orderBy("k", "t").collect()]
    assert values() == [None, 1.0, 2.0, 2.0, None]
    assert values(strict=True) == [None, None, 2.0, 2.0, None]
    assert values(forward=True) == [1.0, 1.0, None, None, None]
    assert values(tolerance_days=20) == [None, 1.0, 2.0, None, None]


def test_a_restated_figure_is_seen_from_its_first_filing(spark):
    rows = [(1, "revenue", day(0), day(90), day(100), 10.0, "sec"), (1, "revenue", day(0), day(90), day(400), 11.0, "sec"), (1, "revenue", day(91), day(181), day(190), 20.0, "sec")]
    asked = spark.createDataFrame([(1, day(i)) for i in (99, 100, 189, 190, 401, 700)], "sid long, on date")
    got = P.value_on(asked, spark.createDataFrame(rows, FACTS), "on", "revenue").orderBy("on").collect()
    assert [r.value for r in got] == [None, 10.0, 10.0, 20.0, 20.0, None]  # the newer period stays; too old is unknown


@pytest.mark.parametrize("seed", range(2))
def test_steps_equal_a_plain_recomputation(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        end = day(90 * rng.randrange(6))
        rows.append((rng.randrange(3), "revenue", end - dt.timedelta(90), end, end + dt.timedelta(rng.randrange(1, 300)), float(rng.randrange(50)), "sec"))
    facts = spark.createDataFrame(rows, FACTS)
    got = {(r.sid, r.filed_at): (r.period_end, r.value) for r in P.steps(facts).collect()}
    want = {}
    for sid in range(3):
        own, last = [r for r in rows if r[0] == sid], None
        for filed in sorted({r[4] for r in own}):
            best = max((r[3], r[4], r[2], r[5]) for r in own if r[4] <= filed)
            if best != last:
                want[sid, filed] = (best[0], best[3])
            last = best
    assert got == want


def test_vendor_facts_only_where_there_is_no_filing(spark):
    rows = [(1, "revenue", None, day(0), day(1), 1.0, "sec"), (1, "revenue", None, day(0), day(1), 2.0, "vendor"), (1, "equity", None, day(0), day(1), 3.0, "vendor"), (2, "revenue", None, day(0), day(1), 4.0, "vendor")]
    assert sorted(r.value for r in P.preferred(spark.createDataFrame(rows, FACTS)).collect()) == [1.0, 3.0, 4.0]


def test_split_and_dividend_on_one_bar(spark):
    bars = series(spark, [100.0, 100.0, 50.0, 50.0])
    rows = [("A", day(2), "dividend", None, 1.0), ("A", day(2), "split", 2.0, None), ("A", day(0), "split", 9.0, None), ("A", day(9), "split", 9.0, None)]
    acts = spark.createDataFrame(rows, "symbol string, ex_date date, action_type string, split_ratio double, dividend double")
    got = C.adjust(bars, acts).orderBy("d").collect()
    assert [r.c for r in got] == pytest.approx([100 * 0.5 * 0.98] * 2 + [50.0] * 2)  # the dividend is per new share
    assert [r.v for r in got] == [200, 200, 100, 100] and [r.raw_close for r in got] == [100.0, 100.0, 50.0, 50.0]
    assert [r.c for r in C.adjust(bars, acts, "none").orderBy("d").collect()] == [100.0, 100.0, 50.0, 50.0]


def test_equal_actions_count_each_whatever_their_number(spark, monkeypatch):
    bars = series(spark, [10.0, 10.0, 10.0, 10.0])
    acts = [("A", day(2), "dividend", None, 1.0)] * 2 + [("A", day(1), "split", 2.0, None), ("A", day(1), "dividend", None, 0.5)]
    df = spark.createDataFrame(acts, "symbol string, ex_date date, action_type string, split_ratio double, dividend double")
    few = [r.c for r in C.adjust(bars, df).orderBy("d").collect()]
    assert few[1:] == pytest.approx([8.1, 10.0, 10.0])
    monkeypatch.setattr(C, "FEW", 0)
    assert [r.c for r in C.adjust(bars, df).orderBy("d").collect()] == pytest.approx(few)


def test_flat_series_fire_no_crosses(spark):
    flat = series(spark, [7.0] * 80)
    for name in ("sma_crossover", "rsi_threshold", "ema_crossover", "macd_crossover", "bollinger_reversion", "zscore_reversion"):
        assert S.events(flat, name).count() == 0, name


@pytest.mark.parametrize("name", sorted(S.RULES))
def test_no_rule_looks_ahead(spark, small, name):
    """Events of a truncated series are the truncated events of the whole series."""
    bars = V.daily_bars(spark, small).where("symbol = '1-URGENT'").orderBy("d").limit(260)
    cut = bars.agg(F.max("d")).first()[0] - dt.timedelta(60)
    whole = S.events(bars, name).where(F.col("d") <= cut).orderBy("d").collect()
    short = S.events(bars.where(F.col("d") <= cut), name).orderBy("d").collect()
    key = lambda rows: [(r.d, r.direction, round(r.trigger, 6)) for r in rows]
    assert key(whole) == key(short) and all(r.data_window_end <= r.d for r in whole)


def test_rules_refuse_unknown_parameters():
    with pytest.raises(ValueError, match="no parameters"):
        S.RULES["breakout"].params(width=3)


def test_strategies_are_validated():
    assert all(not s.problems() and s.lookback() > 0 for s in TEMPLATES.values())
    bad = Strategy("x", (Component("nope", "entry"), Component("volume_spike", "exit"), Component("breakout", "filter", weight=0)), "most", window=0)
    assert len(bad.problems()) >= 5


def test_contradictions_give_no_view(spark):
    rise = series(spark, [1.0] * 25 + [2.0, 2.0])
    both = Strategy("both", (Component("breakout", "entry"), Component("breakout", "entry", invert=True)), "any")
    assert compose(rise, both).count() == 0
    one = compose(rise, Strategy("one", (Component("breakout", "entry"),), "any")).collect()
    assert [(r.d, r.kind, r.direction) for r in one] == [(day(25), "entry", "bullish")]


def test_trades_and_sleeves(spark):
    bars = series(spark, [10.0, 20.0, 10.0, 30.0, 60.0])
    signals = spark.createDataFrame([("A", day(i), x) for i, x in ((0, -1), (1, 1), (2, 1), (3, -1), (4, 1))], "symbol string, d date, direction int")
    trades = B.pair_trades(signals, bars)
    assert [(r.entry_d, r.exit_d, r.return_pct, r.is_open) for r in trades.orderBy("entry_d").collect()] == [(day(1), day(3), 0.5, False), (day(4), None, 0.0, True)]
    assert [r.value for r in B.sleeves(trades, bars).orderBy("d").collect()] == [1.0, 1.0, 0.5, 1.5, 1.5]


def test_equity_carries_sleeves_forward(spark):
    rows = [("A", day(0), 1.0), ("A", day(2), 2.0), ("B", day(1), 3.0)]
    got = B.combine(spark.createDataFrame(rows, "symbol string, d date, value double"), 100.0).orderBy("d").collect()
    assert [r.equity for r in got] == [100.0, 200.0, 250.0]
    assert [round(r.drawdown, 6) for r in B.drawdowns(spark.createDataFrame([(day(0), 90.0), (day(1), 120.0), (day(2), 60.0)], "d date, equity double"), 100.0).orderBy("d").collect()] == [-0.1, 0.0, -0.5]


def test_allocation_by_hand(spark):
    rows = [(DAY, "A", 1, 0.9, 0.1), (DAY, "B", -1, 0.3, 0.2), (DAY, "C", 1, 0.3, None), (DAY, "D", 1, 1.5, 0.1), (DAY, "E", 1, 0.05, 0.1)]
    signals = spark.createDataFrame(rows, "d date, symbol string, direction int, score double, volatility double")
    by_symbol = lambda df: {r.symbol: r.excluded or pytest.approx(r.weight) for r in df.collect()}
    assert by_symbol(A.target_weights(signals, "signal_strength", 1.0, 0.1)) == {"A": 0.6, "B": -0.2, "C": 0.2, "D": "invalid_score", "E": "min_score"}
    assert by_symbol(A.target_weights(signals, "signal_strength", 1.0, 0.1, cap=0.5)) == {"A": 0.5, "B": -0.25, "C": 0.25, "D": "invalid_score", "E": "min_score"}
    assert by_symbol(A.target_weights(signals, "equal_active", 0.9, 0.1, max_positions=2)) == {"A": 0.45, "B": -0.45, "C": "max_positions", "D": "invalid_score", "E": "min_score"}
    assert by_symbol(A.target_weights(signals, "signal_inverse_volatility", 1.0, 0.1))["C"] == "no_volatility"


def test_rebalance_closes_first(spark):
    targets = spark.createDataFrame([(DAY, "A", 0.5), (DAY, "B", 0.11)], "d date, symbol string, weight double")
    held = spark.createDataFrame([(DAY, "B", 0.1), (DAY, "C", 0.2)], "d date, symbol string, held double")
    got = {r.symbol: r.delta for r in A.rebalance(targets, held, 0.05, 0.4).collect()}
    assert got == {"A": pytest.approx(0.2), "C": pytest.approx(-0.2)}


def test_publishing_members_is_checked(spark, tmp_path):
    known = spark.createDataFrame([(1,), (2,)], "sid long")
    assert K.publish_members(known, known, str(tmp_path / "m"), "all", "2024-01-31") == 2
    with pytest.raises(ValueError, match="unknown"):
        K.publish_members(spark.createDataFrame([(3,)], "sid long"), known, str(tmp_path / "m"), "all", "2024-02-29")
    with pytest.raises(ValueError, match="repeated"):
        K.publish_members(known.unionAll(known), known, str(tmp_path / "m"), "all", "2024-02-29")


def test_a_snapshot_is_published_once(spark, tmp_path):
    known, path = spark.createDataFrame([(1,), (2,)], "sid long"), str(tmp_path / "m")
    assert K.publish_members(known, known, path, "all", "2024-01-31") == 2
    with pytest.raises(ValueError, match="published already"):
        K.publish_members(known, known, path, "all", "2024-01-31")
    assert K.publish_members(known, known, path, "all", "2024-02-29") == 2 and K.publish_members(known, known, path, "few", "2024-01-31") == 2
    assert spark.read.parquet(path).count() == 6


def test_content_hash_ignores_order(spark):
    df = spark.range(100)
    assert K.content_hash(df) == K.content_hash(df.orderBy(F.desc("id"))) != K.content_hash(spark.range(99))


def batches(spark, folder, parts, schema):
    """A stream that gives each part as a micro-batch of its own."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def at(s):
    return dt.datetime(2024, 1, 1, 10) + dt.timedelta(seconds=s)


TICKS = "symbol string, ts timestamp, price double, cum long"


def test_rolled_bars_over_several_batches(spark, tmp_path):
    """A minute closes with the next tick; the first is dropped; volume is the growth of the cumulative volume."""
    rows = [("A", at(5), 1.0, 10), ("A", at(61), 2.0, 15), ("A", at(70), 4.0, 18), ("A", at(119), 3.0, 20), ("A", at(125), 5.0, 26), ("A", at(30), 9.0, 11), ("A", at(200), 6.0, 30)]
    stream = batches(spark, tmp_path / "in", (rows[:3], rows[3:5], rows[5:6], rows[6:]), TICKS)  # the tick at 30 is of a closed bar
    out = str(tmp_path / "out")
    want = [(2.0, 4.0, 2.0, 3.0, 10), (5.0, 5.0, 5.0, 5.0, 6)]
    assert [(r.o, r.h, r.l, r.c, r.v) for r in T.to_folder(stream, out, fold=T.rolled_bars()).orderBy("t").collect()] == want
    commits = sorted((tmp_path / "out" / "checkpoint" / "commits").glob("*3*"))
    for f in commits:  # the last batch and its state were written, but the commit was lost
        f.unlink()
    assert commits and [(r.o, r.h, r.l, r.c, r.v) for r in T.to_folder(stream, out, fold=T.rolled_bars()).orderBy("t").collect()] == want


def test_forgotten_symbols_close_their_bar(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", ([("A", at(0), 1.0, 10), ("A", at(60), 2.0, 15)], [("B", at(400), 1.0, 1)], [("A", at(460), 3.0, 90)]), TICKS)
    got = T.to_folder(stream, str(tmp_path / "out"), fold=T.rolled_bars(forget=200)).collect()
    assert [(r.symbol, r.c, r.v) for r in got] == [("A", 2.0, 5)]


def test_changes_over_several_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, at(i * 997), float(rng.randrange(3))) for i in range(120) for s in "AB"]
    want, last = [], {}
    for s, ts, price in rows:
        if last.get(s) != price:
            want.append((s, ts, price))
            last[s] = price
    parts = [rows[:70], rows[70:75], rows[75:]]
    for part in parts:
        rng.shuffle(part)
    stream = batches(spark, tmp_path / "in", parts, "symbol string, ts timestamp, price double")
    got = T.to_folder(stream, str(tmp_path / "out"), fold=T.changes()).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bars_out_of_order_are_refused(spark, tmp_path):
    schema = "symbol string, d date, c double, run_id int"
    day = lambda n: dt.date(2024, 1, n)
    good = [[("A", day(2), 1.0, 1), ("A", day(2), 2.0, 2), ("A", day(3), 3.0, 1)], [("A", day(3), 9.0, 3), ("A", day(4), 4.0, 3), ("B", day(1), 1.0, 1)]]
    got = T.to_folder(batches(spark, tmp_path / "good", good, schema), str(tmp_path / "one"), fold=T.in_order()).collect()
    assert sorted(map(tuple, got)) == [("A", day(2), 1.0), ("A", day(3), 3.0), ("A", day(4), 4.0), ("B", day(1), 1.0)]
    bad = batches(spark, tmp_path / "bad", [good[1], [("A", day(2), 1.0, 4)]], schema)
    with pytest.raises(Exception, match="bar of 2024-01-02 after 2024-01-04"):
        T.to_folder(bad, str(tmp_path / "two"), fold=T.in_order())


def test_a_stream_without_rows_reads_as_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))
    assert T.to_folder(stream, str(tmp_path / "out"), fold=T.rolled_bars()).count() == 0


def test_complete_output_stays_when_nothing_new_comes(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double"
    folder, out = tmp_path / "in", str(tmp_path / "out")
    run = lambda: sorted(map(tuple, T.to_folder(T.conflate(spark.readStream.schema(schema).parquet(str(folder))), out, "complete").select("symbol", "price").collect()))
    add = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(folder))
    add([("a", dt.datetime(2024, 1, 1), 1.0), ("b", dt.datetime(2024, 1, 1), 2.0)])
    assert run() == [("a", 1.0), ("b", 2.0)]
    assert run() == [("a", 1.0), ("b", 2.0)]
    add([("a", dt.datetime(2024, 1, 2), 3.0)])
    assert run() == [("a", 3.0), ("b", 2.0)]
    assert run() == run() == [("a", 3.0), ("b", 2.0)]


def test_old_state_is_removed(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    for i in range(4):
        spark.createDataFrame([("a", dt.datetime(2024, 1, 1, i), float(i))], "symbol string, ts timestamp, price double").write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(str(folder))
        got = T.to_folder(stream, str(out), fold=T.changes())
    assert got.count() == 4 and sorted(p.name for p in (out / "state").iterdir()) == ["batch=2", "batch=3"]
