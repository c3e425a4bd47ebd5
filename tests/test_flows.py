"""Running totals, paced admission, capped recordings and leases against plain walks."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebook.operators import leases as L
from tidebook.operators import pacing as P
from tidebook.operators import scans as S

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("slices", [1, 3, 8])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_totals_equal_a_walk(spark, slices, by):
    rng = random.Random(slices)
    # one key has most rows, one time has a third of them, and there are nulls everywhere
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 5.0, 5.0, rng.uniform(0, 9)]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t double, i int, v int")
    totals = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "n": ("count", F.col("v"))}
    got = {r.i: (r.total, r.top, r.n) for r in S.running(S.sliced(df, "t", slices), ["t", "i"], totals, by).collect()}
    seen = defaultdict(list)
    for k, _, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        seen[k if by else 0] += [v] if v is not None else []
        mine = seen[k if by else 0]
        assert got[i] == ((sum(mine), max(mine), len(mine)) if mine else (None, None, 0)), i


def test_running_has_no_window_over_everything(spark, small):
    df = S.sliced(spark.read.parquet(f"{small}/events.parquet"), "ts", 4)
    found = S.running(df, ["ts", "event_id"], {"n": ("count", F.lit(1))})
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "windowspecdefinition(" in line]
    assert windows and all("windowspecdefinition(slice_" in line for line in windows)
    assert sorted(r.n for r in found.collect()) == list(range(1, found.count() + 1))


def test_times_and_names(spark):
    with pytest.raises(ValueError, match="neither a number nor a time"):
        S.sliced(spark.createDataFrame([("x",)], "t string"), "t")
    times = [START + timedelta(microseconds=m) for m in (0, 1, 999_999, 86_399_999_999)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    base = int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert [r.m - base for r in df.select(S.micros(F.col("t")).alias("m")).collect()] == [0, 1, 999_999, 86_399_999_999]
    assert S.running(S.sliced(spark.createDataFrame([], "t double"), "t"), ["t"], {"n": ("count", F.lit(1))}).count() == 0


@pytest.mark.parametrize(("limit", "seconds"), [(50, 600), (3, 40), (1, 7)])
def test_admissions_equal_a_walk(spark, limit, seconds):
    rng = random.Random(limit)
    at, rows = 0.0, []
    for i in range(500):
        at += rng.choice([0, 0, 0, rng.expovariate(1 / 20), 900 if i % 170 == 169 else 0])
        rows.append((i, rng.choice("aab"), START + timedelta(microseconds=int(at * 1e6))))
    df = spark.createDataFrame(rows, "i int, symbol string, arrival timestamp_ntz")
    for by in ([], ["symbol"]):
        got = {r.i: r.admitted for r in P.admissions(df, ["arrival", "i"], by=by, limit=limit, seconds=seconds).collect()}
        queues = defaultdict(list)
        for i, symbol, arrival in rows:
            mine = queues[symbol if by else 0]
            mine.append(max(arrival, mine[-limit] + timedelta(seconds=seconds)) if len(mine) >= limit else arrival)
            assert got[i] == mine[-1]


@pytest.mark.parametrize(("frames", "closes"), [(5000, 2_000_000), (40, 10_000), (40, 60), (7, 9)])
def test_recorded_sessions_equal_a_walk(spark, frames, closes):
    rng = random.Random(frames)
    events = []
    for d in range(200):
        for symbol in "abc":
            if rng.random() < 0.9 or symbol == "a":
                events.append((d, symbol, "bar"))
        if rng.random() < 0.05:
            events.append((d, "b", rng.choice(["signal", "fill"])))
    got = P.recorded(spark.createDataFrame(events, "d int, symbol string, event string"), frames=frames, closes=closes).orderBy("d").collect()
    every, bars_every = P.record_steps(200, 3, frames, closes)
    kept = 0
    for i, r in enumerate(got):
        mine = [e for d, _, e in events if d == i]
        eventful = i == 199 or "signal" in mine or "fill" in mine
        keep = eventful or i % every == 0
        bars = eventful or (keep and i // every % bars_every == 0)
        kept += mine.count("bar") if bars else 0
        assert (r.d, r.session, r.eventful, r.keep, r.keep_bars, r.closes, r.kept_closes) == (i, i, eventful, keep, bars, mine.count("bar"), kept)
    plain = [r for r in got if not r.eventful]
    assert sum(r.keep for r in plain) <= frames and sum(r.closes for r in plain if r.keep_bars) <= closes


def renewals(seed, n=300, days=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at = START + timedelta(minutes=rng.randrange(days * 24 * 60) // 30 * 30)
        rows.append((rng.choice(["x", "x", "y"]), rng.choice([1, 2]), at, at + timedelta(minutes=rng.choice([0, 30, 300, 2000, 20_000]))))
    return rows


def valid_by_hand(rows):
    """Minute by minute: the last renewal up to then decides."""
    found = []
    for key in sorted({r[:2] for r in rows}):
        mine = {}
        for r in rows:
            if r[:2] == key:
                mine[r[2]] = max(mine.get(r[2], r[3]), r[3])
        stretch = None
        for at, end in sorted(mine.items()):
            if stretch and stretch[1] >= at:
                stretch[1] = end
            else:
                found += [(*key, *stretch)] if stretch and stretch[1] > stretch[0] else []
                stretch = [at, end]
        found += [(*key, *stretch)] if stretch and stretch[1] > stretch[0] else []
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_intervals_equal_a_walk(spark, seed, monkeypatch):
    rows = renewals(seed)
    df = spark.createDataFrame(rows, "symbol string, consumer int, at timestamp_ntz, expires_at timestamp_ntz")
    want = valid_by_hand(rows)
    for days in (1, 7, 1000):
        monkeypatch.setattr(L, "SLICE_DAYS", days)
        got = L.valid_intervals(df, ["symbol", "consumer"])
        assert sorted((r.symbol, r.consumer, r.start, r.end) for r in got.collect()) == want
    assert sum(r.renewals for r in got.collect()) <= len(rows)
    # a line is active at a time if any lease is valid then
    moments = sorted({t for r in want for t in r[2:]})
    changes = []
    for symbol in ("x", "y"):
        before = False
        for t in moments:
            now = any(r[0] == symbol and r[2] <= t < r[3] for r in want)
            changes += [(symbol, t, "active" if now else "expired")] if now != before else []
            before = now
    assert sorted(map(tuple, L.line_changes(got, "symbol").collect())) == sorted(changes)
    now = "2024-01-20 10:00:00"
    moment = datetime.fromisoformat(now)
    last = {}
    for r in sorted((r for r in rows if r[2] <= moment), key=lambda r: (r[2], r[3])):
        last[r[:2]] = r[2:]
    assert sorted(map(tuple, L.open_leases(df, ["symbol", "consumer"], now).collect())) == sorted((*k, *v) for k, v in last.items() if v[1] > moment)


def test_leases_without_a_time_do_nothing(spark):
    df = spark.createDataFrame([("x", 1, None, START), ("x", 1, START, None)], "symbol string, consumer int, at timestamp_ntz, expires_at timestamp_ntz")
    assert L.valid_intervals(df, ["symbol", "consumer"]).count() == 0
