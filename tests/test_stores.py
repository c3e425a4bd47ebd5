"""Bar stores, ordered reads, panels and routing: what is read, what is pruned, and results against plain walks."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same

from tidebook.plans import flows
from tidebook.sources import stores as B
from tidebook.streaming import routing as R
from tidebook.streaming import ticks as T

DAY = dt.date(2024, 1, 1)
BARS = "sid long, d date, c double, v long"


def bars_of(seed, sids=130, days=40):
    rng = random.Random(seed)
    rows = [(s, DAY + dt.timedelta(i), round(rng.uniform(1, 99), 2), rng.randrange(9)) for s in range(sids) for i in range(days) if rng.random() < 0.6]
    return rows + [(7, DAY + dt.timedelta(1000 + i), 5.0, 1) for i in range(500)]  # one has many more


def files(path):
    return sorted(p for p in path.rglob("*.parquet"))


@pytest.fixture
def store(spark, tmp_path):
    rows = bars_of(1)
    B.write_bars(spark.createDataFrame(rows, BARS), str(tmp_path / "store"))
    return rows, tmp_path / "store"


def test_few_instruments_read_few_partitions(spark, store):
    rows, path = store
    catalogue = spark.createDataFrame([(s, "x" if s in range(50, 75) else "y") for s in range(130)], "sid long, kind string")
    catalogue.write.parquet(str(path.parent / "catalogue"))
    wanted = spark.read.parquet(str(path.parent / "catalogue")).where("kind = 'x'")
    got = B.read_bars(spark, str(path), wanted)
    for f in files(path):  # whoever opens another partition's file fails
        if f.parent.name != "batch=2":
            f.write_bytes(b"x" * f.stat().st_size)
            f.with_name(f".{f.name}.crc").unlink()
    assert sorted(map(tuple, got.select("sid", "d", "c", "v").collect())) == sorted(r for r in rows if 50 <= r[0] < 75)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="(?i)parquet"):
        spark.read.schema("sid long, d date, c double, v long, batch long").parquet(str(path)).collect()


def test_files_of_the_store_do_not_overlap(store):
    _, path = store
    for folder in path.glob("batch=*"):
        ranges = []
        for f in files(folder):
            t = pq.read_table(f, columns=["sid", "d"], partitioning=None).to_pylist()
            keys = [(r["sid"], r["d"]) for r in t]
            assert keys == sorted(keys)
            ranges.append((keys[0], keys[-1]))
        ranges.sort()
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_series_stream_through_in_order(spark, store, monkeypatch):
    rows, path = store
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # series go over many batches

    def step(state, row):
        n = 1 if state is None else state["n"] + 1
        late = state is not None and row["d"] <= state["last"]
        return {"sid": row["sid"], "n": n, "last": row["d"], "total": row["c"] + (0 if state is None else state["total"]), "late": late or (state or {}).get("late", False)}

    try:
        got = B.fold_series(spark, str(path), step, "sid long, n long, last date, total double, late boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(list)
    for s, d, c, _ in sorted(rows):
        want[s].append((d, c))
    assert {r.sid for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert (r.n, r.last, r.late) == (len(want[r.sid]), want[r.sid][-1][0], False)
        assert r.total == pytest.approx(sum(c for _, c in want[r.sid]))


def test_panel_round_trip_and_row_groups(spark, tmp_path):
    rows = bars_of(2)
    B.write_panel(spark.createDataFrame(rows, BARS), str(tmp_path / "panel"), width=20)
    got = B.read_panel(spark, str(tmp_path / "panel"))
    assert sorted(map(tuple, got.collect())) == sorted(r[:3] for r in rows)
    for folder in (tmp_path / "panel").glob("group=*"):
        ranges = []
        for f in files(folder):
            meta = pq.ParquetFile(f)
            assert meta.schema_arrow.names == ["d", *[f"p{i}" for i in range(20)]]
            for k in range(meta.metadata.num_row_groups):
                s = meta.metadata.row_group(k).column(0).statistics
                ranges.append((s.min, s.max))
        ranges.sort()
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_a_panels_task_has_a_bounded_number_of_bars(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "PANEL_ROWS", 100, raising=False)
    rows = bars_of(4)  # 3600 in 7 groups; 500 more of one instrument
    B.write_panel(spark.createDataFrame(rows, BARS), str(tmp_path / "panel"), width=20)
    assert sorted(map(tuple, B.read_panel(spark, str(tmp_path / "panel")).collect())) == sorted(r[:3] for r in rows)
    made = defaultdict(int)  # a task's files have its number
    for f in files(tmp_path / "panel"):
        places = pq.read_table(f, partitioning=None).drop_columns(["d"])
        made[f.name.split("-")[1]] += sum(len(c) - c.null_count for c in places.columns)
    assert sum(made.values()) == len(rows) and len(made) > len(rows) / 200 and max(made.values()) < 300
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_messages_go_to_their_owners_subscriptions(spark, tmp_path):
    rng = random.Random(3)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    messages = [(rng.choice(["p", "q", None]), rng.choice(["a", "a", "b", None]), at(m), m) for m in range(0, 600, 3)]
    subs = [(i, rng.choice(["p", "q"]), rng.choice(["a", "b"]), at(m), at(m + rng.choice([-5, 0, 20, 200, 4000]))) for i, m in enumerate(range(0, 590, 25))]
    kinds = "owner string, symbol string, ts timestamp, payload int", "subscription_id int, owner string, symbol string, valid_from timestamp, valid_to timestamp"
    for part in range(4):
        # subscriptions of a part come up to 20 minutes after the messages that they are for
        now = [m for m in messages if part * 150 <= m[3] < part * 150 + 150]
        known = [s for s in subs if part * 150 - 20 <= (s[3] - at(0)).total_seconds() / 60 < part * 150 + 130 or (part == 3 and s[3] >= at(580))]
        for rows, kind, name in ((now, kinds[0], "m"), (known, kinds[1], "s")):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        m, s = (spark.readStream.schema(kind).parquet(str(tmp_path / name)) for kind, name in zip(kinds, "ms", strict=True))
        got = T.to_folder(R.routed(m, s), str(tmp_path / "out"))
    want = []
    for owner, symbol, ts, payload in messages:
        for i, s_owner, s_symbol, since, until in subs:
            if owner == s_owner and symbol == s_symbol and since <= ts < min(until, since + dt.timedelta(days=1)):
                want.append((i, owner, symbol, ts, payload))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_routing_writes_what_came_and_not_each_delivery(spark, tmp_path, monkeypatch):
    n = 1200  # in two hours, one owner and symbol: 60 subscriptions that hold for hours
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=6 * i) for i in range(n)]
    table = {"event_id": range(n), "ts": pa.array(ts, pa.timestamp("us")), "user_id": [4] * n, "event_type": ["view"] * n, "value": [1.0] * n}
    data, shared = tmp_path / "data", tmp_path / "shared"
    data.mkdir()
    pq.write_table(pa.table(table), data / "events.parquet")
    monkeypatch.setattr(flows.sinks, "shared_folder", lambda _, name: str(shared / name))
    got = flows.st04(spark, str(data))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    assert got.count() == sum(n - i for i in range(0, n, 20))
    assert_same(got, con, flows.ORACLES["st04_routed"])
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files(shared)) == n + n // 20
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # a subscription is a row for each of its hours
