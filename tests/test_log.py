"""The log: offsets, end markers, bounded reads, tails that go on where they stopped, and publishes that failed."""

from __future__ import annotations

import datetime as dt
import threading
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same

from tidebook.plans import streams as S
from tidebook.sources import log as L
from tidebook.streaming import ticks as T

KIND = "i int, text string"


def rows_of(df):
    return [tuple(r) for r in df.orderBy("offset").collect()]


def frame(spark, numbers):
    return spark.createDataFrame([(i, f"t{i}") for i in numbers], KIND).repartition(3)


def test_bounded_reads_end_at_the_logs_end_not_at_a_marker(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 4)
    path = str(tmp_path / "log")
    assert L.log_end(path) == (0, False) and L.whole_log(spark, path, KIND).count() == 0
    made = [L.publish(frame(spark, range(10)), path, ["i"]), L.publish(frame(spark, range(5, 12)), path, ["i"])]
    assert made == [L.Publish(0, 11, True, 4), L.Publish(11, 19, True, 4)]
    want = [(i, i, f"t{i}") for i in range(10)] + [(11 + k, i, f"t{i}") for k, i in enumerate(range(5, 12))]
    assert rows_of(L.whole_log(spark, path, KIND)) == want  # what comes twice is there twice
    assert [len(L.segments(path, *r)) for r in ((0, 19), (3, 4), (3, 5), (10, 12), (18, 18))] == [5, 1, 2, 2, 0]


def test_a_failed_publish_is_not_there_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    L.publish(frame(spark, range(3)), path, ["i"])
    with monkeypatch.context() as m:
        m.setattr(L.Publish, "name", property(lambda self: 1 / 0))  # dies before the range is named
        with pytest.raises(ZeroDivisionError):
            L.publish(frame(spark, range(50, 90)), path, ["i"])
    assert [r[1] for r in rows_of(L.whole_log(spark, path, KIND))] == [0, 1, 2]
    L.publish(frame(spark, range(7, 9)), path, ["i"])
    assert rows_of(L.whole_log(spark, path, KIND))[3:] == [(4, 7, "t7"), (5, 8, "t8")]


def test_an_open_publish_is_followed_until_its_marker(spark, tmp_path):
    path = str(tmp_path / "log")
    L.publish(frame(spark, range(3)), path, ["i"], done=False)
    began = time.monotonic()
    assert L.LogReader(path, 0.5).partitions() == L.segments(path, 0, 3) and time.monotonic() - began >= 0.5

    def later():
        time.sleep(1)
        L.publish(frame(spark, range(3, 6)), path, ["i"])

    other = threading.Thread(target=later)
    other.start()
    assert [r[1] for r in rows_of(L.whole_log(spark, path, KIND, idle=60))] == [0, 1, 2, 3, 4, 5]
    other.join()
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("start", ["earliest", "latest", "2"])
def test_a_tail_has_each_record_once(spark, tmp_path, start):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    L.publish(frame(spark, range(4)), path, ["i"])
    run = lambda: [r[1] for r in rows_of(T.to_folder(L.tailed(spark, path, KIND, start), out))]
    first = {"earliest": [0, 1, 2, 3], "latest": [], "2": [2, 3]}[start]
    assert run() == first and run() == first
    L.publish(frame(spark, range(4, 6)), path, ["i"], done=False)
    assert run() == [*first, 4, 5]
    L.publish(frame(spark, []), path, ["i"])  # an end marker alone
    assert run() == [*first, 4, 5]
    assert rows_of(L.whole_log(spark, path, KIND)) == [*((i, i, f"t{i}") for i in range(4)), (5, 4, "t4"), (6, 5, "t5")]


def test_options_are_checked(spark, tmp_path):
    spark.dataSource.register(L.LogSource)
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format(L.FORMAT).load().count()
    with pytest.raises(Exception, match="neither earliest"):
        T.to_folder(L.tailed(spark, str(tmp_path), KIND, "yesterday"), str(tmp_path / "out"))


@pytest.mark.parametrize("name", ["sc14_whole_log", "sc15_tail"])
def test_equal_times_keep_the_tables_order_and_no_time_is_left_out(spark, tmp_path, name):
    days = [dt.datetime(2023, 12, 30), *(dt.datetime(2024, 1, d) for d in (5, 11, 15, 21)), dt.datetime(2024, 3, 1)]
    rows = [(d, kind, value) for d in days for kind, value in (("view", 3.0), ("click", 2.0), ("view", 1.0), ("click", 4.0))]
    ts, kinds, values = map(list, zip(*rows, strict=True))
    table = {"event_id": range(len(rows)), "ts": pa.array(ts, pa.timestamp("us")), "user_id": [1] * len(rows), "event_type": kinds, "value": values}
    pq.write_table(pa.table(table), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    settled = S.ORACLES[name].replace("OVER (ORDER BY ts)", "OVER (ORDER BY ts, event_id)")
    assert settled != S.ORACLES[name]
    assert_same(S.QUERIES[name](spark, str(tmp_path)), con, settled)
