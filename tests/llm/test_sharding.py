"""Sharding: the permutation is one, shards are even, slots are gapless, results do not depend on partitions."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from compare import assert_same

from tidebook.llm import sharding as S

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 4099])
def test_permutation(spark, n):
    places = [r.p for r in spark.range(n).select(S.permute(S.F.col("id"), n).alias("p")).collect()]
    assert sorted(places) == list(range(n))
    if n > 100:
        other = [r.p for r in spark.range(n).select(S.permute(S.F.col("id"), n, seed=1).alias("p")).collect()]
        assert places != other and sum(abs(p - i) for i, p in enumerate(places)) / n > n / 5


def test_long_walks_end_inside(spark, monkeypatch):
    monkeypatch.setattr(S, "WALK", 1)
    for n in (5, 17, 4099):
        assert sorted(r.p for r in spark.range(n).select(S.permute(S.F.col("id"), n).alias("p")).collect()) == list(range(n))


def check(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min([counts[s] for s in range(shards)]) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_edge_cases(spark):
    rows = [(i, f"text {i % 5}") for i in range(50)] + [(7, "same")] * 40 + [(None, None), (None, ""), (3, "é" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{DOCS}, shard int, h string")
    plan = S.plan_shards(df, shards=8).collect()
    assert len(plan) == len(rows)
    check(plan, 8)
    sizes = Counter((r.doc_id, r["size"], r.text_crc32) for r in plan)
    assert sizes == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    again = S.plan_shards(df.repartition(7), shards=8).collect()
    assert Counter(again) == Counter(plan)
    assert S.plan_shards(spark.createDataFrame([], DOCS)).count() == 0


def test_more_shards_than_rows(spark):
    plan = S.plan_shards(spark.createDataFrame([(1, "a"), (2, "b")], DOCS), shards=5).collect()
    assert {r.slot for r in plan} == {0} and len({r.shard for r in plan}) == 2


def test_many_copies_are_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "COPIES", 4)
    plan = S.plan_shards(spark.createDataFrame([(1, "a")] * 30 + [(2, "b")], DOCS), shards=3).collect()
    check(plan, 3)
    assert len(plan) == 31


def test_query(spark, small, sql):
    df = S.op4_sharding(spark, small)
    check(df.collect(), 8)
    assert_same(df, sql, S.ORACLE_SQL)


def test_main_path_has_no_python(spark, small):
    plan = S.op4_sharding(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
