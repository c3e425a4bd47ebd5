"""Approximate neighbours: recall against brute force, exact scores, ties, hot buckets, defined edge cases."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import neighbours as N

VECTORS = "vec_id long, embedding array<float>"


def brute(ids, x, queries, nearest):
    """The nearest of each query by inner product, ties to smaller ids."""
    found = {}
    for q in queries:
        score = x @ x[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != q)
        found[q] = [(i, -s) for s, i in order[:nearest]]
    return found


def by_query(rows):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, scale):
    from conftest import DATA

    folder = str(DATA / scale)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    sound = {r.vec_id: r.embedding for r in rows if r.embedding and np.isfinite(np.array(r.embedding, dtype=float)).all() and any(r.embedding)}
    ids = sorted(sound)
    x = np.array([sound[i] for i in ids], dtype=np.float64)
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = by_query(N.op5_neighbours(spark, folder).collect())
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, near in got.items():
        assert [(-s, i) for i, s in near] == sorted((-s, i) for i, s in near)
        for i, s in near:
            assert s == pytest.approx(float(x[ids.index(i)] @ x[ids.index(q)]), rel=1e-12, abs=1e-12)


def test_unsound_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (8, []), (9, [1.0, 2.0, 3.0])]
    got = by_query(N.search(spark.createDataFrame(rows, VECTORS), F.lit(True), mass=0.999999).collect())
    assert got[0] == [(1, 0.5), (7, 0.5)]
    assert got[1] == [(0, 0.5), (7, 0.5)]
    assert set(got) == {0, 1, 7}


def test_empty_and_single(spark):
    assert N.search(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    assert N.search(spark.createDataFrame([(1, [1.0])], VECTORS), F.lit(True)).count() == 0


def test_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(40)] + [(100, [9.0, 9.0, 9.0])]
    got = by_query(N.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 59, nearest=5, mass=0.999999).collect())
    assert got[59][0][0] == 100  # the largest vector of a repeated id counts
    assert [i for i, s in got[59] if s == 14.0] == [0, 1, 2, 3]


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 4)), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = by_query(N.search(df, F.col("vec_id") % 10 == 0, nearest=7).collect())
    monkeypatch.setattr(N, "BLOCK", 16)
    assert by_query(N.search(df, F.col("vec_id") % 10 == 0, nearest=7).collect()) == whole
    want = brute(list(range(300)), x, range(0, 300, 10), 7)
    hits = sum(len({i for i, _ in whole[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 7 * 30


def test_probes_are_visited_in_order_of_chance():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    index = N.fit(x, 50_000, float(np.linalg.norm(x, axis=1).max()))
    few, many = (index.probes(x[:5], mass) for mass in (0.2, 0.7))
    assert all(set(a.tolist()) <= set(b.tolist()) for f, m in zip(few, many, strict=True) for a, b in zip(f, m, strict=True))


def test_clashing_columns(spark):
    rows = [(i, [float(i + 1), 1.0], 5, "x") for i in range(10)]
    df = spark.createDataFrame(rows, f"{VECTORS}, v int, bucket string")
    assert N.search(df, F.col("vec_id") == 0, nearest=3, mass=0.999999).count() == 3


def test_recall_with_skewed_norms(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32))
    x[0] *= 100  # one very long vector must not stretch the index of all others
    x[1:40] *= 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(N.search(df, F.col("vec_id") % 100 == 0).collect())
    want = brute(list(range(len(x))), x, range(0, len(x), 100), 20)
    assert all(len(got[q]) == 20 for q in want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_too_few_candidates_are_made_up_by_all_vectors(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(size=(3000, 8)) * 0.01 + np.eye(8)[0], -np.eye(8)[:1] + 0.01))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(N.search(df, F.col("vec_id") == 3000).collect())
    assert [i for i, _ in got[3000]] == [i for i, _ in brute(list(range(3001)), x, [3000], 20)[3000]]


@pytest.mark.parametrize("n", [10**7, 10**9])
def test_mass_is_reached_at_any_size(n):
    x = np.random.default_rng(9).normal(size=(1000, 64))
    index = N.fit(x, n, float(np.linalg.norm(x, axis=1).max()))
    assert all(reached for found in index.visits(x[:10], N.MASS) for _, reached in found)


def test_slices_of_the_queries_of_a_bucket(spark, monkeypatch):
    x = np.round(np.random.default_rng(4).normal(size=(300, 4)), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = by_query(N.search(df, F.lit(True), nearest=7).collect())
    monkeypatch.setattr(N, "SLICE", 16)
    assert by_query(N.search(df, F.lit(True), nearest=7).collect()) == whole
