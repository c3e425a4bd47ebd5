"""Periodic runs: the automaton against every period and place, narrowing, digests, and the query against its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebook.llm import periodic as P


def by_hand(words, exponent=4, least=6):
    """Every maximal stretch of every period, unless a smaller period holds in it."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, exponent * q):
                stretch = words[i : i + size]
                if not any(stretch[g:] == stretch[:-g] for g in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


sequences = st.lists(st.integers(0, 3), max_size=50)


@settings(max_examples=600, deadline=None)
@given(sequences, sequences, st.integers(0, 8), st.sampled_from([(3, 1), (4, 6), (5, 10)]))
def test_runs_equal_those_by_hand(before, block, times, limits):
    words = before + block[:9] * times + before[:5] + block[:2] * times
    assert P.runs_of(words, *limits) == by_hand(words, *limits)


@settings(max_examples=200, deadline=None)
@given(sequences, sequences)
def test_narrowing_loses_nothing(a, b):
    words = a + b * 5 + a
    found = {(p, s): e for (p, s), e in P._squares(words).items() if e - s + 1 >= max(6, 4 * p)} if words else {}
    assert sorted((s, e - s + 1, p) for (p, s), e in found.items()) == sorted(P.runs_of(words))


def test_times_of_sequences_inside_a_run():
    for k in P.GRAMS:
        for period in range(1, 12):
            words = (list(range(period)) * 50)[: max(6, 4 * period)]
            grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            assert min(map(grams.count, grams)) >= P._times(k, 4, 6)


def test_collapsed_keeps_the_first_period():
    words = "x a b a b a b a b a y".split()
    assert P.runs_of(words) == [(1, 9, 2)]
    assert P.collapsed(words, P.runs_of(words)) == "x a b y".split()


def test_long_sequences_stay_quick():
    for period in (1, 7, 1000):
        assert P.runs_of([i % period for i in range(100_000)]) == [(0, 100_000, period)]
    rng = random.Random(1)
    words = [rng.randrange(2) for _ in range(3000)]
    assert P.runs_of(words) == by_hand(words)


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError, match="three periods"):
        P.runs_of([1] * 9, exponent=2)


def planted_by_hand(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def row_by_hand(doc, text):
    words = planted_by_hand(doc, text)
    runs = by_hand(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def query_of(spark, folder, docs, schema="doc_id long, text string"):
    spark.createDataFrame(docs, schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return P.op11_periodic(spark, str(folder))


def test_query_equals_sql(spark, small, sql):
    assert_same(P.op11_periodic(spark, small), sql, P.ORACLE_SQL)


def test_query_equals_hand(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = ["  ".join(f"w{x}" for x in rng.integers(0, k, n)) for k, n in ((1, 30), (2, 200), (3, 150), (50, 300), (2, 5), (1, 6))]
    odd = [None, "", " \t\n\x0b\x0c\r ", "é é é é é é é", "a  b\ta\nb a b a b", "one", "a " * 5000, "x y " * 700 + "z " * 9]
    docs = [(i, t) for i, t in enumerate((texts + odd) * 4)] + [(7, "a a a a a a"), (7, "a a a a a a"), (None, "b " * 8), (-3, "c d " * 20)]
    got = query_of(spark, tmp_path, docs)
    assert rows(got) == sorted((row_by_hand(*d) for d in docs), key=str)
    assert rows(query_of(spark, tmp_path / "none", [])) == []


def test_columns_of_the_table_stay(spark):
    df = spark.createDataFrame([(1, "a a a a a a a", 9, "r")], "doc_id long, text string, runs int, n_words string")
    found = P.annotate(df, out="found")
    assert found.columns == [*df.columns, "found"]
    r = found.first()
    assert r.found.collapsed == "a" and r.found.n_words == 7 and [tuple(x) for x in r.found.runs] == [(0, 7, 1)]
    with pytest.raises(ValueError, match="exists already"):
        P.annotate(df, out="runs")
