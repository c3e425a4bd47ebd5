"""Benchmark decontamination against a brute-force search."""

from __future__ import annotations

import random
import re

import pytest
from compare import assert_same

from tidebook.llm import decontamination as D

DOCS = "doc_id long, text string"
ITEMS = "item_id string, text string"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return _WORD.findall(low)


def brute(docs, items, window=D.WINDOW):
    """n_words, n_hit and item ids of every document, by comparing every place with every window."""
    wins = []
    for item, text in items:
        w = words_of(text)
        if w:
            wins += [(item, w[i : i + window]) for i in range(max(1, len(w) - window + 1))]
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        out.append((doc, len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return sorted(out, key=str)


def found_by(df):
    return sorted(((r.doc_id, r.c.n_words, r.c.n_hit, tuple(r.c["items"])) for r in df.select("doc_id", "contamination").withColumnRenamed("contamination", "c").collect()), key=str)


def made(seed: int):
    rng = random.Random(seed)
    pick = lambda n: " ".join(rng.choice(["the", "Cat", "sat", "été", "x1", "日本", "dog"]) + rng.choice(["", ",", "!", "\n"]) for _ in range(n))
    items = [(f"q{i % 7}", pick(rng.randint(1, 14))) for i in range(9)] + [("none", None), ("blank", " ... "), (None, "lone words here now"), ("q1", "the Cat")]
    docs = [(i, pick(rng.randint(0, 40))) for i in range(30)] + [(100, None), (101, ""), (102, "?!"), (None, "the cat sat"), (5, "the cat")]
    docs += [(200 + i, f"Before… {items[i][1]} after") for i in range(9)] + [(300, "lone WORDS here: now")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs, items = made(seed)
    for window in (3, 10):
        got = D.annotate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=window)
        assert found_by(got) == brute(docs, items, window)


@pytest.mark.parametrize("segment", [1, 3, 512])
def test_blocks_give_the_same_result(spark, monkeypatch, segment):
    """Several blocks, with null item ids, and columns of documents named like those that a pass could need."""
    monkeypatch.setattr(D, "SEGMENT", segment)
    docs, items = made(4)
    named = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], f"{DOCS}, contamination_so_far int, found_0 int, c0 int")
    got = D.annotate(named, spark.createDataFrame(items, ITEMS), window=3, block_nodes=150)
    assert got.columns == [*named.columns, "contamination"] and found_by(got) == brute(docs, items, 3)
    assert {(r.contamination_so_far, r.found_0, r.c0) for r in got.collect()} == {(1, 2, 3)}


def test_segments_hold_every_window_and_bound_the_nodes(spark, monkeypatch):
    import ahocorasick

    monkeypatch.setattr(D, "SEGMENT", 7)
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    rows = D.segments(spark.createDataFrame([("q", text), ("q", text), ("short", "two words"), ("none", None)], ITEMS), "item_id", "text").collect()
    long = [r for r in rows if r.item_id == "q"]
    assert len(rows) == len(long) + 1 and len(long) == -(-391 // 7)
    assert {w for r in long for w in D.windows_of(r.words.split())} == set(D.windows_of(text.encode().split()))
    for r in rows:
        machine = ahocorasick.Automaton()
        for w in D.windows_of(r.words.split()):
            machine.add_word((b" " + b" ".join(w) + b" ").decode("latin-1"), 0)
        machine.make_automaton()
        assert machine.get_stats()["nodes_count"] <= r.nodes + 1


def test_spans_point_into_the_original(spark):
    text = "Ünïcode first — THE, cat;\tsat? then more"
    got = D.annotate(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([("q", "the cat sat")], ITEMS)).first()
    (span,) = got.contamination.spans
    assert text[span.start : span.end] == "THE, cat;\tsat"


def test_clashing_columns_are_carried(spark):
    df = spark.createDataFrame([(1, "the cat sat", 7, "x", None)], "doc_id long, text string, c0 int, t string, r string")
    got = D.annotate(df, spark.createDataFrame([("q", "cat sat")], ITEMS)).first()
    assert (got.c0, got.t, got.r, got.contamination.n_hit) == (7, "x", None, 2)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], ITEMS)
    assert D.annotate(docs, none).first().contamination.n_hit == 0
    assert D.annotate(spark.createDataFrame([], DOCS), none).count() == 0


def test_a_very_long_text(spark):
    text = "word " * 300_000 + "one two three"
    got = D.annotate(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([("q", "one two three")], ITEMS)).first()
    assert (got.contamination.n_words, got.contamination.n_hit) == (300_003, 3)


def test_query_equals_sql(spark, small, sql):
    assert_same(D.op1_decontamination(spark, small), sql, D.ORACLE_SQL)
