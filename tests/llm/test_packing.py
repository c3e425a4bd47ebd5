"""Packing: ids against the tokeniser on whole texts, exact cover of sequences, the plan on random lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tidebook.llm import packing as P

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path())


def pieces_by_hand(tokenizer, doc, text, sequence=P.SEQUENCE):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
    return [(doc, k, a, len(ids[a : a + sequence]), zlib.crc32(ids[a : a + sequence].tobytes())) for k, a in enumerate(range(0, len(ids), sequence))]


def check_sequences(rows, sequence=P.SEQUENCE):
    """Offsets of every sequence are gapless from 0, and no sequence is too long; returns the number of sequences."""
    packed = defaultdict(list)
    for r in rows:
        packed[r.sequence_id].append((r["offset"], r.length))
    for places in packed.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sequence
    return len(packed)


def test_query(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = P.op7_packing(spark, small).collect()
    want = sorted(p for r in docs for p in pieces_by_hand(tokenizer, r.doc_id, r.text))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    least = -(-sum(r.length for r in rows) // P.SEQUENCE)
    assert check_sequences(rows) <= least * 1.01 + 1


def test_ids_of_odd_texts(tokenizer):
    texts = ["Hello, World.", "a.b,c. d,", "it's  we'LL 12,34.", "<|endoftext|> x <|STARTOFTEXT|>", "naïve Straße ÇA É", "日本語 テスト", "x y z", "#$%... ,, .", "İstanbul ǅ ﬁ", "ends.", "1. 2, 3.", "﻿bom", "áb", "😀!", "tab\tnl\r\nff\x0c", "abc</w> x"]
    encoder = P.WordEncoder(P.tokenizer_path())
    for text, raw in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@lru_cache
def both():
    return P.WordEncoder(P.tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbß.,'é \n12<|>-_ŉ日😀"), max_size=40))
def test_ids_of_random_texts(text):
    encoder = both()
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_word_memory_changes_nothing(monkeypatch, tokenizer):
    monkeypatch.setattr(P, "CACHE_WORDS", 3)
    text = "one two, three. four five two, one"
    assert np.frombuffer(P.WordEncoder(P.tokenizer_path()).encode([text.encode()])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def walk(plan, counts, sequence):
    """Where the plan puts every piece: sequence to (offset, length)."""
    packed = defaultdict(list)
    for length, n in counts.items():
        start, first, place = plan.by_length[length]
        for rank in range(n):
            at = int(np.searchsorted(start, rank, side="right")) - 1
            packed[int(first[at] + rank - start[at])].append((int(place[at]), length))
    for places in packed.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= sequence
    return packed


def plain_best_fit(counts, sequence):
    """Number of sequences of best fit alone, longest piece first."""
    gaps: list[int] = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        gap = min((g for g in gaps if g >= length), default=None)
        if gap is None:
            gaps.append(sequence - length)
        else:
            gaps[gaps.index(gap)] = gap - length
    return len(gaps)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25))
@example({16: 8, 22: 13})
def test_plan_is_a_packing(counts):
    plan = P.Plan(counts, 64)
    packed = walk(plan, counts, 64)
    assert sum(map(len, packed.values())) == sum(counts.values())
    assert len(packed) == plan.sequences <= plain_best_fit(counts, 64)


@pytest.mark.parametrize("order", P.COMBINED)
@settings(max_examples=100, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25))
def test_every_layout_is_a_packing(order, counts):
    layout = P._Layout(counts, 64, order)
    layout.by_length = {n: tuple(np.array(c) for c in zip(*runs, strict=True)) for n, runs in layout.runs.items()}
    packed = walk(layout, counts, 64)
    assert sum(map(len, packed.values())) == sum(counts.values()) and len(packed) == layout.sequences


def counts_of(tokenizer, folder):
    """Piece lengths of a data directory's documents."""
    import pandas as pd

    counts: dict[int, int] = {}
    encoder = both()
    for text in pd.read_parquet(f"{folder}/documents.parquet").text:
        n = len(encoder.encode([(text or "").encode()])[0]) // 4 + 1
        for k in range(0, n, P.SEQUENCE):
            piece = min(P.SEQUENCE, n - k)
            counts[piece] = counts.get(piece, 0) + 1
    return counts


def grouped_best_fit(counts, sequence):
    """``plain_best_fit`` with equal gaps held together, for large counts."""
    gaps: dict[int, int] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g in gaps if g >= length), default=sequence)
            each = min(gap // length, left)
            many = min(left // each, gaps.get(gap, left))
            if gap in gaps:
                gaps[gap] -= many
                if not gaps[gap]:
                    del gaps[gap]
            rest = gap - each * length
            gaps[rest] = gaps.get(rest, 0) + many
            left -= each * many
    return sum(gaps.values())


def test_exact_complements_need_no_more_than_best_fit(tokenizer, middle):
    own = counts_of(tokenizer, middle)
    rng = np.random.default_rng(0)
    cases = [{k: n * v for k, v in own.items()} for n in (1, 7, 10, 100)]
    cases += [dict(zip(range(1, 2049), rng.integers(1, most, 2048).tolist(), strict=True)) for most in (3, 50, 1000)]
    cases += [{k: 20_000 // k + 1 for k in range(1, 2049)}, {k: 30 for k in range(700, 1500)}]
    for counts in cases:
        assert P.Plan(counts).sequences <= grouped_best_fit(counts, P.SEQUENCE)
    # what the plan of the documents rests on
    assert P._Layout(own, P.SEQUENCE, 3).sequences == P.Plan(own).sequences == -(-sum(k * v for k, v in own.items()) // P.SEQUENCE)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25))
def test_grouped_best_fit_is_best_fit(counts):
    assert grouped_best_fit(counts, 64) == plain_best_fit(counts, 64)


def test_long_pieces_come_before_short_ones_combine():
    assert P.Plan({512: 400, 700: 650}, 2048).sequences == 344  # 325 pairs of 700 take one of 512 each


def test_exact_complements_are_used():
    packed = walk(P.Plan({40: 2, 24: 2, 30: 1, 20: 1, 14: 1, 16: 4}, 64), {40: 2, 24: 2, 30: 1, 20: 1, 14: 1, 16: 4}, 64)
    assert len(packed) == 4 and all(sum(n for _, n in p) == 64 for p in packed.values())


def test_copies_are_written_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "COPIES", 7)
    monkeypatch.setattr(P, "BUCKET_PIECES", 5)
    monkeypatch.setattr(P, "BUCKETS", 2)
    rows = [(i % 3, 0, 0, 10 + i % 2, 9) for i in range(60)] + [(i, 0, 0, 10, i) for i in range(40)] + [(None, 0, 0, 11, 1)] * 5
    pieces = P.shared_checkpoint(spark.createDataFrame(rows, P.PIECE))
    got = P.pack(pieces, 64).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(rows, key=str)
    check_sequences(got, 64)


def test_edge_cases(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "same words"), (3, "same words"), (None, "no id"), (4, "long words here " * 20_000)]
    df = spark.createDataFrame([(*t, 5, 6) for t in texts], f"{DOCS}, length int, bucket int")
    rows = P.pack(P.shared_checkpoint(P.pieces_of(df))).collect()
    want = [p for i, t in texts for p in pieces_by_hand(tokenizer, i, t)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    check_sequences(rows)
    assert P.pack(P.shared_checkpoint(P.pieces_of(spark.createDataFrame([], DOCS)))).count() == 0
