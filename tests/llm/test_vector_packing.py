"""Vector packing: ids against the tokeniser on whole texts, exact cover, limits, no padding, conversations."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebook.llm import vector_packing as V

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(V.tokenizer_path(V.TOKENIZER_FILE))


@pytest.fixture(scope="module")
def encoder():
    return V.Encoder(V.TOKENIZER_FILE)


def ids_by_hand(tokenizer, texts):
    return np.array([*(i for t in texts for i in tokenizer.encode(t or "", add_special_tokens=False).ids), V.END], dtype="<u4")


def check(rows, examples, limits=V.Limits(), task_ends=8):
    """Rows cover every example exactly once and keep the limits; sequences are full or powers of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r["start"], r.length, r.ids_crc32, r.doc_tokens, r.loss_tokens))
        sequences[r.sequence_id].append((r["offset"], r.length, r.loss_tokens))
    want = defaultdict(list)
    for doc, ids, bearing in examples:
        want[doc].append((ids, bearing))
    assert set(pieces) == set(want)
    for doc, found in pieces.items():
        if len(want[doc]) > 1:  # repeated ids: their lengths together
            assert sum(n for _, n, *_ in found) == sum(len(ids) for ids, _ in want[doc])
            continue
        (ids, bearing), at = want[doc][0], 0
        for start, n, crc, total, loss in sorted(found):
            assert start == at and n > 0 and total == len(ids)
            assert crc == zlib.crc32(ids[at : at + n].tobytes()) and loss == int(bearing[at : at + n].sum())
            at += n
        assert at == len(ids)
    short = 0
    for places in sequences.values():
        at = 0
        for offset, n, _ in sorted(places):
            assert offset == at
            at += n
        assert len(places) <= limits.segments and sum(x[2] for x in places) <= limits.loss
        assert at == limits.tokens or at < limits.tokens and at & (at - 1) == 0
        short += at < limits.tokens
    return len(sequences), short


def test_query(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    examples = [(r.doc_id, ids := ids_by_hand(tokenizer, [r.text]), np.ones(len(ids))) for r in docs]
    rows = V.op13_vector_packing(spark, small).collect()
    n, short = check(rows, examples)
    assert short <= 11 * 8 and n - short <= sum(len(e[1]) for e in examples) / 2048
    assert len(rows) <= len(docs) + 2 * n  # about one cut a sequence


def test_every_token_is_reached_by_merges(tokenizer):
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if token != "<|endoftext|>":
            assert [t.id for t in tokenizer.model.tokenize(token)] == [i]


ODD = ["a  b", "x   y", "x\n\ny", "x \n y", "a <|endoftext|> b", "<|endoftext|>", "tail  ", "a \tb", "a b c", "it's don't 'll", "\n a", "é 日本\n語", "a\r\nb", "a\x1cb\x85", "﻿x", "½²Ⅷ", " " * 300_000 + "x", "ab" * 50_000]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(tokenizer, encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=st.sampled_from("aAß.,'é \n\t12<|>-_ŉ日😀st"), max_size=60))
def test_ids_of_random_texts(tokenizer, encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def walk(sizes, limits):
    """Pack examples, each a list of flags whether an id bears loss; rows like the operator's."""
    packer, found, sequence = V.Packer(limits), [], 0
    examples = []
    for doc, flags in enumerate(sizes):
        bearing = np.array(flags, dtype=int)
        ids = np.arange(len(flags), dtype="<u4") + 1000 * doc
        examples.append((doc, ids, bearing))
        packer.add(V._Example(doc, ids.tobytes(), np.concatenate([[0], np.cumsum(bearing)])))
    while packer.pooled:
        offset = 0
        for example, start, n in packer.close():
            ids, bearing = examples[example.doc][1:]
            crc = zlib.crc32(ids[start : start + n].tobytes())
            found.append(Row(example.doc, start, n, crc, len(ids), int(bearing[start : start + n].sum()), sequence, offset))
            offset += n
        sequence += 1
    return found, examples


class Row(dict):
    def __init__(self, *values):
        super().__init__(zip(V.PIECE.names, values, strict=True))

    __getattr__ = dict.__getitem__


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.lists(st.booleans(), min_size=1, max_size=40), max_size=25),
    st.tuples(st.sampled_from([1, 2, 8, 16]), st.integers(1, 6), st.integers(1, 16)),
)
def test_limits_hold_on_random_examples(sizes, limits):
    limits = V.Limits(*limits)
    rows, examples = walk(sizes, limits)
    check(rows, examples, limits)


def test_the_scarcer_limit_decides():
    """A sequence that has used much of its loss takes what has little of it, so both limits are filled."""
    sizes = [[True] * 8] * 10 + [[False] * 8] * 10
    rows, examples = walk(sizes, V.Limits(16, 8, 8))
    assert check(rows, examples, V.Limits(16, 8, 8)) == (10, 0)
    assert len(rows) == 20  # and none is cut


def test_conversations(spark, small, tokenizer):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    found = V.conversations(table)
    limits = V.Limits(512, 16, 256)
    rows = V.pack(found, found.parts, "conv_id", limits).collect()
    turns = defaultdict(list)
    for r in sorted(table.collect(), key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append((r.text, r.role == "assistant"))
    examples = []
    for conv, parts in turns.items():
        lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t, _ in parts]
        bearing = np.repeat([x for _, x in parts] + [parts[-1][1]], [*lengths, 1]).astype(int)
        examples.append((conv, ids_by_hand(tokenizer, [t for t, _ in parts]), bearing))
    check(rows, examples, limits)


def test_edge_cases(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "same words"), (3, "same words"), (None, "no id"), (4, "long words here " * 20_000)]
    df = spark.createDataFrame([(*t, 5, 6) for t in texts], f"{DOCS}, length int, parts int")
    rows = V.pack(df, V.documents_as_parts()).collect()
    check(rows, [(i, ids := ids_by_hand(tokenizer, [t]), np.ones(len(ids))) for i, t in texts])
    empty = spark.createDataFrame([], DOCS)
    assert V.pack(empty, V.documents_as_parts()).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, (None, None)])], "doc_id long, p array<struct<text:string,loss:boolean>>")
    assert sorted((r.doc_id, r.length, r.loss_tokens) for r in V.pack(odd, odd.p).collect()) == [(1, 1, 1), (2, 1, 0)]


def test_a_small_pool_changes_no_guarantee(spark, small, tokenizer, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()
    encoder = V.Encoder(V.TOKENIZER_FILE)
    monkeypatch.setattr(V, "POOL", 5000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r.doc_id for r in docs]), pa.array([[{"text": r.text, "loss": True}] for r in docs])], names=["doc_id", "parts"])
    monkeypatch.setitem(V._encoders, V.TOKENIZER_FILE, encoder)
    rows = [Row(*r.values()) for b in V._rows([batch], V.Limits(), V.TOKENIZER_FILE, V.END, 3) for r in b.to_pylist()]
    check(rows, [(r.doc_id, ids := ids_by_hand(tokenizer, [r.text]), np.ones(len(ids))) for r in docs])
    assert {r.sequence_id >> 36 for r in rows} == {3}


def test_limits_must_be_positive():
    with pytest.raises(ValueError, match="at least 1"):
        V.Packer(V.Limits(segments=0))
