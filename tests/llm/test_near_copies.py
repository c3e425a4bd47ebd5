"""Near copies: forests against plain Kruskal, groups against all pairs by shingles, very large groups."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidebook.llm import near_copies as N
from tidebook.llm import simhash as S

DOCS = "doc_id long, text string"


def jaccard(a, b):
    sets = []
    for text in (a, b):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.append({tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))} if low else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] or sets[1] else 1.0


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def changed(rng, words, share):
    out = list(words)
    for _ in range(round(share * len(words))):
        i = rng.randrange(len(out))
        out[i : i + rng.choice((0, 1, 1))] = [f"n{rng.randrange(10_000)}"]
    return out


def test_forest_is_minimal():
    rng = np.random.default_rng(3)
    for n, m in ((2, 1), (40, 30), (50, 900), (30, 0)):
        u, v, d = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m).astype(np.uint16)
        got = N.forest(n, u, v, d)
        want, up = 0, list(range(n))
        for i in np.argsort(d, kind="stable"):
            a, b = u[i], v[i]
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            if a != b:
                up[a], want = b, want + int(d[i])
        assert d[got].sum() == want and len(set(got.tolist())) == len(got)
        assert roots(range(n), zip(u[got].tolist(), v[got].tolist(), strict=True)) == roots(range(n), zip(u.tolist(), v.tolist(), strict=True))


@pytest.mark.parametrize("held", [10, 400_000])
def test_tiles_connect_all_close_pairs(monkeypatch, held):
    monkeypatch.setattr(N, "HELD", held)
    rng = np.random.default_rng(5)
    x = np.frombuffer(rng.bytes(32 * 200), dtype="<u8").reshape(-1, 4)
    near = np.repeat(x[:40], 20, axis=0)
    for _ in range(25):
        near[np.arange(len(near)), rng.integers(0, 4, len(near))] ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    x = np.unique(np.concatenate((x, near)), axis=0)
    key = [r.tobytes() for r in x]
    first = np.bitwise_count(x[:, None, 0] ^ x[None, :, 0]) <= 20
    close = first & (np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2) <= 57)
    for left, right in ((np.arange(len(x)), None), (np.arange(0, len(x), 2), np.arange(1, len(x), 2))):
        u, v = N.tile_forest(x[left], None if right is None else x[right], 57, 20)
        other = left if right is None else right
        pairs = [(key[i], key[j]) for i in left for j in other if i != j and close[i, j]]
        assert len(u) < len(x)
        assert roots(key, [(a.tobytes(), b.tobytes()) for a, b in zip(u, v, strict=True)]) == roots(key, pairs)


def test_groups_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "HUB_EDGES", 3)
    rng = random.Random(2)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice((6, 30, 120, 400)))] for _ in range(25)]
    rows = []
    for i, words in enumerate(base):
        rows += [(20 * i + k, " ".join(changed(rng, words, share))) for k, share in enumerate((0, 0, 0.01, 0.01, 0.02, 0.02, 0.03, 0.05, 0.1, 0.3))]
    rows += [(900, None), (901, ""), (902, " \t"), (903, "two Words"), (904, "TWO words"), (905, "two other"), (None, rows[0][1]), (None, "lonely " * 9), (906, "long text " * 50_000)]
    got = {(r.doc_id, r.text_hash): r.component_id for r in N.similar(spark.createDataFrame([(*t, 1, 2) for t in rows], f"{DOCS}, fp int, k int")).collect()}
    by_id = {d: c for (d, _), c in got.items() if d is not None}
    texts = {d: t for d, t in rows if d is not None}
    ids = sorted(texts)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if jaccard(texts[a], texts[b]) >= 0.8]
    assert by_id == roots(ids, pairs)
    assert N.similar(spark.createDataFrame([], DOCS)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(i, " ".join(changed(rng, words, 0.01))) for i in range(1500)] + [(5000 + i, " ".join(changed(rng, words, 0.6))) for i in range(20)]
    kept = sorted(r.doc_id for r in S.keep_one(spark.createDataFrame(rows, DOCS), grouped=N.similar(spark.createDataFrame(rows, DOCS))).collect())
    assert kept == [0, *range(5000, 5020)]


@pytest.mark.parametrize("block", [8, 512])
def test_pairs_at_the_border_are_not_lost_to_closer_ones(spark, monkeypatch, block):
    """Groups in which many of the closest pairs by fingerprint are just below the similarity and others above it."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(4)
    rows = []
    for b in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(160)]
        rows += [(100 * b + k, " ".join(changed(rng, words, rng.choice((0.01, 0.02, 0.025, 0.03))))) for k in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    texts = dict(rows)
    pairs = [(a, b) for a in texts for b in texts if a < b and a // 100 == b // 100 and jaccard(texts[a], texts[b]) >= 0.8]
    want = roots(texts, pairs)
    got = {r.doc_id: r.component_id for r in N.similar(docs).collect()}
    assert len(set(want.values())) > 20 and got == want


def test_texts_below_the_similarity_go_to_no_other_block():
    """In a group of texts alike, but less than asked for, few rows of a pair of blocks are candidates; near copies all are."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    far = [" ".join(changed(rng, words, 0.035)) for _ in range(600)]
    near = [" ".join(changed(rng, far[i].split(), 0.005)) for i in range(0, 600, 10)]
    texts = [*far, *near]
    x = N.wide_fingerprints([t.encode() for t in texts], N.FINE)
    radius = N.radius_of(64 * N.FINE, N.SIMILARITY, N.FINE_DEVIATIONS)
    part = np.arange(len(texts))
    first = np.arange(len(texts)) < 600
    likely = [jaccard(a, b) for a, b in zip(far[:200], far[1:201], strict=True)]
    assert 0.5 < np.median(likely) < 0.7
    alone = N.block_candidates(x[:600], np.arange(600) % 2 == 0, part[:600], radius)
    assert alone.mean() < 0.35
    both = N.block_candidates(x, first, part, radius)
    for i, text in enumerate(near):
        if jaccard(far[10 * i], text) >= N.SIMILARITY:
            assert both[600 + i] and both[10 * i]
    assert not N.block_candidates(x, None, np.zeros(len(texts), int), radius).any()  # one part: nothing to join
