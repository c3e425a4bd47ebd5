"""SimHash: fingerprints bit by bit, links against all pairs, components against union-find."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tidebook.llm import simhash as S
from tidebook.llm.components import connected_components

DOCS = "doc_id long, text string"


def print_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, pairs):
    """Smallest node reachable from each."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_pairs(fps, radius=4):
    fps = sorted(set(fps))
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius]


def groups(rows):
    """doc_id, fingerprint and component by brute force; rows are (doc_id, text)."""
    fps = [print_of(t) for _, t in rows]
    root = roots(set(fps), near_pairs(fps))
    lowest: dict = {}
    for (doc, _), fp in zip(rows, fps, strict=True):
        if doc is not None:
            lowest[root[fp]] = min(doc, lowest.get(root[fp], doc))
    return sorted(((d, f"{fp:016x}", lowest.get(root[fp])) for (d, _), fp in zip(rows, fps, strict=True)), key=str)


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = S.op8_simhash(spark, small).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == groups(docs)


@pytest.mark.parametrize("hot_share", [1, 12, 1000])  # no fingerprint is joined by broadcast, some, all
def test_edge_cases(spark, monkeypatch, hot_share):
    monkeypatch.setattr(S, "HOT_SHARE", hot_share)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choices(words, k=rng.randint(1, 400)) for _ in range(20)]
    rows = []
    for i, text in enumerate(base):
        rows += [(10 * i + k, " ".join(w if rng.random() > 0.01 * k else rng.choice(words) for w in text)) for k in range(6)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (None, "lonely words without any id at all"), (None, rows[0][1]), (0, rows[0][1]), (904, "A B C\x0bD e\x1cf g")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{DOCS}, fp int, print int")
    got = S.group(df).collect()
    assert sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got), key=str) == groups(rows)
    assert S.group(spark.createDataFrame([], DOCS)).count() == 0


def test_very_long_and_repetitive_texts():
    texts = ["a b c d " * 70_000, "x " * 1000, "p q r s t u v w " * 300]
    assert S.fingerprints([t.encode() for t in texts]).tolist() == [print_of(t) for t in texts]


def clustered(n, seed):
    """Fingerprints with chains and clusters of small distances."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        x = rng.choice(out)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_tiles_keep_every_component(seed):
    fps = clustered(1500, seed)
    x = np.array(fps, dtype=np.uint64)
    u, v = S.tile_links(x, None)
    assert all((int(a)) in set(fps) for a in u) and len(u) < len(fps)
    assert roots(fps, zip(u.tolist(), v.tolist(), strict=True)) == roots(fps, near_pairs(fps))
    left, right = x[::2], x[1::2]
    u, v = S.tile_links(left, right)
    cross = [(a, b) for a in left.tolist() for b in right.tolist() if (a ^ b).bit_count() <= 4]
    assert roots(fps, zip(u.tolist(), v.tolist(), strict=True)) == roots(fps, cross)


def test_links_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 8)
    fps = clustered(600, 3)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    edges = S.links(spark.createDataFrame(signed, "fp long")).collect()
    pairs = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in edges]
    assert roots(fps, pairs) == roots(fps, near_pairs(fps))


def test_components(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    loose = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    pairs = chain + star + loose + [(5000, 5000), (None, 7), (7, None), chain[0]]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    assert got == roots({x for p in real for x in p}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    rows = [(5, "same text of five words"), (3, "same text of five words"), (3, "same text of five words"), (9, "another thing entirely, with words"), (None, "no id but words of its own"), (None, "no id but words of its own"), (None, "other lonely words are found here now"), (12, None), (11, "")]
    kept = S.keep_one(spark.createDataFrame([(*r, "x") for r in rows], f"{DOCS}, keep_id string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", rows[0][1]), ("9", rows[3][1]), ("None", rows[4][1]), ("None", rows[6][1]), ("11", "")])
    assert all(r.keep_id == "x" for r in kept)
