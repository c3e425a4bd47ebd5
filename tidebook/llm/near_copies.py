"""Near copies by the similarity of shingles: wide SimHash fingerprints compared in tiles, then an exact check.

Two texts are near copies if the Jaccard similarity of their sets of 5-word shingles is ``SIMILARITY`` or more.  Their
fingerprints then differ in a share of bits that follows from the angle of the sets, give or take chance; with
``WORDS`` words of 64 bits a radius of ``RADIUS`` bits misses about one pair in a thousand at the similarity itself and
fewer above it.  All pairs of tiles are compared by numpy exclusive-or and bit counts; small tiles whose population
counts differ beyond the radius are skipped, and a first word beyond ``FIRST_RADIUS`` bits ends a pair early.

A tile pair returns a minimum spanning forest of its close pairs, at most one edge a node, so a group of thousands of
near copies never turns into all its pairs, and the edges are the closest pairs that connect it.  Every edge is then
checked on the texts themselves, so no link stands on fingerprints alone (equal fingerprints of 256 bits count as equal
texts).  Where an edge fails, other pairs between the two parts may still pass: all parts that failed edges connect are
compared again in blocks, by fingerprints of 2048 bits, and every pair of different parts that is close by these on the texts, until
one of them passes.  So no pair within the radius is given up because a closer one failed.

Defined cases: a null or wordless text has fingerprint zero, and all of these are near copies; a text of fewer words
than a shingle is one shingle; null ids, repeated documents, empty tables and other columns as in ``simhash``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import hub_join, map_text, shared_checkpoint
from tidebook.llm.components import HUB_SHARE, connected_components
from tidebook.llm.simhash import majority, named_groups, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Words of 64 bits in a fingerprint.
WORDS = 4


def radius_of(bits: int, similarity: float, deviations: float = 3.1) -> int:
    """Bits in which fingerprints of sets of this similarity differ, and so many standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


#: Nodes in a tile, in the small tiles that are compared at once, and how many tiles there are at least.
TILE = 131_072
SMALL = 256
TILES = 6
#: Edges that a tile pair holds before it reduces them to a forest.
HELD = 400_000
#: Nodes in a block of parts that are compared again.
BLOCK = 512
#: Words and radius of the fingerprints that blocks meet by, and rows that are compared at once.
FINE, FINE_DEVIATIONS = 32, 3.7
CHUNK = 32
#: Texts whose shingles are held at once.
TEXTS = 500
#: Edges of one node that one task checks.
HUB_EDGES = 128

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # fixed values: the splitmix64 finaliser
_PRINT = T.StructType([T.StructField("fp", T.BinaryType())])
_EDGE = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Further independent bits of the same hashes."""
    with np.errstate(over="ignore"):
        x = hashes + _MIX[0] * np.uint64(word)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def wide_fingerprints(texts: list[bytes | None], words: int = WORDS, shingle: int = SHINGLE) -> np.ndarray:
    """One row of ``words`` unsigned numbers per text."""
    found = [np.zeros((0, words), dtype=np.uint64)]
    for a in range(0, len(texts), TEXTS):
        sets = [np.unique(np.array(shingle_hashes(t, shingle), dtype=np.uint64)) for t in texts[a : a + TEXTS]]
        found.append(np.stack([majority([_mixed(s, w) for s in sets]) for w in range(words)], axis=1))
    return np.concatenate(found)


def similarity_of(one: bytes | None, other: bytes | None, shingle: int = SHINGLE) -> float:
    """Jaccard similarity of two texts' shingles; 1 if neither has any."""
    a, b = set(shingle_hashes(one, shingle)), set(shingle_hashes(other, shingle))
    return len(a & b) / len(a | b) if a or b else 1.0


def forest(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the edges of a minimum spanning forest on nodes 0 .. n-1; ties by position.

    Edges come shortest first, in growing chunks; most of the later ones are inside one set already.
    """
    order = np.argsort(d, kind="stable")
    root, chosen = np.arange(n), []
    start, size = 0, 4 * n
    while start < len(order):
        rank = np.arange(start, min(start + size, len(order)))
        start, size = start + size, 2 * size
        a, b = u[order[rank]], v[order[rank]]
        while len(rank):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, rank, ra, rb = a[apart], b[apart], rank[apart], ra[apart], rb[apart]
            # ranks rise, so of several edges of a set the first is written last
            best, other = np.full(n, len(order)), np.full(n, len(order))
            best[ra[::-1]], other[rb[::-1]] = rank[::-1], rank[::-1]
            best = np.minimum(best, other)
            pick = np.unique(best[best < len(order)])
            chosen.append(pick)
            at = np.searchsorted(rank, pick)
            x, y = ra[at], rb[at]
            while len(x):  # join the sets of all picked edges; roots are the smallest positions
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(up := root[root], root):
                    root = up
                x, y = root[x], root[y]
                x, y = x[x != y], y[x != y]
    return order[np.unique(np.concatenate(chosen))] if chosen else np.zeros(0, dtype=np.int64)


class _Tile:
    """Fingerprints in the order of their words' population counts, cut into small tiles with the ranges of the counts."""

    def __init__(self, x: np.ndarray):
        counts = np.bitwise_count(x).astype(np.int16)
        order = np.lexsort(counts.T[::-1])
        self.x, counts = x[order], counts[order]
        self.cuts = [(a, min(a + SMALL, len(x))) for a in range(0, len(x), SMALL)]
        self.low = np.array([counts[a:b].min(0) for a, b in self.cuts]).reshape(-1, x.shape[1])
        self.high = np.array([counts[a:b].max(0) for a, b in self.cuts]).reshape(-1, x.shape[1])


def tile_forest(left: np.ndarray, right: np.ndarray | None, radius: int, first_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the ends of a minimum spanning forest of the close pairs between tiles, or inside one."""
    a = _Tile(left)
    b = a if right is None else _Tile(right)
    base = 0 if right is None else len(left)
    nodes = a.x if right is None else np.concatenate((a.x, b.x))
    held: list[np.ndarray] = []
    size = 0

    def reduced() -> np.ndarray:
        edges = np.concatenate(held, axis=1)
        ends, places = np.unique(edges[:2], return_inverse=True)
        places = places.reshape(2, -1)
        return edges[:, forest(len(ends), places[0], places[1], edges[2])]

    for i, (a0, a1) in enumerate(a.cuts):
        gap = np.maximum(np.maximum(a.low[i] - b.high, b.low - a.high[i]), 0).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            b0, b1 = b.cuts[j]
            if right is None and j < i:
                continue
            u, v = _there(np.bitwise_count(a.x[a0:a1, None, 0] ^ b.x[None, b0:b1, 0]) <= first_radius)
            if right is None and j == i:
                u, v = u[u < v], v[u < v]
            d = np.bitwise_count(a.x[a0 + u] ^ b.x[b0 + v]).sum(axis=1, dtype=np.uint16)
            close = d <= radius
            if close.any():
                u, v, d = u[close], v[close], d[close]
                if len(d) > a1 - a0:
                    kept = forest(2 * SMALL, u, v + SMALL * (right is not None or j != i), d)
                    u, v, d = u[kept], v[kept], d[kept]
                held.append(np.stack((u + a0, v + b0 + base, d.astype(np.int64))))
                size += len(d)
                if size > HELD:
                    held = [reduced()]
                    size = held[0].shape[1]
    edges = reduced() if held else np.zeros((3, 0), dtype=np.int64)
    return nodes[edges[0]], nodes[edges[1]]


def _there(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells of a table, looked up eight cells at a time."""
    flat = hit.ravel()
    if len(flat) % 8:
        at = np.flatnonzero(flat)
    else:
        eights = np.flatnonzero(flat.view(np.uint64))
        at = np.flatnonzero(flat.reshape(-1, 8)[eights].ravel())
        at = eights[at >> 3] * 8 + (at & 7)
    return np.divmod(at, hit.shape[1])


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(len(column), -1)


def close_pairs(nodes: DataFrame, n: int, radius: int, first_radius: int) -> DataFrame:
    """Edges (u, v) between close fingerprints in column ``fp``: those of the tile pairs' forests."""
    tiles = max(TILES, -(-n // TILE))
    own = nodes.select("fp", F.pmod(F.xxhash64("fp"), F.lit(tiles)).cast("int").alias("tile"))
    met = own.select("fp", "tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")).select(
        "fp", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), (F.col("tile") <= F.col("other")).alias("first")
    )

    def run(group):
        import pyarrow as pa

        first = group.column("first").to_numpy()
        fp, same = _unpacked(group.column("fp")), group.column("one")[0] == group.column("two")[0]
        sides = (fp, None) if same else (fp[first], fp[~first])
        none = np.zeros((0, fp.shape[1]), dtype="<u8")
        u, v = tile_forest(*sides, radius, first_radius) if same or (first.any() and not first.all()) else (none, none)
        return pa.table([pa.array([r.tobytes() for r in x.astype("<u8")], pa.binary()) for x in (u, v)], names=["u", "v"])

    return met.groupBy("one", "two").applyInArrow(run, _EDGE)


def checked(edges: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Edges whose texts are similar enough; ``texts`` has one text per fp.

    Nodes of more than ``HUB_EDGES`` edges, and of more than a thousandth of all, get copies of their text and so many
    parts of their edges.
    """
    total = edges.count()
    ends = edges.select(F.col("u").alias("fp")).unionByName(edges.select(F.col("v").alias("fp")))
    most = max(HUB_EDGES, total // 1000)
    hubs = ends.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > most)  # fewer than 2000
    hubs = hubs.select("fp", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    spread = texts.join(F.broadcast(hubs), "fp", "left").select("fp", "text", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))

    def with_text(rows: DataFrame, end: str, other: str) -> DataFrame:
        parts = F.coalesce(F.col("parts"), F.lit(1))
        split = rows.join(F.broadcast(hubs.withColumnRenamed("fp", end)), end, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
        return split.join(spread.select(F.col("fp").alias(end), "part", F.col("text").alias(f"{end}_text")), [end, "part"]).drop("part")

    both = with_text(with_text(edges, "u", "v"), "v", "u").select("u", "v", "u_text", "v_text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            near = [similarity_of(a, b, shingle) >= similarity for a, b in pairs]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, _EDGE)


def block_links(x: np.ndarray, first: np.ndarray | None, part: np.ndarray, text, radius: int, similarity: float, shingle: int) -> list[tuple[int, int]]:
    """Pairs of parts that a pair of similar texts joins, at most one less than there are parts.

    ``x`` has a fingerprint a row, ``part`` numbers the parts from 0, ``text(i)`` is the text of a row; ``first`` tells
    the rows of one block from those of the other, or is None for one block.  Closest pairs are checked first, and pairs
    of parts that are joined already are passed over.
    """
    left = np.arange(len(x)) if first is None else np.flatnonzero(first)
    right = left if first is None else np.flatnonzero(~first)
    d = np.concatenate([np.bitwise_count(x[left[a : a + CHUNK], None] ^ x[None, right]).sum(axis=2, dtype=np.uint16) for a in range(0, len(left), CHUNK)] or [np.zeros((0, 0), np.uint16)])
    u, v = np.nonzero((d <= radius) & (part[left][:, None] != part[right][None, :]))
    order = np.argsort(d[u, v], kind="stable")
    u, v = left[u[order]], right[v[order]]
    if first is None:
        u, v = u[u < v], v[u < v]
    up = list(range(int(part.max(initial=-1)) + 1))
    sets: dict[int, np.ndarray] = {}

    def root(p: int) -> int:
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    def hashes(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.unique(np.array(shingle_hashes(text(i), shingle), dtype=np.uint64))
        return sets[i]

    found = []
    for i, j, p, q in zip(u.tolist(), v.tolist(), part[u].tolist(), part[v].tolist(), strict=True):
        if (p := root(p)) == (q := root(q)):
            continue
        one, other = hashes(i), hashes(j)
        if min(len(one), len(other)) < similarity * max(len(one), len(other)):
            continue
        n = len(np.intersect1d(one, other, assume_unique=True))
        if n >= similarity * (len(one) + len(other) - n):
            up[q] = p
            found.append((p, q))
    return found


def block_candidates(x: np.ndarray, first: np.ndarray | None, part: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of a pair of blocks are close to a row of another part; arguments as for ``block_links``."""
    left = np.arange(len(x)) if first is None else np.flatnonzero(first)
    right = left if first is None else np.flatnonzero(~first)
    found = np.zeros(len(x), dtype=bool)
    for a in range(0, len(left), CHUNK):
        some = left[a : a + CHUNK]
        d = np.bitwise_count(x[some, None] ^ x[None, right]).sum(axis=2, dtype=np.uint16)
        u, v = np.nonzero((d <= radius) & (part[some][:, None] != part[right][None, :]))
        found[some[u]] = found[right[v]] = True
    return found


def completed(close: DataFrame, failed: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Components (fp, component) after the parts that ``failed`` edges connect were compared with each other.

    Parts of half a block or more have blocks of their own, smaller ones of a group share blocks; blocks of one and the
    same part do not meet.  Blocks meet by fingerprints of ``FINE`` words first, so narrow that few pairs below the similarity
    are within their radius; a text then goes only to those pairs of blocks where it is close to another part.  A
    task holds the texts of two blocks.
    """

    def labelled(rows: DataFrame, end: str) -> DataFrame:
        known = close.select(F.col("fp").alias(end), F.col("component").alias(f"{end}_part"))
        of_end = rows.groupBy(end).agg(F.count("*").alias("n")).join(known, end, "left")
        return hub_join(rows, of_end.withColumn(f"{end}_part", F.coalesce(f"{end}_part", end)), end, n_failed, HUB_SHARE)

    n_failed = failed.count()
    apart = labelled(labelled(failed, "u"), "v").select(F.col("u_part").alias("u"), F.col("v_part").alias("v")).where("u != v")
    groups = connected_components(apart, most=n_failed)
    if groups.isEmpty():
        return close
    radius = radius_of(64 * FINE, similarity, FINE_DEVIATIONS)
    total = texts.count()
    own = shared_checkpoint(texts.select("fp").join(close, "fp", "left").withColumn("component", F.coalesce("component", "fp")), total)
    sizes = own.groupBy("component").agg(F.count("*").alias("n"))
    parts = sizes.join(groups.select(F.col("node").alias("component"), F.col("component").alias("g")), "component")
    small = F.col("size") * 2 < BLOCK
    parts = shared_checkpoint(parts.withColumn("size", F.col("n")), total)
    of_group = parts.groupBy("g").agg(F.sum(F.when(small, F.col("size"))).alias("loose"), F.count("*").alias("n"))
    spread = hub_join(parts.withColumnRenamed("n", "rows"), of_group, "g", parts.count(), HUB_SHARE).withColumnRenamed("rows", "n")
    members = hub_join(own, spread, "component", total, HUB_SHARE)
    blocks = F.ceil(F.when(small, F.col("loose")).otherwise(F.col("size")) / BLOCK)
    place = F.pmod(F.xxhash64(F.when(small, F.col("component")).otherwise(F.col("fp"))), blocks)
    members = members.select("fp", "component", "g", F.struct(F.when(~small, F.col("component")).alias("only"), place.alias("k")).alias("block"))

    def make():
        return lambda found: [{"fp": r.tobytes()} for r in wide_fingerprints(found, FINE, shingle).astype("<u8")]

    fine = map_text(texts.join(members.select("fp"), "fp", "left_semi"), "text", make, _PRINT, "fine", ["fp"], True)
    members = shared_checkpoint(members.join(fine.select("fp", F.col("fine.fp").alias("fine")), "fp"), total)
    there = members.select("g", "block").distinct()
    pairs = there.withColumnRenamed("block", "one").join(there.withColumnRenamed("block", "two"), "g")
    pairs = pairs.where((F.col("one") <= F.col("two")) & (F.col("one.only").isNull() | F.col("two.only").isNull() | (F.col("one.only") != F.col("two.only"))))
    sides = pairs.select("g", F.col("one").alias("block"), "one", "two", F.lit(True).alias("first"))
    sides = sides.unionByName(pairs.where("one != two").select("g", F.col("two").alias("block"), "one", "two", F.lit(False).alias("first")))
    met = members.join(sides, ["g", "block"]).select("g", "one", "two", "first", "fp", "component", "fine")

    def sides_of(group) -> tuple:
        first = group.column("first").to_numpy()
        names = group.column("component").combine_chunks().dictionary_encode()
        both = first if group.column("one")[0] != group.column("two")[0] else None
        return both, names.indices.to_numpy(), names.dictionary

    def candidates(group):
        import pyarrow as pa

        both, part, _ = sides_of(group)
        return group.filter(pa.array(block_candidates(_unpacked(group.column("fine")), both, part, radius)))

    def run(group):
        import pyarrow as pa

        both, part, names = sides_of(group)
        text = group.column("text")
        found = block_links(_unpacked(group.column("fine")), both, part, lambda i: text[i].as_py(), radius, similarity, shingle)
        return pa.table([names.take(pa.array([e[k] for e in found], pa.int64())).cast(pa.binary()) for k in (0, 1)], names=["u", "v"])

    close_by = met.groupBy("g", "one", "two").applyInArrow(candidates, met.schema)
    links = close_by.join(texts, "fp").groupBy("g", "one", "two").applyInArrow(run, _EDGE)
    more = connected_components(links, most=total)
    to = sizes.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return hub_join(own, to, "component", total, HUB_SHARE).select("fp", F.coalesce("to", "component").alias("component"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, text_hash (of the whole text), fp, and component_id, the smallest id of its near copies."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))

    def make():
        return lambda texts: [{"fp": r.tobytes()} for r in wide_fingerprints(texts, words, shingle).astype("<u8")]

    found = map_text(rows, "text", make, _PRINT, "print", ["doc_id", "text_hash"], True)
    prints = shared_checkpoint(found.select("doc_id", "text_hash", F.col("print.fp").alias("fp")))
    pick = F.struct("text_hash", F.col("doc_id").isNull().alias("no_id"), "doc_id")
    nodes = shared_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min(pick).alias("sample")))
    radius = radius_of(64 * words, similarity)
    n = nodes.count()
    # a forest of a tile pair has fewer edges than nodes
    edges = shared_checkpoint(close_pairs(nodes.select("fp"), n, radius, radius_of(64, similarity, 3.7)).distinct(), (TILES + n // TILE) * n)
    linked = edges.select(F.col("u").alias("fp")).unionByName(edges.select(F.col("v").alias("fp"))).distinct()
    wanted = nodes.join(linked, "fp", "left_semi").select("fp", F.struct("sample.doc_id", "sample.text_hash").alias("k"))
    keyed = rows.select(F.struct("doc_id", "text_hash").alias("k"), "text")
    texts = shared_checkpoint(keyed.join(wanted, "k").groupBy("fp").agg(F.first("text").alias("text")))
    n_edges = edges.count()
    passed = shared_checkpoint(checked(edges, texts, similarity, shingle), n_edges)
    close = connected_components(passed, most=n_edges).withColumnRenamed("node", "fp")
    failed = edges.join(passed, ["u", "v"], "left_anti")
    return named_groups(prints, nodes, completed(close, failed, texts, similarity, shingle))
