"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has bit *i* set if over half of the hashes of a text's 4-word shingles have it.  Texts link when their
fingerprints differ in at most 4 bits; the groups are the connected components of those links.

Equal fingerprints are one node.  Nodes fall into cells by the population counts of their two 32-bit halves; two
fingerprints that differ in at most 4 bits have counts that differ by at most 4 in all, so a cell meets only the
cells around it.  A cell is split by hash into tiles of about ``TILE`` nodes, and each pair of tiles that can hold
a link is one group of rows.  Inside, the nodes are sorted by the counts of their 16-bit quarters and cut into small
tiles; pairs of these whose counts differ beyond the radius are skipped, the others are compared by numpy exclusive-or
and bit counts.  A tile pair returns a spanning forest of its links, at most one edge a node, so groups of thousands
of alike texts never turn into all their pairs.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; fewer than 4 words are one
shingle; a null id takes part in links but names a component only if all its members' ids are null (then null);
repeated documents share a node; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import fresh, hub_join, map_text, shared_checkpoint, table
from tidebook.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Nodes in a tile, and in the small tiles that are compared at once.
TILE = 16_384
SMALL = 256
#: A fingerprint that over one in so many rows have is joined by broadcast, as its rows would all meet in one task.
HOT_SHARE = 1000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])
_EDGE = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> list[int]:
    """The hashes of a text's shingles, repeats included; of the whole sequence if it has fewer words."""
    import xxhash

    words = text.translate(_LOWER).split() if text else []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    bounds = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in bounds]


def majority(chunks: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes, the bits that over half of them have; zero without hashes."""
    found = np.zeros(len(chunks), dtype=np.uint64)
    n = np.array([len(c) for c in chunks], dtype=np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return found
    hashes = np.concatenate(chunks)
    # runs of at most 255 hashes of one text, so that eight byte-wide counters in a word cannot overflow
    runs = -(-n[full] // 255)
    first = np.concatenate(([0], np.cumsum(n[full])))[:-1]
    within = np.arange(runs.sum()) - np.repeat(np.concatenate(([0], np.cumsum(runs)))[:-1], runs)
    begins = np.repeat(first, runs) + 255 * within
    texts_at = np.concatenate(([0], np.cumsum(runs)))[:-1]
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, begins)
        bytes_ = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits = 2 * np.add.reduceat(bytes_, texts_at, axis=0) > n[full][:, None]
        for lane in range(8):
            found[full] |= bits[:, lane].astype(np.uint64) << np.uint64(8 * lane + shift)
    return found


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """The fingerprints of a batch of texts, unsigned."""
    return majority([np.array(shingle_hashes(t), dtype=np.uint64) for t in texts])


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int16) for s in (0, 16, 32, 48)], 1)


class _Sorted:
    """Nodes in the order of their quarter counts, cut into small tiles with the range of each count."""

    def __init__(self, x: np.ndarray):
        q = _quarters(x)
        order = np.lexsort((q[:, 3], q[:, 1], q[:, 2], q[:, 0]))
        self.x, q = x[order], q[order]
        self.cuts = [(a, min(a + SMALL, len(x))) for a in range(0, len(x), SMALL)]
        self.low = np.array([q[a:b].min(0) for a, b in self.cuts])
        self.high = np.array([q[a:b].max(0) for a, b in self.cuts])


def _union(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the sets of linked nodes; roots are the smallest positions."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or inside one tile (right is None): node, root."""
    a = _Sorted(left)
    b = a if right is None else _Sorted(right)
    base = 0 if right is None else len(left)
    nodes = a.x if right is None else np.concatenate((a.x, b.x))
    root = np.arange(len(nodes))
    near = np.zeros((len(a.cuts), len(b.cuts)), dtype=np.int32)
    for q in range(4):
        gap = np.maximum(a.low[:, None, q] - b.high[None, :, q], b.low[None, :, q] - a.high[:, None, q])
        near += np.maximum(gap, 0)
    for i, j in zip(*np.nonzero(near <= radius), strict=True):
        if right is None and j < i:
            continue
        (a0, a1), (b0, b1) = a.cuts[i], b.cuts[j]
        hit = np.bitwise_count(a.x[a0:a1, None] ^ b.x[None, b0:b1]) <= radius
        if hit.any():
            u, v = np.nonzero(hit)
            _union(root, u + a0, v + b0 + base)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) of a graph with the same components as all links between the fingerprints in column ``fp``."""
    spark = nodes.sparkSession
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    celled = nodes.select("fp", (high * 33 + low).cast("int").alias("cell"))
    counts = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # 33 * 33 at most
    tiles = {c: -(-n // TILE) for c, n in counts.items()}
    around = [
        (c, d, tiles[c], tiles[d])
        for c in counts
        for d in counts
        if abs(c // 33 - d // 33) + abs(c % 33 - d % 33) <= radius
    ]
    if not around:
        return spark.createDataFrame([], _EDGE)
    partners = spark.createDataFrame(around, "cell int, other int, tiles long, other_tiles long")  # at most 41 a cell
    met = (
        celled.join(F.broadcast(partners), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
        .select("fp", "cell", "tile", "other", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)).alias("other_tile"))
        .select("fp", F.struct("cell", "tile").alias("a"), F.struct(F.col("other").alias("cell"), F.col("other_tile").alias("tile")).alias("b"))
        .select(
            "fp",
            F.least("a", "b").alias("one"),
            F.greatest("a", "b").alias("two"),
            F.when(F.col("a") == F.col("b"), 2).when(F.col("a") < F.col("b"), 0).otherwise(1).cast("int").alias("side"),
        )
    )

    def run(group):
        import pyarrow as pa

        fp = group.column("fp").to_numpy().view(np.uint64)
        side = group.column("side").to_numpy()
        if len(side) and side[0] == 2:
            u, v = tile_links(fp, None, radius)
        elif (side == 0).any() and (side == 1).any():
            u, v = tile_links(fp[side == 0], fp[side == 1], radius)
        else:
            u = v = np.zeros(0, np.uint64)
        return pa.table([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return met.groupBy("one", "two").applyInArrow(run, _EDGE)


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash (of the whole text), fp, and component_id, the group's smallest id."""
    found = map_text(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash")
        ),
        "text",
        lambda: lambda texts: [{"fp": x} for x in fingerprints(texts).view(np.int64).tolist()],
        _FINGERPRINT,
        "print",
        ["doc_id", "text_hash"],
        True,
    )
    prints = shared_checkpoint(found.select("doc_id", "text_hash", F.col("print.fp").alias("fp")))
    nodes = shared_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    linked = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    return named_groups(prints, nodes, linked)


def named_groups(prints: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """Every row of ``prints`` with the smallest id of its component.

    ``nodes`` has one row per fp with its smallest id (``first``) and number of rows (``n``); ``linked`` gives the
    component of each fp that has a link.  Components of a thousandth of all nodes and fingerprints of a thousandth of
    all rows are joined by broadcast.
    """
    rooted = shared_checkpoint(linked.join(nodes, "fp"))
    lowest = rooted.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = hub_join(rooted.select("fp", "component"), lowest, "component", rooted.count(), HOT_SHARE).select("fp", "component_id")
    known = shared_checkpoint(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    return hub_join(prints, known, "fp", total, HOT_SHARE).select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouped: DataFrame | None = None) -> DataFrame:
    """The documents without their near-duplicates: of each group the row with the smallest id stays.

    ``grouped`` is the result of ``group`` (the default) or of ``near_copies.similar`` on these documents.  Rows that
    share that id are told apart by their texts; of rows equal in both one stays.
    """
    if grouped is None:
        grouped = group(docs, id_col, text_col)
    best = grouped.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("unnamed")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k")
    )
    key = fresh(docs.columns, "row_key")
    kept = shared_checkpoint(best.select(F.struct("k.doc_id", "k.text_hash").alias(key)).distinct())
    # nulls are equal inside a struct; repeated rows are dropped before the shuffle that the join then uses as well
    keyed = docs.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash")))
    return keyed.dropDuplicates([key]).join(kept, key, "left_semi").drop(key)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return group(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
