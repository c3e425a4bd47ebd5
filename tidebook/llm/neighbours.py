"""Approximate nearest neighbours by multiprobe p-stable hashing, largest inner product first.

Vectors get one more component that makes all norms equal, so that the largest inner product is the smallest
distance.  A table hashes by a few quantised projections on normal vectors.  A query visits, in each table, its own
bucket and perturbed ones: a neighbour at distance *R* differs from the query by a normal variate of deviation *R* in
each projection, so the chance that it lies in a bucket is a product of normal intervals; buckets are visited in the
order of that chance until the visited ones hold ``mass`` of it.  Visited candidates are ranked by exact inner products
on the original vectors, tables are merged per query.

Vectors longer than ``LONG`` of the 99th percentile of norms would stretch the added component of all others, so the
vectors beyond that percentile then fall into bands of doubling norm.  Every band has its own tables, or is scanned if
it is not larger than a block; a query visits all bands.

Projections, their widths and *R* are fitted on a bounded sample (``SAMPLE`` vectors); every vector is indexed.  The
number of projections follows the number of vectors, so that buckets hold about ``BUCKET_ROWS``, but is never so large
that ``PROBES`` buckets miss the mass.  A query that misses it nevertheless, or finds fewer than ``k`` candidates, is
compared with all vectors.

Buckets that share their leading projections lie together in a *place* of about ``BLOCK`` vectors.  A query's buckets
are neighbours, so they lie in few places, and its vector goes to each of these once, with the list of the buckets to
visit there.  Places beyond ``BLOCK`` vectors are split into blocks that each of their queries visits, and the queries of
a place into slices of about ``SLICE``, so a bucket that a third of all vectors share is spread over tasks, and no
candidate is left out.  Each group returns a list of at most ``k`` candidates of a query; lists are merged to the nearest
in two steps, the first in ``PARTS`` parts of a query.  Of equal vectors only the ``k`` + 1 smallest ids can be among the nearest
``k``; the others leave the index without changing any result.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids or
vectors of another length than most; a repeated id counts once, with the largest of its vectors; with fewer than
``k`` other vectors all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import shared_checkpoint, table

NEAREST = 20
TABLES = 3
MASS = 0.62
SAMPLE = 4000
BUCKET_ROWS = 600
BLOCK = 4096
#: Queries that are compared with a block at once; more of them are split into slices that each meet the block.
SLICE = 4096
#: Candidates that a group gathers before it cuts them to the nearest of each query.
HELD = 500_000
#: Parts in which the lists of a query are merged before they meet.
PARTS = 16
#: Buckets that a query may visit in a table; with more to visit it is compared with all vectors.
PROBES = 4096
#: Norms up to so many times their 99th percentile share one index.
LONG = 1.5
SEED = 11


@dataclass
class Index:
    """Projections of each table, their offsets, the width of a bucket, the distance of a neighbour, and how many leading
    projections make a place."""

    projections: np.ndarray  # tables x hashes x (dimensions + 1)
    offsets: np.ndarray  # tables x hashes
    width: float
    radius: float
    norm: float
    lead: int = 0

    def _projected(self, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
        full = np.concatenate((v, extra[:, None]), axis=1)
        return np.einsum("nd,lkd->nlk", full, self.projections) + self.offsets

    @staticmethod
    def _keys(cells: np.ndarray) -> np.ndarray:
        """One number for the cells of a bucket; buckets that collide are just visited together."""
        key = np.zeros(cells.shape[:-1], dtype=np.int64)
        for j in range(cells.shape[-1]):
            key = key * np.int64(1_000_003) + cells[..., j]
        return key

    def homes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and bucket of each vector in each table."""
        extra = np.sqrt(np.maximum(self.norm**2 - (v**2).sum(1), 0))
        cells = np.floor(self._projected(v, extra) / self.width).astype(np.int64)
        return self._keys(cells[..., : self.lead]), self._keys(cells)

    def probes(self, q: np.ndarray, mass: float) -> list[list[np.ndarray]]:
        """For each query and table, the buckets to visit."""
        return [[buckets for buckets, _ in found] for found in self.visits(q, mass)]

    def visits(self, q: np.ndarray, mass: float) -> list[list[tuple[np.ndarray, bool]]]:
        """For each query and table, the buckets to visit, and whether they hold the mass."""
        return [[(buckets, reached) for _, buckets, reached in found] for found in self.placed_visits(q, mass)]

    def placed_visits(self, q: np.ndarray, mass: float) -> list[list[tuple[np.ndarray, np.ndarray, bool]]]:
        """For each query and table, the buckets to visit with their places, and whether they hold the mass."""
        scaled = q * (self.norm / np.linalg.norm(q, axis=1, keepdims=True))  # a query's length does not change its order
        at = self._projected(scaled, np.zeros(len(q))) / self.width
        spread = self.radius / self.width
        reach = math.ceil(3.5 * spread) + 1
        around = np.arange(-reach, reach + 1)
        low = np.floor(at)[..., None] + around
        chance = _normal((low + 1 - at[..., None]) / spread) - _normal((low - at[..., None]) / spread)
        return [[self._ordered(low[i, t], chance[i, t], mass) for t in range(at.shape[1])] for i in range(len(q))]

    def _ordered(self, cells: np.ndarray, chance: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray, bool]:
        """Buckets by falling product of chances: the best prefixes are all that the best buckets can begin with."""
        best, chosen = np.ones(1), np.zeros((1, 0), dtype=np.int64)
        for j in range(len(cells)):
            product = (best[:, None] * chance[j]).ravel()
            keep = np.argsort(-product, kind="stable")[:PROBES]
            best = product[keep]
            chosen = np.concatenate((chosen[keep // len(cells[j])], cells[j][keep % len(cells[j])].astype(np.int64)[:, None]), axis=1)
        enough = int(np.searchsorted(np.cumsum(best), mass)) + 1
        buckets, first = np.unique(self._keys(chosen[:enough]), return_index=True)
        return self._keys(chosen[first, : self.lead]), buckets, enough <= len(best)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * (1 + np.sign(x) * erf)


def fit(sample: np.ndarray, n: int, norm: float, nearest: int = NEAREST, tables: int = TABLES, seed: int = SEED, mass: float = MASS) -> Index:
    """An index for ``n`` vectors from a bounded sample of them."""
    rng = np.random.default_rng(seed)
    extra = np.sqrt(np.maximum(norm**2 - (sample**2).sum(1), 0))
    full = np.concatenate((sample, extra[:, None]), axis=1)
    asked = sample[:200] * (norm / np.linalg.norm(sample[:200], axis=1, keepdims=True))
    distance = np.sqrt(np.maximum(2 * norm**2 - 2 * asked @ sample.T, 0))
    np.put_along_axis(distance, np.arange(len(asked))[:, None], np.inf, axis=1)
    distance.sort(axis=1)
    rank = min(max(1, round(nearest * len(sample) / max(n, 1))), max(1, len(sample) - 1))
    near = distance[:, rank - 1]
    near = near[np.isfinite(near)]
    radius = max(float(np.mean(near)) if len(near) else norm, 1e-3 * norm)
    deviation = float(np.sqrt(full.var(axis=0).sum())) or norm
    width = radius
    cells = max(1.5, deviation * math.sqrt(2 * math.pi * math.e) / width)
    hashes = int(min(max(2, round(math.log(max(1.0, n / BUCKET_ROWS)) / math.log(cells))), 24))
    while True:
        projections = rng.normal(size=(tables, hashes, full.shape[1]))
        lead = int(hashes * math.log(max(1.0, n / BLOCK)) / math.log(max(2.0, n / BUCKET_ROWS)))
        index = Index(projections, rng.uniform(0, width, (tables, hashes)), width, radius, norm, lead)
        if hashes == 1 or all(reached for found in index.visits(asked[:8], mass) for _, reached in found):
            return index
        hashes -= 1


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column, in double precision."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def best_of_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, nearest: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Query position, candidate id and exact score of the nearest candidates in a block, ties to smaller ids.

    Candidates that score below a query's ``floor`` may be left out.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(query_ids), 256):
        q, own = queries[a : a + 256], query_ids[a : a + 256]
        rough = q @ vectors.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        if len(ids) > nearest:
            least = np.partition(rough, len(ids) - nearest, axis=1)[:, len(ids) - nearest]
        else:
            least = np.full(len(own), -np.inf)
        if floor is not None:
            least = np.maximum(least, floor[a : a + 256])
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        row, at = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
        score = (q[row] * vectors[at]).sum(axis=1)  # the same sum for a pair wherever it is taken
        order = np.lexsort((ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = place < nearest
        out.append((row[keep] + a, ids[at[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _nearest(row: np.ndarray, ids: np.ndarray, score: np.ndarray, nearest: int) -> tuple[np.ndarray, ...]:
    """The nearest of each query position, each candidate once."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    again = np.zeros(len(row), dtype=bool)
    again[1:] = (row[1:] == row[:-1]) & (ids[1:] == ids[:-1])
    row, ids, score = row[~again], ids[~again], score[~again]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < nearest
    return row[keep], ids[keep], score[keep]


def best_of_place(ids: np.ndarray, buckets: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, wanted: np.ndarray, nearest: int) -> tuple[np.ndarray, ...]:
    """The same for a place: query *i* meets the vectors of the buckets ``wanted[bounds[i] : bounds[i + 1]]``."""
    order = np.argsort(buckets, kind="stable")
    ids, buckets, vectors = ids[order], buckets[order], vectors[order]
    asking = np.repeat(np.arange(len(query_ids)), np.diff(bounds))
    order = np.argsort(wanted, kind="stable")
    asking, wanted = asking[order], wanted[order]
    found, held = [], 0
    floor = np.full(len(query_ids), -np.inf)  # a score that as many candidates as are wanted have reached in one bucket
    for key in np.intersect1d(buckets, wanted):
        a, b = np.searchsorted(buckets, (key, key + 1))
        q = asking[slice(*np.searchsorted(wanted, (key, key + 1)))]
        row, near, score = best_of_block(ids[a:b], vectors[a:b], query_ids[q], queries[q], nearest, floor[q])
        found.append((q[row], near, score))
        held += len(row)
        full = np.flatnonzero(np.bincount(row, minlength=len(q)) >= nearest)
        floor[q[full]] = np.maximum(floor[q[full]], score[np.searchsorted(row, full, side="right") - 1])
        if held > HELD:
            found = [_nearest(*(np.concatenate(c) for c in zip(*found, strict=True)), nearest)]
            held = len(found[0][0])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, near, score = (np.concatenate(c) for c in zip(*found, strict=True))
    good = score >= floor[row] - 1e-9 * (1 + np.abs(score))
    return _nearest(row[good], near[good], score[good], nearest)


def search(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    nearest: int = NEAREST,
    tables: int = TABLES,
    mass: float = MASS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest candidates of every row that satisfies ``is_query``.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    sound = F.size(v) > 0
    sound &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(sound)
    one = shared_checkpoint(rows.groupBy("vec_id").agg(F.max("v").alias("v")))
    squared = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = one.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(squared).alias("m")).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n, top = max(((r["d"], r["n"], r["m"]) for r in sizes), key=lambda r: (r[1], r[0]))
    one = one.where(F.size("v") == d)

    def sampled(rows: DataFrame) -> np.ndarray:
        taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
        return np.array([r["v"] for r in taken], dtype=np.float64)

    sample = sampled(one)
    edge = float(np.quantile((sample**2).sum(1), 0.99))
    if top <= LONG**2 * edge:
        bands = {0: (0, fit(sample, n, math.sqrt(top), nearest, tables, mass=mass))}
        one = one.withColumn("band", F.lit(0))
    else:
        doublings = F.floor(F.log2(squared / edge) / 2).cast("int")
        one = one.withColumn("band", F.when(squared <= edge, 0).otherwise(1 + F.greatest(doublings, F.lit(0))))
        bands = {}
        for r in one.groupBy("band").agg(F.count("*").alias("n"), F.max(squared).alias("m")).orderBy("band").collect():
            hashes = r["band"] == 0 or r["n"] > BLOCK
            within = fit(sampled(one.where(F.col("band") == r["band"])), r["n"], math.sqrt(r["m"]), nearest, tables, mass=mass) if hashes else None
            bands[r["band"]] = (len(bands) * tables, within)
    index = spark.sparkContext.broadcast(bands)  # the first table of each band, and its index unless it is scanned

    alike = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    kept = one.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= nearest + 1)
    kept = shared_checkpoint(kept.select("vec_id", "v", "band"))
    kind = one.schema["v"].dataType
    head = [T.StructField("t", T.IntegerType()), T.StructField("place", T.LongType())]
    long = T.LongType()

    def table_of(t: int, batch, at: np.ndarray, places: np.ndarray, buckets, names: list[str]):
        """Rows of a batch in one table: table, place, id, vector and bucket or buckets."""
        import pyarrow as pa

        part = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(places), part.column(0), part.column(1), buckets], names=names)

    stored_shape = T.StructType([*head, T.StructField("vec_id", long), T.StructField("v", kind), T.StructField("bucket", long)])
    asking_shape = T.StructType([*head, T.StructField("vec_id", long), T.StructField("v", kind), T.StructField("buckets", T.ArrayType(long))])

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column(2).to_numpy()
            for band in np.unique(own):
                first, within = index.value[int(band)]
                at = np.flatnonzero(own == band)
                if within is None:
                    none = np.zeros(len(at), np.int64)
                    yield table_of(first, batch, at, none, pa.array(none), stored_shape.names)
                    continue
                places, keys = within.homes(_matrix(batch.column(1))[at])
                for t in range(tables):
                    yield table_of(first + t, batch, at, places[:, t], pa.array(keys[:, t]), stored_shape.names)

    def probed(batches):
        import pyarrow as pa

        def lists(of: list[np.ndarray]):
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in of]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(of) if of else np.zeros(0, np.int64)))

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                q = _matrix(part.column(1))
                visits = {first: within.placed_visits(q, mass) for first, within in index.value.values() if within is not None}
                reached = np.array([all(ok for v in visits.values() for _, _, ok in v[i]) for i in range(len(q))], dtype=bool)
                sure = np.flatnonzero(reached)
                for first, within in index.value.values():
                    if within is None:
                        none = np.zeros(len(sure), np.int64)
                        yield table_of(first, part, sure, none, lists([none[:1]] * len(sure)), asking_shape.names)
                        continue
                    for t in range(tables):
                        rows, places, buckets = [], [], []
                        for i in sure:
                            place, keys, _ = visits[first][i][t]
                            order = np.argsort(place, kind="stable")
                            each, starts = np.unique(place[order], return_index=True)
                            rows += [i] * len(each)
                            places.append(each)
                            buckets += np.split(keys[order], starts[1:])
                        if rows:
                            yield table_of(first + t, part, np.array(rows), np.concatenate(places), lists(buckets), asking_shape.names)

    queries = one.where(is_query).select("vec_id", "v")
    stored = kept.mapInArrow(hashed, stored_shape)  # hashed twice, to be counted and to be dealt: cheaper than kept
    asking = shared_checkpoint(queries.mapInArrow(probed, asking_shape))
    blocks = stored.groupBy("t", "place").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    slices = asking.groupBy("t", "place").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    places = shared_checkpoint(blocks.join(slices, ["t", "place"]))
    dealt = (
        stored.join(places, ["t", "place"])
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    )
    asked = (
        asking.join(places, ["t", "place"])
        .withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )

    def ranked(left, right):
        import pyarrow as pa

        names = ["query_id", "ids", "scores"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))], names=names)
        query_ids, lists = right.column("vec_id").to_numpy(), right.column("buckets").combine_chunks()
        row, ids, scores = best_of_place(
            left.column("vec_id").to_numpy(), left.column("bucket").to_numpy(), _matrix(left.column("v")),
            query_ids, _matrix(right.column("v")), lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(), nearest,
        )
        bounds = pa.array(np.searchsorted(row, np.arange(len(query_ids) + 1)).astype(np.int32))
        columns = [pa.ListArray.from_arrays(bounds, pa.array(c)) for c in (ids.astype(np.int64), scores.astype(np.float64))]
        return pa.table([pa.array(query_ids), *columns], names=names)

    def merged(lists: DataFrame, *keys: str) -> DataFrame:
        # a pair has one score wherever it is found, in one place of each table at most
        best = F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, nearest * tables)
        return lists.groupBy(*keys).agg(best.alias("p")).select(*keys, F.slice(F.array_distinct("p"), 1, nearest).alias("p"))

    def nearest_of(stored: DataFrame, asking: DataFrame, places: tuple) -> DataFrame:
        """query_id and p, the nearest of all groups of ``places`` in order; lists are merged in two steps, so none is long."""
        tops = (
            stored.select(*places, "vec_id", "v", "bucket")
            .groupBy(*places)
            .cogroup(asking.select(*places, "vec_id", "v", "buckets").groupBy(*places))
            .applyInArrow(ranked, "query_id long, ids array<long>, scores array<double>")
        )
        pairs = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("i")))
        part = F.pmod(F.hash(F.element_at("ids", 1)), F.lit(PARTS))
        return merged(merged(tops.where(F.size("ids") > 0).select("query_id", pairs.alias("p"), part.alias("part")), "query_id", "part"), "query_id")

    found = shared_checkpoint(nearest_of(dealt, asked, ("t", "place", "block", "slice")))
    enough = found.where(F.size("p") >= nearest)
    apart = queries.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))  # other attributes than the stored side's
    missed = shared_checkpoint(apart.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"))
    left = missed.count()
    if left:
        n_blocks, n_slices = -(-n // BLOCK), -(-left // SLICE)
        block, part = (F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int") for k in (n_blocks, n_slices))
        bucket, buckets = F.lit(0).cast("long").alias("bucket"), F.array(F.lit(0).cast("long")).alias("buckets")
        whole = kept.select("*", bucket, block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"))
        these = missed.select("*", buckets, part.alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        scanned = nearest_of(whole, these, ("block", "slice"))
        enough = enough.unionByName(scanned)
    return enough.select("query_id", F.posexplode("p").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score")
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
