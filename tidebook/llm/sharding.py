"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking, in DataFrame functions only.

Rows get global numbers in the order of a digest of their id, text checksum and size, so the numbers depend on the
rows alone and not on files, partitions or machines.  A keyed Feistel permutation over a grid just large enough for
the row count takes each number to its place; places beyond the count are walked on until they fall inside.  Shard
and slot are remainder and quotient of the place, so anyone who knows the count and the seed can compute them, and
shard sizes differ by at most one row.

Numbering needs no global sort: the digest's leading bits choose one of ``BUCKETS`` buckets, bucket totals give each
bucket its first number, and rows are ordered inside buckets.  Equal rows are counted before that and written out
again in pieces at the end, so that a row that is repeated for a third of the table is no hot key.

Defined cases: a null text has size 1 and the checksum of the empty text; a null id is a value like any other;
repeated rows get places of their own; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import let, shared_checkpoint, table

SHARDS = 8
SEED = 20240501
ROUNDS = 6
#: Steps of the walk that are tried before the long walk that always ends inside.
WALK = 8
BUCKETS = 4096
#: Copies of one row that are written out by one row of the plan.
COPIES = 65_536
PRIME = 2**31 - 1
_DIGEST_BITS = 60


def round_keys(seed: int = SEED) -> list[tuple[int, int, int]]:
    """Multiplier, addend and tweak of each round, below ``PRIME``."""
    keys = []
    for i in range(ROUNDS):
        raw = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        m, c, d = (int.from_bytes(raw[4 * j : 4 * j + 4], "big") % PRIME for j in range(3))
        keys.append((m or 1, c, d))
    return keys


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least n cells."""
    a = math.isqrt(n - 1) + 1 if n > 0 else 1
    return a, max(1, -(-n // a))


def permute(number: Column, n: int, seed: int = SEED) -> Column:
    """The place of a row number under the keyed permutation of 0 .. n-1."""
    a, b = grid(n)
    if n >= 2**52:
        raise ValueError("row count too large for exact divisions")
    keys = F.array(
        *[
            F.struct(F.lit(i % 2).alias("odd"), *[F.lit(v).cast("long").alias(k) for k, v in zip("mcd", key, strict=True)])
            for i, key in enumerate(round_keys(seed))
        ]
    )

    def turned(s: Column, k: Column) -> Column:
        half = F.when(k["odd"] == 0, s["r"]).otherwise(s["l"])
        y = F.pmod(half * k["m"] + k["c"], F.lit(PRIME))
        z = F.pmod(y * y + k["d"], F.lit(PRIME))
        return F.struct(
            F.when(k["odd"] == 0, F.pmod(s["l"] + z, F.lit(a).cast("long"))).otherwise(s["l"]).alias("l"),
            F.when(k["odd"] == 1, F.pmod(s["r"] + z, F.lit(b).cast("long"))).otherwise(s["r"]).alias("r"),
        )

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))
        return F.aggregate(keys, start, turned, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    def walked(place: Column, steps: int) -> Column:
        walk = F.when(place >= n, F.sequence(F.lit(1), F.lit(steps))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(walk, place, lambda p, _: F.when(p >= n, once(p)).otherwise(p))

    # a walk meets each of the fewer than `a` cells beyond n at most once, so `a` steps always end inside; few rows
    # walk at all, and all but one in millions of those are inside after a few steps
    return let(let(once(number), lambda p: walked(p, WALK)), lambda p: walked(p, a))


def plan_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row number, place, shard and slot."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    digest = F.md5(
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size").cast("binary")
    )
    rows = rows.withColumn("h", F.conv(F.substring(digest, 1, _DIGEST_BITS // 4), 16, 10).cast("long"))
    shift = _DIGEST_BITS - int(math.log2(BUCKETS))
    same = ["h", "doc_id", "text_crc32", "size"]
    kinds = shared_checkpoint(rows.groupBy(*same).agg(F.count("*").alias("copies")))
    kinds = kinds.withColumn("bucket", F.shiftright("h", shift).cast("int"))

    totals = sorted((r["bucket"], r["n"]) for r in kinds.groupBy("bucket").agg(F.sum("copies").alias("n")).collect())
    starts, n = [], 0
    for bucket, rows_in in totals:
        starts.append((bucket, n))
        n += rows_in
    firsts = spark.createDataFrame(starts, "bucket int, first long")  # BUCKETS rows at most
    before = Window.partitionBy("bucket").orderBy(*same).rowsBetween(Window.unboundedPreceding, -1)
    numbered = kinds.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(firsts), "bucket")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    single = numbered.where("copies = 1").select(*same, (F.col("first") + F.col("before")).alias("row_number"))
    parts = numbered.where("copies > 1").select(*same, "copies", (F.col("first") + F.col("before")).alias("base"), part.alias("at"))
    last = F.least(F.col("at") + COPIES, F.col("copies")) - 1
    several = parts.repartition("h", "at").select(
        *same, F.explode(F.sequence(F.col("base") + F.col("at"), F.col("base") + last)).alias("row_number")
    )
    place = permute(F.col("row_number"), n, seed)
    return (
        single.unionByName(several)
        .withColumn("place", place)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "row_number",
            "place",
            F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
            F.floor(F.col("place") / shards).cast("long").alias("slot"),
        )
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, under the law ``rows``."""
    return plan_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _crc_table() -> list[int]:
    table_ = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table_.append(v)
    return table_


def _oracle() -> str:
    """DuckDB: the same numbering by one global sort, the permutation by a recursive walk."""
    rounds = []
    for i, (m, c, d) in enumerate(round_keys()):
        half, other, side = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        rounds.append(f"({half}{i} * {m} + {c}) % {PRIME} AS y{i}")
        rounds.append(f"({other}{i} + (y{i} * y{i} + {d}) % {PRIME}) % {side} AS {other}{i + 1}, {half}{i} AS {half}{i + 1}")
    inner = ", ".join(rounds)
    crc = f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda s: CAST('0x' || s AS BIGINT)), lambda c, v: xor(c >> 8, ({_crc_table()})[(xor(c, v) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {crc} AS text_crc32 FROM documents
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32 || ':' || size), 1, {_DIGEST_BITS // 4}) AS BIGINT) AS h FROM keyed
), numbered AS (
  SELECT doc_id, size, text_crc32, CAST(row_number() OVER (ORDER BY h, doc_id, text_crc32, size) - 1 AS BIGINT) AS x,
         CAST(count(*) OVER () AS BIGINT) AS n FROM hashed
), framed AS (
  SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM numbered
), walk AS (
  SELECT x, n, a, b, x AS p, 0 AS step FROM framed
  UNION ALL
  SELECT x, n, a, b, l{ROUNDS} * b + r{ROUNDS} AS p, step + 1 FROM (
    SELECT x, n, a, b, step, p // b AS l0, p % b AS r0, {inner} FROM walk WHERE step = 0 OR p >= n
  )
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {SHARDS} AS INTEGER) AS shard, CAST(p // {SHARDS} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM framed JOIN walk USING (x) WHERE step > 0 AND p < walk.n
"""


ORACLE_SQL = _oracle()
