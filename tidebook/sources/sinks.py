"""Sinks and stores on plain Parquet: upserts, partition overwrites, append-only publishing, recordings, hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.asof import latest
from tidebook.operators.screens import finite
from tidebook.sources.folders import names


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, or a local one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidebook-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the highest version of each key."""
    values = [c for c in old.columns if c not in keys]
    return latest(old.unionByName(new), keys, [version], values)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that ``df`` has rows of, and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def publish_members(members: DataFrame, known: DataFrame, path: str, universe: str, snap_date: str) -> int:
    """Append a universe snapshot after checks: known instruments, none twice, no such snapshot yet.  Returns its members' number."""
    spark = members.sparkSession
    day = F.lit(snap_date).cast("date")
    if names(spark, path):
        there = spark.read.parquet(path)
        if not there.where((F.col("universe") == universe) & (F.col("snap_date") == day)).isEmpty():
            raise ValueError(f"universe {universe} of {snap_date} is published already")
    sids = members.select("sid")
    unknown = sids.join(known.select("sid"), "sid", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown instruments, such as {[r['sid'] for r in unknown]}")
    repeated = sids.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"repeated instruments, such as {[r['sid'] for r in repeated]}")
    counted = Observation()
    out = sids.withColumn("universe", F.lit(universe)).withColumn("snap_date", day).observe(counted, F.count("*").alias("n"))
    out.write.mode("append").parquet(path)
    return counted.get["n"]


def record(events: DataFrame, path: str) -> None:
    """A replay as compressed lines of kind, tab, JSON; undefined numbers become null."""
    lines = finite(events).select(F.concat_ws("\t", F.col("event"), F.to_json(F.struct("*"))).alias("value"))
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def content_hash(df: DataFrame) -> int:
    """A hash of all rows that does not depend on their order."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()["h"] or 0
