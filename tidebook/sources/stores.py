"""A bar store that reads of few instruments prune, ordered reads of all of it in bounded memory, and wide panels.

Instruments are numbered; ``BATCH`` neighbouring numbers share a partition of the store, whose files are sorted by instrument
and time.  A read joins the wanted instruments on partition and number, so that Spark prunes partitions by what the
other side turns out to hold.  A panel has one row per time and group of instruments, and a column for each place in
the group, so its width is bounded whatever the number of instruments; a task makes rows of a range of groups and times that
holds about ``PANEL_ROWS`` bars, so its memory is bounded as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Instruments of a partition: what one request reads.
BATCH = 25
#: Instruments side by side in a panel.
WIDTH = 50
#: Bars that one task makes a panel's rows of.
PANEL_ROWS = 250_000
#: Rows of one file of the store.
FILE_ROWS = 2_000_000


def write_bars(bars: DataFrame, path: str, by: str = "sid", time: str = "d", batch: int = BATCH) -> None:
    """Write bars to a store: one partition for ``batch`` instruments, files of it sorted by instrument and time.

    Files are cut by ranges of instrument and time, so an instrument with most of the bars has several.
    """
    placed = bars.withColumn("batch", F.floor(F.col(by) / batch).cast("long"))
    ranged = placed.repartitionByRange("batch", by, time).sortWithinPartitions("batch", by, time)
    ranged.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("batch").parquet(path)


def read_bars(spark: SparkSession, path: str, wanted: DataFrame, by: str = "sid", batch: int = BATCH) -> DataFrame:
    """Bars of the instruments in ``wanted``, a table with a column ``by``; partitions without any are not read."""
    keys = wanted.select(by).distinct().withColumn("batch", F.floor(F.col(by) / batch).cast("long"))
    return spark.read.parquet(path).join(keys, ["batch", by]).drop("batch")


def fold_series(spark: SparkSession, path: str, step: Callable[[dict | None, dict], dict], schema: str, by: str = "sid", time: str = "d") -> DataFrame:
    """One row per instrument from ``step(state, row)``, called for its bars in order of time, the first time with None.

    The store's rows stream through in order, one Arrow batch after the other; a task holds a batch and one state.  Instruments
    come to tasks by hash, so each is met whole by one task.
    """
    rows = spark.read.parquet(path).drop("batch")
    names = rows.columns
    out = spark.createDataFrame([], schema).schema
    kept = out.fieldNames()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        now, state, done = None, None, []

        def handed(rows):
            return pa.RecordBatch.from_pylist([{k: r[k] for k in kept} for r in rows], schema=kinds)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                row = dict(zip(names, row, strict=True))
                if state is not None and row[by] != now:
                    done.append(state)
                    state = None
                now, state = row[by], step(state, row)
            if done:
                yield handed(done)
                done = []
        if state is not None:
            yield handed([state])

    return rows.repartition(by).sortWithinPartitions(by, time).mapInArrow(run, out)


def write_panel(bars: DataFrame, path: str, value: str = "c", by: str = "sid", time: str = "d", width: int = WIDTH) -> None:
    """Write one value of all bars as a panel: ``time``, p0, p1 and so on, partitioned by group of instruments, sorted by time."""
    at = F.pmod(F.col(by), F.lit(width)).cast("int")
    placed = bars.select(F.floor(F.col(by) / width).cast("long").alias("group"), time, at.alias("at"), value).persist(StorageLevel.DISK_ONLY)
    try:
        parts = -(-placed.count() // PANEL_ROWS) or 1
        ranged = placed.repartitionByRange(parts, "group", time)  # the pivot stays in these ranges
        wide = ranged.groupBy("group", time).pivot("at", list(range(width))).agg(F.first(value))
        wide = wide.select("group", time, *[F.col(str(i)).alias(f"p{i}") for i in range(width)])
        wide.sortWithinPartitions("group", time).write.mode("overwrite").partitionBy("group").parquet(path)
    finally:
        placed.unpersist()


def read_panel(spark: SparkSession, path: str, value: str = "c", by: str = "sid", time: str = "d") -> DataFrame:
    """The panel as a long table again, without what was not there."""
    wide = spark.read.parquet(path)
    places = [c for c in wide.columns if c not in ("group", time)]
    long = wide.unpivot(["group", time], places, "at", value).where(F.col(value).isNotNull())
    sid = F.col("group").cast("long") * len(places) + F.substring("at", 2, 9).cast("long")
    return long.select(sid.alias(by), time, value)
