"""A log of records with offsets, published in turns, and a Spark data source that reads it whole, to its end, or as it grows.

A publish numbers its rows in their order, by distributed running totals, and writes them in segments of ``SEGMENT`` offsets;
only then an empty file names its range, and whether the publisher is done, so a publish is there whole or not at all and a
failed one can be repeated.  A read plans one task a segment from these names.  ``{"kind": "end"}`` closes a publish, not the
log: a bounded read ends where the log did when it began, on a record that is such a marker; a log whose last publish is
still open is followed until its marker comes or nothing has come for a while.

The source reads files by pyarrow, so the log's folder must be a path or URI that pyarrow opens on driver and executors.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidebook.operators.scans import running, sliced

#: Offsets of a segment.
SEGMENT = 100_000
RECORD = "offset long, kind string, payload string"
FORMAT = "tidebook_log"
#: Times in payloads keep their microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass(frozen=True)
class Publish:
    """A published range of offsets, the end left out, whether its publisher was done, and the offsets of its segments."""

    first: int
    end: int
    done: bool
    segment: int

    @property
    def name(self) -> str:
        return f"{self.first:020d}-{self.end:020d}-{self.segment}-{'end' if self.done else 'open'}"


@dataclass(frozen=True)
class Segment(InputPartition):
    """Offsets of one segment folder."""

    folder: str
    first: int
    end: int


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def publishes(path: str) -> list[Publish]:
    """The publishes of a log, in order."""
    from pyarrow import fs

    system, at = _file_system(path)
    found = system.get_file_info(fs.FileSelector(f"{at}/published", allow_not_found=True))
    parts = sorted(f.base_name.split("-") for f in found if f.base_name.count("-") == 3)
    return [Publish(int(a), int(b), c == "end", int(n)) for a, b, n, c in parts]


def log_end(path: str) -> tuple[int, bool]:
    """The offset behind the last record, and whether that record is an end marker."""
    last = (publishes(path) or [Publish(0, 0, False, 1)])[-1]
    return last.end, last.done


def segments(path: str, first: int, end: int) -> list[Segment]:
    """What a read of a range of offsets opens."""
    found = []
    for p in publishes(path):
        lo, hi = max(first, p.first), min(end, p.end)
        for k in range((lo - p.first) // p.segment, -(-(hi - p.first) // p.segment)) if lo < hi else ():
            at = p.first + k * p.segment
            found.append(Segment(f"{path}/records/first={p.first}/segment={k}", max(lo, at), min(hi, at + p.segment)))
    return found


def read_segment(segment: Segment) -> Iterator:
    """Record batches of a segment's offsets, in order."""
    import pyarrow.dataset as ds

    system, at = _file_system(segment.folder)
    wanted = (ds.field("offset") >= segment.first) & (ds.field("offset") < segment.end)
    rows = ds.dataset(at, filesystem=system, format="parquet").to_table(columns=["offset", "kind", "payload"], filter=wanted)
    yield from rows.sort_by("offset").to_batches(10_000)


class LogReader(DataSourceReader):
    """A bounded read: from the first record to the end of the log, once its last publish is done."""

    def __init__(self, path: str, idle: float):
        self.path, self.idle = path, idle

    def partitions(self) -> list[Segment]:
        end, done = log_end(self.path)
        since = time.monotonic()
        while not done and time.monotonic() - since < self.idle:
            time.sleep(min(0.2, self.idle))
            now, done = log_end(self.path)
            if now != end:
                end, since = now, time.monotonic()
        return segments(self.path, 0, end) or [Segment("", 0, 0)]

    def read(self, partition: Segment) -> Iterator:
        return read_segment(partition) if partition.folder else iter(())


class LogStreamReader(DataSourceStreamReader):
    """A tail: each micro-batch has what has been published since the one before."""

    def __init__(self, path: str, start: str):
        self.path, self.start = path, start

    def initialOffset(self) -> dict:
        return {"offset": {"earliest": 0, "latest": log_end(self.path)[0]}.get(self.start, self.start if self.start.isdigit() else None)}

    def latestOffset(self) -> dict:
        return {"offset": log_end(self.path)[0]}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return segments(self.path, int(start["offset"]), int(end["offset"])) or [Segment("", 0, 0)]

    def read(self, partition: Segment) -> Iterator:
        return read_segment(partition) if partition.folder else iter(())

    def commit(self, end: dict) -> None:
        """Nothing to free: the log keeps its records."""


class LogSource(DataSource):
    """Options: ``path``; for a bounded read ``idle`` seconds to wait for an end; for a stream ``start``, an offset, earliest or latest."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> LogReader:
        return LogReader(self._path(), float(self.options.get("idle", "0")))

    def streamReader(self, schema) -> LogStreamReader:
        start = self.options.get("start", "earliest")
        if start not in ("earliest", "latest") and not start.isdigit():
            raise ValueError(f"start {start!r} is neither earliest, latest nor an offset")
        return LogStreamReader(self._path(), start)

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("a log needs a path")
        return self.options["path"].rstrip("/")


def publish(records: DataFrame, path: str, order: list[str], done: bool = True, unsaid: tuple[str, ...] = ()) -> Publish:
    """Append records (their columns as JSON) in their order, and an end marker if the publisher is done.

    One publisher at a time.  ``order`` settles ties, its first column is a number or time.  Columns of ``unsaid`` order the
    records and are not published.
    """
    path = path.rstrip("/")
    spark = records.sparkSession
    first = log_end(path)[0]
    said = [c for c in records.columns if c not in unsaid]
    numbered = running(sliced(records, order[0]), order, {"i_": ("count", F.lit(1))})
    rows = numbered.select((F.col("i_") - 1 + first).alias("offset"), F.lit("record").alias("kind"), F.to_json(F.struct(*said), _TIMES).alias("payload"))
    n = records.count()
    if done:
        rows = rows.unionByName(spark.createDataFrame([(first + n, "end", None)], RECORD))
    placed = rows.withColumn("segment", F.floor((F.col("offset") - first) / SEGMENT))
    ranged = placed.repartitionByRange("segment", "offset").sortWithinPartitions("segment", "offset")
    ranged.write.mode("overwrite").partitionBy("segment").parquet(f"{path}/records/first={first}")
    made = Publish(first, first + n + done, done, SEGMENT)
    system, at = _file_system(path)
    system.create_dir(f"{at}/published", recursive=True)
    with system.open_output_stream(f"{at}/published/{made.name}"):
        pass
    return made


def whole_log(spark: SparkSession, path: str, schema: str, idle: float = 0) -> DataFrame:
    """(offset, the records' columns) of the whole log, without markers."""
    spark.dataSource.register(LogSource)
    return _records(spark.read.format(FORMAT).option("idle", str(idle)).load(path), schema)


def tailed(spark: SparkSession, path: str, schema: str, start: str = "earliest") -> DataFrame:
    """The log as a stream of (offset, the records' columns)."""
    spark.dataSource.register(LogSource)
    return _records(spark.readStream.format(FORMAT).option("start", start).load(path), schema)


def _records(log: DataFrame, schema: str) -> DataFrame:
    return log.where("kind = 'record'").select("offset", F.from_json("payload", schema, _TIMES).alias("r")).select("offset", "r.*")
