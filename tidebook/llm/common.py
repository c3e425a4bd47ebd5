"""Helpers shared by the training-data operators: table paths, Arrow-batch maps and shared-storage checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default place of the public vocabulary file; a parameter of every operator that reads it.
TOKENIZER_FILE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data directory, whatever file system it lives in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` (or the context's); a new local one only on a local master without any."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


#: Rows of a small table that one task writes and later reads, and the fewest tasks.
TASK_ROWS, LEAST_TASKS = 50_000, 12


def shared_checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage through the shared folder.

    With ``rows``, a bound on the table's rows, it goes into as many files as these need, not into one for each partition
    of the shuffle before, and the next shuffle has as many map tasks.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))
    return df.checkpoint(eager=True)


def hub_join(left: DataFrame, right: DataFrame, key: str, total: int, share: int) -> DataFrame:
    """Inner join of ``left`` with one row of ``right`` per key, whose column ``n`` counts the rows of ``left``.

    Rows of keys with over one in ``share`` of ``total`` rows are joined by broadcast: there are fewer than ``share``
    such keys (twice as many if ``total`` counts edges and ``left`` both of their ends).  The column ``n`` is dropped.
    """
    hub = F.col("n") * share > total
    hubs = F.broadcast(right.where(hub).drop("n"))
    rest = left.join(hubs.select(key), key, "left_anti").join(right.where(~hub).drop("n"), key)
    return left.join(hubs, key).unionByName(rest)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that is not taken: ``name``, or ``name`` with underscores behind."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def map_text(
    df: DataFrame,
    text_col: str,
    batch_fn: Callable[[], Callable[[list], list[dict | None]]],
    schema: T.StructType,
    out: str,
    carry: Sequence[str] | None = None,
    binary: bool = False,
) -> DataFrame:
    """Append one struct column ``out`` computed from whole texts, one Arrow batch at a time.

    ``batch_fn()`` is called once per task and returns the function that turns a list of texts (``bytes`` when
    ``binary``; None for null) into a list of dicts of ``schema``.  ``carry`` names the columns to keep (all by
    default); they travel under positional names, so no name of theirs can clash with anything used here.
    """
    names = list(df.columns if carry is None else carry)
    if out in names:
        raise ValueError(f"column {out!r} exists already; choose another name for the result")
    text = F.col(f"`{text_col}`")
    source = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
        (text.cast("binary") if binary else text.cast("string")).alias("t"),
    )
    fields = [source.schema[f"c{i}"] for i in range(len(names))]
    result = T.StructType([*fields, T.StructField("r", schema)])

    def run(batches):
        fn = batch_fn()
        kind = None
        for batch in batches:
            if kind is None:
                from pyspark.sql.pandas.types import to_arrow_type

                kind = to_arrow_type(schema)
            found = pa.array(fn(batch.column(len(names)).to_pylist()), type=kind)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], found], names=[*(f"c{i}" for i in range(len(names))), "r"]
            )

    mapped = source.mapInArrow(run, result)
    return mapped.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("r").alias(out))
