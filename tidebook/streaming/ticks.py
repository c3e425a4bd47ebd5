"""Streaming ticks: minute bars, change-only quotes, conflation, staleness, ordered replay.

What must be remembered between micro-batches is a small table, one row per symbol: its open bar, quote or date.  A
``Fold`` takes a micro-batch and that table and returns what to emit and the table to go on with, all in column
expressions: ticks become one row per symbol and stretch of time by aggregates that are combined before the shuffle,
so a symbol with most of the ticks meets no single task with all of them.  Rows of a micro-batch may come in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.sources.folders import names, remove
from tidebook.sources.views import ohlcv

#: Seconds after which a symbol without ticks is forgotten, counted back from the newest tick of all symbols.
FORGET = 90 * 86_400
#: Seconds of a symbol's quotes that one window compares.
SLICE = 3600


@dataclass
class Fold:
    """A step over micro-batches: ``run(batch, state)`` gives rows and the next state; their schemas as text."""

    run: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
    rows: str
    state: str


def windowed_bars(ticks: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Bars of tumbling windows with a watermark: ticks up to ``late`` behind still count."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "ts").alias("c"), F.count("*").alias("v"))
        .select("symbol", F.col("w.start").alias("t"), "o", "h", "l", "c", "v")
    )


def _recent(state: DataFrame, seconds: F.Column, forget: int) -> DataFrame:
    """State with a column ``gone``: whether its symbol has been quiet for longer than ``forget`` seconds."""
    newest = state.agg(F.max(seconds).alias("newest"))  # one row
    return state.crossJoin(F.broadcast(newest)).withColumn("gone", F.col("newest") - seconds > forget).drop("newest")


def rolled_bars(seconds: int = 60, forget: int = FORGET) -> Fold:
    """Bars that close when a later tick arrives: symbol, t, o, h, l, c, v.

    Ticks have symbol, ts, price, cum (volume traded so far).  A bar's volume is what the cumulative volume grew since
    the bar before; the first bar of a symbol, whose beginning was not seen, is dropped.  Ticks of a bar that is closed
    already are ignored; of equal times the smaller ``cum`` is first.  The open bar of a forgotten symbol is closed.
    """
    held = "symbol string, start long, o double, h double, l double, c double, cum long, before long"

    def run(ticks: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        start = F.floor(F.unix_seconds("ts") / seconds).cast("long") * seconds
        when = F.struct("ts", "cum")
        new = ticks.groupBy("symbol", start.alias("start")).agg(
            F.min_by("price", when).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
            F.max_by("price", when).alias("c"), F.max_by("cum", when).alias("cum"),
        )
        both = new.withColumn("before", F.lit(None).cast("long")).withColumn("age", F.lit(1)).unionByName(state.withColumn("age", F.lit(0)))
        bars = both.groupBy("symbol", "start").agg(
            F.min_by("o", "age").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "age").alias("c"),
            F.max_by("cum", "age").alias("cum"), F.max("before").alias("before"), F.min("age").alias("age"),
        )
        of_symbol = Window.partitionBy("symbol")
        in_time = of_symbol.orderBy("start")
        opened = F.coalesce(F.max(F.when(F.col("age") == 0, F.col("start"))).over(of_symbol), F.col("start"))
        bars = bars.withColumn("opened", opened).where(F.col("start") >= F.col("opened"))
        bars = bars.withColumn("before", F.coalesce("before", F.lag("cum").over(in_time))).withColumn("closed", F.lead("start").over(in_time).isNotNull())
        last = _recent(bars.where(~F.col("closed")), F.col("start"), forget)
        done = bars.where("closed").unionByName(last.where("gone").drop("gone")).where(F.col("before").isNotNull())
        rows = done.select("symbol", F.timestamp_seconds("start").alias("t"), "o", "h", "l", "c", (F.col("cum") - F.col("before")).alias("v"))
        return rows, last.where(~F.col("gone")).select("symbol", "start", "o", "h", "l", "c", "cum", "before")

    return Fold(run, "symbol string, t timestamp, o double, h double, l double, c double, v long", held)


def changes(forget: int = FORGET) -> Fold:
    """Quotes that differ from their symbol's last one: symbol, ts, price.

    Quotes are compared inside slices of ``SLICE`` seconds, and a slice's first with the end of the slice before; the
    first of a batch meets the newest quote of the batches before.  Of equal times the smaller price is first.
    """
    schema = "symbol string, ts timestamp, price double"

    def run(quotes: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        cut = quotes.select("symbol", "ts", "price", F.floor(F.unix_seconds("ts") / SLICE).alias("slice"))
        end = F.max(F.struct("ts", "price"))
        slices = cut.groupBy("symbol", "slice").agg(end.alias("end"))
        in_time = Window.partitionBy("symbol").orderBy("slice")
        known = state.select("symbol", F.col("price").alias("known"))
        first = F.row_number().over(in_time) == 1
        before = F.when(first, F.col("known")).otherwise(F.lag("end.price").over(in_time))
        borders = slices.join(known, "symbol", "left").select("symbol", "slice", before.alias("border"))
        inside = Window.partitionBy("symbol", "slice").orderBy("ts", "price")
        last = F.when(F.row_number().over(inside) == 1, F.col("border")).otherwise(F.lag("price").over(inside))
        rows = cut.join(borders, ["symbol", "slice"]).withColumn("last", last).where(~F.col("price").eqNullSafe(F.col("last")))
        ends = slices.select("symbol", "end").unionByName(state.select("symbol", F.struct("ts", "price").alias("end")))
        newest = ends.groupBy("symbol").agg(F.max("end").alias("end")).select("symbol", "end.ts", "end.price")
        return rows.select("symbol", "ts", "price"), _recent(newest, F.unix_seconds("ts"), forget).where(~F.col("gone")).drop("gone")

    return Fold(run, schema, schema)


def in_order() -> Fold:
    """Bars of each symbol in the order of their days: a repeated day is skipped, an earlier one is an error.

    Of several bars of a day in one batch the one of the smallest run_id stays.  No symbol is forgotten: its last day
    is what tells a repeated bar.
    """

    def run(bars: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        days = bars.groupBy("symbol", "d").agg(F.min_by("c", F.struct("run_id", "c")).alias("c"))
        met = days.join(state.withColumnRenamed("d", "last"), "symbol", "left")
        late = F.raise_error(F.format_string("%s: bar of %s after %s", "symbol", F.col("d").cast("string"), F.col("last").cast("string")))
        fresh = F.when(F.col("d") < F.col("last"), late.cast("boolean")).otherwise(F.col("last").isNull() | (F.col("d") > F.col("last")))
        ends = days.select("symbol", "d").unionByName(state).groupBy("symbol").agg(F.max("d").alias("d"))
        return met.where(fresh).select("symbol", "d", "c"), ends

    return Fold(run, "symbol string, d date, c double", "symbol string, d date")


def conflate(batch: DataFrame) -> DataFrame:
    """The newest message of each key in a batch."""
    return batch.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("price", "ts").alias("price"))


def stale(latest: DataFrame, now: str, seconds: int = 10) -> DataFrame:
    """Whether the last message of each key is older than ``seconds``."""
    return latest.withColumn("stale", F.lit(now).cast("timestamp") - F.col("ts") > F.expr(f"INTERVAL {seconds} SECONDS"))


def to_folder(stream: DataFrame, path: str, mode: str = "append", fold: Fold | None = None) -> DataFrame:
    """Run a stream over all that is there now, write it to ``path``, and read that back.

    Each batch has a folder of its own, named by its number, which a batch that is run again after a failure replaces.
    So has the state of a ``fold``: a batch reads that of the batch before, which it never changes; older state is removed
    once a batch is written.  In complete mode the newest folder is read, whichever run wrote it, so readers never see a
    folder that is being overwritten.
    """
    spark = stream.sparkSession
    schema = spark.createDataFrame([], fold.rows if fold else stream.schema).schema

    def write(batch: DataFrame, number: int) -> None:
        if fold is None:
            batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
            return
        own = batch.sparkSession
        state = own.read.schema(fold.state).parquet(f"{path}/state/batch={number - 1}") if number else own.createDataFrame([], fold.state)
        batch.persist()
        try:
            rows, state = fold.run(batch, state)
            state.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
            rows.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        finally:
            batch.unpersist()
        remove(own, f"{path}/state/batch={number - 2}")

    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/data/batch=-1")  # so that an empty stream reads as empty
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "complete":
        numbers = [int(name.removeprefix("batch=")) for name in names(spark, f"{path}/data") if name.startswith("batch=")]
        return spark.read.schema(schema).parquet(f"{path}/data/batch={max(numbers)}")
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/data").drop("batch")


def tail_bars(history: DataFrame, cutoff: str, n: int) -> DataFrame:
    """What an indicator of n bars needs to go on after a date: the last n - 1 bars up to it, and all later ones."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))
    old = history.where(F.col("d") <= F.lit(cutoff).cast("date")).withColumn("back", newest).where(F.col("back") < n).drop("back")
    return old.unionByName(history.where(F.col("d") > F.lit(cutoff).cast("date")))


def fold_forming(closed: DataFrame, ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Closed bars with the bars that later ticks form: symbol, t, o, h, l, c, v, forming.

    A tick of a bar that is closed already is ignored.
    """
    last = closed.groupBy("symbol").agg(F.max("t").alias("last_t"))
    placed = ticks.withColumn("t", F.date_trunc(unit, "ts").cast("timestamp_ntz")).join(last, "symbol", "left")
    open_ = placed.where(F.col("last_t").isNull() | (F.col("t") > F.col("last_t")))
    bars = ohlcv(open_, ["symbol", "t"], "price", "ts")
    return closed.withColumn("forming", F.lit(False)).unionByName(bars.withColumn("forming", F.lit(True)))
