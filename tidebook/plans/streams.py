"""Streaming queries over the events table, run to its end, and their batch SQL; stores and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.plans.indicators import ORACLES as INDICATORS
from tidebook.sources import log as L
from tidebook.sources import sinks as K
from tidebook.sources import views as V
from tidebook.streaming import averages as A
from tidebook.streaming import ticks as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query together with its SQL."""

    def add(run):
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return add


def _stream(spark, sf_dir):
    """The events table as a stream of ticks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("cum"))


def _out(df, *times):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in times else F.col(c) for c in df.columns])


@query("st01_windowed_bars", f"WITH {V.SQL_BARS_H} SELECT * FROM bars_h")
def st01w(spark, sf_dir):
    """Hourly bars by watermark and tumbling window."""
    bars = T.windowed_bars(_stream(spark, sf_dir), "1 hour", "1 hour")
    return _out(T.to_folder(bars, K.shared_folder(spark, "windowed"), "complete"), "t")


@query(
    "st01_rolled_bars",
    """WITH y AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS t, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c, arg_max(event_id, ts) AS cum FROM events GROUP BY ALL),
 z AS (SELECT *, lag(cum) OVER w AS before, lead(t) OVER w AS later FROM y WINDOW w AS (PARTITION BY symbol ORDER BY t))
 SELECT symbol, t, o, h, l, c, cum - before AS v FROM z WHERE before IS NOT NULL AND later IS NOT NULL""",
)
def st01r(spark, sf_dir):
    """Hourly bars closed by the next tick; first dropped, last still open."""
    return _out(T.to_folder(_stream(spark, sf_dir), K.shared_folder(spark, "rolled"), fold=T.rolled_bars(3600)), "t")


@query(
    "st02_changes",
    "SELECT symbol, ts, price FROM (SELECT event_type AS symbol, ts, round(value / 10) AS price, lag(round(value / 10)) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events) WHERE price IS DISTINCT FROM before",
)
def st02(spark, sf_dir):
    """Quotes that changed."""
    coarse = _stream(spark, sf_dir).select("symbol", "ts", F.round(F.col("price") / 10).alias("price"))
    return _out(T.to_folder(coarse, K.shared_folder(spark, "changes"), fold=T.changes()), "ts")


@query("st03_conflated", "SELECT event_type AS symbol, max(ts) AS ts, arg_max(value, ts) AS price FROM events GROUP BY ALL")
def st03(spark, sf_dir):
    """The newest message of each key."""
    newest = T.conflate(_stream(spark, sf_dir))
    return _out(T.to_folder(newest, K.shared_folder(spark, "conflated"), "complete"), "ts")


@query("st05_staleness", "SELECT event_type AS symbol, max(ts) AS ts, TIMESTAMP '2024-01-31' - max(ts) > INTERVAL 40 MINUTE AS stale FROM events GROUP BY ALL")
def st05(spark, sf_dir):
    """Which keys have gone quiet."""
    newest = V.ticks(spark, sf_dir).groupBy("symbol").agg(F.max("ts").cast("timestamp").alias("ts"))
    return _out(T.stale(newest, "2024-01-31 00:00:00", 2400), "ts")


@query("st07_ordered_replay", f"WITH {V.SQL_VERSIONS} SELECT symbol, d, c FROM versions WHERE run_id = 1")
def st07(spark, sf_dir):
    """Bars of a log that repeats some: the first of each day stays."""
    path = K.shared_folder(spark, "log")
    V.versions(spark, sf_dir).write.parquet(path)
    log = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return T.to_folder(log, K.shared_folder(spark, "ordered"), fold=T.in_order())


def _in_parts(spark, sf_dir, name):
    """Averages of daily bars that are appended to a log in four parts, the stream started anew after each."""
    bars, path, out = V.daily_bars(spark, sf_dir), K.shared_folder(spark, f"{name}-log"), K.shared_folder(spark, name)
    for since, until in (("0001", "1996"), ("1996", "1998"), ("1998", "2001"), ("2001", "9999")):
        bars.where((F.col("d") >= F.lit(f"{since}-07-01").cast("date")) & (F.col("d") < F.lit(f"{until}-07-01").cast("date"))).write.mode("append").parquet(path)
        found = T.to_folder(A.incremental(spark.readStream.schema(bars.schema).parquet(path)), out)
    return found


@query("i19_incremental_atr", INDICATORS["i12_atr"])
def i19(spark, sf_dir):
    """Average true range kept up to date as bars come in."""
    return _in_parts(spark, sf_dir, "atr").select("symbol", "d", F.round("atr", 6).alias("atr"))


@query("i19_incremental_ema", INDICATORS["i05_ema"])
def i19e(spark, sf_dir):
    """Exponential average kept up to date as bars come in."""
    return _in_parts(spark, sf_dir, "ema").select("symbol", "d", F.round("ema", 6).alias("ema"))


_TICK = "symbol string, ts timestamp_ntz, price double"
#: What each of the three publishes has; the first and the last are open to the past and the future.
_STRETCHES = ("ts < TIMESTAMP_NTZ'2024-01-11'", "ts >= TIMESTAMP_NTZ'2024-01-11' AND ts < TIMESTAMP_NTZ'2024-01-21'", "ts >= TIMESTAMP_NTZ'2024-01-21'")


def _publish(spark, sf_dir, path, where, done=True):
    """Publish the ticks of a stretch; of equal times the smaller event_id is first, as in the table."""
    ticks = V.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))
    L.publish(ticks.where(where), path, ["ts", "event_id"], done, unsaid=("event_id",))


@query(
    "sc14_whole_log",
    """SELECT row_number() OVER (ORDER BY ts) - 1 + CASE WHEN ts >= TIMESTAMP '2024-01-11' THEN 1 ELSE 0 END + CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN 1 ELSE 0 END AS "offset",
 event_type AS symbol, ts, value AS price FROM events""",
)
def sc14(spark, sf_dir):
    """A log of three publishes, each with its end marker, read whole."""
    path = K.shared_folder(spark, "log")
    for where in _STRETCHES:
        _publish(spark, sf_dir, path, where)
    return L.whole_log(spark, path, _TICK)


@query(
    "sc15_tail",
    """SELECT row_number() OVER (ORDER BY ts) + (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-11') AS "offset", event_type AS symbol, ts, value AS price
 FROM events WHERE ts >= TIMESTAMP '2024-01-11'""",
)
def sc15(spark, sf_dir):
    """A consumer that joins late: it sees what is published after it came, once."""
    path, out = K.shared_folder(spark, "tail-log"), K.shared_folder(spark, "tail")
    _publish(spark, sf_dir, path, _STRETCHES[0])
    T.to_folder(L.tailed(spark, path, _TICK, "latest"), out)
    _publish(spark, sf_dir, path, _STRETCHES[1], done=False)
    T.to_folder(L.tailed(spark, path, _TICK, "latest"), out)
    _publish(spark, sf_dir, path, _STRETCHES[2])
    return T.to_folder(L.tailed(spark, path, _TICK, "latest"), out)


@query("sk01_upsert", f"WITH {V.SQL_VERSIONS} SELECT symbol, d, arg_max(c, run_id) AS c, max(run_id) AS run_id FROM versions GROUP BY ALL")
def sk01(spark, sf_dir):
    """Bars after a restating run was merged in."""
    v = V.versions(spark, sf_dir).select("symbol", "d", "c", "run_id")
    return K.upsert(v.where("run_id = 1"), v.where("run_id = 2"), ["symbol", "d"], "run_id").select("symbol", "d", "c", "run_id")


@query("sk02_partition_overwrite", f"WITH {V.SQL_BARS_D} SELECT symbol, d, CASE WHEN symbol = '5-LOW' THEN c * 2 ELSE c END AS c FROM bars_d")
def sk02(spark, sf_dir):
    """A store of which one partition was replaced."""
    path = K.shared_folder(spark, "partitions")
    bars = V.daily_bars(spark, sf_dir).select("symbol", "d", "c")
    K.overwrite_partitions(bars, path, "symbol")
    K.overwrite_partitions(bars.where("symbol = '5-LOW'").withColumn("c", F.col("c") * 2), path, "symbol")
    return spark.read.parquet(path).select("symbol", "d", "c")


@query("sk05_recording", f"WITH {V.SQL_BARS_D} SELECT symbol, count(*) AS n, sum(c) AS total FROM (SELECT symbol, CAST(c AS DECIMAL(18,2)) AS c FROM bars_d) GROUP BY ALL".replace("sum(c) AS total", "CAST(sum(c) AS DOUBLE) AS total"))
def sk05(spark, sf_dir):
    """A recorded replay, read back."""
    path = K.shared_folder(spark, "recording")
    K.record(V.daily_bars(spark, sf_dir).select(F.lit("bar").alias("event"), "symbol", "d", "c"), path)
    lines = spark.read.text(path).select(F.from_json(F.split("value", "\t")[1], "symbol string, d date, c double").alias("x"))
    return lines.groupBy("x.symbol").agg(F.count("*").alias("n"), F.sum(F.col("x.c").cast("decimal(18,2)")).cast("double").alias("total"))
