"""Derived market views of the driver's tables: bars, ticks, facts, instruments, actions.

Every view is a lazy DataFrame; filters and column lists of its users reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(ticks: DataFrame, keys: list[str], price: str, order: str, volume=None) -> DataFrame:
    """Roll prices up to bars: first, highest, lowest and last price of a group, and its volume."""
    return ticks.groupBy(*keys).agg(
        F.min_by(price, order).alias("o"),
        F.max(price).alias("h"),
        F.min(price).alias("l"),
        F.max_by(price, order).alias("c"),
        (F.count("*") if volume is None else F.sum(volume)).alias("v"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per order priority (the symbol) and day: symbol, d, o, h, l, c, v."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_totalprice"
    )
    return ohlcv(orders, ["symbol", "d"], "o_totalprice", "o_orderkey")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as ticks: symbol, ts, price."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per symbol and hour: symbol, t, o, h, l, c, v."""
    return ohlcv(
        ticks(spark, sf_dir).withColumn("t", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["symbol", "t"], "price", "ts"
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by ingest run: run 1 has all, run 2 restates closes of every seventh day of the month."""
    bars = daily_bars(spark, sf_dir)
    first = bars.withColumn("run_id", F.lit(1).cast("long"))
    second = bars.where(F.dayofmonth("d") % 7 == 0).withColumn("c", F.round(F.col("c") + 1, 2))
    return first.unionByName(second.withColumn("run_id", F.lit(2).cast("long")))


def facts(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Bitemporal facts by supplier and month, with a restatement a year on.

    Columns: sid, concept, period_start, period_end, filed_at, value, provider.  With ``until`` the scan stops at that
    date, as do the filings: a figure is filed after the end of its period.
    """
    source = table(spark, sf_dir, "lineitem")
    if until is not None:
        return _facts(source.where(F.col("l_shipdate") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz"))).where(F.col("filed_at") <= F.lit(until).cast("date"))
    return _facts(source)


def _facts(lineitem: DataFrame) -> DataFrame:
    lines = lineitem.select(
        F.col("l_suppkey").alias("sid"),
        F.trunc("l_shipdate", "month").alias("period_start"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("revenue"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
    )
    months = lines.groupBy("sid", "period_start").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("double").alias("quantity")
    )
    filed = months.select(
        "sid",
        "period_start",
        F.last_day("period_start").alias("period_end"),
        F.date_add(F.last_day("period_start"), (20 + F.col("sid") % 25).cast("int")).alias("first_filed"),
        F.expr("stack(2, 'revenue', revenue, 'quantity', quantity) AS (concept, value)"),
    )
    original = filed.select(
        "sid", "concept", "period_start", "period_end", F.col("first_filed").alias("filed_at"), "value", F.lit("sec").alias("provider")
    )
    restated = filed.where((F.month("period_end") % 3 == 0) & (F.col("sid") % 4 == 1)).select(
        "sid",
        "concept",
        "period_start",
        "period_end",
        F.date_add("first_filed", 365).alias("filed_at"),
        F.round(F.col("value") * 1.01, 4).alias("value"),
        F.lit("sec").alias("provider"),
    )
    vendor = filed.where(F.col("sid") % 10 == 3).select(
        "sid", "concept", "period_start", "period_end", F.col("first_filed").alias("filed_at"), (F.col("value") * 2).alias("value"), F.lit("vendor").alias("provider")
    )
    return original.where(F.col("sid") % 10 != 7).unionByName(restated.where(F.col("sid") % 10 != 7)).unionByName(vendor).unionByName(
        original.where(F.col("sid") % 10 == 7).withColumn("provider", F.lit("vendor"))
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation and region: sid, name, country, region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s["s_nationkey"] == n["n_nationkey"])
        .join(r, n["n_regionkey"] == r["r_regionkey"])
        .select(F.col("s_suppkey").alias("sid"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    )


ACTIONS = (
    ("1-URGENT", "1996-03-04", "split", 2.0, None),
    ("1-URGENT", "1997-06-10", "dividend", None, 50.0),
    ("2-HIGH", "1998-01-05", "dividend", None, 120.0),
    ("2-HIGH", "1998-01-05", "split", 3.0, None),
    ("3-MEDIUM", "1999-05-17", "split", 0.5, None),
    ("4-NOT SPECIFIED", "2000-02-28", "dividend", None, 75.5),
    ("5-LOW", "2010-01-01", "split", 4.0, None),
)


def actions(spark: SparkSession) -> DataFrame:
    """Corporate actions: symbol, ex_date, action_type, split_ratio, dividend."""
    return spark.createDataFrame(list(ACTIONS), "symbol string, ex string, action_type string, split_ratio double, dividend double").select(
        "symbol", F.to_date("ex").alias("ex_date"), "action_type", "split_ratio", "dividend"
    )


def yearly_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions of the orders: on its first day of a year a symbol splits, every third year, or pays a dividend."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("d"), "o_totalprice")
    years = orders.groupBy("symbol", F.year("d").alias("y")).agg(F.min("d").alias("ex_date"), F.min("o_totalprice").alias("low"))
    splits = F.col("y") % 3 == 0
    return years.select(
        "symbol",
        "ex_date",
        F.when(splits, "split").otherwise("dividend").alias("action_type"),
        F.when(splits, 2.0).alias("split_ratio"),
        F.when(~splits, F.floor("low") / 100).alias("dividend"),
    )


# The same views for DuckDB, as common table expressions.
SQL_BARS_D = """bars_d AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS o,
 max(o_totalprice) AS h, min(o_totalprice) AS l, arg_max(o_totalprice, o_orderkey) AS c, count(*) AS v FROM orders GROUP BY ALL)"""
SQL_TICKS = "ticks AS (SELECT event_type AS symbol, ts, value AS price FROM events)"
SQL_BARS_H = SQL_TICKS + """, bars_h AS (SELECT symbol, date_trunc('hour', ts) AS t, arg_min(price, ts) AS o, max(price) AS h,
 min(price) AS l, arg_max(price, ts) AS c, count(*) AS v FROM ticks GROUP BY ALL)"""
SQL_VERSIONS = SQL_BARS_D + """, versions AS (SELECT symbol, d, o, h, l, c, v, CAST(1 AS BIGINT) AS run_id FROM bars_d
 UNION ALL SELECT symbol, d, o, h, l, round(c + 1, 2), v, 2 FROM bars_d WHERE day(d) % 7 = 0)"""
SQL_FACTS = """months AS (SELECT l_suppkey AS sid, CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
 FROM lineitem GROUP BY ALL), filed AS (
 SELECT sid, period_start, last_day(period_start) AS period_end, last_day(period_start) + CAST(20 + sid % 25 AS INTEGER) AS first_filed, concept, value
 FROM (SELECT *, 'revenue' AS concept, revenue AS value FROM months UNION ALL SELECT *, 'quantity', quantity FROM months)), facts AS (
 SELECT sid, concept, period_start, period_end, first_filed AS filed_at, value, CASE WHEN sid % 10 = 7 THEN 'vendor' ELSE 'sec' END AS provider FROM filed
 UNION ALL SELECT sid, concept, period_start, period_end, first_filed + 365, round(value * 1.01, 4), 'sec' FROM filed
   WHERE month(period_end) % 3 = 0 AND sid % 4 = 1 AND sid % 10 <> 7
 UNION ALL SELECT sid, concept, period_start, period_end, first_filed, value * 2, 'vendor' FROM filed WHERE sid % 10 = 3)"""
SQL_INSTRUMENTS = """instruments AS (SELECT s_suppkey AS sid, s_name AS name, n_name AS country, r_name AS region FROM supplier
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_YEARLY_ACTIONS = """yearly AS (SELECT o_orderpriority AS symbol, year(o_orderdate) AS y, CAST(min(o_orderdate) AS DATE) AS ex_date, min(o_totalprice) AS low FROM orders GROUP BY ALL),
 yearly_actions AS (SELECT symbol, ex_date, CASE WHEN y % 3 = 0 THEN 'split' ELSE 'dividend' END AS action_type, CASE WHEN y % 3 = 0 THEN CAST(2 AS DOUBLE) END AS split_ratio,
 CASE WHEN y % 3 <> 0 THEN floor(low) / 100 END AS dividend FROM yearly)"""
SQL_ACTIONS = "actions AS (SELECT a AS symbol, CAST(b AS DATE) AS ex_date, c AS action_type, CAST(e AS DOUBLE) AS split_ratio, CAST(f AS DOUBLE) AS dividend FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in ACTIONS
) + ") t(a, b, c, e, f))"
