"""Scans, filters, joins, aggregations, sorts and set operations over the derived views, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions import rules as S
from tidebook.operators.asof import latest
from tidebook.sources import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query together with its SQL."""

    def add(run):
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return add


_SIGNALS = f"""{V.SQL_BARS_D}, ch AS (SELECT *, CASE WHEN count(h) OVER p20 = 20 THEN max(h) OVER p20 END AS top, CASE WHEN count(h) OVER p20 = 20 THEN min(l) OVER p20 END AS bottom
 FROM bars_d WINDOW p20 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 signals AS (SELECT symbol, d, 'breakout' AS rule, CASE WHEN c > top THEN 1 ELSE -1 END AS direction, c AS trigger FROM ch WHERE c > top OR c < bottom)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(V.daily_bars(spark, sf_dir), "breakout").drop("data_window_end")


@query("sc01_dedup_scan", f"WITH {V.SQL_VERSIONS} SELECT symbol, d, arg_max(c, run_id) AS c, arg_max(v, run_id) AS v, max(run_id) AS run_id FROM versions GROUP BY ALL")
def sc01(spark, sf_dir):
    """Current bars: the highest run of each key wins."""
    return latest(V.versions(spark, sf_dir), ["symbol", "d"], ["run_id"], ["c", "v", "run_id"])


@query("sc02_bars_window", f"WITH {V.SQL_BARS_D} SELECT * FROM bars_d WHERE symbol IN ('1-URGENT', '5-LOW') AND d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def sc02(spark, sf_dir):
    """Bars of some symbols in a window."""
    return V.daily_bars(spark, sf_dir).where(F.col("symbol").isin("1-URGENT", "5-LOW") & F.col("d").between("1996-01-01", "1996-12-31"))


@query("sc04_intraday_rollup", f"WITH {V.SQL_TICKS} SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS t, arg_min(price, ts) AS o, max(price) AS h, min(price) AS l, arg_max(price, ts) AS c, count(*) AS v FROM ticks GROUP BY ALL")
def sc04(spark, sf_dir):
    """Fifteen-minute bars of ticks."""
    start = F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"].cast("timestamp_ntz")
    return V.ohlcv(V.ticks(spark, sf_dir).withColumn("t", start), ["symbol", "t"], "price", "ts")


@query("sc05_session_minutes", f"WITH {V.SQL_TICKS}, y AS (SELECT symbol, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local, price FROM ticks) SELECT symbol, CAST(local AS DATE) AS session, strftime(local, '%H:%M') AS minute, price FROM y WHERE strftime(local, '%H:%M') BETWEEN '09:30' AND '15:59'")
def sc05(spark, sf_dir):
    """Ticks of the exchange's session, by its local clock."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    y = V.ticks(spark, sf_dir).select("symbol", local.alias("local"), "price")
    out = y.select("symbol", F.to_date("local").alias("session"), F.date_format("local", "HH:mm").alias("minute"), "price")
    return out.where(F.col("minute").between("09:30", "15:59"))


@query("sc09_price_history", f"WITH {V.SQL_BARS_D} SELECT d, c, v FROM bars_d WHERE symbol = '2-HIGH' AND d >= DATE '1998-01-01' ORDER BY d")
def sc09(spark, sf_dir):
    """Price history of a symbol from a date on."""
    return V.daily_bars(spark, sf_dir).where("symbol = '2-HIGH' AND d >= DATE'1998-01-01'").select("d", "c", "v").orderBy("d")


@query("sc10_signal_page", f"WITH {_SIGNALS} SELECT symbol, d, direction, round(trigger, 6) AS trigger FROM signals WHERE direction = 1 ORDER BY d DESC, symbol LIMIT 25 OFFSET 50")
def sc10(spark, sf_dir):
    """The third page of signals of one direction, newest first."""
    page = _signals(spark, sf_dir).where("direction = 1").orderBy(F.desc("d"), "symbol").offset(50).limit(25)
    return page.select("symbol", "d", "direction", F.round("trigger", 6).alias("trigger"))


@query("sc11_actions", f"WITH {V.SQL_YEARLY_ACTIONS} SELECT * FROM yearly_actions WHERE ex_date <= DATE '2001-01-01'")
def sc11(spark, sf_dir):
    """Corporate actions up to a date, splits first."""
    found = V.yearly_actions(spark, sf_dir).where("ex_date <= DATE'2001-01-01'")
    return found.orderBy("symbol", "ex_date", F.when(F.col("action_type") == "split", 0).otherwise(1))


@query("sc12_facts_scan", f"WITH {V.SQL_FACTS} SELECT sid, concept, period_end, filed_at, round(value, 4) AS value, provider FROM facts f WHERE filed_at <= DATE '1998-06-30' AND (provider = 'sec' OR NOT EXISTS (SELECT 1 FROM facts g WHERE g.sid = f.sid AND g.concept = f.concept AND g.provider = 'sec' AND g.filed_at <= DATE '1998-06-30'))")
def sc12(spark, sf_dir):
    """Facts filed up to a date; a vendor's only where the primary source has none."""
    from tidebook.operators.facts import preferred

    known = V.facts(spark, sf_dir).where("filed_at <= DATE'1998-06-30'")
    return preferred(known).select("sid", "concept", "period_end", "filed_at", F.round("value", 4).alias("value"), "provider")


@query("sc13_latest_session", f"WITH {V.SQL_BARS_H} SELECT symbol, t, c FROM bars_h WHERE CAST(t AS DATE) = (SELECT max(CAST(t AS DATE)) FROM bars_h)")
def sc13(spark, sf_dir):
    """The bars of the latest session."""
    bars = V.hourly_bars(spark, sf_dir)
    last = V.ticks(spark, sf_dir).agg(F.max(F.to_date("ts")).alias("last"))  # one row
    return bars.join(F.broadcast(last), F.to_date("t") == F.col("last")).select("symbol", "t", "c")


@query("sc17_weekday_calendar", "SELECT CAST(d AS DATE) AS d FROM range(TIMESTAMP '2023-01-01', TIMESTAMP '2026-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5")
def sc17(spark, sf_dir):
    """Weekdays of three years."""
    days = spark.sql("SELECT explode(sequence(DATE'2023-01-01', DATE'2025-12-31')) AS d")
    return days.where(F.weekday("d") < 5)


@query("sk08_content_hash", "SELECT count(*) AS n, CAST(sum(o_orderkey % 1000003 * 31 + CAST(round(o_totalprice * 100) AS BIGINT) % 999983) AS BIGINT) AS h FROM orders")
def sk08(spark, sf_dir):
    """A content hash that does not depend on the order of rows."""
    o = V.table(spark, sf_dir, "orders")
    part = F.col("o_orderkey") % 1000003 * 31 + F.round(F.col("o_totalprice") * 100).cast("long") % 999983
    return o.agg(F.count("*").alias("n"), F.sum(part).alias("h"))


@query("pf03_tuple_in", f"WITH {_SIGNALS} SELECT symbol, d, c FROM bars_d WHERE (symbol, d) IN (SELECT symbol, d FROM signals)")
def pf03(spark, sf_dir):
    """Bars on which a signal fired (composite key)."""
    return V.daily_bars(spark, sf_dir).join(_signals(spark, sf_dir), ["symbol", "d"], "left_semi").select("symbol", "d", "c")


@query("pf04_like_filters", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%ring' AND p_brand LIKE 'Brand#1%'")
def pf04(spark, sf_dir):
    """Suffix and prefix filters."""
    p = V.table(spark, sf_dir, "part")
    return p.where(~F.col("p_name").endswith("ring") & F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_name")


@query("pf06_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def pf06(spark, sf_dir):
    """A field of a JSON column as a number."""
    return V.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("pf07_distinct_from", f"WITH {V.SQL_VERSIONS} SELECT a.symbol, a.d FROM versions a JOIN versions b ON a.symbol = b.symbol AND a.d = b.d AND a.run_id = 1 AND b.run_id = 2 WHERE a.c IS DISTINCT FROM b.c")
def pf07(spark, sf_dir):
    """Keys whose restated value differs."""
    v = V.versions(spark, sf_dir)
    two = v.where("run_id = 2").select("symbol", "d", F.col("c").alias("c2"))
    return v.where("run_id = 1").join(two, ["symbol", "d"]).where(~F.col("c").eqNullSafe(F.col("c2"))).select("symbol", "d")


@query("pf09_three_way_status", "SELECT p_brand, count(*) FILTER (WHERE p_size IS NULL) AS unknown, count(*) FILTER (WHERE p_size BETWEEN 10 AND 20) AS passed, count(*) FILTER (WHERE p_size NOT BETWEEN 10 AND 20) AS failed FROM part GROUP BY ALL")
def pf09(spark, sf_dir):
    """Unknown, passed and failed against a range."""
    size = F.col("p_size")
    return V.table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count_if(size.isNull()).alias("unknown"), F.count_if(size.between(10, 20)).alias("passed"), F.count_if(~size.between(10, 20)).alias("failed")
    )


@query("pf11_unknown_symbols", f"WITH {V.SQL_BARS_D} SELECT s AS symbol FROM (VALUES ('1-URGENT'), ('NOPE'), ('5-LOW'), ('GONE')) t(s) WHERE s NOT IN (SELECT symbol FROM bars_d)")
def pf11(spark, sf_dir):
    """Requested symbols that have no bars."""
    asked = spark.createDataFrame([("1-URGENT",), ("NOPE",), ("5-LOW",), ("GONE",)], "symbol string")
    return asked.join(V.daily_bars(spark, sf_dir).select("symbol").distinct(), "symbol", "left_anti")


@query("pf12_guarded_ratio", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(100.0 / c_acctbal, 8) END AS ratio FROM customer")
def pf12(spark, sf_dir):
    """A percentage that is null for a degenerate denominator."""
    from tidebook.operators.facts import ratio

    return V.table(spark, sf_dir, "customer").select("c_custkey", F.round(ratio(F.lit(100.0), F.col("c_acctbal")), 8).alias("ratio"))


@query("pf14_scope", f"WITH {V.SQL_FACTS} SELECT concept, CASE WHEN date_diff('day', period_start, period_end) <= 130 THEN 'quarter' ELSE 'annual' END AS scope, count(*) AS n FROM facts GROUP BY ALL")
def pf14(spark, sf_dir):
    """Facts by scope of their period."""
    from tidebook.operators.facts import scope_of

    f = V.facts(spark, sf_dir)
    return f.groupBy("concept", scope_of(F.col("period_start"), F.col("period_end")).alias("scope")).agg(F.count("*").alias("n"))


@query("j01_star_join", f"WITH {V.SQL_INSTRUMENTS} SELECT region, country, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN instruments ON l_suppkey = sid GROUP BY ALL")
def j01(spark, sf_dir):
    """Fact table with a snowflake of small dimensions."""
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sid"), "l_quantity")
    per = lines.groupBy("sid").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))  # before the join: a row per key
    return per.join(V.instruments(spark, sf_dir), "sid").groupBy("region", "country").agg(F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("quantity"))


@query("j02_catalogue_counts", f"WITH {V.SQL_INSTRUMENTS} SELECT i.sid, i.name, coalesce(n, 0) AS n_lines FROM instruments i LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY ALL) ON sid = l_suppkey")
def j02(spark, sf_dir):
    """A catalogue with counts, zero where there are none."""
    counts = V.table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("sid")).agg(F.count("*").alias("n"))
    return V.instruments(spark, sf_dir).join(counts, "sid", "left").select("sid", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n_lines"))


_MEMBERS = "members AS (SELECT region AS universe, DATE '1996-01-01' AS snap_date, sid FROM instruments WHERE sid % 3 = 0 UNION ALL SELECT region, DATE '1998-01-01', sid FROM instruments WHERE sid % 2 = 0)"


def _members(spark, sf_dir):
    i = V.instruments(spark, sf_dir).select(F.col("region").alias("universe"), "sid")
    first = i.where("sid % 3 = 0").withColumn("snap_date", F.lit("1996-01-01").cast("date"))
    return first.unionByName(i.where("sid % 2 = 0").withColumn("snap_date", F.lit("1998-01-01").cast("date"))).select("universe", "snap_date", "sid")


@query("j03_left_join_count", f"WITH {V.SQL_INSTRUMENTS}, {_MEMBERS}, snaps AS (SELECT DISTINCT r_name AS universe, s AS snap_date FROM region, (VALUES (DATE '1996-01-01'), (DATE '1998-01-01'), (DATE '2000-01-01')) t(s)) SELECT universe, snap_date, count(sid) AS n FROM snaps LEFT JOIN members USING (universe, snap_date) GROUP BY ALL")
def j03(spark, sf_dir):
    """Members of every snapshot, zero for an empty one."""
    dates = F.explode(F.array(*[F.lit(x).cast("date") for x in ("1996-01-01", "1998-01-01", "2000-01-01")]))
    snaps = V.table(spark, sf_dir, "region").select(F.col("r_name").alias("universe"), dates.alias("snap_date"))
    return snaps.join(_members(spark, sf_dir), ["universe", "snap_date"], "left").groupBy("universe", "snap_date").agg(F.count("sid").alias("n"))


@query("j05_anti_preference", f"WITH {V.SQL_FACTS} SELECT sid, concept, provider, count(*) AS n FROM facts f WHERE provider = 'sec' OR NOT EXISTS (SELECT 1 FROM facts g WHERE g.sid = f.sid AND g.concept = f.concept AND g.provider = 'sec') GROUP BY ALL")
def j05(spark, sf_dir):
    """The primary provider wins per instrument and concept."""
    from tidebook.operators.facts import preferred

    return preferred(V.facts(spark, sf_dir)).groupBy("sid", "concept", "provider").agg(F.count("*").alias("n"))


@query("j06_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j06(spark, sf_dir):
    """Customers without an order."""
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("j07_scalar_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def j07(spark, sf_dir):
    """A correlated count, as an aggregate and a left join."""
    n = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return V.table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("j10_snapshot_asof", f"WITH {V.SQL_INSTRUMENTS}, {_MEMBERS} SELECT universe, snap_date, sid FROM members WHERE snap_date = (SELECT max(snap_date) FROM members WHERE snap_date <= DATE '1997-06-30')")
def j10(spark, sf_dir):
    """Members of the latest snapshot on or before a date."""
    m = _members(spark, sf_dir).where("snap_date <= DATE'1997-06-30'")
    return m.join(F.broadcast(m.agg(F.max("snap_date").alias("snap_date"))), "snap_date").select("universe", "snap_date", "sid")


@query("j11_last_close", f"WITH {V.SQL_BARS_D} SELECT symbol, max(d) AS d, arg_max(c, d) AS c FROM bars_d WHERE d <= DATE '1997-12-31' GROUP BY ALL")
def j11(spark, sf_dir):
    """The last close on or before a date."""
    return V.daily_bars(spark, sf_dir).where("d <= DATE'1997-12-31'").groupBy("symbol").agg(F.max("d").alias("d"), F.max_by("c", "d").alias("c"))


@query("j12_conditional_asof", f"WITH {V.SQL_BARS_D} SELECT symbol, arg_max(c, d) FILTER (WHERE d <= DATE '1996-12-31') AS c96, arg_max(c, d) FILTER (WHERE d <= DATE '1999-12-31') AS c99, count(*) FILTER (WHERE d > DATE '1999-12-31') AS later FROM bars_d GROUP BY ALL")
def j12(spark, sf_dir):
    """Closes as of two dates and a count, in one pass."""
    at = lambda x: F.max_by("c", F.when(F.col("d") <= F.lit(x).cast("date"), F.col("d")))
    return V.daily_bars(spark, sf_dir).groupBy("symbol").agg(at("1996-12-31").alias("c96"), at("1999-12-31").alias("c99"), F.count_if(F.col("d") > F.lit("1999-12-31").cast("date")).alias("later"))


@query("j17_interval_join", "SELECT s.name, count(*) AS n FROM events JOIN (VALUES ('asia', 0, 8), ('europe', 7, 16), ('america', 13, 22)) s(name, a, b) ON hour(ts) >= a AND hour(ts) < b GROUP BY ALL")
def j17(spark, sf_dir):
    """Events in each of a few overlapping sessions: hours are counted first, so the range join is tiny."""
    hours = V.table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))  # 24 rows
    sessions = spark.createDataFrame([("asia", 0, 8), ("europe", 7, 16), ("america", 13, 22)], "name string, a int, b int")
    inside = (F.col("hour") >= F.col("a")) & (F.col("hour") < F.col("b"))
    return hours.join(F.broadcast(sessions), inside).groupBy("name").agg(F.sum("n").alias("n"))


@query("a01_daily_rollup", f"WITH {V.SQL_BARS_D} SELECT * FROM bars_d")
def a01(spark, sf_dir):
    """Daily bars."""
    return V.daily_bars(spark, sf_dir)


@query("a02_session_collapse", f"WITH {V.SQL_BARS_H} SELECT symbol, CAST(t AS DATE) AS session, arg_min(o, t) AS o, max(h) AS h, min(l) AS l, arg_max(c, t) AS c, CAST(sum(v) AS BIGINT) AS v FROM bars_h GROUP BY ALL")
def a02(spark, sf_dir):
    """Intraday bars collapsed to sessions."""
    b = V.hourly_bars(spark, sf_dir)
    return b.groupBy("symbol", F.to_date("t").alias("session")).agg(
        F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v")
    )


@query("a03_resample_week", f"WITH {V.SQL_BARS_D} SELECT symbol, max(d) AS d, arg_min(o, d) AS o, max(h) AS h, min(l) AS l, arg_max(c, d) AS c, CAST(sum(v) AS BIGINT) AS v FROM bars_d GROUP BY symbol, date_trunc('week', d)")
def a03w(spark, sf_dir):
    """ISO weeks, dated by their last bar."""
    return _resampled(spark, sf_dir, "week")


@query("a03_resample_month", f"WITH {V.SQL_BARS_D} SELECT symbol, max(d) AS d, arg_min(o, d) AS o, max(h) AS h, min(l) AS l, arg_max(c, d) AS c, CAST(sum(v) AS BIGINT) AS v FROM bars_d GROUP BY symbol, date_trunc('month', d)")
def a03m(spark, sf_dir):
    """Months, dated by their last bar."""
    return _resampled(spark, sf_dir, "month")


def _resampled(spark, sf_dir, unit):
    return V.daily_bars(spark, sf_dir).groupBy("symbol", F.date_trunc(unit, "d").alias("p")).agg(
        F.max("d").alias("d"), F.min_by("o", "d").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "d").alias("c"), F.sum("v").alias("v")
    ).drop("p")


@query("a05_first_dates", f"WITH {V.SQL_FACTS} SELECT sid, min(filed_at) AS first_filed, count(DISTINCT concept) AS concepts FROM facts GROUP BY ALL")
def a05(spark, sf_dir):
    """First filing per instrument, with the number of its concepts."""
    per = V.facts(spark, sf_dir).groupBy("sid", "concept").agg(F.min("filed_at").alias("f"))
    return per.groupBy("sid").agg(F.min("f").alias("first_filed"), F.count("*").alias("concepts"))


@query("a07_latest_direction", f"WITH {_SIGNALS} SELECT symbol, arg_max(direction, d) AS direction, max(d) AS d, count(*) AS n FROM signals GROUP BY ALL")
def a07(spark, sf_dir):
    """Latest direction and number of signals."""
    return _signals(spark, sf_dir).groupBy("symbol").agg(F.max_by("direction", "d").alias("direction"), F.max("d").alias("d"), F.count("*").alias("n"))


@query("a08_coverage", f"WITH {V.SQL_FACTS} SELECT concept, count(DISTINCT sid) AS instruments, min(period_end) AS first, max(period_end) AS last, count(*) AS n FROM facts GROUP BY ALL")
def a08(spark, sf_dir):
    """Coverage per concept, in two levels."""
    per = V.facts(spark, sf_dir).groupBy("concept", "sid").agg(F.min("period_end").alias("a"), F.max("period_end").alias("b"), F.count("*").alias("n"))
    return per.groupBy("concept").agg(F.count("*").alias("instruments"), F.min("a").alias("first"), F.max("b").alias("last"), F.sum("n").alias("n"))


@query("a11_session_vwap", f"WITH {V.SQL_BARS_H} SELECT symbol, CAST(t AS DATE) AS session, round(CASE WHEN sum(v) > 0 THEN sum((h + l + c) / 3 * v) / sum(v) ELSE avg((h + l + c) / 3) END, 6) AS vwap FROM bars_h GROUP BY ALL")
def a11(spark, sf_dir):
    """Volume-weighted typical price of a session; its mean without volume."""
    tp, v = (F.col("h") + F.col("l") + F.col("c")) / 3, F.col("v")
    vwap = F.when(F.sum(v) > 0, F.sum(tp * v) / F.sum(v)).otherwise(F.avg(tp))
    return V.hourly_bars(spark, sf_dir).groupBy("symbol", F.to_date("t").alias("session")).agg(F.round(vwap, 6).alias("vwap"))


@query("a12_provider_mix", f"WITH {V.SQL_FACTS} SELECT provider, count(*) AS n FROM facts GROUP BY ALL ORDER BY n DESC")
def a12(spark, sf_dir):
    """Facts per provider."""
    return V.facts(spark, sf_dir).groupBy("provider").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("a19_downsample", f"WITH {V.SQL_BARS_D}, y AS (SELECT symbol, d, c, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars_d), k AS (SELECT DISTINCT symbol, CAST(round_even(j * (n - 1) / 47.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT symbol, n FROM y), range(48) t(j)) SELECT symbol, d, c FROM y JOIN k USING (symbol, i)")
def a19(spark, sf_dir):
    """A curve at 48 evenly spaced places."""
    w = Window.partitionBy("symbol")
    y = V.daily_bars(spark, sf_dir).select("symbol", "d", "c", (F.row_number().over(w.orderBy("d")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    places = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda j: F.bround(j * (F.col("n") - 1) / 47.0, 0).cast("int"))
    return y.where(F.array_contains(places, F.col("i"))).select("symbol", "d", "c")


@query("a22_pivot_grid", f"WITH {V.SQL_FACTS}, r AS (SELECT *, dense_rank() OVER (ORDER BY filed_at DESC) AS k FROM facts WHERE sid = 1) SELECT concept, " + ", ".join(f"round(max(value) FILTER (WHERE k = {i}), 4) AS r{i}" for i in (1, 2, 3, 4)) + " FROM r WHERE k <= 4 GROUP BY ALL")
def a22(spark, sf_dir):
    """A grid of the newest four releases of one instrument."""
    one = V.facts(spark, sf_dir).where("sid = 1")
    dates = one.select("filed_at").distinct().orderBy(F.desc("filed_at")).limit(4)
    ranked = dates.withColumn("k", F.concat(F.lit("r"), F.row_number().over(Window.orderBy(F.desc("filed_at")))))  # four rows
    return one.join(F.broadcast(ranked), "filed_at").groupBy("concept").pivot("k", ["r1", "r2", "r3", "r4"]).agg(F.round(F.max("value"), 4))


@query("a23_pivot_metrics", f"WITH {V.SQL_FACTS} SELECT period_end, CAST(sum(CAST(value AS DECIMAL(22,4))) FILTER (WHERE concept = 'revenue') AS DOUBLE) AS revenue, CAST(sum(CAST(value AS DECIMAL(22,4))) FILTER (WHERE concept = 'quantity') AS DOUBLE) AS quantity FROM facts GROUP BY ALL")
def a23(spark, sf_dir):
    """Concepts side by side for each date."""
    return V.facts(spark, sf_dir).groupBy("period_end").pivot("concept", ["revenue", "quantity"]).agg(
        F.sum(F.col("value").cast("decimal(22,4)")).cast("double")
    )


@query("a24_holder_sum", f"WITH {V.SQL_FACTS}, y AS (SELECT sid, filed_at, value - coalesce(lag(value) OVER (PARTITION BY sid ORDER BY filed_at, period_end), 0) AS delta FROM facts WHERE concept = 'quantity' AND provider = 'sec'), s AS (SELECT filed_at, sum(delta) AS delta FROM y GROUP BY ALL) SELECT filed_at, round(sum(delta) OVER (ORDER BY filed_at), 4) AS total FROM s")
def a24(spark, sf_dir):
    """Sum of every holder's latest value at each filing date: running sum of changes."""
    f = V.facts(spark, sf_dir).where("concept = 'quantity' AND provider = 'sec'")
    before = F.lag("value").over(Window.partitionBy("sid").orderBy("filed_at", "period_end"))
    per = f.withColumn("delta", F.col("value") - F.coalesce(before, F.lit(0.0))).groupBy("filed_at").agg(F.sum("delta").alias("delta"))
    # one row per day is left; a window without a key is bounded by the calendar
    return per.select("filed_at", F.round(F.sum("delta").over(Window.orderBy("filed_at")), 4).alias("total"))


@query("sl04_rank_nulls_last", "SELECT p_partkey, row_number() OVER (ORDER BY m DESC NULLS LAST, p_partkey) AS place FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice END AS m FROM part) QUALIFY place <= 100")
def sl04(spark, sf_dir):
    """The first hundred by a metric, unmeasured last, ties by key."""
    m = V.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("m"))
    top = m.orderBy(F.desc_nulls_last("m"), "p_partkey").limit(100)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(F.desc_nulls_last("m"), "p_partkey")).cast("long").alias("place"))


@query("sl06_top_per_group", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part QUALIFY place <= 3")
def sl06(spark, sf_dir):
    """The three largest per group."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return V.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


@query("sl07_line_planning", "WITH w AS (SELECT p_partkey, min(CASE WHEN p_brand LIKE 'Brand#1%' THEN 0 WHEN p_type = 'ECONOMY' THEN 1 ELSE 2 END) AS rank FROM part GROUP BY ALL) SELECT p_partkey, rank FROM w ORDER BY rank, p_partkey LIMIT 50")
def sl07(spark, sf_dir):
    """The first fifty by priority class, then key."""
    rank = F.when(F.col("p_brand").startswith("Brand#1"), 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(2)
    return V.table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.min(rank).alias("rank")).orderBy("rank", "p_partkey").limit(50)


@query("so01_union_all", "SELECT 'part' AS kind, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def so01(spark, sf_dir):
    """Union of two aggregates."""
    count = lambda t: V.table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("kind"), "n")
    return count("part").unionByName(count("supplier"))


@query("so02_set_difference", f"WITH {V.SQL_BARS_D} SELECT d FROM bars_d WHERE symbol = '1-URGENT' EXCEPT SELECT d FROM bars_d WHERE symbol = '5-LOW'")
def so02(spark, sf_dir):
    """Days of one symbol without the other."""
    b = V.daily_bars(spark, sf_dir)
    return b.where("symbol = '1-URGENT'").select("d").subtract(b.where("symbol = '5-LOW'").select("d"))


@query("so03_intersection", f"WITH {V.SQL_BARS_D} SELECT d FROM bars_d WHERE symbol = '1-URGENT' INTERSECT SELECT d FROM bars_d WHERE symbol = '5-LOW'")
def so03(spark, sf_dir):
    """Days that two symbols share."""
    b = V.daily_bars(spark, sf_dir)
    return b.where("symbol = '1-URGENT'").select("d").intersect(b.where("symbol = '5-LOW'").select("d"))


@query("so04_timeline_union", f"WITH {V.SQL_BARS_D} SELECT DISTINCT d FROM bars_d")
def so04(spark, sf_dir):
    """All days on which any symbol traded."""
    return V.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


@query("so05_symmetric_diff", f"WITH {V.SQL_INSTRUMENTS}, {_MEMBERS} SELECT 'open' AS side, universe, sid FROM (SELECT universe, sid FROM members WHERE snap_date = DATE '1998-01-01' EXCEPT SELECT universe, sid FROM members WHERE snap_date = DATE '1996-01-01') UNION ALL SELECT 'close', universe, sid FROM (SELECT universe, sid FROM members WHERE snap_date = DATE '1996-01-01' EXCEPT SELECT universe, sid FROM members WHERE snap_date = DATE '1998-01-01')")
def so05(spark, sf_dir):
    """What to open and close between two snapshots."""
    m = _members(spark, sf_dir)
    old, new = (m.where(F.col("snap_date") == F.lit(x).cast("date")).select("universe", "sid") for x in ("1996-01-01", "1998-01-01"))
    side = lambda name, a, b: a.join(b, ["universe", "sid"], "left_anti").select(F.lit(name).alias("side"), "universe", "sid")
    return side("open", new, old).unionByName(side("close", old, new))


@query("so06_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def so06(spark, sf_dir):
    """The first of rows that repeat a key."""
    return V.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
