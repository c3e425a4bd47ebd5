"""Screens, published metrics, fundamental filters, coverage, headlines, publication and live folds, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import rules as S
from tidebook.functions import windows as W
from tidebook.operators import facts as P
from tidebook.operators import performance as B
from tidebook.operators import screens as X
from tidebook.plans import books as K
from tidebook.plans import pointintime as PT
from tidebook.plans import rules as R
from tidebook.plans.relational import _MEMBERS, _SIGNALS, _members, _signals
from tidebook.sources import sinks
from tidebook.sources import synthetic
from tidebook.sources import views as V
from tidebook.streaming import ticks as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ON = "1999-03-31"


def query(name: str, sql: str):
    """Register a query together with its SQL."""

    def add(run):
        QUERIES[name] = run
        ORACLES[name] = sql
        return run

    return add


# --- screens and coverage

_KNOWN = f"""{PT.SQL_STEPS}, {V.SQL_INSTRUMENTS}, {_MEMBERS}, m AS (SELECT universe, sid FROM members WHERE snap_date = DATE '1998-01-01'),
 known_at AS (SELECT sid, concept, arg_max(value, filed_at) AS value, max(filed_at) AS f FROM steps WHERE filed_at <= DATE '{ON}' GROUP BY ALL),
 fresh AS (SELECT * FROM known_at WHERE date_diff('day', f, DATE '{ON}') <= 60),
 x AS (SELECT universe, m.sid, r.value AS revenue, q.value AS quantity, CASE WHEN q.value > 0 THEN round(r.value / q.value, 6) END AS unit_price
  FROM m LEFT JOIN fresh r ON m.sid = r.sid AND r.concept = 'revenue' LEFT JOIN fresh q ON m.sid = q.sid AND q.concept = 'quantity')"""
METRICS = ("revenue", "quantity", "unit_price")


def _measured(spark, sf_dir):
    known = X.known_on(V.facts(spark, sf_dir, ON), ON, ("revenue", "quantity"), 60)
    return known.withColumn("unit_price", F.round(P.ratio(F.col("revenue"), F.col("quantity")), 6))


def _universe(spark, sf_dir):
    return _members(spark, sf_dir).where("snap_date = DATE'1998-01-01'").select("universe", "sid")


@query(
    "pf10_constraint_grammar",
    f"""{_KNOWN}, s AS (SELECT *, [CASE WHEN unit_price IS NULL THEN 'u' WHEN unit_price BETWEEN 1900 AND 2400 THEN 'p' ELSE 'f' END,
 CASE WHEN revenue IS NULL THEN 'u' WHEN revenue >= 50000 THEN 'p' ELSE 'f' END, CASE WHEN quantity IS NULL THEN 'u' WHEN quantity <= 300 THEN 'p' ELSE 'f' END] AS c FROM x)
 SELECT universe, sid, unit_price, round(revenue, 4) AS revenue, round(quantity, 4) AS quantity, len(list_filter(c, lambda y: y = 'p')) AS passed, len(list_filter(c, lambda y: y = 'f')) AS failed,
 len(list_filter(c, lambda y: y = 'u')) AS unknown, len(list_filter(c, lambda y: y = 'p')) = 3 AS accepted FROM s""",
)
def pf10(spark, sf_dir):
    """A universe against several constraints given as text; unknown is told from failed."""
    found = X.screen_many(_universe(spark, sf_dir), _measured(spark, sf_dir), X.parse_constraints("unit_price:1900:2400, revenue:50000:,quantity::300", METRICS))
    counts = [F.col(c).cast("long").alias(c) for c in ("passed", "failed", "unknown")]
    return found.select("universe", "sid", "unit_price", F.round("revenue", 4).alias("revenue"), F.round("quantity", 4).alias("quantity"), *counts, "accepted")


@query("a09_metric_coverage", f"{_KNOWN} SELECT unnest(['revenue', 'quantity', 'unit_price']) AS metric, unnest([count(revenue), count(quantity), count(unit_price)]) AS known, count(*) AS \"of\" FROM x")
def a09(spark, sf_dir):
    """How many members of a universe have each metric."""
    return X.coverage(_universe(spark, sf_dir).join(_measured(spark, sf_dir), "sid", "left"), METRICS)


@query(
    "a10_fact_coverage",
    f"{_KNOWN} SELECT universe, count(*) AS members, count(*) FILTER (WHERE revenue IS NOT NULL AND quantity IS NOT NULL) AS complete, count(revenue) AS with_revenue, count(quantity) AS with_quantity FROM x GROUP BY ALL",
)
def a10(spark, sf_dir):
    """Members with all figures, and with each."""
    both = _universe(spark, sf_dir).join(_measured(spark, sf_dir), "sid", "left")
    complete = F.count_if(F.col("revenue").isNotNull() & F.col("quantity").isNotNull())
    return both.groupBy("universe").agg(F.count("*").alias("members"), complete.alias("complete"), F.count("revenue").alias("with_revenue"), F.count("quantity").alias("with_quantity"))


PUBLISHED = {
    "sales": X.Published("revenue", 45),
    "units": X.Published("quantity", 200),
    "excess": X.Published("excess", 200, positive_only=True),
}


def _published(spark, sf_dir):
    f = V.facts(spark, sf_dir, ON)
    over = f.where("concept = 'revenue'").withColumn("concept", F.lit("excess")).withColumn("value", F.round(F.col("value") - 200_000, 4))
    return f.unionByName(over)


@query(
    "p10_vendor_metrics",
    f"""WITH {V.SQL_FACTS}, p AS (SELECT sid, concept, filed_at, period_end, value FROM facts WHERE provider = 'vendor' UNION ALL SELECT sid, 'excess', filed_at, period_end, round(value - 200000, 4) FROM facts WHERE provider = 'vendor' AND concept = 'revenue'),
 b AS (SELECT *, date_diff('day', filed_at, DATE '{ON}') AS age FROM p WHERE filed_at <= DATE '{ON}'),
 v AS (SELECT sid, arg_max(value, (filed_at, period_end, value)) FILTER (WHERE concept = 'revenue' AND age <= 45) AS sales, arg_max(value, (filed_at, period_end, value)) FILTER (WHERE concept = 'quantity' AND age <= 200) AS units,
  arg_max(value, (filed_at, period_end, value)) FILTER (WHERE concept = 'excess' AND age <= 200) AS excess FROM b WHERE age <= 200 GROUP BY ALL)
 SELECT sid, round(sales, 4) AS sales, round(units, 4) AS units, round(CASE WHEN excess > 0 THEN excess END, 4) AS excess FROM v""",
)
def p10(spark, sf_dir):
    """A vendor's figures, each with its own staleness; a figure that means nothing unless positive is null."""
    found = X.published_on(_published(spark, sf_dir), ON, PUBLISHED)
    return found.select("sid", *[F.round(m, 4).alias(m) for m in PUBLISHED])


# --- scopes, windows and tags of facts

_ACCOUNTS = f"""{V.SQL_FACTS}, accounts AS (SELECT sid, concept, CASE WHEN concept = 'quantity' THEN NULL ELSE period_start END AS period_start, period_end, filed_at, value, provider FROM facts
 UNION ALL SELECT l_suppkey, 'revenue', make_date(year(l_shipdate), 1, 1), make_date(year(l_shipdate), 12, 31), make_date(year(l_shipdate), 12, 31) + 45, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 'sec' FROM lineitem GROUP BY l_suppkey, year(l_shipdate)),
 scoped AS (SELECT *, CASE WHEN period_start IS NULL THEN 'instant' WHEN date_diff('day', period_start, period_end) <= 130 THEN 'quarter' WHEN date_diff('day', period_start, period_end) <= 300 THEN 'interim' ELSE 'annual' END AS scope FROM accounts)"""


def _accounts(spark, sf_dir):
    """Monthly revenue, yearly revenue, and quantity as a stock, with their scopes."""
    f = V.facts(spark, sf_dir)
    stock = F.when(F.col("concept") != "quantity", F.col("period_start"))
    year = F.year("l_shipdate")
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sid"), year.alias("y"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    end = F.make_date("y", F.lit(12), F.lit(31))
    yearly = lines.groupBy("sid", "y").agg(F.sum("v").cast("double").alias("value")).select(
        "sid", F.lit("revenue").alias("concept"), F.make_date("y", F.lit(1), F.lit(1)).alias("period_start"), end.alias("period_end"), F.date_add(end, 45).alias("filed_at"), "value", F.lit("sec").alias("provider")
    )
    return f.withColumn("period_start", stock).unionByName(yearly).withColumn("scope", P.scope_of(F.col("period_start"), F.col("period_end")))


_TOP = "arg_max(value, (period_end, filed_at, coalesce(period_start, DATE '0001-01-01'), value))"


@query("p06_as_of_scopes", f"WITH {_ACCOUNTS}, s AS (SELECT sid, concept, max((period_end, filed_at, coalesce(period_start, DATE '0001-01-01'), value)) AS k FROM scoped WHERE filed_at <= DATE '{ON}' GROUP BY ALL) SELECT s.sid, s.concept, k[1] AS period_end, k[2] AS filed_at, round(k[4], 4) AS value FROM s".replace("k[1]", "struct_extract(k, 1)").replace("k[2]", "struct_extract(k, 2)").replace("k[4]", "struct_extract(k, 4)"))
def p06(spark, sf_dir):
    """The latest figure of every concept as known on a date, whatever its scope: the best of the scopes' best."""
    key = F.struct("period_end", "filed_at", F.coalesce("period_start", F.lit("0001-01-01").cast("date")).alias("start"), "value")
    of_scope = _accounts(spark, sf_dir).where(F.col("filed_at") <= ON).groupBy("sid", "concept", "scope").agg(F.max(key).alias("k"))
    return of_scope.groupBy("sid", "concept").agg(F.max("k").alias("k")).select("sid", "concept", "k.period_end", "k.filed_at", F.round("k.value", 4).alias("value"))


@query("p07_default_scope", f"WITH {_ACCOUNTS} SELECT sid, concept, scope, round({_TOP}, 4) AS value FROM scoped WHERE filed_at <= DATE '{ON}' AND scope = CASE WHEN concept IN ('quantity', 'equity', 'debt') THEN 'instant' ELSE 'annual' END GROUP BY ALL")
def p07(spark, sf_dir):
    """Figures in the scope that a rule gets if it names none."""
    own = _accounts(spark, sf_dir).where((F.col("filed_at") <= ON) & (F.col("scope") == X.default_scope(F.col("concept"))))
    key = F.struct("period_end", "filed_at", F.coalesce("period_start", F.lit("0001-01-01").cast("date")), "value")
    return own.groupBy("sid", "concept", "scope").agg(F.round(F.max(key)["value"], 4).alias("value"))


@query("p11_window_clamp", f"WITH {V.SQL_FACTS} SELECT concept, provider, count(*) AS n, min(filed_at) AS first, max(filed_at) AS last FROM facts WHERE filed_at BETWEEN DATE '1999-01-01' - INTERVAL 3 YEAR AND DATE '1999-12-31' GROUP BY ALL")
def p11(spark, sf_dir):
    """Facts that a run of a window needs: filed from three years before it to its end."""
    f = V.facts(spark, sf_dir, "1999-12-31").where(F.col("filed_at") >= F.add_months(F.lit("1999-01-01").cast("date"), -36))
    return f.groupBy("concept", "provider").agg(F.count("*").alias("n"), F.min("filed_at").alias("first"), F.max("filed_at").alias("last"))


@query("pf15_tag_rank", f"WITH {V.SQL_FACTS} SELECT sid, concept, period_end, arg_min(provider, (CASE provider WHEN 'vendor' THEN 0 WHEN 'sec' THEN 1 ELSE 2 END, filed_at)) AS provider FROM facts GROUP BY ALL")
def pf15(spark, sf_dir):
    """The preferred source of each figure, by a rank that is written down."""
    rank = F.when(F.col("provider") == "vendor", 0).when(F.col("provider") == "sec", 1).otherwise(2)
    return V.facts(spark, sf_dir).groupBy("sid", "concept", "period_end").agg(F.min_by("provider", F.struct(rank.alias("rank"), "filed_at")).alias("provider"))


# --- fundamental filters and conditions

_EQUITY, _DEBT = "(revenue - 2000 * quantity)", "(CASE WHEN sid % 5 = 0 THEN 0 ELSE quantity * 20 END)"


def _equity(b):
    return b["revenue"] - 2000 * b["quantity"]


@query("r17_price_to_book", f'{PT._AT_ENDS} SELECT sid, on_ AS "on", round(revenue / {_EQUITY}, 9) AS trigger FROM x WHERE {_EQUITY} > 0 AND revenue / {_EQUITY} BETWEEN 0 AND 30')
def r17(spark, sf_dir):
    """A multiple of book value in a band; negative book value is no low multiple."""
    return PT._fundamental_rule(spark, sf_dir, lambda b: P.ratio(b["revenue"], _equity(b)), lambda t: t.between(0, 30))


@query("r19_leverage", f'{PT._AT_ENDS} SELECT sid, on_ AS "on", round(CASE WHEN {_DEBT} = 0 THEN 0.0 ELSE {_DEBT} / {_EQUITY} END, 9) AS trigger FROM x WHERE {_EQUITY} > 0 AND CASE WHEN {_DEBT} = 0 THEN 0.0 ELSE {_DEBT} / {_EQUITY} END <= 0.1')
def r19(spark, sf_dir):
    """Debt to equity at most; no debt passes, negative equity does not."""
    debt = lambda b: F.when(b["sid"] % 5 == 0, 0.0).otherwise(b["quantity"] * 20)
    return PT._fundamental_rule(spark, sf_dir, lambda b: X.leverage(debt(b), _equity(b)), lambda t: t <= 0.1)


@query("r20_margin", f'{PT._AT_ENDS} SELECT sid, on_ AS "on", round({_EQUITY} / revenue, 9) AS trigger FROM x WHERE revenue > 0 AND {_EQUITY} / revenue >= 0.1')
def r20(spark, sf_dir):
    """A margin at least; it may be negative, its base may not."""
    return PT._fundamental_rule(spark, sf_dir, lambda b: P.ratio(_equity(b), b["revenue"]), lambda t: t >= 0.1)


@query("r21_liquidity", f'{PT._AT_ENDS} SELECT sid, on_ AS "on", round(revenue / (quantity * 2100), 9) AS trigger FROM x WHERE quantity > 0 AND revenue / (quantity * 2100) >= 1')
def r21(spark, sf_dir):
    """Current assets over current liabilities at least."""
    return PT._fundamental_rule(spark, sf_dir, lambda b: P.ratio(b["revenue"], b["quantity"] * 2100), lambda t: t >= 1)


@query(
    "r28_fundamental_condition",
    f"""{PT.SQL_STEPS}, s AS (SELECT sid, filed_at, value FROM steps WHERE concept = 'revenue'), g AS (SELECT a.sid, a.filed_at, a.value / b.value - 1 AS value FROM s a ASOF JOIN s b ON a.sid = b.sid AND a.filed_at - INTERVAL 1 YEAR >= b.filed_at WHERE b.value <> 0),
 l AS (SELECT 'level' AS transform, sid, filed_at, value, lag(value) OVER (PARTITION BY sid ORDER BY filed_at) AS before FROM s UNION ALL SELECT 'yoy_growth', sid, filed_at, value, lag(value) OVER (PARTITION BY sid ORDER BY filed_at) FROM g)
 SELECT transform, sid, filed_at, CASE transform WHEN 'level' THEN 1 ELSE -1 END AS direction, round(value, 6) AS trigger FROM l WHERE (transform = 'level' AND before <= 300000 AND value > 300000) OR (transform = 'yoy_growth' AND before >= 0.05 AND value < 0.05)""",
)
def r28(spark, sf_dir):
    """Filing dates on which a figure crosses a level upwards, or its yearly growth another one downwards."""
    s = P.steps(V.facts(spark, sf_dir).where("concept = 'revenue'")).select("sid", "filed_at", "value")
    now = s.withColumn("year_ago", F.add_months("filed_at", -12)).withColumnRenamed("value", "now")
    grown = PT.asof(now, s.withColumnRenamed("filed_at", "then"), ["sid"], "year_ago", "then", ["value"]).where("value <> 0")
    growth = grown.select("sid", "filed_at", (F.col("now") / F.col("value") - 1).alias("value"))
    out = X.crossings(s, 300_000, above=True, bullish=True).withColumn("transform", F.lit("level"))
    out = out.unionByName(X.crossings(growth, 0.05, above=False, bullish=False).withColumn("transform", F.lit("yoy_growth")))
    return out.select("transform", "sid", "filed_at", "direction", F.round("trigger", 6).alias("trigger"))


@query("r27_indicator_crossover", R._values(f"{R._mean(10)} AS fast, {R._mean(10)} - ({R._mean(30)}) AS x", R._w(10), R._w(30)) + f", z AS (SELECT *, lag(x) OVER w AS px FROM y WINDOW {R._W}) " + R._select("z", "golden", R._CROSS[0], R._NEVER, "fast"))
def r27(spark, sf_dir):
    """A crossing of two indicators, given as data."""
    return R._rounded(S.configured(V.daily_bars(spark, sf_dir), R.GOLDEN))


# --- counts, sorts and headlines

@query("sc03_daily_columns", f"WITH {V.SQL_BARS_D} SELECT symbol, list(d ORDER BY d) AS d, list(c ORDER BY d) AS c FROM bars_d WHERE d BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' GROUP BY ALL".replace("list(d ORDER BY d) AS d, list(c ORDER BY d) AS c", "count(*) AS n, min(d) AS first, string_agg(CAST(c AS DECIMAL(18,2)), ',' ORDER BY d) AS closes"))
def sc03(spark, sf_dir):
    """A quarter's bars as columns: one row a symbol, its closes in the order of their days."""
    few = V.daily_bars(spark, sf_dir).where(F.col("d").between("1997-01-01", "1997-03-31"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda x: x["c"].cast("decimal(18,2)").cast("string"))
    return few.groupBy("symbol").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.array_join(ordered, ",").alias("closes"))


@query("a04_count_per_key", f"WITH {V.SQL_BARS_D} SELECT symbol, year(d) AS y, count(*) AS n FROM bars_d GROUP BY ALL")
def a04(spark, sf_dir):
    """Bars per symbol and year."""
    return V.daily_bars(spark, sf_dir).groupBy("symbol", F.year("d").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query("a06_distinct_values", f"WITH {V.SQL_VERSIONS} SELECT DISTINCT symbol, run_id FROM versions")
def a06(spark, sf_dir):
    """Ingest runs of each symbol."""
    return V.versions(spark, sf_dir).select("symbol", "run_id").distinct()


@query(
    "a20_run_headline",
    f"{K._TRADES} SELECT round((SELECT arg_max(equity, d) FROM equity) / 100000.0 - 1, 6) AS total_return, round((SELECT arg_max(equity, d) FROM bench) / 100000.0 - 1, 6) AS benchmark_return, "
    "round((SELECT arg_max(equity, d) FROM equity) / 100000.0 - (SELECT arg_max(equity, d) FROM bench) / 100000.0, 6) AS excess_return, (SELECT count(*) FROM trades WHERE NOT is_open) AS closed_trades, (SELECT count(*) FROM trades WHERE is_open) AS open_trades",
)
def a20(spark, sf_dir):
    """A run in one row: its return, that of buying and holding, and the excess."""
    trades, bars = K._trades(spark, sf_dir)
    end = lambda curve, name: curve.agg((F.max_by("equity", "d") / B.CAPITAL - 1).alias(name))
    both = end(B.combine(B.sleeves(trades, bars)), "s").crossJoin(end(B.combine(B.buy_and_hold(bars)), "b"))  # single rows
    counts = trades.agg(F.count_if(~F.col("is_open")).alias("closed_trades"), F.count_if("is_open").alias("open_trades"))
    figures = both.select(F.round("s", 6).alias("total_return"), F.round("b", 6).alias("benchmark_return"), F.round(F.col("s") - F.col("b"), 6).alias("excess_return"))
    return figures.crossJoin(counts)


@query("a21_signal_counts", f"WITH {_SIGNALS} SELECT symbol, rule, count(*) AS n, max(d) AS last, arg_max(direction, d) AS direction FROM signals WHERE d <= DATE '1998-06-30' GROUP BY ALL")
def a21(spark, sf_dir):
    """Signals of each rule as of a date, and the latest direction."""
    known = _signals(spark, sf_dir).where("d <= DATE'1998-06-30'")
    return known.groupBy("symbol", "rule").agg(F.count("*").alias("n"), F.max("d").alias("last"), F.max_by("direction", "d").alias("direction"))


@query("a25_run_volatility", f"WITH {V.SQL_BARS_D}, r AS (SELECT symbol, d, c / lag(c) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars_d) SELECT symbol, count(r) AS n, round(stddev_samp(r) * sqrt(252), 6) AS volatility FROM r WHERE d BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ALL")
def a25(spark, sf_dir):
    """Volatility of each symbol over a run's window."""
    before = F.lag("c").over(Window.partitionBy("symbol").orderBy("d"))
    r = V.daily_bars(spark, sf_dir).select("symbol", "d", (F.col("c") / before - 1).alias("r")).where(F.col("d").between("1997-01-01", "1998-12-31"))
    return r.groupBy("symbol").agg(F.count("r").alias("n"), F.round(F.stddev_samp("r") * F.sqrt(F.lit(252.0)), 6).alias("volatility"))


@query("sl01_total_order", f"WITH {_SIGNALS} SELECT symbol, d, rule, direction, row_number() OVER (ORDER BY symbol, d, rule) AS place FROM signals QUALIFY place <= 500")
def sl01(spark, sf_dir):
    """The first events in the order of symbol, day and rule (a top report)."""
    first = _signals(spark, sf_dir).orderBy("symbol", "d", "rule").limit(500)
    place = F.row_number().over(Window.orderBy("symbol", "d", "rule")).cast("long")  # five hundred rows
    return first.select("symbol", "d", "rule", "direction", place.alias("place"))


@query("sl02_kind_order", f"WITH {_SIGNALS}, k AS (SELECT symbol, d, CASE WHEN direction < 0 THEN 'exit' WHEN day(d) % 2 = 0 THEN 'both' ELSE 'entry' END AS kind FROM signals) SELECT symbol, d, kind, row_number() OVER (PARTITION BY symbol ORDER BY CASE kind WHEN 'exit' THEN 0 WHEN 'both' THEN 1 ELSE 2 END, d) AS place FROM k")
def sl02(spark, sf_dir):
    """Decisions in the order exit, both, entry."""
    kind = F.when(F.col("direction") < 0, "exit").when(F.dayofmonth("d") % 2 == 0, "both").otherwise("entry")
    order = Window.partitionBy("symbol").orderBy(F.when(F.col("kind") == "exit", 0).when(F.col("kind") == "both", 1).otherwise(2), "d")
    return _signals(spark, sf_dir).select("symbol", "d", kind.alias("kind")).withColumn("place", F.row_number().over(order).cast("long"))


@query("sl08_newest_snapshot", f"WITH {V.SQL_INSTRUMENTS}, {_MEMBERS} SELECT universe, max(snap_date) AS snap_date FROM members GROUP BY ALL ORDER BY snap_date DESC, universe LIMIT 1")
def sl08(spark, sf_dir):
    """The newest snapshot."""
    return _members(spark, sf_dir).groupBy("universe").agg(F.max("snap_date").alias("snap_date")).orderBy(F.desc("snap_date"), "universe").limit(1)


@query("rp04_summary_event", f"{K._REPLAY} SELECT 'summary' AS event, max(d) AS d, count(*) FILTER (WHERE event = 'bar') AS bars, count(*) FILTER (WHERE event = 'signal') AS signals, count(*) FILTER (WHERE event = 'fill') AS fills FROM ev")
def rp04(spark, sf_dir):
    """The event that closes a replay."""
    counts = [F.count_if(F.col("event") == k).alias(f"{k}s") for k in ("bar", "signal", "fill")]
    return K._replay(spark, sf_dir).agg(F.max("d").alias("d"), *counts).select(F.lit("summary").alias("event"), "d", "bars", "signals", "fills")


# --- sinks, sources and live folds

@query("pf13_finite_numbers", "SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN NULL ELSE value END AS value FROM events")
def pf13(spark, sf_dir):
    """Undefined and infinite numbers as null."""
    odd = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("inf"))).when(F.col("event_id") % 7 == 2, F.lit(float("-inf")))
    return X.finite(V.table(spark, sf_dir, "events").select("event_id", F.coalesce(odd, F.col("value")).alias("value")))


@query("sk04_published_members", f"WITH {V.SQL_INSTRUMENTS}, {_MEMBERS} SELECT universe, snap_date, sid FROM members WHERE universe = 'ASIA'")
def sk04(spark, sf_dir):
    """Two snapshots of a universe, published one after the other and read back."""
    path = sinks.shared_folder(spark, "members")
    known = V.instruments(spark, sf_dir)
    for date in ("1996-01-01", "1998-01-01"):
        one = _members(spark, sf_dir).where((F.col("universe") == "ASIA") & (F.col("snap_date") == date))
        sinks.publish_members(one, known, path, "ASIA", date)
    return spark.read.parquet(path).select("universe", "snap_date", "sid")


@query("sc16_synthetic_bars", synthetic.SQL)
def sc16(spark, sf_dir):
    """Seeded bars of a few symbols: random walks and mean reversion."""
    return synthetic.bars(spark, ("AAA", "BBB", "CCC"), 500)


@query("st08_tail_recompute", f"WITH {V.SQL_BARS_D}, s AS (SELECT symbol, d, CASE WHEN count(c) OVER w = 20 THEN avg(c) OVER w END AS m FROM bars_d WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, d, round(m + {PT.OFF_TIE}, 4) AS sma FROM s WHERE d > DATE '2000-12-31'")
def st08(spark, sf_dir):
    """An indicator of new bars, from no more of the old ones than it needs."""
    few = T.tail_bars(V.daily_bars(spark, sf_dir), "2000-12-31", 20)
    out = few.withColumn("sma", F.round(W.sma(F.col("c"), 20, W.series()) + PT.OFF_TIE, 4))
    return out.where("d > DATE'2000-12-31'").select("symbol", "d", "sma")


@query(
    "st09_forming_candle",
    f"WITH {V.SQL_BARS_H}, closed AS (SELECT * FROM bars_h WHERE t < TIMESTAMP '2024-01-20 10:00:00'), lt AS (SELECT symbol, max(t) AS lt FROM closed GROUP BY ALL), late AS (SELECT * FROM ticks WHERE ts >= TIMESTAMP '2024-01-19 00:00:00' AND ts < TIMESTAMP '2024-01-21 06:30:00'), "
    "f AS (SELECT symbol, date_trunc('hour', ts) AS t, arg_min(price, ts) AS o, max(price) AS h, min(price) AS l, arg_max(price, ts) AS c, count(*) AS v FROM late LEFT JOIN lt USING (symbol) WHERE lt IS NULL OR date_trunc('hour', ts) > lt GROUP BY ALL) SELECT *, false AS forming FROM closed UNION ALL SELECT *, true FROM f",
)
def st09(spark, sf_dir):
    """Closed bars and the ones that later ticks form; ticks of closed hours are ignored."""
    closed = V.hourly_bars(spark, sf_dir).where("t < TIMESTAMP_NTZ'2024-01-20 10:00:00'")
    late = V.ticks(spark, sf_dir).where("ts >= TIMESTAMP_NTZ'2024-01-19 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-21 06:30:00'")
    return T.fold_forming(closed, late)


@query("st12_keep_latest", f"WITH {V.SQL_VERSIONS} SELECT symbol, d, arg_max(c, run_id) AS c, max(run_id) AS run_id FROM versions GROUP BY ALL")
def st12(spark, sf_dir):
    """A live store that keeps the latest version of each bar, as a stream."""
    path = sinks.shared_folder(spark, "versions")
    V.versions(spark, sf_dir).select("symbol", "d", "c", "run_id").write.parquet(path)
    log = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    newest = log.groupBy("symbol", "d").agg(F.max_by("c", "run_id").alias("c"), F.max("run_id").alias("run_id"))
    return T.to_folder(newest, sinks.shared_folder(spark, "latest"), "complete")
