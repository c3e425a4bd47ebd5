"""As-of joins, point-in-time facts, fundamental rules and corporate actions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions import windows as W
from tidebook.operators import actions as A
from tidebook.operators import facts as P
from tidebook.operators.asof import asof
from tidebook.plans.relational import _MEMBERS, _members
from tidebook.plans.indicators import OFF_TIE
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


_MACRO = f"{V.SQL_BARS_H}, macro AS (SELECT CAST(t AS DATE) AS day, arg_max(c, t) AS level FROM bars_h WHERE symbol = 'error' AND day(t) % 5 <> 0 GROUP BY CAST(t AS DATE))"


def _macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = V.hourly_bars(spark, sf_dir).where("symbol = 'error'").groupBy(F.to_date("t").alias("day")).agg(F.max_by("c", "t").alias("level"))
    return one.where(F.dayofmonth("day") % 5 != 0)


def _with_macro(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """Hourly bars with the macro level of the day before at the latest, unless that is stale."""
    bars = V.hourly_bars(spark, sf_dir).where("symbol <> 'error'").select("symbol", "t", "c", F.to_date("t").alias("on"))
    # the as-of day of an intraday bar is the calendar day before; one macro row serves all symbols of a day
    dates = bars.select("on").distinct().withColumn("k", F.lit(1))
    known = asof(dates, _macro(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], "on", "day", ["level"], tolerance_days=days, strict=True)
    return bars.join(known.select("on", "level", "day_matched"), "on")


@query(
    "j08_asof_macro",
    f"WITH {_MACRO} SELECT symbol, t, CASE WHEN date_diff('day', day, CAST(t AS DATE)) <= 1 THEN level END AS level FROM bars_h ASOF LEFT JOIN macro ON CAST(t AS DATE) > day WHERE symbol <> 'error'",
)
def j08(spark, sf_dir):
    """A daily series as of the day before, at most one day old."""
    return _with_macro(spark, sf_dir, 1).select("symbol", "t", "level")


@query(
    "r15_macro_gate",
    f"WITH {_MACRO} SELECT symbol, t, round(level, 6) AS trigger FROM bars_h ASOF JOIN macro ON CAST(t AS DATE) > day WHERE symbol <> 'error' AND date_diff('day', day, CAST(t AS DATE)) <= 5 AND level <= 40",
)
def r15(spark, sf_dir):
    """Bars on which the macro level, at most five days old, allows risk."""
    return _with_macro(spark, sf_dir, 5).where("level <= 40").select("symbol", "t", F.round("level", 6).alias("trigger"))


SQL_STEPS = f"""WITH {V.SQL_FACTS}, ver AS (SELECT sid, concept, period_end, filed_at, arg_max(value, (period_start, value)) AS value FROM facts GROUP BY ALL),
 known AS (SELECT *, max({{'a': period_end, 'b': filed_at, 'v': value}}) OVER (PARTITION BY sid, concept ORDER BY filed_at, period_end ROWS UNBOUNDED PRECEDING) AS k FROM ver),
 daily AS (SELECT sid, concept, filed_at, max(k) AS k FROM known GROUP BY ALL),
 steps AS (SELECT sid, concept, filed_at, k.a AS period_end, k.v AS value FROM (SELECT *, lag(k) OVER (PARTITION BY sid, concept ORDER BY filed_at) AS b FROM daily) WHERE k IS DISTINCT FROM b)"""


@query("p02_versions", f"{SQL_STEPS} SELECT sid, concept, period_end, filed_at, round(value, 4) AS value FROM ver")
def p02(spark, sf_dir):
    """The best row of each period and filing date."""
    return P.versions(V.facts(spark, sf_dir)).select("sid", "concept", "period_end", "filed_at", F.round("value", 4).alias("value"))


@query("p03_steps", f"{SQL_STEPS} SELECT sid, concept, filed_at, period_end, round(value, 4) AS value FROM steps")
def p03(spark, sf_dir):
    """What is known from each filing date on."""
    return P.steps(V.facts(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query(
    "j09_bitemporal_asof",
    f"{SQL_STEPS} SELECT l_orderkey, l_linenumber, CASE WHEN date_diff('day', filed_at, shipped) <= 60 THEN round(value, 4) END AS value, CASE WHEN date_diff('day', filed_at, shipped) <= 60 THEN period_end END AS period_end "
    "FROM (SELECT l_orderkey, l_linenumber, l_suppkey AS sid, CAST(l_shipdate AS DATE) AS shipped FROM lineitem) l ASOF LEFT JOIN (SELECT * FROM steps WHERE concept = 'revenue') s ON l.sid = s.sid AND l.shipped >= s.filed_at",
)
def j09(spark, sf_dir):
    """The revenue figure known on every shipping day, at most 60 days old."""
    lines = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("at"))
    found = P.value_on(lines, V.facts(spark, sf_dir), "at", "revenue", 60)
    return found.select("l_orderkey", "l_linenumber", F.round("value", 4).alias("value"), "period_end")


@query(
    "p05_history",
    f"{SQL_STEPS}, h AS (SELECT sid, concept, period_end, arg_max(value, filed_at) AS value, max(filed_at) AS filed_at FROM ver WHERE filed_at <= DATE '1998-06-30' GROUP BY ALL) "
    "SELECT sid, concept, period_end, round(value, 4) AS value, filed_at, row_number() OVER (PARTITION BY sid, concept ORDER BY period_end DESC) AS back FROM h QUALIFY back <= 4",
)
def p05(spark, sf_dir):
    """The last four periods known on a date."""
    found = P.history(V.facts(spark, sf_dir), "1998-06-30", 4)
    return found.withColumn("value", F.round("value", 4)).withColumn("back", F.col("back").cast("long"))


@query(
    "p08_inspector",
    f"{SQL_STEPS} SELECT sid, concept, arg_max(period_end, filed_at) AS period_end, round(arg_max(value, filed_at), 4) AS value, CAST(date_diff('day', max(filed_at), DATE '1999-03-31') AS BIGINT) AS days_stale FROM steps WHERE filed_at <= DATE '1999-03-31' GROUP BY ALL",
)
def p08(spark, sf_dir):
    """Every figure as known on a date, with its age."""
    known = P.steps(V.facts(spark, sf_dir)).where("filed_at <= DATE'1999-03-31'")
    return known.groupBy("sid", "concept").agg(
        F.max_by("period_end", "filed_at").alias("period_end"),
        F.round(F.max_by("value", "filed_at"), 4).alias("value"),
        F.datediff(F.lit("1999-03-31").cast("date"), F.max("filed_at")).cast("long").alias("days_stale"),
    )


@query(
    "p09_screen",
    f"""{SQL_STEPS}, {V.SQL_INSTRUMENTS}, {_MEMBERS}, m AS (SELECT universe, sid FROM members WHERE snap_date = DATE '1998-01-01'),
 known_at AS (SELECT sid, concept, arg_max(value, filed_at) AS value, max(filed_at) AS f FROM steps WHERE filed_at <= DATE '1999-03-31' GROUP BY ALL),
 fresh AS (SELECT * FROM known_at WHERE date_diff('day', f, DATE '1999-03-31') <= 455),
 x AS (SELECT universe, m.sid, CASE WHEN q.value > 0 THEN round(r.value / q.value, 6) END AS metric FROM m LEFT JOIN fresh r ON m.sid = r.sid AND r.concept = 'revenue' LEFT JOIN fresh q ON m.sid = q.sid AND q.concept = 'quantity')
 SELECT universe, sid, metric, CASE WHEN metric IS NULL THEN 'unknown' WHEN metric BETWEEN 2000 AND 2400 THEN 'passed' ELSE 'failed' END AS status,
 row_number() OVER (PARTITION BY universe ORDER BY metric DESC NULLS LAST, sid) AS place FROM x""",
)
def p09(spark, sf_dir):
    """A universe screened by revenue per unit as known on a date."""
    members = _members(spark, sf_dir).where("snap_date = DATE'1998-01-01'").select("universe", "sid")
    return P.screen(V.facts(spark, sf_dir, "1999-03-31"), members, "1999-03-31", 2000.0, 2400.0).withColumn("place", F.col("place").cast("long"))


@query(
    "i24_yoy_growth",
    f"{SQL_STEPS}, s AS (SELECT * FROM steps WHERE concept = 'revenue') SELECT a.sid, a.filed_at, round(a.value / b.value - 1, 8) AS growth FROM s a ASOF JOIN s b ON a.sid = b.sid AND a.filed_at - INTERVAL 1 YEAR >= b.filed_at WHERE b.value <> 0",
)
def i24(spark, sf_dir):
    """Growth of a step series against itself a year before."""
    s = P.steps(V.facts(spark, sf_dir).where("concept = 'revenue'")).select("sid", "filed_at", "value")
    now = s.withColumn("year_ago", F.add_months("filed_at", -12)).withColumnRenamed("value", "now")
    found = asof(now, s.withColumnRenamed("filed_at", "then"), ["sid"], "year_ago", "then", ["value"])
    return found.where("value <> 0").select("sid", "filed_at", F.round(F.col("now") / F.col("value") - 1, 8).alias("growth"))


def _fundamental_rule(spark, sf_dir, metric, keep):
    """Days at quarter ends on which an instrument's ratio, as known then, is in a band."""
    ends = spark.sql("SELECT explode(sequence(DATE'1996-03-31', DATE'2000-12-31', INTERVAL 3 MONTHS)) AS q").select(F.last_day("q").alias("on"))
    asked = V.instruments(spark, sf_dir).select("sid").join(F.broadcast(ends))  # twenty dates
    facts = V.facts(spark, sf_dir)
    r = P.value_on(asked, facts, "on", "revenue").withColumnRenamed("value", "revenue").withColumnRenamed("period_end", "revenue_end").drop("filed_at_matched")
    both = P.value_on(r, facts, "on", "quantity").withColumnRenamed("value", "quantity").withColumnRenamed("period_end", "quantity_end")
    found = both.withColumn("trigger", metric(both)).where(keep(F.col("trigger")))
    return found.select("sid", "on", F.round("trigger", 9).alias("trigger"))


_AT_ENDS = f"""{SQL_STEPS}, {V.SQL_INSTRUMENTS}, asked AS (SELECT sid, CAST(last_day(CAST(q AS DATE)) AS DATE) AS on_ FROM instruments, range(TIMESTAMP '1996-03-31', TIMESTAMP '2001-01-01', INTERVAL 3 MONTH) t(q)),
 r AS (SELECT a.sid, on_, s.value, s.period_end, s.filed_at FROM asked a ASOF LEFT JOIN (SELECT * FROM steps WHERE concept = 'revenue') s ON a.sid = s.sid AND a.on_ >= s.filed_at),
 q AS (SELECT a.sid, on_, s.value, s.period_end, s.filed_at FROM asked a ASOF LEFT JOIN (SELECT * FROM steps WHERE concept = 'quantity') s ON a.sid = s.sid AND a.on_ >= s.filed_at),
 x AS (SELECT r.sid, r.on_, r.value AS revenue, q.value AS quantity, r.period_end AS re, q.period_end AS qe FROM r JOIN q ON r.sid = q.sid AND r.on_ = q.on_
  WHERE date_diff('day', r.filed_at, r.on_) <= 455 AND date_diff('day', q.filed_at, q.on_) <= 455)"""


@query("r16_ratio_band", f'{_AT_ENDS} SELECT sid, on_ AS "on", round(revenue / quantity, 9) AS trigger FROM x WHERE quantity > 0 AND revenue / quantity BETWEEN 1900 AND 2300')
def r16(spark, sf_dir):
    """Ratio of two figures in a band (the valuation filters)."""
    return _fundamental_rule(spark, sf_dir, lambda b: P.ratio(b["revenue"], b["quantity"]), lambda t: t.between(1900, 2300))


@query("r18_ratio_at_least", f'{_AT_ENDS} SELECT sid, on_ AS "on", round(quantity / revenue * 10000, 9) AS trigger FROM x WHERE revenue > 0 AND quantity / revenue * 10000 >= 5')
def r18(spark, sf_dir):
    """Ratio of two figures at least (profitability, margin, liquidity)."""
    return _fundamental_rule(spark, sf_dir, lambda b: P.ratio(b["quantity"], b["revenue"], 10000.0), lambda t: t >= 5)


@query("r24_same_period_ratio", f'{_AT_ENDS} SELECT sid, on_ AS "on", round((revenue - quantity * 2000) / quantity, 9) AS trigger FROM x WHERE re = qe AND quantity > 0 AND abs((revenue - quantity * 2000) / quantity) > 200')
def r24(spark, sf_dir):
    """Excess of one figure over another of the same period."""
    return _fundamental_rule(
        spark, sf_dir, lambda b: F.when((b["revenue_end"] == b["quantity_end"]) & (b["quantity"] > 0), (b["revenue"] - b["quantity"] * 2000) / b["quantity"]), lambda t: F.abs(t) > 200
    )


@query(
    "r22_growth_once_per_period",
    f"{SQL_STEPS}, s AS (SELECT * FROM steps WHERE concept = 'revenue' AND sid % 10 <> 3), g AS (SELECT sid, filed_at, period_end, value / lag(value) OVER (PARTITION BY sid ORDER BY filed_at) - 1 AS g FROM s), e AS (SELECT * FROM g WHERE abs(g) >= 0.1) "
    "SELECT sid, filed_at, period_end, CASE WHEN g >= 0.1 THEN 1 ELSE -1 END AS direction, round(g, 8) AS trigger FROM (SELECT *, lag(period_end) OVER (PARTITION BY sid ORDER BY filed_at) AS before FROM e) WHERE period_end IS DISTINCT FROM before",
)
def r22(spark, sf_dir):
    """Growth of the newest figure over the one before, once per deciding period."""
    s = P.steps(V.facts(spark, sf_dir).where("concept = 'revenue' AND sid % 10 <> 3"))
    w = Window.partitionBy("sid").orderBy("filed_at")
    e = s.withColumn("g", F.col("value") / F.lag("value").over(w) - 1).where(F.abs("g") >= 0.1)
    once = e.withColumn("before", F.lag("period_end").over(w)).where(~F.col("period_end").eqNullSafe(F.col("before")))
    return once.select("sid", "filed_at", "period_end", F.when(F.col("g") >= 0.1, 1).otherwise(-1).alias("direction"), F.round("g", 8).alias("trigger"))


@query(
    "r23_consecutive_rises",
    f"{SQL_STEPS}, h AS (SELECT sid, concept, period_end, arg_max(value, filed_at) AS value FROM ver WHERE filed_at <= DATE '2000-06-30' GROUP BY ALL), "
    "m AS (SELECT r.sid, r.period_end, r.value / q.value AS margin FROM h r JOIN h q ON r.sid = q.sid AND r.period_end = q.period_end AND r.concept = 'revenue' AND q.concept = 'quantity' AND q.value > 0), "
    "dd AS (SELECT *, sign(margin - lag(margin) OVER w) AS s1, lag(margin) OVER w AS p1, lag(margin, 2) OVER w AS p2 FROM m WINDOW w AS (PARTITION BY sid ORDER BY period_end)) "
    "SELECT sid, period_end, CASE WHEN margin > p1 THEN 1 ELSE -1 END AS direction, round(margin, 6) AS trigger FROM dd WHERE (margin > p1 AND p1 > p2) OR (margin < p1 AND p1 < p2)",
)
def r23(spark, sf_dir):
    """Two rises or falls in a row of a ratio of the same periods."""
    h = P.history(V.facts(spark, sf_dir), "2000-06-30", 10_000)
    r, q = (h.where(F.col("concept") == k).select("sid", "period_end", F.col("value").alias(k)) for k in ("revenue", "quantity"))
    w = Window.partitionBy("sid").orderBy("period_end")
    m = r.join(q, ["sid", "period_end"]).where("quantity > 0").withColumn("m", F.col("revenue") / F.col("quantity"))
    d = m.withColumn("p1", F.lag("m").over(w)).withColumn("p2", F.lag("m", 2).over(w))
    up, down = (F.col("m") > F.col("p1")) & (F.col("p1") > F.col("p2")), (F.col("m") < F.col("p1")) & (F.col("p1") < F.col("p2"))
    return d.where(up | down).select("sid", "period_end", F.when(up, 1).otherwise(-1).alias("direction"), F.round("m", 6).alias("trigger"))


_SQL_EFFECTIVE = f"""WITH {V.SQL_BARS_D}, {V.SQL_ACTIONS}, nb AS (SELECT symbol, d, lag(c) OVER (PARTITION BY symbol ORDER BY d) AS bc FROM bars_d),
 eff AS (SELECT a.*, nb.d, nb.bc FROM actions a ASOF JOIN nb ON a.symbol = nb.symbol AND a.ex_date <= nb.d WHERE nb.bc IS NOT NULL)"""
_SQL_FACTORS = f"""{_SQL_EFFECTIVE}, sp AS (SELECT symbol, d, product(split_ratio) AS ratio FROM eff WHERE action_type = 'split' GROUP BY ALL),
 fac AS (SELECT symbol, d, product(CASE WHEN action_type = 'split' THEN 1 / split_ratio ELSE (bc - dividend * coalesce(ratio, 1.0)) / bc END) AS p, product(CASE WHEN action_type = 'split' THEN split_ratio ELSE 1.0 END) AS q FROM eff LEFT JOIN sp USING (symbol, d) GROUP BY ALL),
 adj AS (SELECT symbol, d, o, h, l, c, v, coalesce(product(p) OVER w, 1.0) AS pf, coalesce(product(q) OVER w, 1.0) AS qf FROM bars_d LEFT JOIN fac USING (symbol, d)
  WINDOW w AS (PARTITION BY symbol ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("j15_first_bar_after", f"{_SQL_EFFECTIVE} SELECT symbol, ex_date, action_type, d AS bar_d FROM eff")
def j15(spark, sf_dir):
    """The bar on which each action takes effect (forward as-of)."""
    return A.effective(V.actions(spark), V.daily_bars(spark, sf_dir)).select("symbol", "ex_date", "action_type", "bar_d")


@query("c03_factors", f"{_SQL_FACTORS} SELECT symbol, d, round(p, 10) AS p, round(q, 10) AS q FROM fac")
def c03(spark, sf_dir):
    """Adjustment factors per bar with actions."""
    return A.factors(V.actions(spark), V.daily_bars(spark, sf_dir)).select("symbol", "d", F.round("p", 10).alias("p"), F.round("q", 10).alias("q"))


@query(
    "c04_adjusted_bars",
    f"{_SQL_FACTORS} SELECT symbol, d, round(o * pf, 6) AS o, round(h * pf, 6) AS h, round(l * pf, 6) AS l, round(c * pf, 6) AS c, CAST(round_even(v * qf, 0) AS BIGINT) AS v, c AS raw_close FROM adj",
)
def c04(spark, sf_dir):
    """Back-adjusted bars with the close as traded."""
    out = A.adjust(V.daily_bars(spark, sf_dir), V.actions(spark))
    return out.select("symbol", "d", *[F.round(x, 6).alias(x) for x in "ohlc"], "v", "raw_close")


@query("c02_split_only", f"{_SQL_FACTORS.replace('FROM actions a ASOF', 'FROM (SELECT * FROM actions WHERE action_type = ' + chr(39) + 'split' + chr(39) + ') a ASOF')} SELECT symbol, d, round(c * pf, 6) AS c FROM adj")
def c02(spark, sf_dir):
    """Closes adjusted for splits only."""
    return A.adjust(V.daily_bars(spark, sf_dir), V.actions(spark), "split").select("symbol", "d", F.round("c", 6).alias("c"))


@query(
    "r30_studies",
    f"{_SQL_FACTORS}, s AS (SELECT symbol, d, pf, CASE WHEN count(c) OVER w = 20 THEN avg(c * pf) OVER w END AS m FROM adj WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, d, round(m / pf + {OFF_TIE}, 4) AS line FROM s WHERE m IS NOT NULL",
)
def r30(spark, sf_dir):
    """An indicator line of adjusted closes, drawn at traded prices."""
    a = A.adjust(V.daily_bars(spark, sf_dir), V.actions(spark))
    s = a.withColumn("m", W.sma(F.col("c"), 20, W.series())).where("m IS NOT NULL")
    return s.select("symbol", "d", F.round(F.col("m") / (F.col("c") / F.col("raw_close")) + OFF_TIE, 4).alias("line"))
