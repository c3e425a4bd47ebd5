"""Paced admission, capped recordings, leases and open lines, routed messages, bar stores and panels, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions import reach
from tidebook.functions import rules as S
from tidebook.operators import leases as L
from tidebook.operators import pacing as P
from tidebook.plans import books as K
from tidebook.sources import sinks
from tidebook.sources import stores as B
from tidebook.sources import views as V
from tidebook.streaming import routing as R
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


@query(
    "st10_paced_admission",
    """WITH RECURSIVE q AS (SELECT event_id, event_type AS symbol, date_trunc('day', ts) AS arrival, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
 walk AS (SELECT i, event_id, symbol, arrival, CAST(arrival AS TIMESTAMP) AS admitted FROM q WHERE i <= 50
  UNION ALL SELECT q.i, q.event_id, q.symbol, q.arrival, greatest(CAST(q.arrival AS TIMESTAMP), w.admitted + INTERVAL 600 SECOND) FROM walk w JOIN q ON q.i = w.i + 50)
 SELECT event_id, symbol, CAST(arrival AS TIMESTAMP) AS arrival, admitted FROM walk""",
)
def st10(spark, sf_dir):
    """All requests of a day arrive at its start: at most 50 are admitted in any ten minutes."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    requests = V.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", day.alias("arrival"))
    return P.admissions(requests, ["ts", "event_id"]).drop("ts")


@query(
    "st10_queue_per_symbol",
    """WITH RECURSIVE q AS (SELECT event_id, event_type AS symbol, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
 walk AS (SELECT i, event_id, symbol, ts, ts AS admitted FROM q WHERE i <= 3
  UNION ALL SELECT q.i, q.event_id, q.symbol, q.ts, greatest(q.ts, w.admitted + INTERVAL 7200 SECOND) FROM walk w JOIN q ON q.symbol = w.symbol AND q.i = w.i + 3)
 SELECT event_id, symbol, ts, admitted FROM walk""",
)
def st10s(spark, sf_dir):
    """A queue for each symbol: three in any two hours."""
    requests = V.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    return P.admissions(requests, ["ts", "event_id"], "ts", ["symbol"], 3, 7200)


FRAMES, CLOSES = 400, 800


@query(
    "rp03_record_caps",
    f"""{K._REPLAY}, s AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS session, bool_or(event IN ('signal', 'fill')) OR d = (SELECT max(d) FROM ev) AS eventful,
  count(*) FILTER (event = 'bar') AS closes FROM ev GROUP BY d),
 e AS (SELECT CAST(ceil(count(*) / {FRAMES}) AS BIGINT) AS every, count(*) AS n, (SELECT count(DISTINCT symbol) FROM ev) AS symbols FROM s),
 b AS (SELECT every, greatest(1, CAST(ceil(ceil(n / every) * symbols / {CLOSES}) AS BIGINT)) AS bars_every FROM e),
 k AS (SELECT d, session, eventful, closes, eventful OR session % every = 0 AS keep, eventful OR (session % every = 0 AND session // every % bars_every = 0) AS keep_bars FROM s, b)
 SELECT d, CAST(session AS BIGINT) AS session, eventful, keep, keep_bars, closes,
  CAST(sum(CASE WHEN keep_bars THEN closes ELSE 0 END) OVER (ORDER BY d) AS BIGINT) AS kept_closes FROM k""",
)
def rp03(spark, sf_dir):
    """Sessions of a replay that a recording of limited size keeps."""
    return P.recorded(K._replay(spark, sf_dir), frames=FRAMES, closes=CLOSES)


_RENEWALS = "renewals AS (SELECT event_type AS symbol, user_id % 4 AS consumer, ts, max(ts + to_hours(CAST(2 + event_id % 7 AS INTEGER))) AS expires_at, count(*) AS n FROM events GROUP BY ALL)"
_INTERVALS = f"""WITH {_RENEWALS}, b AS (SELECT *, CASE WHEN lag(expires_at) OVER w >= ts THEN 0 ELSE 1 END AS begins FROM renewals WINDOW w AS (PARTITION BY symbol, consumer ORDER BY ts)),
 g AS (SELECT *, sum(begins) OVER (PARTITION BY symbol, consumer ORDER BY ts) AS g FROM b),
 valid AS (SELECT symbol, consumer, min(ts) AS valid_from, arg_max(expires_at, ts) AS valid_to, CAST(sum(n) AS BIGINT) AS renewals FROM g GROUP BY symbol, consumer, g)"""


def _renewals(spark, sf_dir):
    """Events as renewals: a user's group holds a symbol's line for some hours."""
    hours = F.make_dt_interval(hours=(2 + F.col("event_id") % 7).cast("int"))
    return V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), (F.col("user_id") % 4).alias("consumer"), F.col("ts").alias("at"), (F.col("ts") + hours).alias("expires_at")
    )


@query("st11_lease_intervals", f"{_INTERVALS} SELECT * FROM valid")
def st11(spark, sf_dir):
    """When each lease was valid."""
    valid = L.valid_intervals(_renewals(spark, sf_dir), ["symbol", "consumer"])
    return valid.select("symbol", "consumer", F.col("start").alias("valid_from"), F.col("end").alias("valid_to"), "renewals")


@query(
    "st11_line_changes",
    f"""{_INTERVALS}, t AS (SELECT DISTINCT symbol, unnest([valid_from, valid_to]) AS changed_at FROM valid),
 held AS (SELECT t.symbol, t.changed_at, count(v.symbol) > 0 AS open FROM t LEFT JOIN valid v ON v.symbol = t.symbol AND v.valid_from <= t.changed_at AND t.changed_at < v.valid_to GROUP BY ALL)
 SELECT symbol, changed_at, CASE WHEN open THEN 'active' ELSE 'expired' END AS status FROM (SELECT *, lag(open, 1, false) OVER (PARTITION BY symbol ORDER BY changed_at) AS before FROM held) WHERE open <> before""",
)
def st11c(spark, sf_dir):
    """When each symbol's line opens, with its first lease, and closes with its last."""
    return L.line_changes(L.valid_intervals(_renewals(spark, sf_dir), ["symbol", "consumer"]), "symbol").withColumnRenamed("at", "changed_at")


@query(
    "j16_open_leases",
    f"""WITH {V.SQL_INSTRUMENTS}, r AS (SELECT l_suppkey AS sid, l_returnflag AS consumer, max({{'t': l_shipdate, 'e': l_shipdate + to_days(CAST(1 + l_linenumber % 5 AS INTEGER))}}) AS m
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-01' GROUP BY ALL)
 SELECT sid, consumer, name, country, m.t AS renewed_at, m.e AS expires_at FROM r JOIN instruments USING (sid) WHERE m.e > TIMESTAMP '1998-06-01'""",
)
def j16(spark, sf_dir):
    """Leases that are valid at a time, with their instruments."""
    days = F.make_dt_interval(days=(1 + F.col("l_linenumber") % 5).cast("int"))
    renewals = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sid"), F.col("l_returnflag").alias("consumer"), F.col("l_shipdate").alias("at"), (F.col("l_shipdate") + days).alias("expires_at")
    )
    open_ = L.open_leases(renewals, ["sid", "consumer"], "1998-06-01")
    return open_.join(V.instruments(spark, sf_dir), "sid").select("sid", "consumer", "name", "country", F.col("at").alias("renewed_at"), "expires_at")


@query(
    "st04_routed",
    """WITH m AS (SELECT event_id AS payload, event_type AS symbol, user_id % 4 AS owner, ts FROM events),
 s AS (SELECT event_id AS subscription_id, event_type AS symbol, user_id % 4 AS owner, ts AS valid_from, ts + to_hours(CAST(3 + event_id % 11 AS INTEGER)) AS valid_to FROM events WHERE event_id % 20 = 0)
 SELECT subscription_id, owner, symbol, ts, payload FROM m JOIN s USING (owner, symbol) WHERE ts >= valid_from AND ts < valid_to""",
)
def st04(spark, sf_dir):
    """Messages per subscription: each goes to those of its owner that hold its symbol then.

    Both streams are written once, as they come; deliveries, whose number grows with the square of the events, are made when read.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    def stream():
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        return events.select("event_id", F.col("event_type").alias("symbol"), (F.col("user_id") % 4).alias("owner"), F.col("ts").cast("timestamp").alias("ts"))

    messages = stream().withColumnRenamed("event_id", "payload")
    hours = F.make_dt_interval(hours=(3 + F.col("event_id") % 11).cast("int"))
    held = stream().where("event_id % 20 = 0").select(
        F.col("event_id").alias("subscription_id"), "owner", "symbol", F.col("ts").alias("valid_from"), (F.col("ts") + hours).alias("valid_to")
    )
    come = [T.to_folder(x, sinks.shared_folder(spark, f"routed-{name}")) for x, name in ((messages, "messages"), (held, "subscriptions"))]
    found = R.routed(*come)
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_SID_BARS = "sid_bars AS (SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS c, count(*) AS v FROM lineitem GROUP BY ALL)"


def _sid_bars(spark, sf_dir):
    """Daily closes of suppliers."""
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("d"), "l_extendedprice")
    return lines.groupBy("sid", "d").agg(F.max("l_extendedprice").alias("c"), F.count("*").alias("v"))


@query("sc08_batched_read", f"WITH {_SID_BARS} SELECT sid, d, c, v FROM sid_bars JOIN supplier ON s_suppkey = sid WHERE s_suppkey BETWEEN 30 AND 54")
def sc08(spark, sf_dir):
    """Bars of 25 instruments from a store of all; the other partitions are pruned."""
    path = sinks.shared_folder(spark, "bars")
    B.write_bars(_sid_bars(spark, sf_dir), path)
    wanted = V.table(spark, sf_dir, "supplier").where("s_suppkey BETWEEN 30 AND 54").select(F.col("s_suppkey").alias("sid"))
    return B.read_bars(spark, path, wanted)


def deepest(state: dict | None, row: dict) -> dict:
    """Bars so far, the highest close, and the deepest fall from it."""
    top = row["c"] if state is None else max(state["top"], row["c"])
    fall = row["c"] / top - 1
    if state is None:
        return {"sid": row["sid"], "n": 1, "last": row["d"], "top": top, "fall": fall}
    return state | {"n": state["n"] + 1, "last": row["d"], "top": top, "fall": min(state["fall"], fall)}


@query(
    "sc07_series_stream",
    f"""WITH {_SID_BARS}, t AS (SELECT *, max(c) OVER (PARTITION BY sid ORDER BY d) AS top FROM sid_bars)
 SELECT sid, count(*) AS n, max(d) AS last, max(top) AS top, round(min(c / top - 1), 9) AS fall FROM t GROUP BY sid""",
)
def sc07(spark, sf_dir):
    """All instruments' bars streamed through in order, one state at a time."""
    path = sinks.shared_folder(spark, "series")
    B.write_bars(_sid_bars(spark, sf_dir), path)
    return B.fold_series(spark, path, deepest, "sid long, n long, last date, top double, fall double").withColumn("fall", F.round("fall", 9))


@query("sk07_panel", f"WITH {_SID_BARS} SELECT sid, d, c FROM sid_bars")
def sk07(spark, sf_dir):
    """Closes written as a wide panel and read back as they were."""
    path = sinks.shared_folder(spark, "panel")
    B.write_panel(_sid_bars(spark, sf_dir), path)
    return B.read_panel(spark, path)


# Bars that each rule declares and needs, by hand: the longest window, what it stands on, and the bar before a crossing.
_LOOKBACKS = {
    "sma_crossover": (51, 51), "ema_crossover": (27, 27), "rsi_threshold": (16, 16), "breakout": (21, 21), "adx_trend": (29, 28),
    "macd_crossover": (35, 35), "macd_slope": (37, 36), "roc_momentum": (14, 14), "stochastic_threshold": (17, 15),
    "bollinger_reversion": (21, 21), "zscore_reversion": (21, 21), "rsi_zone": (15, 15), "donchian_breakout": (21, 21), "volume_spike": (21, 21),
}


@query(
    "u07_lookbacks",
    " UNION ALL ".join(
        f"SELECT '{name}' AS rule, '{','.join(S.RULES[name].roles)}' AS roles, CAST({declared} AS BIGINT) AS declared, CAST({needed} AS BIGINT) AS needed, count(*) AS events FROM (WITH {V.SQL_BARS_D} SELECT * FROM {K._RULE_SQL[name]})"
        for name, (declared, needed) in _LOOKBACKS.items()
    ),
)
def u07(spark, sf_dir):
    """Every rule with its roles, the lookback that it declares and the one that its plan has, and its events on the bars."""
    bars = V.daily_bars(spark, sf_dir)
    names = sorted(S.RULES)
    wide = S.fired(bars, [(n, {}) for n in names])
    counted = wide.agg(F.array(*[F.struct(F.lit(k).alias("k"), F.count(f"dir{k}").alias("events")) for k in range(len(names))]).alias("x")).select(F.inline("x"))
    known = [(k, n, ",".join(S.RULES[n].roles), *reach.check(bars, n)) for k, n in enumerate(names)]
    return counted.join(spark.createDataFrame(known, "k int, rule string, roles string, declared long, needed long"), "k").drop("k")
