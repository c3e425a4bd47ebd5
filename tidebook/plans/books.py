"""Composition, trades, equity, performance and replay queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import rules as S
from tidebook.operators import allocation as A
from tidebook.operators import performance as B
from tidebook.operators import simulator as X
from tidebook.plans import rules as RS
from tidebook.plans.relational import _SIGNALS
from tidebook.plans.strategy import TEMPLATES, Component, Strategy, compose, compose_all, namespaces
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


def _inner(body: str, tail: str) -> str:
    """A rule's SQL as a subquery of a statement that already has bars_d."""
    return "(" + body.replace("WITH " + V.SQL_BARS_D + ", y AS", "WITH y AS") + " " + tail + ")"


def _roc(n: int, up: int, down: int) -> str:
    value = f"CASE WHEN lag(c, {n}) OVER w <> 0 THEN 100 * (c - lag(c, {n}) OVER w) / lag(c, {n}) OVER w END AS x"
    return _inner(RS._values(value) + RS._lagged("x"), RS._select("z", "roc_momentum", f"px <= {up} AND x > {up}", f"px >= {down} AND x < {down}", "x"))


#: The events of a rule with its default parameters, as a subquery of a statement that has bars_d.
_RULE_SQL = {name[4:]: f"({sql})" for name, sql in RS.ORACLES.items() if name not in ("r02_rsi_threshold", "r09_stochastic_smoothed", "r26_configured_rules", "r29_batch_runner")} | {
    "rsi_threshold": _inner(RS._RSI + RS._lagged("x"), RS._select("z", "rsi_threshold", "px < 30 AND x >= 30", "px > 70 AND x <= 70", "x")),
    "roc_momentum": _roc(12, 5, -5),
    ("roc_momentum", ("n", 6)): _roc(6, 5, -5),
}


def _compose_sql(s: Strategy, evidence: bool = False) -> str:
    n = len(s.components)
    ctes, columns, joins = [], [], []
    for i, c in enumerate(s.components):
        body = _RULE_SQL[(c.rule, *c.params.items()) if c.params else c.rule]
        ctes.append(f"e{i} AS (SELECT symbol, d, {'-' if c.invert else ''}direction AS f{i}, trigger AS t{i} FROM {body})")
        joins.append(f"LEFT JOIN e{i} USING (symbol, d)")
        columns += [f"last_value(CASE WHEN f{i} = {v} THEN t{i} END IGNORE NULLS) OVER run AS t{i}_{k}" for v, k in ((1, "up"), (-1, "down"))]
        columns += [
            f"coalesce(i - last_value(CASE WHEN f{i} = {v} THEN i END IGNORE NULLS) OVER run < {s.window}, false) AS a{i}_{k}" for v, k in ((1, "up"), (-1, "down"))
        ]

    def votes(role: str, side: str) -> tuple[str, str]:
        own = [(i, c.weight) for i, c in enumerate(s.components) if c.role == role]
        if not own:
            return "false", "0.0"
        count = " + ".join(f"CAST(a{i}_{side} AS INT)" for i, _ in own)
        weight = " + ".join(f"CASE WHEN a{i}_{side} THEN CAST({w} AS DOUBLE) ELSE 0 END" for i, w in own)
        logic, least = (s.entry_logic, s.entry_threshold) if role == "entry" else (s.exit_logic, s.exit_threshold)
        carried = {"all": f"({count}) = {len(own)}", "any": f"({count}) > 0", "majority": f"2 * ({count}) > {len(own)}", "weighted": f"({weight}) >= {least} AND ({count}) > 0"}[logic]
        return f"({carried})", f"({weight}) / CAST({sum(w for _, w in own)} AS DOUBLE)"

    gate = " AND ".join([f"a{i}_up" for i, c in enumerate(s.components) if c.role == "filter"] or ["true"])
    (up, up_s), (down, down_s) = votes("entry", "up"), votes("entry", "down")
    sides = " UNION ALL ".join(
        f"SELECT symbol, d, CASE WHEN en AND ex THEN 'both' WHEN en THEN 'entry' WHEN ex THEN 'exit' END AS kind, '{name}' AS direction, CASE WHEN en THEN sc END AS score "
        f"FROM (SELECT symbol, d, {v} AND NOT ({up} AND {down}) AND {gate} AS en, {votes('exit', side)[0]} AS ex, {sc} AS sc FROM live)"
        for name, side, v, sc in (("bullish", "up", up, up_s), ("bearish", "down", down, down_s))
    )
    if evidence:
        sides = " UNION ALL ".join(
            f"SELECT symbol, d, CASE WHEN en AND ex THEN 'both' WHEN en THEN 'entry' WHEN ex THEN 'exit' END AS kind, '{name}' AS direction, {_evidence_sql(s, side)} "
            f"FROM (SELECT *, {v} AND NOT ({up} AND {down}) AND {gate} AS en, {votes('exit', side)[0]} AS ex FROM live)"
            for name, side, v in (("bullish", "up", up), ("bearish", "down", down))
        )
    chosen = "evidence, components, logic" if evidence else "round(score, 6) AS score"
    return f"""WITH {V.SQL_BARS_D}, {', '.join(ctes)}, line AS (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i, {', '.join(f'f{i}, t{i}' for i in range(n))} FROM bars_d {' '.join(joins)}),
 live AS (SELECT symbol, d, {', '.join(columns)} FROM line WINDOW run AS (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING))
 SELECT symbol, d, kind, direction, {chosen} FROM ({sides}) WHERE kind IS NOT NULL"""


def _evidence_sql(s: Strategy, side: str) -> str:
    """Sorted key=value texts of the triggers, the members, and the logic."""
    under = namespaces(s)
    speak = {"entry": "en", "exit": "ex", "filter": "true"}
    values, members = {}, []
    for role in ("entry", "exit", "filter"):
        for i, c in enumerate(s.components):
            if c.role != role:
                continue
            on = "up" if role == "filter" else side
            values.setdefault(under[i], []).insert(0, f"CASE WHEN {speak[role]} AND a{i}_{on} THEN '{under[i]}.trigger=' || CAST(CAST(round(t{i}_{on}, 6) AS DECIMAL(20,6)) AS VARCHAR) END")
            if role != "filter":
                members.append(f"CASE WHEN {speak[role]} AND a{i}_{on} THEN '{under[i]}' END")
    entries = ", ".join(f"coalesce({', '.join(v)})" for v in values.values())
    return (
        f"array_to_string(list_sort(list_filter([{entries}], lambda x: x IS NOT NULL)), ';') AS evidence, "
        f"array_to_string(list_filter([{', '.join(members)}], lambda x: x IS NOT NULL), ',') AS components, CASE WHEN en THEN '{s.entry_logic}' ELSE '{s.exit_logic}' END AS logic"
    )


_PARTS = (Component("sma_crossover", "entry"), Component("breakout", "entry", 2.0), Component("volume_spike", "filter"), Component("roc_momentum", "exit"))
STRATEGIES = {
    "x08_compose_any": Strategy("any", _PARTS, "any", window=5),
    "x03_compose_all": Strategy("all", _PARTS, "all", window=20),
    "x03_compose_majority": Strategy("majority", (*_PARTS, Component("roc_momentum", "entry")), "majority", window=5),
    "x03_compose_weighted": Strategy("weighted", _PARTS, "weighted", window=5, entry_threshold=2.0),
    "x01_compose_inverted": Strategy("inverted", (Component("breakout", "entry", invert=True), Component("sma_crossover", "exit")), window=3),
    "x10_promoted_rule": Strategy("promoted", (Component("breakout", "entry"), Component("breakout", "exit"))),
}
for _name, _strategy in STRATEGIES.items():
    QUERIES[_name] = lambda spark, sf_dir, s=_strategy: compose(V.daily_bars(spark, sf_dir), s).withColumn("score", F.round("score", 6))
    ORACLES[_name] = _compose_sql(_strategy)


EXPLAINED = Strategy("explained", (*_PARTS, Component("roc_momentum", "entry", params={"n": 6}), Component("breakout", "exit")), "any", window=5)


@query("x07_evidence", _compose_sql(EXPLAINED, evidence=True))
def x07(spark, sf_dir):
    """What spoke for each decision, by rule; one rule runs with two sets of parameters."""
    found = compose(V.daily_bars(spark, sf_dir), EXPLAINED, evidence=True)
    entry = lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"], 6).cast("decimal(20,6)").cast("string"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("evidence"), entry)), ";")
    return found.select("symbol", "d", "kind", "direction", text.alias("evidence"), F.array_join("components", ",").alias("components"), "logic")


@query("x11_templates", " UNION ALL ".join(f"SELECT '{s.name}' AS strategy, * FROM ({_compose_sql(s)})" for s in TEMPLATES.values()))
def x11(spark, sf_dir):
    """The decisions of all ready-made strategies, from one pass over the bars."""
    return compose_all(V.daily_bars(spark, sf_dir), list(TEMPLATES.values())).withColumn("score", F.round("score", 6))


# Trades are taken at closes lifted by a constant: the raw ones jump many times over, which no return survives.
LIFT = 1_000_000.0

_TRADES = f"""WITH {_SIGNALS}, px AS (SELECT symbol, d, c + {LIFT} AS c FROM bars_d), pr AS (SELECT s.symbol, s.d, direction, px.c FROM signals s JOIN px USING (symbol, d)),
 turns AS (SELECT * FROM (SELECT *, lag(direction) OVER (PARTITION BY symbol ORDER BY d) AS before FROM pr) WHERE direction IS DISTINCT FROM before),
 pairs AS (SELECT * FROM (SELECT *, lead(d) OVER w AS exit_d, lead(c) OVER w AS exit_c FROM turns WINDOW w AS (PARTITION BY symbol ORDER BY d)) WHERE direction = 1),
 trades AS (SELECT symbol, d AS entry_d, c AS entry_price, exit_d, coalesce(exit_c, lc) AS exit_price, coalesce(exit_c, lc) / c - 1 AS return_pct, exit_d IS NULL AS is_open
  FROM pairs JOIN (SELECT symbol, arg_max(c, d) AS lc FROM px GROUP BY ALL) USING (symbol)),
 grid AS (SELECT dd.d, s.symbol FROM (SELECT DISTINCT d FROM px) dd, (SELECT DISTINCT symbol FROM px) s),
 held AS (SELECT b.symbol, b.d, CASE WHEN t.entry_price IS NOT NULL THEN b.c / t.entry_price ELSE 1.0 END AS ratio FROM px b LEFT JOIN trades t ON t.symbol = b.symbol AND b.d >= t.entry_d AND (t.exit_d IS NULL OR b.d <= t.exit_d)),
 real AS (SELECT b.symbol, b.d, coalesce(product(t.exit_price / t.entry_price), 1.0) AS realised FROM px b LEFT JOIN trades t ON t.symbol = b.symbol AND t.exit_d < b.d AND NOT t.is_open GROUP BY ALL),
 sleeve AS (SELECT symbol, d, ratio * realised AS value FROM held JOIN real USING (symbol, d)),
 filled AS (SELECT g.d, g.symbol, coalesce(s.value, 1.0) AS value FROM grid g ASOF LEFT JOIN sleeve s ON g.symbol = s.symbol AND g.d >= s.d),
 equity AS (SELECT d, 100000.0 * sum(value) / count(*) AS equity FROM filled GROUP BY ALL),
 hold AS (SELECT symbol, d, c / first_value(c) OVER (PARTITION BY symbol ORDER BY d) AS value FROM px),
 bench AS (SELECT g.d, 100000.0 * sum(coalesce(s.value, 1.0)) / count(*) AS equity FROM grid g ASOF LEFT JOIN hold s ON g.symbol = s.symbol AND g.d >= s.d GROUP BY ALL)"""


def _lifted(spark, sf_dir):
    return V.daily_bars(spark, sf_dir).withColumn("c", F.col("c") + LIFT)


def _trades(spark, sf_dir):
    bars = _lifted(spark, sf_dir)
    return B.pair_trades(S.events(V.daily_bars(spark, sf_dir), "breakout"), bars), bars


@query("e23_pair_trades", f"{_TRADES} SELECT symbol, entry_d, entry_price, exit_d, exit_price, round(return_pct, 8) AS return_pct, is_open FROM trades")
def e23(spark, sf_dir):
    """Round trips of a rule's signals."""
    return _trades(spark, sf_dir)[0].withColumn("return_pct", F.round("return_pct", 8))


@query("b01_sleeves", f"{_TRADES} SELECT symbol, d, round(value, 6) AS value FROM sleeve")
def b01(spark, sf_dir):
    """Value of each symbol's sleeve."""
    trades, bars = _trades(spark, sf_dir)
    return B.sleeves(trades, bars).withColumn("value", F.round("value", 6))


@query("b02_equity", f"{_TRADES} SELECT d, round(equity, 3) AS equity FROM equity")
def b02(spark, sf_dir):
    """The book over all dates."""
    return B.combine(B.sleeves(*_trades(spark, sf_dir))).withColumn("equity", F.round("equity", 3))


@query("b03_benchmark", f"{_TRADES} SELECT d, round(equity, 3) AS equity FROM bench")
def b03(spark, sf_dir):
    """Buying and holding the same symbols."""
    return B.combine(B.buy_and_hold(_lifted(spark, sf_dir))).withColumn("equity", F.round("equity", 3))


@query("a17_drawdown", f"{_TRADES} SELECT d, round(least(equity / greatest(max(equity) OVER (ORDER BY d), 100000.0) - 1, 0.0), 8) AS drawdown FROM bench")
def a17(spark, sf_dir):
    """Fall from the highest mark so far."""
    held = B.combine(B.buy_and_hold(_lifted(spark, sf_dir)))
    return B.drawdowns(held).select("d", F.round("drawdown", 8).alias("drawdown"))


_RETURNS = """, rs AS (SELECT d, equity / coalesce(lag(equity) OVER (ORDER BY d), 100000.0) - 1 AS r FROM equity), rb AS (SELECT d, equity / coalesce(lag(equity) OVER (ORDER BY d), 100000.0) - 1 AS r FROM bench)"""


@query("b05_returns", f"{_TRADES}{_RETURNS} SELECT d, round(r, 8) AS r FROM rb")
def b05(spark, sf_dir):
    """Daily returns of the benchmark."""
    return B.returns(B.combine(B.buy_and_hold(_lifted(spark, sf_dir)))).withColumn("r", F.round("r", 8))


@query(
    "b04_summary",
    f"{_TRADES}{_RETURNS} SELECT round((SELECT arg_max(equity, d) FROM equity) / 100000.0 - 1, 6) AS total_return, "
    "round((SELECT min(x) FROM (SELECT least(equity / greatest(max(equity) OVER (ORDER BY d), 100000.0) - 1, 0.0) AS x FROM equity)), 6) AS max_drawdown, "
    "round((SELECT avg(r) / stddev_samp(r) * sqrt(252) FROM rs), 6) AS sharpe, (SELECT count(*) FROM trades WHERE NOT is_open) AS n_trades, "
    "round((SELECT avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) FROM trades WHERE NOT is_open), 6) AS win_rate",
)
def b04(spark, sf_dir):
    """Headline figures of the book."""
    trades, bars = _trades(spark, sf_dir)
    s = B.summary(B.combine(B.sleeves(trades, bars)), trades)
    return s.select(*[F.round(c, 6).alias(c) if c != "n_trades" else c for c in s.columns])


@query(
    "a18_regression",
    f"{_TRADES}{_RETURNS} SELECT count(*) AS n, round(regr_intercept(y, x) * 252, 6) AS alpha, round(regr_slope(y, x), 6) AS beta, round(regr_r2(y, x), 6) AS r2, round(corr(y, x), 6) AS correlation, "
    "round(stddev_samp(y - x) * sqrt(252), 6) AS tracking_error, round(avg(y - x) / stddev_samp(y - x) * sqrt(252), 6) AS information_ratio FROM (SELECT rs.r AS y, rb.r AS x FROM rs JOIN rb USING (d))",
)
def a18(spark, sf_dir):
    """The book's returns regressed on the benchmark's."""
    held = B.combine(B.buy_and_hold(_lifted(spark, sf_dir)))
    r = B.regression(B.combine(B.sleeves(*_trades(spark, sf_dir))), held)
    return r.select("n", *[F.round(c, 6).alias(c) for c in r.columns if c != "n"])


_REPLAY = f"""{_TRADES}, ev AS (SELECT d, symbol, 'bar' AS event, 0 AS k, c AS value FROM px UNION ALL SELECT d, symbol, 'signal', 1, CAST(direction AS DOUBLE) FROM signals
 UNION ALL SELECT entry_d, symbol, 'fill', 2, entry_price FROM trades UNION ALL SELECT exit_d, symbol, 'fill', 2, exit_price FROM trades WHERE NOT is_open)"""


def _replay(spark, sf_dir):
    trades, bars = _trades(spark, sf_dir)
    kind = lambda df, name, k, value, d="d": df.select(F.col(d).alias("d"), "symbol", F.lit(name).alias("event"), F.lit(k).alias("k"), value.cast("double").alias("value"))
    return (
        kind(bars, "bar", 0, F.col("c"))
        .unionByName(kind(S.events(V.daily_bars(spark, sf_dir), "breakout"), "signal", 1, F.col("direction")))
        .unionByName(kind(trades, "fill", 2, F.col("entry_price"), "entry_d"))
        .unionByName(kind(trades.where("NOT is_open"), "fill", 2, F.col("exit_price"), "exit_d"))
    )


@query("rp01_replay_events", f"{_REPLAY} SELECT d, symbol, event, round(value, 6) AS value FROM ev ORDER BY d, k, symbol")
def rp01(spark, sf_dir):
    """Bars, signals and fills as one ordered stream."""
    return _replay(spark, sf_dir).orderBy("d", "k", "symbol").select("d", "symbol", "event", F.round("value", 6).alias("value"))


@query(
    "rp02_thinned",
    f"{_REPLAY}, busy AS (SELECT DISTINCT symbol, d FROM ev WHERE k > 0), nb AS (SELECT symbol, d, value, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM ev WHERE k = 0) "
    "SELECT nb.symbol, nb.d, nb.value FROM nb LEFT JOIN busy b ON nb.symbol = b.symbol AND nb.d = b.d WHERE (i - 1) % 10 = 0 OR b.d IS NOT NULL",
)
def rp02(spark, sf_dir):
    """Every tenth bar, and those of days with a signal or fill."""
    e = _replay(spark, sf_dir)
    day = Window.partitionBy("symbol", "d")
    marked = e.withColumn("busy", F.max("k").over(day) > 0).where("k = 0")
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("d"))
    return marked.withColumn("i", i).where("(i - 1) % 10 = 0 OR busy").select("symbol", "d", "value")


_ALLOC = f"""WITH {V.SQL_BARS_D}, m AS (SELECT symbol, date_trunc('month', d) AS month, max(d) AS d, avg(c) AS mean, stddev_pop(c) AS volatility, max(h) - min(l) AS span FROM bars_d GROUP BY ALL),
 sg AS (SELECT CAST(month AS DATE) AS d, symbol, CASE WHEN mean > 250000 THEN 1 ELSE -1 END AS direction, round(least(span / 600000, 1.0), 6) AS score, CASE WHEN volatility > 0 THEN volatility END AS volatility FROM m)"""


def _allocation_signals(spark, sf_dir):
    m = V.daily_bars(spark, sf_dir).groupBy("symbol", F.date_trunc("month", "d").cast("date").alias("d")).agg(
        F.avg("c").alias("mean"), F.stddev_pop("c").alias("volatility"), (F.max("h") - F.min("l")).alias("span")
    )
    return m.select(
        "d",
        "symbol",
        F.when(F.col("mean") > 250000, 1).otherwise(-1).alias("direction"),
        F.round(F.least(F.col("span") / 600000, F.lit(1.0)), 6).alias("score"),
        F.when(F.col("volatility") > 0, F.col("volatility")).alias("volatility"),
    )


def _alloc_sql(raw: str, extra: str, top: int) -> str:
    """The capped split by repeated pinning, as the definition has it (four rounds are enough for four names)."""
    rounds = "".join(
        f""", p{i} AS (SELECT *, CASE WHEN pin THEN false WHEN raw > 0 THEN left_ * raw / sum(CASE WHEN pin THEN 0 ELSE raw END) OVER (PARTITION BY d) > 0.35 ELSE false END AS new
 FROM (SELECT *, greatest(1.0 - 0.35 * sum(CAST(pin AS INT)) OVER (PARTITION BY d), 0) AS left_ FROM q{i})), q{i + 1} AS (SELECT d, symbol, direction, raw, pin OR new AS pin FROM p{i})"""
        for i in range(5)
    )
    return f"""{_ALLOC}, j AS (SELECT *, CASE WHEN score IS NULL OR score <= 0 OR score > 1 THEN 'invalid_score' WHEN score < 0.2 THEN 'min_score' {extra} END AS why FROM sg),
 k AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY d ORDER BY why IS NOT NULL, score DESC, symbol) > {top} THEN 'max_positions' ELSE why END AS excluded FROM j),
 q0 AS (SELECT d, symbol, direction, {raw} AS raw, false AS pin FROM k WHERE excluded IS NULL){rounds}
 SELECT d, symbol, round(direction * CASE WHEN pin THEN 0.35 ELSE greatest(1.0 - 0.35 * sum(CAST(pin AS INT)) OVER (PARTITION BY d), 0) * raw / sum(CASE WHEN pin THEN 0 ELSE raw END) OVER (PARTITION BY d) END, 8) AS weight, CAST(NULL AS VARCHAR) AS excluded FROM q5
 UNION ALL SELECT d, symbol, NULL, excluded FROM k WHERE excluded IS NOT NULL"""


_ALLOCATIONS = {
    "e15_equal_active": ("equal_active", _alloc_sql("1.0", "", 4)),
    "e15_signal_strength": ("signal_strength", _alloc_sql("score", "", 4)),
    "e16_inverse_volatility_capped": ("signal_inverse_volatility", _alloc_sql("score / volatility", "WHEN volatility IS NULL THEN 'no_volatility'", 4)),
}
for _name, (_mode, _text) in _ALLOCATIONS.items():
    QUERIES[_name] = lambda spark, sf_dir, m=_mode: A.target_weights(_allocation_signals(spark, sf_dir), m, 1.0, 0.2, 4, 0.35).withColumn("weight", F.round("weight", 8))
    ORACLES[_name] = _text


@query(
    "e17_rebalance",
    f"""{_ALLOC}, t AS (SELECT d, symbol, CAST(direction * 0.2 AS DOUBLE) AS weight FROM sg WHERE score >= 0.5), hd AS (SELECT d, symbol, CAST(direction * 0.15 AS DOUBLE) AS held FROM sg WHERE score < 0.9),
 bo AS (SELECT d, symbol, coalesce(weight, 0.0) AS w, coalesce(held, 0.0) AS h FROM t FULL JOIN hd USING (d, symbol)), mv AS (SELECT d, symbol, w - h AS delta, w = 0 AND h <> 0 AS closing FROM bo),
 wa AS (SELECT * FROM mv WHERE (closing OR abs(delta) >= 0.1) AND delta <> 0), sc AS (SELECT *, sum(CASE WHEN closing THEN abs(delta) ELSE 0 END) OVER (PARTITION BY d) AS must, sum(CASE WHEN closing THEN 0 ELSE abs(delta) END) OVER (PARTITION BY d) AS free FROM wa)
 SELECT d, symbol, round(CASE WHEN closing THEN delta WHEN free > 0 THEN delta * least(1.0, greatest(0.0, 0.4 - must) / free) ELSE delta END, 8) AS delta, closing FROM sc""",
)
def e17(spark, sf_dir):
    """Trades toward targets, above a threshold and within a turnover."""
    s = _allocation_signals(spark, sf_dir)
    targets = s.where("score >= 0.5").select("d", "symbol", (F.col("direction") * 0.2).alias("weight"))
    held = s.where("score < 0.9").select("d", "symbol", (F.col("direction") * 0.15).alias("held"))
    return A.rebalance(targets, held, 0.1, 0.4).withColumn("delta", F.round("delta", 8))


@query("e18_weekly_schedule", f"WITH {V.SQL_BARS_D} SELECT symbol, d, date_trunc('week', d) IS DISTINCT FROM lag(date_trunc('week', d)) OVER (PARTITION BY symbol ORDER BY d) AS due FROM bars_d")
def e18(spark, sf_dir):
    """The first trading day of each ISO week."""
    return A.schedule(V.daily_bars(spark, sf_dir).select("symbol", "d"), "weekly")


RUNS = {
    "plain": X.Execution(participation=None),
    "costly": X.Execution(participation=None, commission_bps=5, slippage_bps=10, timing="next_open", sizing="fixed_fraction", sizing_value=0.2, max_positions=3),
    "protected": X.Execution(participation=None, sizing="volatility_target", sizing_value=0.1, stop_pct=0.3, trail_pct=0.4, target_pct=0.5, max_days=40, cooldown=3),
    "two_sided": X.Execution(participation=None, sizing="fixed_notional", sizing_value=10_000, shorts=True, borrow_bps=50, timing="next_typical", stop_atr=2.0),
}


def _simulated(spark, sf_dir):
    lifted = V.daily_bars(spark, sf_dir).select("symbol", "d", *[(F.col(x) + LIFT).alias(x) for x in "ohlc"], "v")
    decisions = compose(V.daily_bars(spark, sf_dir), TEMPLATES["channel"])
    return X.simulate(X.prepared(lifted, decisions), RUNS)


def _simulation(spark, sf_dir):
    """Every event of four runs over one strategy."""
    return _simulated(spark, sf_dir)


def _reasons(spark, sf_dir):
    """Exit reasons and results of the four runs."""
    return X.exit_reasons(_simulated(spark, sf_dir)).withColumn("pnl", F.round("pnl", 4))


def _costs(spark, sf_dir):
    """Costs of the four runs."""
    return X.costs(_simulated(spark, sf_dir)).withColumn("commission", F.round("commission", 4)).withColumn("traded", F.round("traded", 4))


QUERIES |= {"e21_simulate": _simulation, "a13_exit_reasons": _reasons, "a14_costs": _costs}
