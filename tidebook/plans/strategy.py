"""Strategy composition: several rules, their agreement within a window, gates and contradictions, as one plan.

Every rule that any component of any strategy runs is a column beside the bars, and one window per symbol tells when each
last fired either way.  What follows is row-wise: votes, scores, gates, kinds and evidence.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import rules as S

ROLES = ("entry", "exit", "filter")
LOGICS = ("all", "any", "majority", "weighted")
SIDES = ((1, "bullish"), (-1, "bearish"))


@dataclass(frozen=True)
class Component:
    """One rule of a strategy: its role, weight, parameters, and whether its direction is turned round."""

    rule: str
    role: str
    weight: float = 1.0
    invert: bool = False
    params: dict = field(default_factory=dict)

    def lookback(self) -> int:
        """Bars that the rule needs with these parameters."""
        own = S.RULES[self.rule]
        return own.lookback(**own.params(**self.params))


@dataclass(frozen=True)
class Strategy:
    """Components, how those of a role combine, and the bars within which they must agree."""

    name: str
    components: tuple[Component, ...]
    entry_logic: str = "all"
    exit_logic: str = "any"
    window: int = 1
    entry_threshold: float = 1.0
    exit_threshold: float = 1.0

    def problems(self) -> list[str]:
        """What is wrong with the strategy; empty if it can run."""
        found = []
        if not any(c.role == "entry" for c in self.components):
            found.append("no entry component")
        if self.window < 1:
            found.append("window below 1")
        found += [f"unknown logic {x}" for x in (self.entry_logic, self.exit_logic) if x not in LOGICS]
        for c in self.components:
            if c.rule not in S.RULES:
                found.append(f"unknown rule {c.rule}")
            elif c.role not in ROLES or c.role not in S.RULES[c.rule].roles:
                found.append(f"{c.rule} has no role {c.role}")
            if c.weight <= 0:
                found.append(f"{c.rule} has weight {c.weight}")
        return found

    def lookback(self) -> int:
        """Bars before the first decision."""
        return max(c.lookback() for c in self.components) + self.window - 1


def promoted(rule: str, **params) -> Strategy:
    """A single rule as a strategy: it enters and exits."""
    return Strategy(rule, (Component(rule, "entry", params=params), Component(rule, "exit", params=params)))


#: Ready-made strategies.
TEMPLATES: dict[str, Strategy] = {
    s.name: s
    for s in (
        Strategy("trend_follow", (Component("sma_crossover", "entry"), Component("adx_trend", "filter"), Component("sma_crossover", "exit")), window=5),
        Strategy("breakout_volume", (Component("breakout", "entry"), Component("volume_spike", "filter"), Component("donchian_breakout", "exit")), window=3),
        Strategy("mean_revert", (Component("rsi_threshold", "entry"), Component("zscore_reversion", "entry"), Component("roc_momentum", "exit")), "any", window=3),
        Strategy("momentum", (Component("roc_momentum", "entry"), Component("macd_crossover", "entry"), Component("macd_crossover", "exit")), window=5),
        Strategy("bands", (Component("bollinger_reversion", "entry"), Component("rsi_zone", "filter"), Component("bollinger_reversion", "exit")), window=3),
        Strategy("fade", (Component("breakout", "entry", invert=True), Component("sma_crossover", "exit")), window=2),
        Strategy("slope", (Component("macd_slope", "entry"), Component("ema_crossover", "exit")), window=2),
        Strategy("vote", (Component("sma_crossover", "entry"), Component("ema_crossover", "entry"), Component("macd_crossover", "entry"), Component("breakout", "exit")), "majority", window=5),
        Strategy("weighted_vote", (Component("breakout", "entry", 2.0), Component("roc_momentum", "entry"), Component("sma_crossover", "exit")), "weighted", window=5, entry_threshold=2.0),
        Strategy("oscillators", (Component("stochastic_threshold", "entry"), Component("rsi_threshold", "entry"), Component("zscore_reversion", "exit")), window=4),
        promoted("breakout"),
        replace(promoted("donchian_breakout"), name="channel"),
    )
}


def namespaces(strategy: Strategy) -> list[str]:
    """Under what name each component's evidence goes: its rule, and #i if the rule runs with other parameters as well.

    i is the index of the first component with the same rule and parameters.
    """
    kinds = [_kind(c) for c in strategy.components]
    several = {rule for rule, _ in kinds if len({k for k in kinds if k[0] == rule}) > 1}
    return [f"{k[0]}#{kinds.index(k)}" if k[0] in several else k[0] for k in kinds]


def _kind(c: Component) -> tuple:
    """What a component runs, whatever its role."""
    return c.rule, tuple(sorted(S.RULES[c.rule].params(**c.params).items()))


def _votes(strategy: Strategy, live: list[dict[int, Column]], role: str, side: int) -> tuple[Column, Column]:
    """Whether the role's components carry the side, and their share of its weight."""
    own = [(live[i][side], c.weight) for i, c in enumerate(strategy.components) if c.role == role]
    if not own:
        return F.lit(False), F.lit(0.0)
    logic, threshold = (strategy.entry_logic, strategy.entry_threshold) if role == "entry" else (strategy.exit_logic, strategy.exit_threshold)
    count = sum((F.when(a, 1).otherwise(0) for a, _ in own), F.lit(0))
    weight = sum((F.when(a, w).otherwise(0.0) for a, w in own), F.lit(0.0))
    carried = {"all": count == len(own), "any": count > 0, "majority": count * 2 > len(own), "weighted": (weight >= threshold) & (count > 0)}[logic]
    return carried, weight / sum(w for _, w in own)


def _evidence(strategy: Strategy, live: list[dict[int, Column]], last: list[dict[int, Column]], side: int, enters: Column, exits: Column) -> list[Column]:
    """The trigger of each component that speaks for a decision, by its namespace; their names; the logic that decided."""
    under, speak = namespaces(strategy), {"entry": enters, "exit": exits}
    values: dict[str, Column] = {}
    members = []
    for role in ("entry", "exit", "filter"):  # a later component's evidence replaces that of the same rule
        for i, c in enumerate(strategy.components):
            if c.role != role:
                continue
            there = live[i][1] if role == "filter" else live[i][side] & speak[role]
            value = F.when(there, F.struct(F.lit(f"{under[i]}.trigger").alias("key"), last[i][1 if role == "filter" else side]["trigger"].alias("value")))
            values[under[i]] = F.coalesce(value, values[under[i]]) if under[i] in values else value
            if role != "filter":
                members.append(F.when(there, F.lit(under[i])))
    entries = F.filter(F.array(*values.values()), lambda x: x.isNotNull())
    logic = F.when(enters, F.lit(strategy.entry_logic)).otherwise(F.lit(strategy.exit_logic))
    return [F.map_from_entries(entries).alias("evidence"), F.filter(F.array(*members), lambda x: x.isNotNull()).alias("components"), logic.alias("logic")]


def compose_all(bars: DataFrame, strategies: list[Strategy], evidence: bool = False) -> DataFrame:
    """Decisions (strategy, symbol, d, kind, direction, score) of several strategies, from one pass over the bars.

    Entries are gated, exits never; no view where both sides carry.  A rule that several components or strategies run is one
    column.  With ``evidence`` come the triggers behind a decision as a map, the components that carried it, and the logic.
    """
    found = [p for s in strategies for p in s.problems()]
    if found or not strategies:
        raise ValueError("; ".join(found) or "no strategy")
    kinds = list(dict.fromkeys(_kind(c) for s in strategies for c in s.components))
    w = Window.partitionBy("symbol").orderBy("d")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = S.fired(bars, [(rule, dict(params)) for rule, params in kinds]).withColumn("i", F.row_number().over(w))
    newest = {}
    for k in range(len(kinds)):
        for side in (1, -1):
            said = F.when(F.col(f"dir{k}") == side, F.struct("i", F.col(f"trig{k}").alias("trigger")))
            newest[k, side] = F.last(said, ignorenulls=True).over(run).alias(f"last{k}_{side % 3}")
    aged = line.select("symbol", "d", "i", *newest.values())
    sides = []
    for s in strategies:
        # an inverted component speaks for the other side
        last = [{side: F.col(f"last{kinds.index(_kind(c))}_{(-side if c.invert else side) % 3}") for side in (1, -1)} for c in s.components]
        live = [{side: F.coalesce(F.col("i") - x["i"] < s.window, F.lit(False)) for side, x in of.items()} for of in last]
        gate = F.lit(True)
        for k, c in enumerate(s.components):
            if c.role == "filter":
                gate &= live[k][1]
        (up, up_score), (down, down_score) = _votes(s, live, "entry", 1), _votes(s, live, "entry", -1)
        clear = ~(up & down) & gate
        for (side, name), carried, score in zip(SIDES, (up, down), (up_score, down_score), strict=True):
            enters, exits = carried & clear, _votes(s, live, "exit", side)[0]
            kind = F.when(enters & exits, "both").when(enters, "entry").when(exits, "exit")
            more = _evidence(s, live, last, side, enters, exits) if evidence else []
            sides.append(F.struct(F.lit(s.name).alias("strategy"), kind.alias("kind"), F.lit(name).alias("direction"), F.when(enters, score).alias("score"), *more))
    said = aged.select("symbol", "d", F.explode(F.filter(F.array(*sides), lambda x: x["kind"].isNotNull())).alias("x"))
    names = ["kind", "direction", "score", *(["evidence", "components", "logic"] if evidence else [])]
    return said.select("x.strategy", "symbol", "d", *[f"x.{c}" for c in names])


def compose(bars: DataFrame, strategy: Strategy, evidence: bool = False) -> DataFrame:
    """Decisions (symbol, d, kind, direction, score) of one strategy."""
    return compose_all(bars, [strategy], evidence).drop("strategy")
