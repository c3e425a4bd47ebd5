"""Strategies: decisions and evidence against a plain walk over events, and one pass for all of them."""

from __future__ import annotations

from collections import defaultdict

import pytest

from tidebook.functions import rules as S
from tidebook.plans.strategy import TEMPLATES, Component, Strategy, compose, compose_all, namespaces
from tidebook.sources import views as V

PARTS = (
    Component("sma_crossover", "entry"),
    Component("roc_momentum", "entry", params={"n": 6}),
    Component("breakout", "entry", 2.0, invert=True),
    Component("volume_spike", "filter"),
    Component("roc_momentum", "exit"),
    Component("breakout", "exit"),
)


def walk(days, events, s):
    """Decisions of one symbol, day by day: what fired within the window, who agrees, who is gated."""
    found, last = [], {}
    under = namespaces(s)
    for i, d in enumerate(days):
        for k, c in enumerate(s.components):
            for direction, trigger in events[k].get(d, ()):
                last[k, -direction if c.invert else direction] = (i, trigger)
        live = {key: t for key, (at, t) in last.items() if i - at < s.window}
        of = lambda role, side: [k for k, c in enumerate(s.components) if c.role == role and (k, side) in live]

        def carried(role, side):
            own = [k for k, c in enumerate(s.components) if c.role == role]
            yes = of(role, side)
            logic, least = (s.entry_logic, s.entry_threshold) if role == "entry" else (s.exit_logic, s.exit_threshold)
            weight = sum(s.components[k].weight for k in yes)
            return bool(yes) and {"all": len(yes) == len(own), "any": True, "majority": 2 * len(yes) > len(own), "weighted": weight >= least}[logic]

        filters = [k for k, c in enumerate(s.components) if c.role == "filter"]
        clear = not (carried("entry", 1) and carried("entry", -1)) and all((k, 1) in live for k in filters)
        for side, name in ((1, "bullish"), (-1, "bearish")):
            enters, exits = carried("entry", side) and clear, carried("exit", side)
            if not (enters or exits):
                continue
            members = (of("entry", side) if enters else []) + (of("exit", side) if exits else [])
            evidence = {f"{under[k]}.trigger": live[k, side] for k in members}
            evidence |= {f"{under[k]}.trigger": live[k, 1] for k in filters if (k, 1) in live}
            kind = "both" if enters and exits else "entry" if enters else "exit"
            found.append((d, kind, name, evidence, [under[k] for k in members], s.entry_logic if enters else s.exit_logic))
    return found


@pytest.mark.parametrize("logic", ["all", "any", "majority", "weighted"])
def test_decisions_and_evidence_equal_a_walk(spark, middle, logic):
    s = Strategy("walked", PARTS, logic, window=6, entry_threshold=2.0)
    bars = V.daily_bars(spark, middle).where("symbol IN ('1-URGENT', '5-LOW') AND d < DATE'1996-06-01'").persist()
    events = defaultdict(lambda: [defaultdict(list) for _ in PARTS])
    for k, c in enumerate(PARTS):
        for r in S.events(bars, c.rule, **c.params).collect():
            events[r.symbol][k][r.d].append((r.direction, r.trigger))
    want = []
    for symbol in ("1-URGENT", "5-LOW"):
        days = sorted(r.d for r in bars.where(bars.symbol == symbol).select("d").collect())
        want += [(symbol, *x) for x in walk(days, events[symbol], s)]
    got = compose(bars, s, evidence=True).drop("score").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 50


def test_names_of_evidence():
    assert namespaces(Strategy("x", PARTS)) == ["sma_crossover", "roc_momentum#1", "breakout", "volume_spike", "roc_momentum#4", "breakout"]
    pinned = Component("roc_momentum", "filter", params={"n": 12})  # the default, said aloud
    assert namespaces(Strategy("y", (Component("roc_momentum", "entry"), pinned))) == ["roc_momentum", "roc_momentum"]


def test_all_templates_share_one_pass(spark, small):
    found = compose_all(V.daily_bars(spark, small), list(TEMPLATES.values()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(TEMPLATES) == 12
    assert plan.count("FileScan") == 1 and plan.count("FlatMapGroupsInArrow") == 1
    # bars, their series, and the series again behind the recurrences
    assert plan.count("Exchange hashpartitioning") == 3


def test_columns_of_all_rules_equal_their_events(spark, small):
    bars = V.daily_bars(spark, small).persist()
    names = sorted(S.RULES)
    wide = S.fired(bars, [(n, {}) for n in names]).persist()
    for k, n in enumerate(names):
        got = wide.where(f"dir{k} IS NOT NULL").select("symbol", "d", f"dir{k}", f"trig{k}").collect()
        want = S.events(bars, n).select("symbol", "d", "direction", "trigger").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str), n


def test_without_strategies(spark, small):
    with pytest.raises(ValueError, match="no strategy"):
        compose_all(V.daily_bars(spark, small), [])
