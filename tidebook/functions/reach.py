"""How far back a rule looks, from the tree of its expressions, held against the lookback that it declares.

A rule is a plan over the bars.  Its direction reaches back as far as the windows that it stands on, one above the other: a
lag by its offset, a frame by its rows, a recurrence by the values that seed it.  Only the plan is read; no job runs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import recurrences as R
from tidebook.functions import rules as S
from tidebook.functions import windows as W

_ROWS = re.compile(r"BETWEEN (?:-(\d+) FOLLOWING|(\d+) PRECEDING)")


class _StandIns(R.Gathering):
    """Answers every recurrence by a window of the rows that seed it, over the columns that it reads."""

    def _recur(self, df: DataFrame, specs) -> DataFrame:
        made: list[str] = []
        for name, _, source, n in specs:
            read = [source] if isinstance(source, str) else made
            rows = W.series().rowsBetween(1 - n, 0)
            df = df.withColumn(name, F.sum(sum((F.col(c) for c in read), F.lit(0.0))).over(rows))
            made = [*made, name]
        return df


def _seq(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


def _of(expression, known: dict[int, int]) -> int:
    """Rows before its own that an expression reads."""
    name = expression.getClass().getSimpleName()
    if name == "AttributeReference":
        return known.get(expression.exprId().id(), 0)
    below = max((_of(c, known) for c in _seq(expression.children())), default=0)
    if name != "WindowExpression":
        return below
    function = expression.windowFunction()
    if function.prettyName() == "lag":
        return below + abs(int(function.offset().toString()))
    frame = _ROWS.search(expression.windowSpec().frameSpecification().sql())
    return below + (int(frame.group(1) or frame.group(2)) if frame else 0)  # a frame from the first row on is there at once


def _columns(plan, known: dict[int, int]) -> None:
    for child in _seq(plan.children()):
        _columns(child, known)
    name = plan.getClass().getSimpleName()
    for e in _seq(plan.projectList()) if name == "Project" else _seq(plan.windowExpressions()) if name == "Window" else ():
        known[e.exprId().id()] = _of(e, known)


def rows_back(df: DataFrame, column: str) -> int:
    """Rows before its own that a column of a plan over one ordered series reads."""
    plan = df.select(column)._jdf.queryExecution().analyzed()
    known: dict[int, int] = {}
    _columns(plan, known)
    return max(known[e.exprId().id()] for e in _seq(plan.output()))


def needed(bars: DataFrame, name: str, **given) -> int:
    """Bars that a rule needs before it can say anything."""
    own = S.RULES[name]
    stand_ins = _StandIns(bars)
    with stand_ins.answers():
        df, direction, _ = own.build(bars, **own.params(**given))
        return rows_back(df.withColumn("direction_", direction), "direction_") + 1


def check(bars: DataFrame, name: str, **given) -> tuple[int, int]:
    """(declared, needed) bars of a rule; a declaration that is too short is refused."""
    declared, least = S.RULES[name].lookback(**S.RULES[name].params(**given)), needed(bars, name, **given)
    if declared < least:
        raise ValueError(f"rule {name} declares a lookback of {declared} bars and needs {least}")
    return declared, least
