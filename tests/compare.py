"""Comparison of a DataFrame with the result of a DuckDB query, columns by name and rows in any order."""

from __future__ import annotations

import datetime
import math


def _plain(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(df) -> tuple[list[str], list[tuple[str, ...]]]:
    """Sorted column names and sorted rows of a DataFrame."""
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())


def rows_of_sql(con, text: str) -> tuple[list[str], list[tuple[str, ...]]]:
    """The same of a DuckDB query."""
    result = con.execute(text)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def assert_same(df, con, text: str) -> None:
    """Equal columns, equal number of rows, equal values."""
    columns, rows = rows_of(df)
    other_columns, other_rows = rows_of_sql(con, text)
    assert columns == other_columns
    assert len(rows) == len(other_rows)
    unlike = [(a, b) for a, b in zip(rows, other_rows, strict=True) if a != b]
    assert not unlike, unlike[:3]
