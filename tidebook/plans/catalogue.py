"""All market queries and their SQL, by name."""

from __future__ import annotations

from tidebook.plans import books, flows, indicators, pointintime, relational, rules, screens, streams

FAMILIES = (indicators, relational, rules, pointintime, screens, books, streams, flows)


def queries() -> dict:
    """Name to a function of (spark, sf_dir)."""
    return {name: run for family in FAMILIES for name, run in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
