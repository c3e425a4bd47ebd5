"""Registry of this subpackage's queries: opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import decontamination, language, neighbours, packing, periodic, pii, quality, secrets, sharding, simhash, spelling, urls, vector_packing

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Name to query, each over its whole table."""
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_secrets": secrets.op2_secrets,
        "op3_quality": quality.op3_quality,
        "op4_sharding": sharding.op4_sharding,
        "op5_neighbours": neighbours.op5_neighbours,
        "op6_language": language.op6_language,
        "op7_packing": packing.op7_packing,
        "op8_simhash": simhash.op8_simhash,
        "op9_urls": urls.op9_urls,
        "op10_pii": pii.op10_pii,
        "op11_periodic": periodic.op11_periodic,
        "op12_spelling": spelling.op12_spelling,
        "op13_vector_packing": vector_packing.op13_vector_packing,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the operator."""
    return {
        "op1_decontamination": decontamination.ORACLE_SQL,
        "op4_sharding": sharding.ORACLE_SQL,
        "op9_urls": urls.ORACLE_SQL,
        "op11_periodic": periodic.ORACLE_SQL,
        "op12_spelling": spelling.ORACLE_SQL,
    }
