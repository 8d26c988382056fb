"""All queries outside the language-model subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hindcast.plans import evidence, experiments, known, files, ordered, questions, reports, retrieval, scoring, upkeep

MODULES = (retrieval, scoring, questions, ordered, upkeep, reports, experiments, evidence, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": known.p2_found}
    for module in MODULES:
        out |= {name: query for name, (query, _) in module.QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {"p2_found": known.P2_FOUND_SQL}
    for module in MODULES:
        out |= {name: sql for name, (_, sql) in module.QUERIES.items() if sql}
    return out
