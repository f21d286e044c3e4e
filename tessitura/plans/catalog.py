"""The registered queries, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessitura.plans import checks, corpus, ngram, punct, routing, scoring, text

MODULES = (text, corpus, scoring, routing, punct, ngram, checks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
