"""Every operator as a query over the test tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str]]:
    from tabloom.queries import cleaning, generation, profiling, scoring, texts

    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for module in (profiling, cleaning, generation, scoring, texts):
        queries.update(module.BOOK.queries)
        oracles.update(module.BOOK.oracles)
    return queries, oracles
