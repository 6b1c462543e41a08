"""All queries of the library's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame by its name, and its SQL behind the given frames."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql is not None:
            body = dedent(sql).strip()
            head = ",\n".join(ctes)
            if body.upper().startswith("WITH ") and not body.upper().startswith("WITH RECURSIVE "):
                body = f"WITH RECURSIVE {head},\n{body[5:]}" if head else f"WITH RECURSIVE {body[5:]}"
            elif head:
                body = f"WITH RECURSIVE {head}\n{body}"
            ORACLE_SQL[function.__name__] = body
        return function

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over all documents: full text and vectors fused, decayed and ranked."""
    return QUERIES["r5_recall"](spark, sf_dir)


from lumenvault.plans import files, graphs, history, indexes, knowledge, retrieval, reports, segmentation, sequences, synopses, texts  # noqa: E402, F401  they register their queries
