"""Every registered query with its DuckDB SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.sources.tables import table

#: Modules of this package that register queries.
FAMILIES = ("temporal", "prepare", "profile", "compare", "text", "research", "runs", "integrity", "reads", "sources", "streams")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir); ``sql``: the same rows in DuckDB, with tables as {name}."""

    def add(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = duck(sql)
        return f

    return add


def duck(text: str) -> str:
    """A text with tables as {name} for DuckDB."""
    return re.sub(r"\{([a-z]\w*)\}", r"\1", text)


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a plain SQL text, which both engines understand, over tables as {name}."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{([a-z]\w*)\}", text))})


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"quillspan.plans.{family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
