"""All named queries of the engine, with the SQL that says what each returns."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

MODULES = ("retrieval", "documents", "evaluation", "reports")


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"lakeglass.plans.{name}"), attribute)
        if both := found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        found |= part
    return found


def _wide(query: Callable) -> Callable:
    """The query with its whole numbers as long, as SQL counts them."""

    @wraps(query)
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.select(*(F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes))

    return run


def queries() -> dict[str, Callable]:
    return {k: _wide(q) for k, q in _merged("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
