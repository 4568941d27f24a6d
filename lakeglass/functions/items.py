"""The standard items of an annual report: code, title, order."""

from __future__ import annotations

import csv
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def standard_items() -> dict[str, str]:
    with (Path(__file__).parent / "items.csv").open(encoding="utf-8") as f:
        rows = {r["code"]: r["title"] for r in csv.DictReader(f)}
    return dict(sorted(rows.items(), key=lambda r: (int(re.match(r"\d+", r[0])[0]), r[0])))


def standard_title(code: Column) -> Column:
    pairs = [F.lit(x) for kv in standard_items().items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("Unknown"))


def item_order(code: Column) -> tuple[Column, Column]:
    """Sort keys: 1 < 1A < 2 < 10."""
    return F.regexp_extract(code, r"\d+", 0).cast("int"), F.regexp_extract(code, r"[A-Z]+$", 0)
