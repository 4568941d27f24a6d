"""Quality gates over a section map, and the tier of chunking that they route a filing to. Predicates only: one pass, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeglass.functions.text import let, once


@dataclass(frozen=True)
class Limits:
    coverage: float = 0.65
    dominance: float = 0.50
    item_7_chars: int = 5_000
    relaxed_items: tuple[str, ...] = ("8", "15")
    relaxed_dominance: float = 0.75
    relaxed_sections: int = 12
    partial_sections: int = 10
    partial_coverage: float = 0.50
    partial_items: tuple[str, ...] = ("1", "1A", "7", "8")
    partial_chars: int = 5_000


LIMITS = Limits()


def _parts(sections: Column, total: Column, body: Callable[[Column], Column]) -> Column:
    """body of a struct of what the gates look at, worked out once for a row."""
    size = F.transform(sections, lambda s: F.struct((s["end"] - s["start"]).alias("size"), (-s["start"]).alias("first"), s["item"].alias("item")))

    def parts(size: Column) -> Column:
        captured = F.aggregate(size, F.lit(0), lambda a, s: a + s["size"])
        largest = F.array_max(size)  # the largest, of equal ones the earliest
        seven = F.get(F.filter(size, lambda s: s["item"] == "7"), F.lit(0))["size"]
        made = {
            "none": (F.coalesce(total, F.lit(0)) == 0) | (F.coalesce(F.size(sections), F.lit(0)) <= 0),
            "coverage": F.try_divide(captured, total), "largest_item": largest["item"], "largest_ratio": F.try_divide(largest["size"], total),
            "item_7": seven, "item_7_chars": F.coalesce(seven, F.lit(0)),
        }
        return F.struct(*(x.alias(n) for n, x in made.items()))

    return let(let(size, parts), body)


def one_place(x: Column) -> Column:
    """A double from 0 below 2^20 with one decimal place, as C prints it: of the binary value, ties to even. Java's format rounds the shortest decimal, half up.

    Split at 2^-20, both parts times ten are exact, and so is what is compared with a half.
    """
    high = F.floor(x * (1 << 20)) / float(1 << 20)
    tenths = F.floor(10 * high)
    low, half = 10 * (x - high), 0.5 - (10 * high - tenths)
    tenths = tenths + F.when((low > half) | ((low == half) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _pct(x: Column) -> Column:
    return F.concat(one_place((100 * x).cast("double")), F.lit("%"))


def strict_v2(sections: Column, total: Column, limits: Limits = LIMITS) -> Column:
    """The reason, 'all signals pass' if it is reliable: no sections, low coverage, dominance unless it is allowed, small Item 7."""

    def reason(p: Column) -> Column:
        healthy = p["item_7_chars"] >= limits.item_7_chars
        allowed = p["largest_item"].isin(*limits.relaxed_items) & (p["largest_ratio"] <= limits.relaxed_dominance) & (F.size(sections) >= limits.relaxed_sections) & healthy
        return (
            F.when(p["none"], "no sections detected")
            .when(p["coverage"] < limits.coverage, F.concat(F.lit("low coverage ("), _pct(p["coverage"]), F.lit(")")))
            .when((p["largest_ratio"] > limits.dominance) & ~allowed, F.concat(F.lit("section dominance: Item "), p["largest_item"], F.lit(" ("), _pct(p["largest_ratio"]), F.lit(")")))
            .when(~healthy, F.concat(F.lit("Item 7 too small ("), F.format_number(p["item_7_chars"], 0), F.lit(" chars)")))
            .otherwise("all signals pass")
        )

    return _parts(sections, total, reason)


def strict_v1(sections: Column, total: Column, limits: Limits = LIMITS) -> Column:
    """The older gate: no allowed dominance, and a missing Item 7 is its own reason."""
    whole = lambda x: F.lit(f"{x:.0%}")

    def reason(p: Column) -> Column:
        return (
            F.when(p["none"], "no text or no sections detected")
            .when(p["coverage"] < limits.coverage, F.concat(F.lit("low coverage ("), _pct(p["coverage"]), F.lit(" < "), whole(limits.coverage), F.lit(")")))
            .when(p["largest_ratio"] > limits.dominance, F.concat(F.lit("single section dominates ("), _pct(p["largest_ratio"]), F.lit(" > "), whole(limits.dominance), F.lit(")")))
            .when(p["item_7"].isNull(), "Item 7 not detected")
            .when(p["item_7"] < limits.item_7_chars, F.concat(F.lit("Item 7 too small ("), F.format_number(p["item_7"], 0), F.lit(f" < {limits.item_7_chars:,} chars)")))
            .otherwise("all signals pass")
        )

    return _parts(sections, total, reason)


def partially_usable(sections: Column, total: Column, limits: Limits = LIMITS) -> Column:
    important = F.exists(sections, lambda s: s["item"].isin(*limits.partial_items) & (s["end"] - s["start"] >= limits.partial_chars))
    return F.coalesce(_parts(sections, total, lambda p: ~p["none"] & (F.size(sections) >= limits.partial_sections) & (p["coverage"] >= limits.partial_coverage) & important), F.lit(False))


def diagnostics(sections: Column, total: Column) -> list[Column]:
    shown = {
        "captured_ratio": lambda p: F.when(p["none"], 0.0).otherwise(F.round(p["coverage"], 4)), "largest_section_item": lambda p: F.when(p["none"], "").otherwise(p["largest_item"]),
        "largest_section_ratio": lambda p: F.when(p["none"], 0.0).otherwise(F.round(p["largest_ratio"], 4)), "item_7_chars": lambda p: F.when(p["none"], 0).otherwise(p["item_7_chars"]),
    }
    return [_parts(sections, total, x).alias(n) for n, x in shown.items()]


def routed(filings: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """filings(sections, total_chars, …) with the gates, the diagnostics and the tier of three."""
    s, t = F.col("sections"), F.col("total_chars")
    out = filings.withColumns({"quality_check_reason": once(strict_v2(s, t, limits)), "partially_usable": once(partially_usable(s, t, limits))})
    passed = F.col("quality_check_reason") == "all signals pass"
    method = F.when(passed, "section_aware").when(F.col("partially_usable"), "hybrid_section_aware").otherwise("fixed_size")
    return out.select("*", passed.alias("quality_check_passed"), method.alias("method_used"), F.size(s).alias("sections_detected"), *diagnostics(s, t))


def routed_v1(filings: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The older router of two tiers."""
    out = filings.withColumn("quality_check_reason", strict_v1(F.col("sections"), F.col("total_chars"), limits))
    return out.withColumn("method_used", F.when(F.col("quality_check_reason") == "all signals pass", "section_aware").otherwise("fixed_size"))
