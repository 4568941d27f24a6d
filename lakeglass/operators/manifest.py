"""The manifest of a corpus, derived from its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeglass.functions.text import col

TIERS = ("section_aware", "hybrid_section_aware", "fixed_size")

#: Why filings of a company are hard, by company.
MODES = {
    "non_standard_format": ("C", "INTC", "MS"),
    "incorporation_by_reference": ("WFC", "IBM"),
    "dominant_section_parser_failure": ("USB", "JPM"),
    "parser_limitation_item7": ("BAC", "MSFT"),
    "large_item8_legit": ("PRU", "MET"),
}


def tier_order(method: str | Column) -> Column:
    m = col(method)
    out = F.when(m == TIERS[0], 0)
    for i, t in enumerate(TIERS[1:], 1):
        out = out.when(m == t, i)
    return out.otherwise(9)


def failure_mode(ticker: str | Column, method: str | Column, modes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """none for filings with all sections, unless their company is one whose large section is legitimate; else by company, or uncharacterized."""
    modes = modes or MODES
    t, known = col(ticker), F.lit("uncharacterized")
    for mode, names in modes.items():
        known = F.when(t.isin(*names), mode).otherwise(known)
    shown = t.isin(*modes.get("large_item8_legit", ())) if modes.get("large_item8_legit") else F.lit(False)
    return F.when((col(method) == TIERS[0]) & ~F.coalesce(shown, F.lit(False)), "none").otherwise(known)


def filing_year(accession: str | Column) -> Column:
    """2000 + the middle field of the accession if it is two digits, else unknown. Two other characters are unknown too, where the reference stops with an error."""
    part = F.get(F.split(col(accession), "-"), F.lit(1))
    return F.when(part.rlike(r"^[0-9]{2}$"), (F.try_to_number(part, F.lit("99")).cast("int") + 2000).cast("string")).otherwise("unknown")


def manifest(stats: DataFrame) -> DataFrame:
    """The sixteen columns, a row for each filing without an error."""
    good = stats.filter(F.coalesce(F.col("error"), F.lit("")) == "") if "error" in stats.columns else stats
    return good.select(
        F.concat_ws("_", "ticker", "accession").alias("filing_id"), "ticker", "filing_type", F.col("accession").alias("accession_number"), filing_year("accession").alias("filing_year"),
        F.col("method_used").alias("chunking_method"), failure_mode("ticker", "method_used").alias("failure_mode"), "sections_detected", "chunks_produced", "total_chars", "captured_ratio",
        "largest_section_item", "largest_section_ratio", "item_7_chars", "quality_check_passed", "quality_check_reason",
    )


def ordered(manifest_: DataFrame) -> DataFrame:
    return manifest_.orderBy(tier_order("chunking_method"), "ticker", "accession_number")


def method_counts(manifest_: DataFrame) -> DataFrame:
    return manifest_.groupBy("chunking_method").agg(F.count("*").alias("n")).orderBy("chunking_method")


def failure_counts(manifest_: DataFrame) -> DataFrame:
    return manifest_.groupBy("failure_mode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failure_mode")
