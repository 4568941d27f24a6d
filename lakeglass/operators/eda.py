"""Reports over a manifest. All are generic in their columns: group, value, flag.

Exact medians hold a count for each distinct value of a group: right for manifests (a row a filing), not for logs.
Pivots take their columns as a list, so that none needs a job to find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.functions.text import col

TECH = tuple("AAPL ACN ADBE AMAT AMD AMZN ANET AVGO CDNS CRM CSCO GOOGL IBM INTC INTU KLAC LRCX META MSFT MU NOW NVDA ORCL PANW QCOM SNPS TXN".split())
FINANCIAL = tuple("AIG ALL AON APO AXP BAC BLK BRK-B BX C CB CME COF GS ICE JPM KKR MA MCO MET MS PNC PRU SCHW SPGI TFC TRV USB V WFC WTW".split())
LABELED = ("section_aware", "hybrid_section_aware")


def sector(ticker: str | Column, tech: tuple[str, ...] = TECH, financial: tuple[str, ...] = FINANCIAL) -> Column:
    t = col(ticker)
    return F.when(t.isin(*tech), "tech").when(t.isin(*financial), "financial").otherwise("other")


def uncovered(df: DataFrame, sector_column: str = "sector", key: str = "ticker") -> DataFrame:
    """The keys without a sector; there should be none."""
    return df.filter(F.coalesce(F.col(sector_column), F.lit("other")) == "other").select(key).distinct()


def assert_covered(df: DataFrame, sector_column: str = "sector", key: str = "ticker") -> None:
    rows = uncovered(df, sector_column, key).orderBy(key).limit(20).collect()
    if rows:
        raise AssertionError(f"without a sector: {[r[0] for r in rows]}")


def corpus_scalars(df: DataFrame, company: str, year: str, chunks: str, chars: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("filings"), F.count_distinct(company).alias("companies"), F.array_join(F.sort_array(F.collect_set(F.col(year).cast("string"))), ",").alias("years"),
        F.sum(chunks).cast("long").alias("chunks"), F.sum(chars).cast("long").alias("text_chars"), F.round(F.avg(chunks), 4).alias("mean_chunks"),
    )


def pivot_counts(df: DataFrame, row: str, column: str, values: tuple[str, ...], total: str | None = None) -> DataFrame:
    """Counts by row and column, 0 where there is none; total: the name of a column with the row's sum."""
    out = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    return out.withColumn(total, sum((F.col(f"`{v}`") for v in values), F.lit(0))) if total else out


def crosstab(df: DataFrame, row: str, column: str, values: tuple[str, ...]) -> DataFrame:
    return pivot_counts(df, row, column, values)


def row_percent(df: DataFrame, row: str, column: str, digits: int = 4) -> DataFrame:
    """(row, column, n, pct): shares within the row. The window is over counts, not over the table."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(row)), digits))


def grouped_stats(df: DataFrame, group: str, value: str, digits: int = 4) -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.median(value), digits).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def histogram(df: DataFrame, group: str, value: str, bins: int = 25) -> DataFrame:
    """(group, bin, n): equal bins between each group's own extremes; the last is closed. If all are equal, as with one value, the range is half below to half above."""
    ends = df.groupBy(group).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(group, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    rows = df.filter(F.col(value).isNotNull()).join(ends, group)
    at = F.least(F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return rows.groupBy(group, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def largest(df: DataFrame, value: str, k: int, order: str, smallest: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) value, ties as they come in order."""
    return df.orderBy(F.asc(value) if smallest else F.desc(value), order).limit(k)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def value_counts_with_total(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """(column, n, pct), and a row TOTAL."""
    n = df.groupBy(F.col(column).cast("string").alias(column)).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    shares = n.crossJoin(F.broadcast(total)).select(column, "n", F.round(100.0 * F.col("n") / F.col("all"), digits).alias("pct"))
    return shares.unionByName(total.select(F.lit("TOTAL").alias(column), F.col("all").alias("n"), F.lit(100.0).alias("pct")))


def conditional_share(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("n"), F.count("*").alias("of"), F.round(F.coalesce(F.try_divide(100.0 * F.count_if(condition), F.count("*")), F.lit(0.0)), 4).alias("pct"))


def of_interest(df: DataFrame, key: str, flagged: Column) -> DataFrame:
    """All rows whose key has a flagged row."""
    return df.join(df.filter(flagged).select(key).distinct(), key, "left_semi")


def pivot_first(df: DataFrame, row: str, column: str, values: tuple[str, ...], value: str, order: str, fill: str = "-") -> DataFrame:
    """The first value, in order, of each cell; fill where there is none."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.min_by(value, order)).na.fill(fill)


def relaxed_gate_rows(manifest: DataFrame) -> DataFrame:
    """Filings that carry the label of a legitimately large section."""
    return manifest.filter("failure_mode = 'large_item8_legit'").select("ticker", "filing_year", "largest_section_item", "largest_section_ratio")


def uncharacterized_rows(manifest: DataFrame) -> DataFrame:
    return manifest.filter("failure_mode = 'uncharacterized'").select("ticker", "filing_year", "chunking_method", "quality_check_reason")


def _by_item(chunks: DataFrame) -> DataFrame:
    """(item, chunks, tokens, companies) of labelled chunks, those whose label has no ' - ' under the item null."""
    label = F.col("section_label")
    item = F.when(F.contains(label, F.lit(" - ")), F.split_part(label, F.lit(" - "), F.lit(1)))
    rows = chunks.filter(F.col("chunking_method").isin(*LABELED)).select(item.alias("item"), F.coalesce("token_count", F.lit(0)).alias("t"), "ticker")
    return rows.groupBy("item").agg(F.count("*").alias("chunks"), F.sum("t").cast("long").alias("tokens"), F.count_distinct("ticker").alias("companies"))


def item_composition(chunks: DataFrame) -> DataFrame:
    """(item, chunks, tokens, companies) of labelled chunks; the item is the label up to ' - ', and labels without it don't count."""
    return _by_item(chunks).filter("item IS NOT NULL")


def labelled_totals(chunks: DataFrame) -> DataFrame:
    """(filings, chunks) with a label."""
    return chunks.filter(F.col("chunking_method").isin(*LABELED)).agg(F.count_distinct("accession").alias("filings"), F.count("*").alias("chunks"))


def top_items(chunks: DataFrame, companies: int, k: int = 10) -> DataFrame:
    """(item, chunks, share_pct, avg_tokens, coverage): by number of chunks, ties by item; shares are of all labelled chunks."""
    # The window is over the items, a few rows; the chunks are gone through once.
    rows = _by_item(chunks).withColumn("all", F.sum("chunks").over(Window.partitionBy(F.lit(1))))
    rows = rows.filter("item IS NOT NULL").orderBy(F.desc("chunks"), "item").limit(k)
    return rows.select("item", "chunks", F.round(100.0 * F.col("chunks") / F.col("all"), 4).alias("share_pct"), F.round(F.col("tokens") / F.col("chunks"), 4).alias("avg_tokens"), F.concat(F.col("companies").cast("string"), F.lit(f"/{companies}")).alias("coverage"))


def named_aggregates(df: DataFrame, group: str, means: dict[str, tuple[str, int]], flag: Column, flag_name: str) -> DataFrame:
    """(group, n, a rounded mean for each name, and the share of a flag)."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *(F.round(F.avg(c), d).alias(name) for name, (c, d) in means.items()), F.round(F.avg(F.when(flag, 1.0).otherwise(0.0)), 4).alias(flag_name))


RECIPES = {
    "labeled": "chunking_method IN ('section_aware', 'hybrid_section_aware')",
    "strict": "chunking_method = 'section_aware'",
    "item7_safe": "item_7_chars >= 5000",
    "strict_item7": "chunking_method = 'section_aware' AND item_7_chars >= 5000",
}


def recipe(manifest: DataFrame, name: str) -> DataFrame:
    return manifest.filter(RECIPES[name])
