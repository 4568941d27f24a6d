"""Queries of the manifest, of reports over it, and of the integrity of question pairs. Statistics are those of the filings made in plans.documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.operators import eda, fusion, manifest, validate
from lakeglass.plans import documents as D
from lakeglass.sources.tables import table

TICKERS = ("AAPL", "MSFT", "MET", "JPM", "IBM", "C", "BLK", "ZZZ")
YEARS = tuple(str(y) for y in range(2022, 2027))


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics without chunks: companies by the document's number, tiers by the gates."""
    names = F.array(*map(F.lit, TICKERS))
    return D.routed(spark, d).select(
        F.get(names, (F.col("doc_id") % len(TICKERS)).cast("int")).alias("ticker"), "filing_type", "accession", "total_chars", "sections_detected", "quality_check_passed", "quality_check_reason", "method_used",
        (F.col("doc_id") % 50).alias("chunks_produced"), "captured_ratio", "largest_section_item", "largest_section_ratio", "item_7_chars", F.lit("").alias("error"),
    )


def made(spark: SparkSession, d: str) -> DataFrame:
    return manifest.manifest(stats(spark, d)).withColumn("sector", eda.sector("ticker"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Question pairs as JSON lines, with a fault by the item's number."""
    i = F.col("item_id")
    ev = lambda chunk, ticker, quote: F.concat(F.lit('{"chunk_id": "'), chunk, F.lit('", "filing_accession": "A'), (i % 5).cast("string"), F.lit('"'), ticker, F.lit(', "quote": "'), quote, F.lit('"}'))
    chunk = F.concat(F.lit("c"), F.when(i % 11 == 3, i + 1_000_000).otherwise(i).cast("string"))
    ticker = F.when(i % 11 == 4, "").otherwise(F.concat(F.lit(', "ticker": "T'), F.when(i % 11 == 5, "X").otherwise((i % 3).cast("string")), F.lit('"')))
    quote = F.when(i % 11 == 6, "not in there").otherwise(F.translate(F.substring("text", 1, 20), "\n", " "))
    evidence = F.when(i % 11 == 7, "").otherwise(ev(chunk, ticker, quote))
    kind = F.when(i % 11 == 8, "riddle").otherwise("factual_lookup")
    number = F.when(i % 11 == 9, i - 1).otherwise(i)
    line = F.concat(F.lit('{"qa_id": "q'), number.cast("string"), F.lit('", "question": "?", "gold_answer": "!", "gold_evidence": ['), evidence, F.lit('], "question_type": "'), kind, F.lit('"'), F.when(i % 11 == 10, "").otherwise(', "difficulty": "easy"'), F.when(i % 13 == 0, "").otherwise("}"))
    return table(spark, d, "benchmark").select((i + 1).alias("line"), line.alias("value"))


def cited_chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, d, "benchmark").select(F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), F.concat(F.lit("T"), (i % 3).cast("string")).alias("ticker"), F.concat(F.lit("A"), F.when(i % 7 == 2, 9).otherwise(i % 5).cast("string")).alias("accession"), "text")


def violations(spark: SparkSession, d: str) -> DataFrame:
    return validate.violations(lines(spark, d), cited_chunks(spark, d))


def checked(*names: str):
    return lambda s, d: violations(s, d).filter(F.col("check").isin(*names)).select("line", "tag", "check")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


LANGS = ("de", "en", "es", "fr")
TIERS = manifest.TIERS
QUERIES = {
    "m1_failure_mode": lambda s, d: made(s, d).select("filing_id", "failure_mode"),
    "m2_filing_year": lambda s, d: made(s, d).select("filing_id", "filing_year"),
    "m4_tier_order": lambda s, d: made(s, d).select("filing_id", manifest.tier_order("chunking_method").alias("tier")),
    "m5_manifest": lambda s, d: manifest.manifest(stats(s, d)),
    "m6_method_counts": lambda s, d: manifest.method_counts(made(s, d)),
    "m6_failure_counts": lambda s, d: manifest.failure_counts(made(s, d)),
    "a1_sector": lambda s, d: made(s, d).select("filing_id", "sector"),
    "a2_uncovered": lambda s, d: eda.uncovered(made(s, d)),
    "a3_scalars": lambda s, d: eda.corpus_scalars(made(s, d), "ticker", "filing_year", "chunks_produced", "total_chars"),
    "a4_pivot_years": lambda s, d: eda.pivot_counts(made(s, d), "sector", "filing_year", YEARS),
    "a5_pivot_total": lambda s, d: eda.pivot_counts(docs(s, d), "source", "lang", LANGS, "TOTAL"),
    "a6_grouped_stats": lambda s, d: eda.grouped_stats(made(s, d), "sector", "total_chars"),
    "a6_item7_stats": lambda s, d: eda.grouped_stats(made(s, d), "chunking_method", "item_7_chars"),
    "a7_histogram": lambda s, d: eda.histogram(docs(s, d), "lang", "n_chars"),
    "a8_largest": lambda s, d: eda.largest(docs(s, d).select("doc_id", "n_chars"), "n_chars", 10, "doc_id"),
    "a8_smallest": lambda s, d: eda.largest(docs(s, d).select("doc_id", "n_chars"), "n_chars", 10, "doc_id", True),
    "a9_counts_total": lambda s, d: eda.value_counts_with_total(made(s, d), "chunking_method"),
    "a10_labelled_share": lambda s, d: eda.conditional_share(made(s, d), F.col("chunking_method").isin(*eda.LABELED)),
    "a11_crosstab": lambda s, d: eda.crosstab(made(s, d), "sector", "chunking_method", TIERS),
    "a11_failure_crosstab": lambda s, d: eda.crosstab(made(s, d), "failure_mode", "chunking_method", TIERS),
    "a12_row_percent": lambda s, d: eda.row_percent(made(s, d), "sector", "chunking_method"),
    "a13_value_counts": lambda s, d: eda.value_counts(docs(s, d), "source"),
    "a14_of_interest": lambda s, d: eda.of_interest(made(s, d), "ticker", F.col("failure_mode").isin("non_standard_format", "parser_limitation_item7")).select("filing_id"),
    "a15_pivot_first": lambda s, d: eda.pivot_first(made(s, d), "ticker", "filing_year", YEARS, "chunking_method", "accession_number"),
    "a16_relaxed_rows": lambda s, d: eda.relaxed_gate_rows(made(s, d)),
    "a16_uncharacterized": lambda s, d: eda.uncharacterized_rows(made(s, d)),
    "a17_item_composition": lambda s, d: eda.item_composition(D.chunks(s, d)),
    "a17_labelled_totals": lambda s, d: eda.labelled_totals(D.chunks(s, d)),
    "a18_top_items": lambda s, d: eda.top_items(D.chunks(s, d), 50),
    "a19_named_aggregates": lambda s, d: eda.named_aggregates(made(s, d), "sector", {"avg_chars": ("total_chars", 4), "avg_item7_chars": ("item_7_chars", 4), "avg_largest_section_ratio": ("largest_section_ratio", 3)}, F.col("chunking_method") == "section_aware", "section_aware_pct"),
    **{f"a20_recipe_{n}": (lambda s, d, n=n: eda.recipe(made(s, d), n).select("filing_id")) for n in eda.RECIPES},
    "r11_strategy_subset": lambda s, d: fusion.strategy_subset(D.chunks(s, d), "labeled").select("chunk_id"),
    "s7_chunk_defaults": lambda s, d: fusion.strategy_subset(D.chunks(s, d), "strict").select("chunk_id", F.lit(0).alias("char_start"), F.length("text").alias("char_end")),
    "v1_missing_fields": checked("missing fields", "invalid JSON"),
    "v2_duplicate_ids": checked("duplicate qa_id"),
    "v3_enums": checked("question_type", "difficulty"),
    "v4_empty_evidence": checked("empty evidence"),
    "v5_evidence_fields": checked("missing evidence fields"),
    "v6_schema_only": lambda s, d: validate.violations(lines(s, d), None).groupBy("check").agg(F.count("*").alias("n")),
    "v7_chunk_exists": checked("chunk not found"),
    "v8_agreement": checked("ticker mismatch", "accession mismatch"),
    "v9_quotes": checked("quote not found"),
    "v10_normalize": lambda s, d: docs(s, d).select("doc_id", validate.normalize_for_search(F.concat(F.lit(" “It’s” \n "), "text")).alias("text")),
    "v11_chunk_index": lambda s, d: validate.chunk_index(cited_chunks(s, d).unionByName(cited_chunks(s, d).withColumn("ticker", F.lit("A")))).select("chunk_id", "ticker", "accession"),
    "v12_summary": lambda s, d: validate.summary(lines(s, d), violations(s, d)),
}

_NAMES = "[" + ", ".join(f"'{t}'" for t in TICKERS) + "]"
MANIFEST = f"""{D.GATED}, st0 AS (SELECT ({_NAMES})[doc_id % {len(TICKERS)} + 1] AS ticker, filing_type, accession, total AS total_chars, n AS sections_detected, reason = 'all signals pass' AS quality_check_passed, reason AS quality_check_reason, method_used,
        doc_id % 50 AS chunks_produced, CASE WHEN n = 0 THEN 0 ELSE round(cov::DECIMAL(18, 12), 4) END::DOUBLE AS captured_ratio, CASE WHEN n = 0 THEN '' ELSE big END AS largest_section_item, CASE WHEN n = 0 THEN 0 ELSE round(ratio::DECIMAL(18, 12), 4) END::DOUBLE AS largest_section_ratio, seven0 AS item_7_chars FROM r),
    mf AS (SELECT ticker || '_' || accession AS filing_id, ticker, filing_type, accession AS accession_number, (2000 + split_part(accession, '-', 2)::INT)::VARCHAR AS filing_year, method_used AS chunking_method,
        CASE WHEN method_used = 'section_aware' AND ticker NOT IN ('MET', 'PRU') THEN 'none' ELSE CASE WHEN ticker IN ('C', 'INTC', 'MS') THEN 'non_standard_format' WHEN ticker IN ('IBM', 'WFC') THEN 'incorporation_by_reference'
            WHEN ticker IN ('JPM', 'USB') THEN 'dominant_section_parser_failure' WHEN ticker IN ('BAC', 'MSFT') THEN 'parser_limitation_item7' WHEN ticker IN ('MET', 'PRU') THEN 'large_item8_legit' ELSE 'uncharacterized' END END AS failure_mode,
        sections_detected, chunks_produced, total_chars, captured_ratio, largest_section_item, largest_section_ratio, item_7_chars, quality_check_passed, quality_check_reason FROM st0),
    ms AS (SELECT *, CASE WHEN ticker IN ('AAPL', 'MSFT', 'IBM') THEN 'tech' WHEN ticker IN ('MET', 'JPM', 'C', 'BLK') THEN 'financial' ELSE 'other' END AS sector FROM mf)"""


def man(body: str) -> str:
    return f"WITH {MANIFEST} {body}"


def _pivot(row: str, column: str, values: tuple[str, ...], source: str, extra: str = "") -> str:
    return f"SELECT {row}, " + ", ".join(f"count(*) FILTER ({column} = '{v}') AS \"{v}\"" for v in values) + f"{extra} FROM {source} GROUP BY {row}"


_STAT = lambda g, v: f"SELECT {g}, count({v}) AS n, round(avg({v}), 4) AS mean, round(median({v}), 4) AS median, min({v}) AS min, max({v}) AS max FROM ms GROUP BY {g}"
_LABELED = "('section_aware', 'hybrid_section_aware')"
_IC = f"ic AS (SELECT split_part(section_label, ' - ', 1) AS item, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, count(DISTINCT ticker) AS companies FROM ch WHERE chunking_method IN {_LABELED} AND contains(section_label, ' - ') GROUP BY 1)"
LINES = """q0 AS (SELECT item_id AS i, text FROM benchmark),
    q1 AS (SELECT *, 'c' || CASE WHEN i % 11 = 3 THEN i + 1000000 ELSE i END AS cid, CASE WHEN i % 11 = 5 THEN 'TX' ELSE 'T' || (i % 3) END AS tk, 'A' || (i % 5) AS acc, CASE WHEN i % 11 = 6 THEN 'not in there' ELSE replace(substr(text, 1, 20), chr(10), ' ') END AS quote,
        'q' || CASE WHEN i % 11 = 9 THEN i - 1 ELSE i END AS qa_id, i % 13 = 0 AS broken, i % 11 AS f FROM q0),
    pr AS (SELECT * FROM q1 WHERE NOT broken), wh AS (SELECT * FROM pr WHERE f <> 10), ev AS (SELECT *, qa_id || '.evidence[0]' AS tag FROM wh WHERE f <> 7), ok AS (SELECT * FROM ev WHERE f <> 4),
    cc AS (SELECT 'c' || item_id AS cid, 'T' || (item_id % 3) AS tk2, 'A' || CASE WHEN item_id % 7 = 2 THEN 9 ELSE item_id % 5 END AS acc2, text AS t2 FROM benchmark), jo AS (SELECT * FROM ok LEFT JOIN cc USING (cid)),
    vi AS (SELECT i + 1 AS line, '<line ' || (i + 1) || '>' AS tag, 'invalid JSON' AS "check", 'error' AS severity FROM q1 WHERE broken
        UNION ALL SELECT i + 1, qa_id, 'missing fields', 'error' FROM pr WHERE f = 10
        UNION ALL SELECT i + 1, qa_id, 'duplicate qa_id', 'error' FROM (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY i) AS n FROM wh) WHERE n > 1
        UNION ALL SELECT i + 1, qa_id, 'question_type', 'error' FROM wh WHERE f = 8
        UNION ALL SELECT i + 1, qa_id, 'empty evidence', 'error' FROM wh WHERE f = 7
        UNION ALL SELECT i + 1, tag, 'missing evidence fields', 'error' FROM ev WHERE f = 4
        UNION ALL SELECT i + 1, tag, 'chunk not found', 'error' FROM jo WHERE tk2 IS NULL
        UNION ALL SELECT i + 1, tag, 'ticker mismatch', 'error' FROM jo WHERE tk2 <> tk
        UNION ALL SELECT i + 1, tag, 'accession mismatch', 'error' FROM jo WHERE acc2 <> acc
        UNION ALL SELECT i + 1, tag, 'quote not found', 'warning' FROM jo WHERE tk2 IS NOT NULL AND NOT contains(trim(lower(regexp_replace(t2, '\\s+', ' ', 'g'))), trim(lower(regexp_replace(quote, '\\s+', ' ', 'g')))))"""


def val(*names: str) -> str:
    return f"""WITH {LINES} SELECT line, tag, "check" FROM vi WHERE "check" IN ({", ".join(f"'{n}'" for n in names)})"""


NORMALIZE = "SELECT doc_id, trim(lower(regexp_replace(translate(chr(32) || chr(34) || 'It' || chr(39) || 's' || chr(34) || ' ' || chr(10) || ' ' || text, chr(160), ' '), '\\s+', ' ', 'g'))) AS text FROM documents"

ORACLES = {
    "m1_failure_mode": man("SELECT filing_id, failure_mode FROM mf"), "m2_filing_year": man("SELECT filing_id, filing_year FROM mf"),
    "m4_tier_order": man("SELECT filing_id, CASE chunking_method WHEN 'section_aware' THEN 0 WHEN 'hybrid_section_aware' THEN 1 WHEN 'fixed_size' THEN 2 ELSE 9 END::BIGINT AS tier FROM mf"),
    "m5_manifest": man("SELECT * FROM mf"), "m6_method_counts": man("SELECT chunking_method, count(*) AS n FROM mf GROUP BY 1"), "m6_failure_counts": man("SELECT failure_mode, count(*) AS n FROM mf GROUP BY 1"),
    "a1_sector": man("SELECT filing_id, sector FROM ms"), "a2_uncovered": man("SELECT DISTINCT ticker FROM ms WHERE sector = 'other'"),
    "a3_scalars": man("SELECT count(*) AS filings, count(DISTINCT ticker) AS companies, array_to_string(list_sort(list(DISTINCT filing_year)), ',') AS years, sum(chunks_produced)::BIGINT AS chunks, sum(total_chars)::BIGINT AS text_chars, round(avg(chunks_produced), 4) AS mean_chunks FROM ms"),
    "a4_pivot_years": man(_pivot("sector", "filing_year", YEARS, "ms")), "a5_pivot_total": _pivot("source", "lang", LANGS, "documents", ", count(*) AS \"TOTAL\""),
    "a6_grouped_stats": man(_STAT("sector", "total_chars")), "a6_item7_stats": man(_STAT("chunking_method", "item_7_chars")),
    "a7_histogram": "WITH e AS (SELECT lang, min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents GROUP BY lang), e2 AS (SELECT lang, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM e) SELECT lang, least(floor((n_chars - lo) * 25 / (hi - lo)), 24)::BIGINT AS bin, count(*) AS n FROM documents JOIN e2 USING (lang) GROUP BY ALL",
    "a8_largest": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10", "a8_smallest": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 10",
    "a9_counts_total": man("SELECT chunking_method, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ms), 4)::DOUBLE AS pct FROM ms GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), 100.0::DOUBLE FROM ms"),
    "a10_labelled_share": man(f"SELECT count(*) FILTER (chunking_method IN {_LABELED}) AS n, count(*) AS of, round(100.0 * count(*) FILTER (chunking_method IN {_LABELED}) / count(*), 4)::DOUBLE AS pct FROM ms"),
    "a11_crosstab": man(_pivot("sector", "chunking_method", TIERS, "ms")), "a11_failure_crosstab": man(_pivot("failure_mode", "chunking_method", TIERS, "ms")),
    "a12_row_percent": man("SELECT sector, chunking_method, n, round(100.0 * n / sum(n) OVER (PARTITION BY sector), 4)::DOUBLE AS pct FROM (SELECT sector, chunking_method, count(*) AS n FROM ms GROUP BY ALL)"),
    "a13_value_counts": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "a14_of_interest": man("SELECT filing_id FROM ms WHERE ticker IN (SELECT ticker FROM ms WHERE failure_mode IN ('non_standard_format', 'parser_limitation_item7'))"),
    "a15_pivot_first": man("SELECT ticker, " + ", ".join(f"coalesce(arg_min(chunking_method, accession_number) FILTER (filing_year = '{y}'), '-') AS \"{y}\"" for y in YEARS) + " FROM ms GROUP BY ticker"),
    "a16_relaxed_rows": man("SELECT ticker, filing_year, largest_section_item, largest_section_ratio FROM ms WHERE failure_mode = 'large_item8_legit'"),
    "a16_uncharacterized": man("SELECT ticker, filing_year, chunking_method, quality_check_reason FROM ms WHERE failure_mode = 'uncharacterized'"),
    "a17_item_composition": f"WITH {D.CHUNKS}, {_IC} SELECT * FROM ic",
    "a17_labelled_totals": f"WITH {D.CHUNKS} SELECT count(DISTINCT accession) AS filings, count(*) AS chunks FROM ch WHERE chunking_method IN {_LABELED}",
    "a18_top_items": f"WITH {D.CHUNKS}, {_IC}, t AS (SELECT count(*) AS n FROM ch WHERE chunking_method IN {_LABELED}) SELECT item, chunks, round(100.0 * chunks / n, 4)::DOUBLE AS share_pct, round(tokens / chunks, 4) AS avg_tokens, companies || '/50' AS coverage FROM ic, t ORDER BY chunks DESC, item LIMIT 10",
    "a19_named_aggregates": man("SELECT sector, count(*) AS n, round(avg(total_chars), 4) AS avg_chars, round(avg(item_7_chars), 4) AS avg_item7_chars, round(avg(largest_section_ratio), 3) AS avg_largest_section_ratio, round(avg(CASE WHEN chunking_method = 'section_aware' THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS section_aware_pct FROM ms GROUP BY sector"),
    **{f"a20_recipe_{n}": man(f"SELECT filing_id FROM ms WHERE {w}") for n, w in eda.RECIPES.items()},
    "r11_strategy_subset": f"WITH {D.CHUNKS} SELECT chunk_id FROM ch WHERE chunking_method IN {_LABELED}",
    "s7_chunk_defaults": f"WITH {D.CHUNKS} SELECT chunk_id, 0::BIGINT AS char_start, length(text) AS char_end FROM ch WHERE chunking_method = 'section_aware'",
    "v1_missing_fields": val("missing fields", "invalid JSON"), "v2_duplicate_ids": val("duplicate qa_id"), "v3_enums": val("question_type", "difficulty"), "v4_empty_evidence": val("empty evidence"),
    "v5_evidence_fields": val("missing evidence fields"), "v7_chunk_exists": val("chunk not found"), "v8_agreement": val("ticker mismatch", "accession mismatch"), "v9_quotes": val("quote not found"),
    "v6_schema_only": f"""WITH {LINES} SELECT "check", count(*) AS n FROM vi WHERE "check" NOT IN ('chunk not found', 'ticker mismatch', 'accession mismatch', 'quote not found') GROUP BY 1""",
    "v10_normalize": NORMALIZE,
    "v11_chunk_index": "SELECT 'c' || item_id AS chunk_id, 'T' || (item_id % 3) AS ticker, 'A' || CASE WHEN item_id % 7 = 2 THEN 9 ELSE item_id % 5 END AS accession FROM benchmark",
    "v12_summary": f"""WITH {LINES} SELECT (SELECT count(*) FROM pr) AS n_pairs, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 1 ELSE 0 END::BIGINT AS exit_status FROM vi""",
}
