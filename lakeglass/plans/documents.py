"""Queries of extraction, sections, gates and chunks.

The data set's documents have no item headers, so filings are made of them: before every second line stands a header,
its code by the line and the document. The SQL makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.functions import text as X
from lakeglass.functions.items import standard_items
from lakeglass.operators import chunking, gates, sections
from lakeglass.sources import filings as S
from lakeglass.sources.tables import table

CODES = tuple(standard_items())
LIMITS = gates.Limits(item_7_chars=150, relaxed_sections=4, partial_sections=3, partial_chars=100)
SIZE, OVERLAP = 64, 8


def filings(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ticker, filing_type, accession, text)."""
    codes = F.array(*map(F.lit, CODES))
    line = lambda x, i: F.concat(F.when(i % 2 == 0, F.concat(F.lit("Item "), F.get(codes, ((F.floor(i / 2) + F.col("doc_id")) % len(CODES)).cast("int")), F.lit(". "), F.substring(x, 1, 20), F.lit("\n"))).otherwise(""), x)
    made = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")).alias("ticker"), F.lit("10-K").alias("filing_type"),
        F.format_string("%010d-%02d-%06d", "doc_id", 22 + F.col("doc_id") % 5, F.col("doc_id")).alias("accession"), made.alias("text"),
    )


def sectioned(spark: SparkSession, d: str) -> DataFrame:
    return sections.with_sections(filings(spark, d))


def routed(spark: SparkSession, d: str) -> DataFrame:
    return gates.routed(sectioned(spark, d), LIMITS)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(routed(spark, d), SIZE, OVERLAP)


def stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.counted_stats(routed(spark, d), SIZE, OVERLAP)


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """Pages as submissions: an exhibit first, then the report, which every fifth page lacks."""
    ix = F.concat(F.lit('<XBRL><ix:header><p>us-gaap</p></ix:header><ix:nonNumeric name="a">'), "html", F.lit("</ix:nonNumeric></XBRL>"))
    kind = F.when(F.col("page_id") % 5 == 0, "8-K").otherwise("10-K")
    text = F.concat(F.lit("head\n<DOCUMENT>\n<TYPE>EX-21\n<TEXT>exhibit</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>"), kind, F.lit("\n<TEXT>\n"), ix, F.lit("\n</TEXT>\n</DOCUMENT>"))
    return table(spark, d, "pages").select("page_id", text.alias("submission"), ix.alias("ix"), "html")


def pages(columns):
    return lambda s, d: submissions(s, d).select("page_id", *columns())


QUERIES = {
    "x1_primary_document": pages(lambda: [X.primary_document("submission", "10-K").alias("text")]),
    "x2_html_v0": pages(lambda: [X.html_text_v0("html").alias("text")]),
    "x3_html_v1": pages(lambda: [X.html_text_v1("html").alias("text")]),
    "x4_html_v2": pages(lambda: [X.html_text_v2("ix").alias("text")]),
    "x5_contamination": pages(lambda: [X.xbrl_contaminated(X.html_text_v1("ix")).alias("v1"), X.xbrl_contaminated(X.html_text_v2("ix")).alias("v2")]),
    "x6_counts": lambda s, d: table(s, d, "documents").select("doc_id", X.char_count("text").alias("chars"), X.word_count("text").alias("words")),
    "x7_first_sentence": lambda s, d: table(s, d, "documents").select("doc_id", X.first_sentence("text").alias("preview")),
    "s3_decode": lambda s, d: table(s, d, "documents").select("doc_id", X.decode_text(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("0D0AFF0D41")))).alias("text")),
    "s4_largest_file": lambda s, d: S.largest_file(table(s, d, "pages").select((F.col("page_id") % 20).alias("accession"), F.concat(F.lit("f/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, ".HTML").otherwise(".txt")).alias("path"), F.length("html").alias("length"))),
    "s5_latest_submission": lambda s, d: S.latest_submission(filings(s, d)),
    "s8_stats_lines": lambda s, d: S.stats_lines(stats(s, d)),
    "s15_fetch_filing": lambda s, d: S.fetch_filing(table(s, d, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderstatus").alias("filing_type"), F.col("o_orderdate").alias("filing_date"), "o_orderkey"), "1-URGENT", "F", 1995).select("o_orderkey"),
    "s15_fetch_company_filings": lambda s, d: S.fetch_company_filings(table(s, d, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderstatus").alias("filing_type"), F.col("o_orderdate").cast("date").alias("filing_date"), "o_orderkey"), "2-HIGH", ["F", "P"], "1994-03-01", "1996-02-29").select("o_orderkey"),
    "s16_key_item_status": lambda s, d: sections.key_item_status(sectioned(s, d), least=60),
    "d1_headers": lambda s, d: filings(s, d).select("doc_id", F.explode(sections.headers("text")).alias("h")).select("doc_id", "h.item", "h.start", "h.title"),
    "d2_section_map": lambda s, d: sectioned(s, d).select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*"),
    "d4_item_order": lambda s, d: sectioned(s, d).select(F.explode("sections.item").alias("item")).distinct().select("item", F.regexp_extract("item", r"\d+", 0).cast("int").alias("number"), F.regexp_extract("item", "[A-Z]+$", 0).alias("suffix")),
    "d5_section_report": lambda s, d: sections.section_rows(sectioned(s, d)),
    "d5_section_totals": lambda s, d: sections.section_totals(sectioned(s, d)),
    "d6_top_sections": lambda s, d: sections.top_sections(sectioned(s, d)),
    "d7_section_keys": lambda s, d: sections.section_keys(sectioned(s, d)).withColumn("first_keys", F.array_join("first_keys", ",")),
    "g1_strict_gate": lambda s, d: sectioned(s, d).select("doc_id", gates.strict_v2(F.col("sections"), F.col("total_chars"), LIMITS).alias("reason")),
    "g2_strict_gate_v1": lambda s, d: sectioned(s, d).select("doc_id", gates.strict_v1(F.col("sections"), F.col("total_chars"), LIMITS).alias("reason")),
    "g3_partial_gate": lambda s, d: sectioned(s, d).select("doc_id", gates.partially_usable(F.col("sections"), F.col("total_chars"), LIMITS).alias("usable")),
    "g4_diagnostics": lambda s, d: sectioned(s, d).select("doc_id", *gates.diagnostics(F.col("sections"), F.col("total_chars"))),
    "g5_tier_router": lambda s, d: routed(s, d).select("doc_id", "method_used"),
    "g6_tier_router_v1": lambda s, d: gates.routed_v1(sectioned(s, d), LIMITS).select("doc_id", "method_used"),
    "g7_filing_stats": stats,
    "c1_tokenize": lambda s, d: table(s, d, "documents").select("doc_id", F.size(chunking.white_space_tokens("text")).alias("n"), chunking.join_tokens(chunking.white_space_tokens("text")).alias("text")),
    "c2_fixed_windows": lambda s, d: chunking.fixed_chunks(filings(s, d), SIZE, OVERLAP),
    "c3_section_windows": lambda s, d: chunking.section_chunks(routed(s, d), SIZE, OVERLAP),
    "c4_windows_v1": lambda s, d: chunking.fixed_chunks(filings(s, d), SIZE, OVERLAP, with_accession=False).unionByName(chunking.section_chunks(routed(s, d), SIZE, OVERLAP, with_accession=False)),
    "c5_chunk_summary": lambda s, d: chunking.chunk_summary(chunking.fixed_chunks(filings(s, d), SIZE, OVERLAP)),
    "c6_sample_chunks": lambda s, d: chunking.sample_chunks(filings(s, d), SIZE, OVERLAP),
    "c7_offset_windows": lambda s, d: chunking.fixed_chunks_with_offsets(table(s, d, "documents"), SIZE, OVERLAP),
    "c9_batch_summary": lambda s, d: chunking.batch_summary(stats(s, d)),
    "c10_method_summary": lambda s, d: gates.routed_v1(sectioned(s, d), LIMITS).groupBy("method_used").agg(F.count("*").alias("filings"), F.sum("total_chars").cast("long").alias("chars")),
}

# The same in SQL

RE = r"(?im)^\s*item\s+(\d{1,2}[a-c]?)\b\.?\s*(.*?)\s*$"
_CODES = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
_TITLES = " ".join(f"WHEN '{c}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for c, t in standard_items().items())


def title_sql(x: str) -> str:
    return f"CASE {x} {_TITLES} ELSE 'Unknown' END"


FILINGS = f"""f AS (SELECT doc_id, 'T' || (doc_id % 7) AS ticker, '10-K' AS filing_type, printf('%010d-%02d-%06d', doc_id, 22 + doc_id % 5, doc_id) AS accession,
        array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 2 = 0 THEN 'Item ' || ({_CODES})[((i - 1) // 2 + doc_id) % {len(CODES)} + 1] || '. ' || substr(x, 1, 20) || chr(10) ELSE '' END || x), chr(10)) AS text FROM documents)"""
HEADERS = rf"""{FILINGS},
    m AS (SELECT doc_id, text, regexp_split_to_array(text, '{RE}') AS g, regexp_extract_all(text, '{RE}') AS m, regexp_extract_all(text, '{RE}', 1) AS c, regexp_extract_all(text, '{RE}', 2) AS t FROM f),
    h AS (SELECT doc_id, text, i, upper(c[i]) AS item, t[i] AS title, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m))"""
SECTIONS = f"""{HEADERS},
    l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY i DESC) AS r FROM h),
    s AS (SELECT doc_id, text, item, start, lead(start, 1, length(text)) OVER (PARTITION BY doc_id ORDER BY start) AS "end", CASE WHEN title <> '' THEN title ELSE {title_sql("item")} END AS title FROM l WHERE r = 1)"""
GATED = f"""{SECTIONS},
    a AS (SELECT doc_id, count(*) AS n, sum("end" - start)::BIGINT AS captured, arg_max(item, ("end" - start) * 1000000 - start) AS big, max("end" - start) AS size, max("end" - start) FILTER (item = '7') AS seven,
          coalesce(bool_or(item IN ('1', '1A', '7', '8') AND "end" - start >= {LIMITS.partial_chars}), false) AS important FROM s GROUP BY doc_id),
    d AS (SELECT f.*, length(f.text) AS total, coalesce(n, 0) AS n, captured / length(f.text) AS cov, big, size / length(f.text) AS ratio, seven, coalesce(seven, 0) AS seven0, important FROM f LEFT JOIN a USING (doc_id)),
    e AS (SELECT *, CASE WHEN n = 0 OR total = 0 THEN 'no sections detected' WHEN cov < 0.65 THEN 'low coverage (' || printf('%.1f', 100 * cov) || '%)'
            WHEN ratio > 0.5 AND NOT (big IN ('8', '15') AND ratio <= 0.75 AND n >= {LIMITS.relaxed_sections} AND seven0 >= {LIMITS.item_7_chars}) THEN 'section dominance: Item ' || big || ' (' || printf('%.1f', 100 * ratio) || '%)'
            WHEN seven0 < {LIMITS.item_7_chars} THEN 'Item 7 too small (' || printf('%,d', seven0) || ' chars)' ELSE 'all signals pass' END AS reason,
          CASE WHEN n = 0 OR total = 0 THEN 'no text or no sections detected' WHEN cov < 0.65 THEN 'low coverage (' || printf('%.1f', 100 * cov) || '% < 65%)'
            WHEN ratio > 0.5 THEN 'single section dominates (' || printf('%.1f', 100 * ratio) || '% > 50%)' WHEN seven IS NULL THEN 'Item 7 not detected'
            WHEN seven < {LIMITS.item_7_chars} THEN 'Item 7 too small (' || printf('%,d', seven) || ' < {LIMITS.item_7_chars} chars)' ELSE 'all signals pass' END AS reason1,
          coalesce(n >= {LIMITS.partial_sections} AND cov >= 0.5 AND important, false) AS usable FROM d),
    r AS (SELECT *, CASE WHEN reason = 'all signals pass' THEN 'section_aware' WHEN usable THEN 'hybrid_section_aware' ELSE 'fixed_size' END AS method_used FROM e)"""


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda x: x <> '')"


STEP = SIZE - OVERLAP
FIXED = f"""(SELECT doc_id, ticker, filing_type, accession, i // {STEP} AS k, list_slice(tk, i + 1, i + {SIZE}) AS w FROM (SELECT *, unnest(range(0, len(tk), {STEP})) AS i FROM (SELECT *, {tokens_sql("text")} AS tk FROM f)))"""


def fixed_sql(source: str, accession: bool = True) -> str:
    return f"""SELECT ticker, filing_type, accession, ticker || '_' || {"accession || '_' ||" if accession else ""} 'fixed_' || printf('%04d', k) AS chunk_id, array_to_string(w, ' ') AS text, 'chunk_' || k AS section_label, 'fixed_size' AS chunking_method, len(w) AS token_count FROM {source}"""


SECTION_WINDOWS = f"""(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, i) - 1 AS k FROM (SELECT doc_id, item, start, i, list_slice(tk, i + 1, i + {SIZE}) AS w FROM (SELECT *, unnest(range(0, len(tk), {STEP})) AS i FROM (SELECT *, {tokens_sql('substr(text, start + 1, "end" - start)')} AS tk FROM s))))"""


def section_sql(accession: bool = True, where: str = "") -> str:
    return f"""SELECT ticker, filing_type, accession, ticker || '_' || {"accession || '_' ||" if accession else ""} 'item' || item || '_' || printf('%04d', k) AS chunk_id, array_to_string(w, ' ') AS text,
        'Item ' || item || ' - ' || {title_sql("item")} AS section_label, method_used AS chunking_method, len(w) AS token_count FROM {SECTION_WINDOWS} JOIN (SELECT doc_id, ticker, filing_type, accession, method_used FROM r) USING (doc_id) {where}"""


CHUNKS = f"""{GATED}, ch AS ({section_sql(where="WHERE method_used <> 'fixed_size'")} UNION ALL {fixed_sql(FIXED.replace("FROM f)", "FROM r WHERE method_used = 'fixed_size')"))})"""
STATS = f"""{CHUNKS}, cn AS (SELECT accession, count(*) AS chunks_produced FROM ch GROUP BY accession),
    st AS (SELECT ticker, filing_type, accession, total AS total_chars, n AS sections_detected, reason = 'all signals pass' AS quality_check_passed, reason AS quality_check_reason, method_used, coalesce(chunks_produced, 0) AS chunks_produced,
        CASE WHEN n = 0 THEN 0 ELSE round(cov::DECIMAL(18, 12), 4) END::DOUBLE AS captured_ratio, CASE WHEN n = 0 THEN '' ELSE big END AS largest_section_item, CASE WHEN n = 0 THEN 0 ELSE round(ratio::DECIMAL(18, 12), 4) END::DOUBLE AS largest_section_ratio, seven0 AS item_7_chars, '' AS error
        FROM r LEFT JOIN cn USING (accession))"""


def with_sql(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


_DEAD = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_IX = "|".join(rf"<ix:{n}\b[^>]*>.*?</ix:{n}\s*>" for n in ("hidden", "references", "resources", "header"))


def _html_sql(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '<c>', 'g'), '(?:<[^>]*>)+', chr(10), 'g'), '\A\n|\n\z', '', 'g')"
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", "\xa0"), ("#160", "\xa0"), ("copy", "©"), ("middot", "·"), ("mdash", "—"), ("ndash", "–"), ("rsquo", "’"), ("lsquo", "‘"), ("rdquo", "”"), ("ldquo", "“"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{mark}')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"


_V1 = lambda x: _html_sql(f"regexp_replace({x}, '{_DEAD}', '<c>', 'g')")
_V2 = lambda x: _V1(f"regexp_replace(regexp_replace({x}, '(?i)</?XBRL>', '', 'g'), '(?is){_IX}', '<c>', 'g')")
PAGES = """p AS (SELECT *, 'head' || chr(10) || '<DOCUMENT>' || chr(10) || '<TYPE>EX-21' || chr(10) || '<TEXT>exhibit</TEXT>' || chr(10) || '</DOCUMENT>' || chr(10) || '<DOCUMENT>' || chr(10) || '<TYPE>' || CASE WHEN page_id % 5 = 0 THEN '8-K' ELSE '10-K' END || chr(10) || '<TEXT>' || chr(10) || ix || chr(10) || '</TEXT>' || chr(10) || '</DOCUMENT>' AS submission
    FROM (SELECT page_id, html, '<XBRL><ix:header><p>us-gaap</p></ix:header><ix:nonNumeric name="a">' || html || '</ix:nonNumeric></XBRL>' AS ix FROM pages))"""
_FIRST = r"""SELECT doc_id, CASE WHEN len(l) < 2 THEN '(empty)' ELSE '"' || CASE WHEN length(x) > 80 THEN substr(x, 1, 79) || '…' ELSE x END || '"' END AS preview FROM
    (SELECT *, CASE WHEN q <> '' THEN q ELSE substr(b, 1, 80) END AS x FROM (SELECT *, regexp_extract(b, '^(.{20,}?[.!?])(?:\s|$)', 1) AS q FROM (SELECT *, array_to_string(l[2:], ' ') AS b FROM
    (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM ({source})))))"""
_SAMPLES = "SELECT accession, unnest(['first', 'middle', 'last']) AS place, unnest([0, n // 2, n - 1]) AS i FROM (SELECT accession, count(*) AS n FROM x GROUP BY accession)"

ORACLES = {
    "x1_primary_document": with_sql(PAGES, r"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE regexp_extract(string_split(submission, '<DOCUMENT>')[3], '(?s)<TEXT>\s*(.*?)\s*</TEXT>', 1) END AS text FROM p"),
    "x2_html_v0": with_sql(PAGES, f"SELECT page_id, {_html_sql('html')} AS text FROM p"),
    "x3_html_v1": with_sql(PAGES, f"SELECT page_id, {_V1('html')} AS text FROM p"),
    "x4_html_v2": with_sql(PAGES, f"SELECT page_id, {_V2('ix')} AS text FROM p"),
    "x5_contamination": with_sql(PAGES, f"SELECT page_id, contains(lower(substr({_V1('ix')}, 1, 5000)), 'us-gaap') AS v1, contains(lower(substr({_V2('ix')}, 1, 5000)), 'us-gaap') AS v2 FROM p"),
    "x6_counts": f"SELECT doc_id, length(text) AS chars, len({tokens_sql('text')}) AS words FROM documents",
    "x7_first_sentence": _FIRST.replace("{source}", "SELECT doc_id, text AS t FROM documents"),
    "s3_decode": "SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') || chr(10) || chr(10) || 'A' AS text FROM documents",
    "s4_largest_file": "SELECT accession, arg_max(path, (length(html), path)) AS path FROM (SELECT page_id % 20 AS accession, html, 'f/' || page_id || CASE page_id % 3 WHEN 1 THEN '.HTML' ELSE '.txt' END AS path FROM pages WHERE page_id % 3 <> 0) GROUP BY accession",
    "s5_latest_submission": with_sql(FILINGS, "SELECT ticker, filing_type, max(accession) AS accession FROM f GROUP BY ALL"),
    "s8_stats_lines": with_sql(STATS, """SELECT concat_ws(',', ticker, filing_type, accession, total_chars, sections_detected, quality_check_passed, replace(quality_check_reason, ',', ';'), method_used, chunks_produced, captured_ratio, largest_section_item, largest_section_ratio, item_7_chars, '') AS value FROM st"""),
    "s15_fetch_filing": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND year(o_orderdate) = 1995",
    "s15_fetch_company_filings": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus IN ('F', 'P') AND o_orderdate::DATE BETWEEN DATE '1994-03-01' AND DATE '1996-02-29'",
    "s16_key_item_status": with_sql(SECTIONS, """SELECT doc_id, item, CASE WHEN start IS NULL THEN 'MISSING' WHEN "end" - start < 60 THEN 'present' ELSE ("end" - start) || ' chars' END AS status FROM (SELECT doc_id, unnest(['1', '1A', '7', '8']) AS item FROM f) LEFT JOIN s USING (doc_id, item)"""),
    "d1_headers": with_sql(HEADERS, "SELECT doc_id, item, start, title FROM h"),
    "d2_section_map": with_sql(SECTIONS, 'SELECT doc_id, item, start, "end", title FROM s'),
    "d4_item_order": with_sql(SECTIONS, r"SELECT DISTINCT item, regexp_extract(item, '\d+')::BIGINT AS number, regexp_extract(item, '[A-Z]+$') AS suffix FROM s"),
    "d5_section_report": with_sql(SECTIONS, 'SELECT doc_id, item, title, chars, preview FROM (' + _FIRST.replace("SELECT doc_id, CASE WHEN len", "SELECT doc_id, item, title, chars, CASE WHEN len").replace("{source}", 'SELECT doc_id, item, title, "end" - start AS chars, substr(text, start + 1, "end" - start) AS t FROM s') + ")"),
    "d5_section_totals": with_sql(SECTIONS, 'SELECT f.doc_id, coalesce(sum("end" - start), 0)::BIGINT AS captured_chars, round(coalesce(sum("end" - start), 0) / length(f.text), 6) AS coverage, (length(f.text) - coalesce(sum("end" - start), 0))::BIGINT AS unassigned_chars FROM f LEFT JOIN s USING (doc_id) GROUP BY f.doc_id, f.text'),
    "d6_top_sections": with_sql(SECTIONS, 'SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY "end" - start DESC, start) AS rank, item, "end" - start AS chars FROM s) WHERE rank <= 5'),
    "d7_section_keys": with_sql(SECTIONS, "SELECT f.doc_id, count(item) AS n_sections, coalesce(array_to_string(list_sort(list(item) FILTER (item IS NOT NULL))[1:10], ','), '') AS first_keys FROM f LEFT JOIN s USING (doc_id) GROUP BY f.doc_id"),
    "g1_strict_gate": with_sql(GATED, "SELECT doc_id, reason FROM r"),
    "g2_strict_gate_v1": with_sql(GATED, "SELECT doc_id, reason1 AS reason FROM r"),
    "g3_partial_gate": with_sql(GATED, "SELECT doc_id, usable FROM r"),
    "g4_diagnostics": with_sql(GATED, "SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE round(cov::DECIMAL(18, 12), 4) END::DOUBLE AS captured_ratio, CASE WHEN n = 0 THEN '' ELSE big END AS largest_section_item, CASE WHEN n = 0 THEN 0 ELSE round(ratio::DECIMAL(18, 12), 4) END::DOUBLE AS largest_section_ratio, seven0 AS item_7_chars FROM r"),
    "g5_tier_router": with_sql(GATED, "SELECT doc_id, method_used FROM r"),
    "g6_tier_router_v1": with_sql(GATED, "SELECT doc_id, CASE WHEN reason1 = 'all signals pass' THEN 'section_aware' ELSE 'fixed_size' END AS method_used FROM r"),
    "g7_filing_stats": with_sql(STATS, "SELECT * FROM st"),
    "c1_tokenize": f"SELECT doc_id, len({tokens_sql('text')}) AS n, array_to_string({tokens_sql('text')}, ' ') AS text FROM documents",
    "c2_fixed_windows": with_sql(FILINGS, fixed_sql(FIXED)),
    "c3_section_windows": with_sql(GATED, section_sql()),
    "c4_windows_v1": with_sql(GATED, f"{fixed_sql(FIXED, False)} UNION ALL {section_sql(False)}"),
    "c5_chunk_summary": with_sql(FILINGS, f"SELECT accession, count(*) AS n_chunks, (sum(length(text)) // count(*))::BIGINT AS avg_chars FROM ({fixed_sql(FIXED)}) GROUP BY accession"),
    "c6_sample_chunks": with_sql(f"{FILINGS}, x AS {FIXED}", f"SELECT accession, place, i, substr(array_to_string(w, ' '), 1, 500) AS text FROM ({_SAMPLES}) JOIN x ON x.accession = _.accession AND k = i".replace(") JOIN x ON x.accession = _.accession AND k = i", ") JOIN (SELECT accession, k AS i, w FROM x) USING (accession, i)")),
    "c7_offset_windows": rf"""WITH t AS (SELECT doc_id, text, regexp_split_to_array(text, '\S+') AS g, regexp_extract_all(text, '\S+') AS w FROM documents),
        i AS (SELECT *, unnest(range(0, len(w), {STEP})) AS pos FROM t),
        o AS (SELECT doc_id, pos // {STEP} AS i, text, least(pos + {SIZE}, len(w)) AS e, pos, length(array_to_string(g[1:pos + 1], '') || array_to_string(w[1:pos], '')) AS char_start, length(array_to_string(g[1:least(pos + {SIZE}, len(w))], '') || array_to_string(w[1:pos + {SIZE}], '')) AS char_end FROM i)
        SELECT doc_id, i, char_start, char_end, e - pos AS token_count, substr(text, char_start + 1, char_end - char_start) AS text FROM o""",
    "c9_batch_summary": with_sql(STATS, "SELECT count(*) AS successful, 0::BIGINT AS failed, " + ", ".join(f"count(*) FILTER (method_used = '{t}') AS {t}" for t in ("section_aware", "hybrid_section_aware", "fixed_size")) + ", " + ", ".join(f"round(100.0 * count(*) FILTER (method_used = '{t}') / count(*), 4)::DOUBLE AS {t}_pct" for t in ("section_aware", "hybrid_section_aware", "fixed_size")) + ", sum(chunks_produced)::BIGINT AS total_chunks FROM st"),
    "c10_method_summary": with_sql(GATED, "SELECT CASE WHEN reason1 = 'all signals pass' THEN 'section_aware' ELSE 'fixed_size' END AS method_used, count(*) AS filings, sum(total)::BIGINT AS chars FROM r GROUP BY 1"),
}
