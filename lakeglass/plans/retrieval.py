"""Queries of sparse retrieval over documents, asked with benchmark passages and texts of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.operators import bm25
from lakeglass.sources.tables import table


def own(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")


TEXTS = {
    "bm25_topk": ["the erth onthan of shre", "la ouè des éeau"],
    "bm25_repeat_terms": ["of of of erth onthan onthan"],
    "bm25_zero_scores": ["nosuchword", "idiot nosuchword"],
    "bm25_negative_idf": ["the of and", "the"],
}


def _bm25(texts: list[str]):
    return lambda spark, d: bm25.top_k(bm25.build_index(table(spark, d, "documents")), own(spark, texts))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    return bm25.top_k(bm25.build_index(table(spark, d, "documents")), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


QUERIES = {k: _bm25(v) for k, v in TEXTS.items()} | {"bm25_batch": _batch}


def bm25_sql(queries: str, k: int = 10) -> str:
    return f"""
        WITH queries AS ({queries}),
        d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS tk FROM documents),
        st AS (SELECT count(*) AS n, sum(len(tk)) / count(*) AS avgdl FROM d),
        p AS (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM d),
        pt AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
        i0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM pt, st GROUP BY term, n),
        i AS (SELECT term, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM i0) ELSE idf0 END AS idf FROM i0),
        q AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM queries),
        s AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
              FROM q JOIN i USING (term) JOIN pt USING (term), st GROUP BY ALL),
        a AS (SELECT query_id, doc_id, round(coalesce(score, 0), 6) AS score FROM (SELECT query_id FROM queries) CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN s USING (query_id, doc_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM a)
        SELECT query_id, rank, doc_id, score FROM r WHERE rank <= {k}"""


def _values(texts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, '{t}' AS text" for i, t in enumerate(texts))


ORACLES = {k: bm25_sql(_values(v)) for k, v in TEXTS.items()} | {"bm25_batch": bm25_sql("SELECT item_id AS query_id, text FROM benchmark")}
