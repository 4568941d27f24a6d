"""Queries of metrics, dense retrieval, fusion, evaluation. Rankings: sparse top-20 of documents for benchmark passages; gold: the documents that hold the passage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.operators import bm25, dense, evaluate, fusion, metrics
from lakeglass.plans.retrieval import bm25_sql
from lakeglass.sources.tables import table


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def ranked(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return bm25.top_k(bm25.build_index(table(spark, d, "documents")), asked(spark, d), k)


def gold(spark: SparkSession, d: str) -> DataFrame:
    """The passages are few and go to the documents; each document is read once."""
    return evaluate.containing(table(spark, d, "documents"), asked(spark, d))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def dense_ranked(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    q = table(spark, d, "embeddings").filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.top_k(vectors(spark, d), q, k)


def dense_judged(spark: SparkSession, d: str) -> DataFrame:
    """Gold of a vector: the others of its label."""
    e = table(spark, d, "embeddings")
    return metrics.judged_by_label(dense_ranked(spark, d, 20), e, e.filter("vec_id % 25 = 0"), "label", "vec_id")


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sparse and dense lists for one set of queries: query q is passage q and the vector of number 25 q."""
    s = ranked(spark, d, 50)
    v = dense_ranked(spark, d, 50).withColumn("query_id", (F.col("query_id") / 25).cast("long"))
    return s, v


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs: type as model and config, value as latency."""
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), F.col("event_type").alias("config"), F.col("value").alias("latency_ms"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"), "user_id")


RATES = [("click", 3.0, 15.0), ("view", 0.5, 1.5), ("purchase", 10.0, 30.0)]


def results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    part = lambda m: ((F.col("event_id") * m) % 101 / 100.0)
    return e.select(
        F.col("event_type").alias("config"), F.when(F.col("event_id") % 2 == 0, "bm25").otherwise("dense").alias("retriever"), F.when(F.col("event_id") % 3 == 0, "fixed").otherwise("section_aware").alias("chunker"),
        *(part(m).alias(c) for c, m in (("recall_at_10", 3), ("mrr", 5), ("ndcg_at_10", 7), ("evidence_hit", 11), ("faithfulness", 13), ("correctness", 17))), (F.col("event_id") % 7 / 1000.0).alias("cost_usd"), F.col("value").alias("latency_ms"),
    )


def qa(spark: SparkSession, d: str) -> DataFrame:
    types, levels = F.array(*map(F.lit, evaluate.QUESTION_TYPES)), F.array(*map(F.lit, evaluate.DIFFICULTIES))
    i = F.col("item_id")
    return table(spark, d, "benchmark").select(i.alias("qa_id"), F.get(types, (i % 3).cast("int")).alias("question_type"), F.get(levels, (i % 3).cast("int")).alias("difficulty"), F.array(F.struct(F.concat(F.lit("T"), (i % 31).cast("string")).alias("ticker"))).alias("gold_evidence"))


def one_metric(name: str, k: int = 10):
    return lambda s, d: metrics.at_k(ranked(s, d), gold(s, d), k).select("query_id", name)


QUERIES = {
    "e1_recall_at_k": one_metric("recall"), "e2_precision_at_k": one_metric("precision"), "e3_reciprocal_rank": one_metric("mrr"), "e4_ndcg_at_k": one_metric("ndcg"), "e5_hit_at_k": one_metric("hit"),
    "e6_k_sweep": lambda s, d: metrics.k_sweep(ranked(s, d), gold(s, d)),
    "e6_dense_k_sweep": lambda s, d: metrics.swept(dense_judged(s, d)),
    "e8_report": lambda s, d: evaluate.report(results(s, d)),
    "e9_latency_percentiles": lambda s, d: evaluate.latency_percentiles(runs(s, d), "model"),
    "e10_cost": lambda s, d: evaluate.cost(runs(s, d), s.createDataFrame(RATES, "model string, usd_per_m_input double, usd_per_m_output double")).select("event_id", "model", "cost_usd"),
    "e11_pareto": lambda s, d: evaluate.pareto_frontier(table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("quality"), F.col("p_size").cast("double").alias("cost"))),
    "e13_abstention": lambda s, d: table(s, d, "labels").select("doc_id", evaluate.abstention_outcome(F.col("toxic") == 1, F.col("quality") == 1).alias("outcome"), evaluate.abstention_correct(F.col("toxic") == 1, F.col("quality") == 1).alias("correct")),
    "e14_kappa": lambda s, d: evaluate.cohens_kappa(table(s, d, "labels").select("quality", F.when(F.col("doc_id") % 5 == 0, F.col("toxic")).otherwise(F.col("quality")).alias("judge"), (F.col("doc_id") % 3).cast("string").alias("dimension")), "quality", "judge", "dimension"),
    "e14_binned": lambda s, d: table(s, d, "events").select("event_id", evaluate.binned(F.col("event_id") % 101 / 100.0).alias("bin")),
    "e15_dataset_filter": lambda s, d: evaluate.filter_questions(qa(s, d), "multi_doc_synthesis", "medium").select("qa_id"),
    "e16_composition": lambda s, d: evaluate.composition(qa(s, d)),
    "e17_comparison_table": lambda s, d: evaluate.comparison_table(results(s, d), "recall_at_10", ("bm25", "dense")),
    "e18_prompts": lambda s, d: evaluate.prompts(asked(s, d), table(s, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("text")).join(F.broadcast(ranked(s, d, 3)), "doc_id")).select("query_id", "prompt"),
    "e21_reproducible_sample": lambda s, d: evaluate.reproducible_sample(qa(s, d), 5, 7).select("qa_id"),
    "e21_grounding": lambda s, d: evaluate.grounding(table(s, d, "labels").filter("doc_id < 50").select((F.col("quality") == 1).alias("matches")), "matches", 4),
    "r1_tokens": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(bm25.lexical_tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")),
    "r2_term_statistics": lambda s, d: bm25.build_index(table(s, d, "documents")).terms.select("term", F.round("idf", 6).alias("idf")),
    "r4_index_statistics": lambda s, d: bm25.build_index(table(s, d, "documents")).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl")),
    "r7_dense_topk": dense_ranked,
    "r8_rrf": lambda s, d: fusion.reciprocal_rank_fusion(*both(s, d)).withColumn("score", F.round("score", 9)),
    "r9_hybrid_topk": lambda s, d: fusion.hybrid(*both(s, d)).withColumn("score", F.round("score", 9)),
    "r10_rerank": lambda s, d: fusion.reranked(ranked(s, d, 50), fusion.overlap_score(asked(s, d), table(s, d, "documents"))),
    "r12_experiment_grid": lambda s, d: fusion.experiment_grid(s),
}

RANKED = f"rk AS ({bm25_sql('SELECT item_id AS query_id, text FROM benchmark', 20)})"
GOLD = "g AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _ranked_sql(k: int) -> str:
    return f"rk AS ({bm25_sql('SELECT item_id AS query_id, text FROM benchmark', k)})"


def _metrics_sql(k: str) -> str:
    """Metrics by query for k from a table ks(k)."""
    return f"""q AS (SELECT query_id FROM rk UNION SELECT query_id FROM g), n AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM g GROUP BY query_id),
        h AS (SELECT rk.*, g.doc_id IS NOT NULL AS hit FROM rk LEFT JOIN (SELECT DISTINCT * FROM g) g USING (query_id, doc_id)),
        mt AS (SELECT q.query_id, k, coalesce(any_value(n.n), 0) AS n, count(DISTINCT doc_id) FILTER (hit AND rank <= k) AS hits, count(*) FILTER (hit AND rank <= k) AS places, count(*) FILTER (rank <= k) AS taken,
               min(rank) FILTER (hit) AS first, sum(CASE WHEN hit AND rank <= k THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
               FROM q CROSS JOIN ({k}) LEFT JOIN h USING (query_id) LEFT JOIN n USING (query_id) GROUP BY q.query_id, k),
        me AS (SELECT query_id, k, CASE WHEN n > 0 THEN hits / n ELSE 0 END AS recall, CASE WHEN taken > 0 THEN places / taken ELSE 0 END AS precision, coalesce(1 / first, 0) AS mrr,
               CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg, CASE WHEN places > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM mt)"""


def _metric(name: str) -> str:
    return f"WITH {RANKED}, {GOLD}, {_metrics_sql('SELECT 10 AS k')} SELECT query_id, round({name}, 6) AS {name} FROM me"


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("recall", "precision", "mrr", "ndcg", "hit"))
_KS = "SELECT unnest([5, 10, 20]) AS k"


def _dense_sql(k: int) -> str:
    return f"""SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
        (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 25 = 0)) WHERE rank <= {k}"""


_FUSED = f"""{_ranked_sql(50)}, dn AS (SELECT (query_id / 25)::BIGINT AS query_id, rank, doc_id FROM ({_dense_sql(50)})),
    u AS (SELECT query_id, doc_id, rank, 0 AS list FROM rk UNION ALL SELECT query_id, doc_id, rank, 1 FROM dn),
    fu AS (SELECT query_id, doc_id, sum(1 / (60 + rank) ORDER BY list, rank) AS score, min(list * 1000000 + rank) AS first FROM u GROUP BY ALL),
    fr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank, doc_id, round(score, 9) AS score FROM fu)"""
_PART = lambda m: f"((event_id * {m}) % 101 / 100.0)"
_RESULTS = f"""rs AS (SELECT event_type AS config, CASE WHEN event_id % 2 = 0 THEN 'bm25' ELSE 'dense' END AS retriever, CASE WHEN event_id % 3 = 0 THEN 'fixed' ELSE 'section_aware' END AS chunker,
    {", ".join(f"{_PART(m)} AS {c}" for c, m in (("recall_at_10", 3), ("mrr", 5), ("ndcg_at_10", 7), ("evidence_hit", 11), ("faithfulness", 13), ("correctness", 17)))}, event_id % 7 / 1000.0 AS cost_usd, value AS latency_ms FROM events)"""
_TYPES = "['factual_lookup', 'multi_doc_synthesis', 'numerical_reasoning', 'temporal_comparison']"
_QA = f"qa AS (SELECT item_id AS qa_id, ({_TYPES})[item_id % 3 + 1] AS question_type, (['easy', 'medium', 'hard'])[item_id % 3 + 1] AS difficulty, 'T' || (item_id % 31) AS ticker FROM benchmark)"
_RATES = "(VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in RATES) + ") AS t(model, a, b)"
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
_STATS = f"d AS (SELECT doc_id, {_TOKENS} AS tk FROM documents), p AS (SELECT DISTINCT doc_id, unnest(tk) AS term FROM d), n AS (SELECT count(*) AS n FROM d), i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM p, n GROUP BY term, n)"
_HEAD, _REST = evaluate.QA_TEMPLATE.split("{passages}")
_MIDDLE, _TAIL = _REST.split("{question}")
_lit = lambda x: "'" + x.replace("'", "''") + "'"

ORACLES = {
    "e1_recall_at_k": _metric("recall"), "e2_precision_at_k": _metric("precision"), "e3_reciprocal_rank": _metric("mrr"), "e4_ndcg_at_k": _metric("ndcg"), "e5_hit_at_k": _metric("hit"),
    "e6_k_sweep": f"WITH {RANKED}, {GOLD}, {_metrics_sql(_KS)} SELECT k::BIGINT AS k, count(*) AS n_queries, {_MEANS} FROM me GROUP BY k",
    "e6_dense_k_sweep": f"WITH rk AS ({_dense_sql(20)}), g AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id AND a.vec_id % 25 = 0), {_metrics_sql(_KS)} SELECT k::BIGINT AS k, count(*) AS n_queries, {_MEANS} FROM me GROUP BY k",
    "e8_report": f"WITH {_RESULTS} SELECT config, count(*) AS n_questions, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("recall_at_10", "mrr", "ndcg_at_10", "evidence_hit", "faithfulness", "correctness")) + ", round(sum(cost_usd), 6) AS total_cost_usd, round(avg(latency_ms), 6) AS mean_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms FROM rs GROUP BY config",
    "e9_latency_percentiles": "SELECT event_type AS model, count(value) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{n}" for n, p in ((50, 0.5), (95, 0.95), (99, 0.99))) + " FROM events GROUP BY 1",
    "e10_cost": f"SELECT event_id, event_type AS model, round(((event_id % 1000) * a + (event_id % 77) * b) / 1e6, 8) AS cost_usd FROM events LEFT JOIN {_RATES} ON event_type = model",
    "e11_pareto": "SELECT p_partkey, p_retailprice AS quality, p_size::DOUBLE AS cost FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE (b.p_retailprice >= a.p_retailprice AND b.p_size < a.p_size) OR (b.p_retailprice > a.p_retailprice AND b.p_size <= a.p_size))",
    "e13_abstention": "SELECT doc_id, CASE WHEN toxic = 0 AND quality = 1 THEN 'answered' WHEN toxic = 0 THEN 'should_have_abstained' WHEN quality = 1 THEN 'wrong_abstention' ELSE 'correct_abstention' END AS outcome, (toxic = 0) = (quality = 1) AS correct FROM labels".replace("(toxic = 0) = (quality = 1)", "CASE WHEN toxic = 0 THEN quality = 1 ELSE quality <> 1 END"),
    "e14_kappa": """WITH x AS (SELECT (doc_id % 3)::VARCHAR AS "group", quality AS a, CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END AS b FROM labels),
        t AS (SELECT "group", count(*) AS n, count(*) FILTER (a = b) / count(*) AS po FROM x GROUP BY 1), ma AS (SELECT "group", a AS v, count(*) AS na FROM x GROUP BY ALL), mb AS (SELECT "group", b AS v, count(*) AS nb FROM x GROUP BY ALL),
        pe AS (SELECT "group", sum(na * nb) AS c FROM ma JOIN mb USING ("group", v) GROUP BY 1), k AS (SELECT "group", n, round(po, 6) AS agreement, round((po - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM t JOIN pe USING ("group"))
        SELECT *, kappa >= 0.5 AS accepted FROM k""",
    "e14_binned": "SELECT event_id, (CASE WHEN event_id % 101 / 100.0 >= 1/3 THEN 1 ELSE 0 END + CASE WHEN event_id % 101 / 100.0 >= 2/3 THEN 1 ELSE 0 END)::BIGINT AS bin FROM events",
    "e15_dataset_filter": f"WITH {_QA} SELECT qa_id FROM qa WHERE question_type = 'multi_doc_synthesis' AND difficulty = 'medium'",
    "e16_composition": f"WITH {_QA}, c AS (SELECT 'question_type' AS dimension, question_type AS value, count(*) AS n FROM qa GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*) FROM qa GROUP BY 2 UNION ALL SELECT 'companies', 'all', count(DISTINCT ticker) FROM qa), w AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {n}::BIGINT)" for (a, b), n in evaluate.TARGETS.items()) + ") AS t(dimension, value, target)) SELECT dimension, value, coalesce(n, 0) AS n, target, coalesce(n, 0) >= target AS met FROM w LEFT JOIN c USING (dimension, value)",
    "e17_comparison_table": f"WITH {_RESULTS} SELECT chunker, round(avg(recall_at_10) FILTER (retriever = 'bm25'), 6) AS bm25, round(avg(recall_at_10) FILTER (retriever = 'dense'), 6) AS dense FROM rs GROUP BY chunker",
    "e18_prompts": f"WITH {_ranked_sql(3)} SELECT query_id, {_lit(_HEAD)} || string_agg('[P' || rank || '] ' || substr(d.text, 1, 60), chr(10) ORDER BY rank) || {_lit(_MIDDLE)} || any_value(b.text) || {_lit(_TAIL)} AS prompt FROM rk JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id GROUP BY query_id",
    "e21_reproducible_sample": "SELECT item_id AS qa_id FROM benchmark ORDER BY md5('7|' || item_id), item_id LIMIT 5",
    "e21_grounding": "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS matching, round(count(*) FILTER (quality = 1) / count(*), 6) AS rate, count(*) FILTER (quality = 1) >= 4 AS passed FROM labels WHERE doc_id < 50",
    "r1_tokens": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL",
    "r2_term_statistics": f"WITH {_STATS} SELECT term, round(CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM i) ELSE idf0 END, 6) AS idf FROM i",
    "r4_index_statistics": f"WITH {_STATS} SELECT count(*) AS n_docs, round(sum(len(tk)) / count(*), 6) AS avgdl FROM d",
    "r7_dense_topk": _dense_sql(10),
    "r8_rrf": f"WITH {_FUSED} SELECT * FROM fr",
    "r9_hybrid_topk": f"WITH {_FUSED} SELECT * FROM fr WHERE rank <= 10",
    "r10_rerank": f"WITH {_ranked_sql(50)}, q AS (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS qt FROM benchmark), d AS (SELECT doc_id, {_TOKENS} AS dt FROM documents), s AS (SELECT query_id, doc_id, rank AS first, round(len(list_intersect(qt, dt)) / len(qt), 6) AS score FROM rk JOIN q USING (query_id) JOIN d USING (doc_id)) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank, doc_id, score FROM s QUALIFY rank <= 10",
    "r12_experiment_grid": "SELECT r || '+' || c AS config, r AS retriever, c AS chunker FROM (SELECT unnest(['bm25', 'dense', 'hybrid']) AS r) CROSS JOIN (SELECT unnest(['fixed', 'section_aware']) AS c)",
}
