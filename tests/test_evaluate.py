"""Retrievers, harness, answers and reports that have no SQL."""

import json

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lakeglass.operators import eda, evaluate, fusion, manifest, serve
from lakeglass.sources import filings
from lakeglass.sources.tables import table


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["alpha beta gamma", "alpha alpha beta", "delta", "beta gamma delta", "epsilon", "alpha", "zeta beta"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def embed(df):
    letters = "abdegz"
    return df.withColumn("embedding", F.array(*(F.regexp_count("text", F.lit(c)).cast("float") for c in letters)))


def test_retrievers(spark, corpus, tmp_path):
    hybrid = fusion.HybridRetriever(fusion.SparseRetriever(), fusion.DenseRetriever(embed))
    for r in (hybrid, hybrid.sparse, hybrid.dense):
        with pytest.raises(RuntimeError):
            r.retrieve(corpus)
    hybrid.index(corpus)
    asked = spark.createDataFrame([(0, "alpha beta"), (1, "delta")], "query_id long, text string")
    for r in (hybrid, hybrid.sparse, hybrid.dense):
        rows = r.retrieve(asked, 3).collect()
        assert sorted((x["query_id"], x["rank"]) for x in rows) == [(q, k) for q in (0, 1) for k in (1, 2, 3)]
    rows, ms = hybrid.sparse.retrieve_timed(asked, 2)
    assert len(rows) == 4 and ms > 0 and hybrid.sparse.stats["num_chunks"] == 7
    hybrid.sparse.save(str(tmp_path / "ix/sparse"))
    hybrid.dense.vectors.write.parquet(str(tmp_path / "ix/dense"))
    again = fusion.HybridRetriever(fusion.SparseRetriever(), fusion.DenseRetriever(embed))
    again.load(str(tmp_path / "ix"), spark)
    assert again.retrieve(asked, 3).orderBy("query_id", "rank").collect() == hybrid.retrieve(asked, 3).orderBy("query_id", "rank").collect()
    assert hybrid.retrieve(asked, 100).filter("query_id = 0").count() == 7
    variants = fusion.index_variants(corpus.withColumn("chunking_method", F.when(F.col("doc_id") < 4, "section_aware").otherwise("fixed_size")))
    assert {k: v.stats["num_chunks"] for k, v in variants.items()} == {"labeled": 4, "fixed_size": 3}


def test_harness_and_report(spark, corpus, tmp_path):
    sparse = fusion.SparseRetriever()
    sparse.index(corpus)
    asked = spark.createDataFrame([(0, "gamma"), (1, "epsilon"), (2, "nothing")], "query_id long, text string")
    gold = spark.createDataFrame([(0, 0), (0, 3), (1, 4)], "query_id long, doc_id long")
    answer = lambda q, r: q.select("query_id", F.lit(0.5).alias("faithfulness"), F.lit(1.0).alias("correctness"), F.lit(0.01).alias("cost_usd"), (F.col("query_id") * 10.0).alias("latency_ms"))
    rows, report = serve.evaluate_config(asked, gold, sparse, answer, "bm25")
    r = report.first()
    assert (r["n_questions"], r["mean_recall_at_10"], r["total_cost_usd"], r["p95_latency_ms"]) == (3, pytest.approx(2 / 3, abs=1e-6), 0.03, 19.0)
    filings.save_report(report, rows, str(tmp_path / "runs"))
    saved = [json.loads(x) for p in (tmp_path / "runs/of=bm25").glob("*.json") for x in p.read_text().splitlines()]
    assert len(saved) == 1 and len(saved[0]["per_question"]) == 3


def test_answers(spark):
    replies = [(0, '{"answer": "yes", "citations": ["P2", "[P1]", "P9", "x"], "abstain": false}', [7, 8]), (1, "not json", [1]), (2, '{"answer": "", "abstain": true, "abstention_reason": "none"}', [])]
    got = {r["query_id"]: r for r in evaluate.parsed_answers(spark.createDataFrame(replies, "query_id long, reply string, doc_ids array<long>")).collect()}
    assert got[0]["cited"] == [8, 7] and got[0]["answer_text"] == "yes" and not got[0]["abstained"]
    assert got[1]["abstained"] and "JSON" in got[1]["abstention_reason"] and got[2]["abstained"] and got[2]["abstention_reason"] == "none"
    scores = spark.createDataFrame([(1, 1.5, -1.0, 0.5, None, 1)], "query_id long, correctness double, completeness double, faithfulness double, citation_support double, abstention_correct int")
    r = evaluate.judged_answers(scores).first()
    assert (r["correctness"], r["completeness"], r["abstention_correct"]) == (1.0, 0.0, True)


def test_kappa(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (1, 0), (None, 1)], "a int, b int")
    r = evaluate.cohens_kappa(pairs, "a", "b").first()
    assert r["n"] == 4 and r["kappa"] == pytest.approx(0.5, abs=1e-6) and r["accepted"]
    assert evaluate.cohens_kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first()["kappa"] == 1.0


def test_pareto_keeps_equal_points(spark):
    pts = [(1, 0.5, 1.0), (2, 0.5, 1.0), (3, 0.4, 2.0), (4, 0.9, 3.0), (5, 0.9, 4.0), (6, None, 0.1)]
    df = spark.createDataFrame(pts, "i int, quality double, cost double").repartition(3)
    assert {r["i"] for r in evaluate.pareto_frontier(df).collect()} == {1, 2, 4}


def test_reports(spark):
    df = spark.createDataFrame([("AAPL", 5), ("JPM", 5), ("ZZZ", 5)], "ticker string, x int").withColumn("sector", eda.sector("ticker"))
    with pytest.raises(AssertionError, match="ZZZ"):
        eda.assert_covered(df)
    eda.assert_covered(df.filter("ticker <> 'ZZZ'"))
    assert eda.histogram(df.filter("sector = 'tech'"), "sector", "x").collect()[0]["bin"] == 12
    m = manifest.manifest(table(spark, SMALL, "documents").select(F.lit("MET").alias("ticker"), F.lit("10-K").alias("filing_type"), F.concat(F.lit("1-24-"), F.col("doc_id").cast("string")).alias("accession"), F.lit(1).alias("total_chars"), F.lit(1).alias("sections_detected"), F.lit(True).alias("quality_check_passed"), F.lit("").alias("quality_check_reason"), F.lit("section_aware").alias("method_used"), F.lit(1).alias("chunks_produced"), F.lit(1.0).alias("captured_ratio"), F.lit("8").alias("largest_section_item"), F.lit(0.6).alias("largest_section_ratio"), F.lit(1).alias("item_7_chars")))
    assert {r["failure_mode"] for r in m.collect()} == {"large_item8_legit"} and manifest.ordered(m).first()["filing_year"] == "2024"


def test_containing_is_that_of_sql(spark):
    docs = spark.createDataFrame([(1, "aé b\n c"), (2, None), (3, ""), (4, "b\n c aé"), (4, "x")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "é b"), (8, ""), (9, None), (10, "b\n c"), (11, "zz")], "query_id long, text string")
    want = docs.alias("d").join(asked.alias("q"), F.contains(F.col("d.text"), F.col("q.text"))).select("query_id", "doc_id")
    got = evaluate.containing(docs, asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
