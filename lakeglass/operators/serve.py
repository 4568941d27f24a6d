"""What a command line or a web service would call: plain functions that take a session. A server is out of scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.operators import chunking, evaluate, fusion, gates, sections
from lakeglass.sources import filings

CONFIGS = ("bm25", "dense", "hybrid", "hybrid+rerank")
TABS = ("Ask", "Evaluation")


def health() -> dict[str, str]:
    return {"status": "ok"}


def ingest(spark: SparkSession, landed: str, out: str, tickers: tuple[str, ...] = (), filing_types: tuple[str, ...] = ("10-K",), limits: gates.Limits = gates.LIMITS) -> DataFrame:
    """Landed submissions to clean text, chunks and statistics under out; returns the statistics. The clean text is written once and both read it."""
    raw = filings.landed_submissions(spark, landed).filter(F.col("filing_type").isin(*filing_types))
    if tickers:
        raw = raw.filter(F.col("ticker").isin(*tickers))
    filings.extracted(raw).select("ticker", "filing_type", "accession", "text", "error").write.mode("overwrite").parquet(f"{out}/text")
    text = spark.read.parquet(f"{out}/text")
    routed = gates.routed(sections.with_sections(text.filter("error = ''")), limits)
    filings.write_chunks(chunking.chunks(routed), f"{out}/chunks")
    made = spark.read.schema(filings.CHUNK).option("recursiveFileLookup", True).json(f"{out}/chunks")
    stats = chunking.corpus_stats(routed, made)
    failed = text.filter("error <> ''").select("ticker", "filing_type", "accession", "error")
    return stats.unionByName(failed, allowMissingColumns=True)


def index(spark: SparkSession, chunks: str, out: str, strategy: str = "labeled") -> fusion.SparseRetriever:
    found = fusion.strategy_subset(filings.read_chunks(spark, chunks), strategy)
    r = fusion.SparseRetriever(f"bm25-{strategy}")
    r.index(found.select(F.col("chunk_id").alias("doc_id"), "text"))
    r.save(out)
    return r


def ask(spark: SparkSession, question: str, retriever: fusion.Retriever, k: int = 10) -> DataFrame:
    """The k passages for a question. An answer needs a model: see evaluate.prompts and evaluate.parsed_answers."""
    return retriever.retrieve(spark.createDataFrame([(0, question)], "query_id long, text string"), k)


def ask_endpoint(question: str, config: str = "hybrid", k: int = 10) -> dict:
    """The request as it was understood, with its defaults."""
    if config not in CONFIGS:
        raise ValueError(f"config is one of {', '.join(CONFIGS)}")
    return {"question": question, "config": config, "k": k}


def evaluate_config(questions: DataFrame, gold: DataFrame, retriever: fusion.Retriever, answer: Callable[[DataFrame, DataFrame], DataFrame], config: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    return evaluate.run_harness(questions, gold, lambda q: retriever.retrieve(q, k), answer, config)
