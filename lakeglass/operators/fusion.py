"""Rank fusion, hybrid retrieval, reranking, and the contract of a retriever."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.operators import bm25, dense

RRF_K, POOL = 60, 50


def reciprocal_rank_fusion(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, rank, doc_id, score): the sum of 1 / (k + rank) over the lists; ties as the documents first came, list by list."""
    lists = None
    for n, r in enumerate(rankings):
        one = r.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.lit(n).alias("list"))
        lists = one if lists is None else lists.unionByName(one)
    # The parts are added in the order of lists and ranks, so the sum doesn't depend on the partitioning.
    parts = F.array_sort(F.collect_list(F.struct("list", "rank")))
    fused = lists.groupBy("query_id", "doc_id").agg(parts.alias("ps"))
    fused = fused.select("query_id", "doc_id", F.aggregate("ps", F.lit(0.0), lambda s, p: s + 1.0 / (k + p["rank"])).alias("score"), F.get("ps", F.lit(0)).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "rank", "doc_id", "score")


def hybrid(sparse: DataFrame, dense_: DataFrame, k: int = 10, pool: int = POOL, rrf_k: int = RRF_K) -> DataFrame:
    """Both lists cut to the pool, fused, and the k best."""
    cut = lambda r: r.filter(F.col("rank") <= pool)
    return reciprocal_rank_fusion(cut(sparse), cut(dense_), k=rrf_k).filter(F.col("rank") <= k)


def reranked(ranking: DataFrame, score: Callable[[DataFrame], DataFrame], k: int = 10, pool: int = POOL) -> DataFrame:
    """The pool of a ranking in the order of another score, ties by the first rank. score: adds the column rerank_score to (query_id, doc_id, …)."""
    rows = score(ranking.filter(F.col("rank") <= pool))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.col("first_rank"))
    rows = rows.withColumnRenamed("rank", "first_rank").withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.col("rerank_score").alias("score"))


def overlap_score(queries: DataFrame, docs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The default pair score: the share of the query's distinct words that the document has. A model's score takes its place as a pandas UDF."""
    q = queries.select("query_id", F.array_distinct(bm25.lexical_tokens("text")).alias("qt"))
    d = docs.select("doc_id", "text")

    def run(pool: DataFrame) -> DataFrame:
        # The pool's few ids go to the documents, so that no other text is split or shuffled.
        few = d.join(F.broadcast(pool.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.array_distinct(bm25.lexical_tokens("text")).alias("dt"))
        both = pool.join(q, "query_id").join(few, "doc_id")
        share = F.coalesce(F.try_divide(F.size(F.array_intersect("qt", "dt")), F.size("qt")), F.lit(0.0))
        return both.withColumn("rerank_score", F.round(share, 6)).drop("qt", "dt")

    return run


class Retriever(Protocol):
    """What every retriever offers; queries are a table (query_id, text), so a batch is one job."""

    name: str

    def index(self, chunks: DataFrame) -> None: ...

    def load(self, path: str) -> None: ...

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


@dataclass
class SparseRetriever:
    """BM25 over chunks (doc_id, text). The index can be kept as Parquet tables."""

    name: str = "bm25"
    built: bm25.Index | None = None
    stats: dict = field(default_factory=dict)

    def index(self, chunks: DataFrame) -> None:
        began = time.perf_counter()
        self.built = bm25.build_index(chunks)
        self.stats = {"num_chunks": self.built.docs.count(), "build_time_ms": 1000 * (time.perf_counter() - began)}

    def save(self, path: str) -> None:
        i = self._index()
        i.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("docs", "terms", "stats"):
            getattr(i, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def load(self, path: str, spark=None) -> None:
        from pyspark.sql import SparkSession

        read = (spark or SparkSession.getActiveSession()).read
        self.built = bm25.Index(*(read.parquet(f"{path}/{n}") for n in ("docs", "postings", "terms", "stats")))
        self.stats = {"num_chunks": self.built.docs.count()}

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        began = time.perf_counter()
        out = bm25.top_k(self._index(), queries, k)
        self.stats["plan_ms"] = 1000 * (time.perf_counter() - began)
        return out

    def retrieve_timed(self, queries: DataFrame, k: int = 10) -> tuple[list, float]:
        """Collected results and the milliseconds that they took."""
        began = time.perf_counter()
        rows = self.retrieve(queries, k).orderBy("query_id", "rank").collect()
        self.stats["latency_ms"] = 1000 * (time.perf_counter() - began)
        return rows, self.stats["latency_ms"]

    def _index(self) -> bm25.Index:
        if self.built is None:
            raise RuntimeError("there is no index: call index() or load() first")
        return self.built


@dataclass
class DenseRetriever:
    """Cosine over vectors of chunks. embed: adds the column embedding to a table with the column text."""

    embed: Callable[[DataFrame], DataFrame]
    name: str = "dense"
    vectors: DataFrame | None = None

    def index(self, chunks: DataFrame) -> None:
        self.vectors = self.embed(chunks).select("doc_id", "embedding")

    def load(self, path: str, spark=None) -> None:
        from pyspark.sql import SparkSession

        self.vectors = (spark or SparkSession.getActiveSession()).read.parquet(path)

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        if self.vectors is None:
            raise RuntimeError("there is no index: call index() or load() first")
        return dense.top_k(self.vectors, self.embed(queries), k)


@dataclass
class HybridRetriever:
    sparse: SparseRetriever
    dense: DenseRetriever
    rrf_k: int = RRF_K
    pool: int = POOL
    name: str = "hybrid"

    def index(self, chunks: DataFrame) -> None:
        self.sparse.index(chunks)
        self.dense.index(chunks)

    def load(self, path: str, spark=None) -> None:
        self.sparse.load(f"{path}/sparse", spark)
        self.dense.load(f"{path}/dense", spark)

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return hybrid(self.sparse.retrieve(queries, self.pool), self.dense.retrieve(queries, self.pool), k, self.pool, self.rrf_k)


STRATEGIES = {"labeled": ("section_aware", "hybrid_section_aware"), "fixed_size": ("fixed_size",), "strict": ("section_aware",)}


def strategy_subset(chunks: DataFrame, strategy: str = "labeled") -> DataFrame:
    """Chunks of a strategy; any other name takes all."""
    return chunks.filter(F.col("chunking_method").isin(*STRATEGIES[strategy])) if strategy in STRATEGIES else chunks


def index_variants(chunks: DataFrame, strategies: tuple[str, ...] = ("labeled", "fixed_size")) -> dict[str, SparseRetriever]:
    out = {}
    for s in strategies:
        out[s] = SparseRetriever(f"bm25-{s}")
        out[s].index(strategy_subset(chunks, s))
    return out


def experiment_grid(spark, retrievers: tuple[str, ...] = ("bm25", "dense", "hybrid"), chunkers: tuple[str, ...] = ("fixed", "section_aware")) -> DataFrame:
    """(config, retriever, chunker): every combination."""
    r, c = spark.createDataFrame([(x,) for x in retrievers], "retriever string"), spark.createDataFrame([(x,) for x in chunkers], "chunker string")
    return r.crossJoin(F.broadcast(c)).select(F.concat_ws("+", "retriever", "chunker").alias("config"), "retriever", "chunker")
