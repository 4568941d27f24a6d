"""Exact dense top-k: queries go in blocks of a checked size to the vectors; a task keeps its own k best of each query, so only these are shuffled. Scores are made in tiles of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.operators.best import TILE, Best

#: Bytes of query vectors that are sent at once; more queries go in several rounds over the vectors.
QUERY_BYTES = 64 << 20
ROUND = 6
#: Vectors of a tile.
WIDTH = 1024


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score) by cosine, rounded to 6 places, ties by doc_id. vectors: (doc_id, embedding), queries: (query_id, embedding).

    Null vectors take no part; a vector of zeros has score 0 with all. A round sends query_bytes of vectors at most, and as many
    queries as have query_bytes of answers.
    """
    vectors = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").filter("doc_id IS NOT NULL AND embedding IS NOT NULL")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("query_id IS NOT NULL AND embedding IS NOT NULL")
    size, n = queries.agg(F.coalesce(F.sum(F.size("embedding").cast("long") * 8), F.lit(0)), F.count("*")).first()
    rounds = max(1, -(-size // query_bytes), -(-n * k * 16 // query_bytes))
    best = None
    for r in range(rounds):
        t = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r).toArrow()
        if t.num_rows:
            part = vectors.mapInArrow(_searcher(t["query_id"].to_numpy(), _matrix(t["embedding"].combine_chunks()), k), "query_id long, doc_id long, score double")
            best = part if best is None else best.unionByName(part)
    if best is None:
        best = vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _searcher(ids: np.ndarray, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = Best(len(ids), k, np.dtype(np.int64)), max(1, TILE // WIDTH)
        for b in batches:
            for at in range(0, len(b), WIDTH):
                part = b.slice(at, WIDTH)
                docs, turned = part["doc_id"].to_numpy(), _matrix(part["embedding"]).T
                for q in range(0, len(ids), rows):
                    best.add(q, np.round(matrix[q : q + rows] @ turned, ROUND) + 0.0, docs)
        yield best.rows(ids, [pa.int64(), pa.int64()], ["query_id", "doc_id", "score"])

    return run
