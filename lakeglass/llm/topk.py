"""Operator 3: exact BM25 top-k with block-max WAND, one inverted index a shard, merged under global statistics.

1. Global statistics: number of documents, mean length, document frequencies of all terms of the queries.
2. A shard is the documents of a task, at most SHARD_TOKENS words at once. It gets an inverted index of all its
   terms: postings by term, in the order of documents, in blocks of BLOCK documents with the highest impact each.
3. For each query the pivot moves through the shard's blocks in order: blocks whose sum of the maxima of the query's terms can't
   reach the k-th best score so far are passed over unread; a term's own maximum over the shard bounds the rest of the walk. The
   block with the highest bound is read first, so that the k-th score is high early.
4. Shards' best k are merged by (score, doc_id). A document that isn't among its shard's best can't be among all.

Score: sum over the query's words, repeats included, of ln(1 + (N - df + 0.5) / (df + 0.5)) tf (K1 + 1) / (tf + K1 (1 - B + B len /
avgdl)), rounded to 6 places. Ranks by score, ties by doc_id (null first).

Defined results: only documents with a word of the query are found, so a query can get fewer than k rows, and an empty or
null query gets none. Null texts count as documents without words. Repeated rows are documents of their own, and ties between them
take neighbouring ranks. Queries that have one query_id are asked each by itself and merged. Queries are sent to shards in
portions of at most QUERY_BYTES, each of which reads the documents again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

K1, B, K = 1.2, 0.75, 10
BLOCK, SHARD_TOKENS, QUERY_BYTES = 64, 8_000_000, 32 << 20
ROUNDING = 1e-6


class Index:
    """The inverted index of a shard. Terms are numbered as they come."""

    def __init__(self, number: dict[str, int], terms: np.ndarray, docs: np.ndarray, tf: np.ndarray, length: np.ndarray, ids: list):
        o = np.lexsort((docs, terms))
        self.number, self.docs, self.tf, self.length, self.ids = number, docs[o], tf[o], length, ids
        self.start = np.searchsorted(terms[o], np.arange(len(number) + 1))
        self.read = self.passed = 0

    @staticmethod
    def of(texts: list[list[str]], ids: list) -> Index:
        number: dict[str, int] = {}
        terms, docs, tf = [], [], []
        for d, ws in enumerate(texts):
            c = Counter(ws)
            terms.append(np.fromiter((number.setdefault(w, len(number)) for w in c), np.int64, len(c)))
            tf.append(np.fromiter(c.values(), np.int64, len(c)))
            docs.append(np.full(len(c), d))
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, docs, tf)]
        return Index(number, *flat, np.array([len(t) for t in texts], np.int64), ids)

    def impacts(self, avgdl: float, idf: dict[str, float]) -> None:
        """Impacts and block maxima of the terms that are asked for."""
        norm = K1 * (1 - B + B * self.length / avgdl)
        self.lists = {}
        for w, v in idf.items():
            t = self.number.get(w)
            if t is None:
                continue
            i, j = self.start[t], self.start[t + 1]
            d, f = self.docs[i:j], self.tf[i:j]
            x = v * f * (K1 + 1) / (f + norm[d])
            block = d // BLOCK
            at = np.flatnonzero(np.append(True, np.diff(block) != 0))
            self.lists[w] = d, x, block[at], np.append(at, len(d)), np.maximum.reduceat(x, at)

    def top(self, query: Counter, k: int) -> list[tuple[float, int]]:
        """(score, document) of the k best, ties by document id."""
        lists = [(n, *self.lists[w]) for w, n in query.items() if w in self.lists]
        if not lists or k < 1:
            return []
        bound = np.zeros(len(self.length) // BLOCK + 1)
        for n, _, _, block, _, most in lists:
            bound[block] += n * most
        best: list[tuple[float, int]] = []
        least = 0.0

        def read(b: int) -> None:
            nonlocal best, least
            self.read += 1
            score, hit = np.zeros(BLOCK), np.zeros(BLOCK, bool)
            for n, d, x, block, at, _ in lists:
                p = np.searchsorted(block, b)
                if p < len(block) and block[p] == b:
                    s = slice(at[p], at[p + 1])
                    score[d[s] - b * BLOCK] += n * x[s]
                    hit[d[s] - b * BLOCK] = True
            found = np.flatnonzero(hit & (score >= least - ROUNDING))
            best += [(round(float(score[i]), 6), int(b * BLOCK + i)) for i in found]
            best.sort(key=lambda s: (-s[0], self.ids[s[1]] is not None, self.ids[s[1]] or 0))
            del best[k:]
            if len(best) == k:
                least = best[-1][0]

        first = int(np.argmax(bound))
        read(first)
        pivot = 0
        live = np.flatnonzero(bound > 0)
        while pivot < len(live):
            ahead = np.flatnonzero(bound[live[pivot:]] >= least - ROUNDING)
            if not len(ahead):
                break
            pivot += int(ahead[0])
            if live[pivot] != first:
                read(int(live[pivot]))
            pivot += 1
        self.passed += len(live)
        return best


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[str]], list]]:
    texts, ids, size = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            texts.append(ws := WORD.findall((t or "").lower()))
            ids.append(i)
            size += len(ws)
            if size > SHARD_TOKENS:
                yield texts, ids
                texts, ids, size = [], [], 0
    if texts:
        yield texts, ids


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score). queries: (query_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "text").filter("text IS NOT NULL")
    size = F.sum(F.octet_length("text"))
    portions = max(1, -(-(queries.agg(size).first()[0] or 0) // QUERY_BYTES))
    out = None
    for p in range(portions):
        asked = [(r["query_id"], r["text"]) for r in queries.filter(F.pmod(F.xxhash64("query_id", "text"), F.lit(portions)) == p).collect()]
        part = _portion(docs, [(q, Counter(WORD.findall(t.lower()))) for q, t in asked], k)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return out.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def statistics(docs: DataFrame, terms: set[str]) -> tuple[int, float, dict[str, float]]:
    """Number of documents, mean length, idf of the terms, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = Counter(), 0, 0
        for b in batches:
            for t in b["text"].to_pylist():
                ws = WORD.findall((t or "").lower())
                n, total = n + 1, total + len(ws)
                df.update(sent.value.intersection(ws))
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.string()), pa.array([n, *df.values()], pa.int64()), pa.array([total] + [0] * len(df), pa.int64())], ["term", "n", "total"])

    rows = docs.select("text").mapInArrow(count, "term string, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    whole = next((r for r in rows if r["term"] is None), None)
    if whole is None or not whole["total"]:
        return 0, 1.0, {}
    n = whole["n"]
    return n, whole["total"] / n, {r["term"]: float(np.log(1 + (n - r["n"] + 0.5) / (r["n"] + 0.5))) for r in rows if r["term"] is not None}


def _portion(docs: DataFrame, asked: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    _, avgdl, idf = statistics(docs, {w for _, c in asked for w in c})
    sent = docs.sparkSession.sparkContext.broadcast((asked, avgdl, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, mean, weights = sent.value
        for texts, ids in shards(batches):
            index = Index.of(texts, ids)
            index.impacts(mean, weights)
            rows = [(q, ids[d], s) for q, c in queries for s, d in index.top(c, k)]
            q, d, s = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], ["query_id", "doc_id", "score"])

    return written(docs.mapInArrow(run, "query_id long, doc_id long, score double"), "best")


SQL = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS tk FROM documents),
    st AS (SELECT count(*) AS n, sum(len(tk)) / count(*) AS avgdl FROM d),
    p AS (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM d),
    pt AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
    i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM pt, st GROUP BY term, n),
    q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark),
    s AS (SELECT query_id, doc_id, round(sum(idf * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / avgdl))), 6) AS score
          FROM q JOIN i USING (term) JOIN pt USING (term), st GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query_id, rank, doc_id, score FROM r WHERE rank <= {K}"""
