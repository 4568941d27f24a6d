"""Operator 4: importance resampling. Two generative models over hashed n-grams, one of the target text (documents
labelled of good quality) and one of the raw text (all documents); a document's log weight is the sum over its n-grams of
the log ratio of the two; Gumbel top-k on the log weights samples k documents without replacement in proportion to them.

Features: words and runs of marks, case kept, and pairs of neighbours, hashed into BUCKETS. A token that repeats the
one before it counts as one of its own kind, whatever it is, so that the models see repetition. Log ratios are whole
numbers of millionths, so that sums don't depend on their order. The noise of a document comes from its doc_id.

k is the number of documents times the share of good ones among the labelled documents, unless it is given.
The k-th key is found by its digits, 16 bits at a time, over counts; nothing is sorted as a whole.

Defined results: a null or empty text has no feature and log weight 0. Null doc_ids share the noise of ''. Of rows that tie in
the key at the limit, those with smaller doc_ids (null first) are taken; rows that tie in doc_id too are taken together, so there can be more
than k. Without labels, or none good, target is raw and every weight is 0; k is then all documents. Models count all
documents; the target is fitted on at most labels.LABELLED labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .labels import LABELLED, sampled

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS, ALPHA, MUL = 10_000, 1.0, 1_000_003
AGAIN = "\x00again"


def hash32(s: str) -> int:
    return int(md5(s.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)


class Words(dict):
    def __missing__(self, w: str) -> int:
        h = self[w] = hash32(w)
        return h


def features(text: str | None, seen: Words) -> np.ndarray:
    """Buckets of a text's tokens and of its pairs of neighbours."""
    ws = TOKEN.findall(text or "")
    h = np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))
    if len(h) > 1:
        h[1:][h[1:] == h[:-1]] = seen[AGAIN]
    if len(seen) > 500_000:
        seen.clear()
    return np.concatenate([h, h[:-1] * MUL + h[1:]]) % BUCKETS


def gumbel(doc_id: int | None) -> int:
    """Noise in millionths."""
    u = (hash32("" if doc_id is None else str(doc_id)) + 0.5) / 2**32
    return round(-1e6 * math.log(-math.log(u)))


def weights(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[np.ndarray, int]:
    """Log ratio in millionths by bucket, and how many documents to take."""
    sent = docs.sparkSession.sparkContext.broadcast(sampled(labels, "quality", bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, good, raw, rows = Words(), np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64), 0
        labelled = 0
        for b in small(batches):
            for label, text in zip(sent.value.of(b["doc_id"].to_pylist()), b["text"].to_pylist()):
                c = np.bincount(features(text, seen), minlength=BUCKETS + 1)
                raw += c
                rows += 1
                if label >= 0:
                    labelled += 1
                    if label == 1:
                        good += c
                        good[BUCKETS] += 1
        raw[BUCKETS] = rows
        n = np.zeros(BUCKETS + 1, np.int64)
        n[BUCKETS] = labelled
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(good), pa.array(raw), pa.array(n)], ["bucket", "good", "raw", "labelled"])

    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "bucket long, good long, raw long, labelled long")
    t = t.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("good", "raw", "labelled"))).orderBy("bucket").toArrow()
    if not t.num_rows:
        return np.zeros(BUCKETS, np.int64), 0
    good, raw, labelled = (t[c].to_numpy() for c in ("good", "raw", "labelled"))
    n = int(raw[-1])
    if not good[:-1].sum():
        return np.zeros(BUCKETS, np.int64), n
    g, r = good[:-1], raw[:-1]
    ratio = np.log((g + ALPHA) / (g.sum() + ALPHA * BUCKETS)) - np.log((r + ALPHA) / (r.sum() + ALPHA * BUCKETS))
    return np.round(ratio * 1e6).astype(np.int64), math.floor(n * int(good[-1]) / int(labelled[-1]) + 0.5)


def scored(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, key), both in millionths."""
    sent = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words()
        for b in small(batches):
            ids = b["doc_id"].to_pylist()
            s = np.array([int(sent.value[features(t, seen)].sum()) for t in b["text"].to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array(s + np.array([gumbel(i) for i in ids], np.int64))], ["doc_id", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, log_weight long, key long")


def limit_of(keys: DataFrame, k: int) -> tuple[int, list[int | None]] | None:
    """The k-th largest key, and the doc_ids that are taken of the rows with it; None if all are taken. keys: (doc_id, key), written."""
    if k >= keys.count():
        return None
    up = keys.select("doc_id", "key", (F.col("key") + F.lit(1 << 62)).alias("x"))
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        here = up.filter(F.shiftrightunsigned("x", shift + 16) == prefix) if shift < 48 else up
        digits = here.groupBy(F.shiftrightunsigned("x", shift).bitwiseAND(F.lit(0xFFFF)).alias("d")).agg(F.count("*").alias("n")).collect()
        for d in sorted(digits, key=lambda r: -r["d"]):
            if d["n"] >= left:
                break
            left -= d["n"]
        prefix = (prefix << 16) | d["d"]
    key = prefix - (1 << 62)
    ties = keys.filter(F.col("key") == key).orderBy(F.asc_nulls_first("doc_id")).limit(max(1, left)).select("doc_id").collect()
    return key, [r["doc_id"] for r in ties] if left else []


def taken(limit: tuple[int, list[int | None]] | None) -> F.Column:
    if limit is None:
        return F.lit(True)
    key, ties = limit
    last = ties[-1] if ties else None
    tie = F.col("doc_id").isNull() if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(True))
    return (F.col("key") > key) | ((F.col("key") == key) & (tie if ties else F.lit(False)))


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, log_weight) of the sampled documents."""
    w, share = weights(docs, labels)
    keys = written(scored(docs, w), "keys")
    limit = limit_of(keys, share if k is None else k)
    return keys.filter(taken(limit)).select("doc_id", (F.col("log_weight") / 1e6).alias("log_weight"))


def sample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """docs, all columns, that are sampled. Keys are worked out again where a row is read, so that no text is shuffled."""
    w, share = weights(docs, labels)
    limit = limit_of(written(scored(docs, w).select("doc_id", "key"), "keys"), share if k is None else k)
    if limit is None:
        return docs
    key, ties = limit
    sent = docs.sparkSession.sparkContext.broadcast(w)
    last = ties[-1] if ties else None

    def kept(i: int | None, x: int) -> bool:
        return x > key or (x == key and bool(ties) and (i is None or (last is not None and i <= last)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words()
        for b in small(batches):
            ids = [None if i is None else int(i) for i in b["doc_id"].to_pylist()]
            yield b.filter(pa.array([kept(i, int(sent.value[features(t, seen)].sum()) + gumbel(i)) for i, t in zip(ids, b["text"].to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


SQL = rf"""
    WITH lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    tok AS (SELECT doc_id, text, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+'), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h0 FROM documents),
    rep AS (SELECT doc_id, list_transform(h0, lambda x, i: CASE WHEN i > 1 AND h0[i - 1] = x THEN ('0x' || substr(md5(chr(0) || 'again'), 1, 8))::BIGINT ELSE x END) AS h FROM tok),
    f AS (SELECT doc_id, list_concat(list_transform(h, lambda x: x % {BUCKETS}), list_transform(h[:-2], lambda x, i: (x * {MUL} + h[i + 1]) % {BUCKETS})) AS fs FROM rep),
    e AS (SELECT f.doc_id, unnest(fs) AS b, coalesce(quality, 0) AS good FROM f LEFT JOIN lab USING (doc_id)),
    m AS (SELECT b, sum(good) AS g, count(*) AS r FROM e GROUP BY b),
    tot AS (SELECT sum(g) AS gs, sum(r) AS rs FROM m),
    w AS (SELECT b, CASE WHEN gs = 0 THEN 0 ELSE round(1e6 * (ln((g + {ALPHA}) / (gs + {ALPHA * BUCKETS})) - ln((r + {ALPHA}) / (rs + {ALPHA * BUCKETS}))))::BIGINT END AS w FROM m, tot),
    s AS (SELECT doc_id, sum(w)::BIGINT AS lw FROM e JOIN w USING (b) GROUP BY doc_id),
    k AS (SELECT d.doc_id, coalesce(lw, 0) AS lw, coalesce(lw, 0) + round(-1e6 * ln(-ln((('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS key FROM documents d LEFT JOIN s USING (doc_id)),
    n AS (SELECT floor((SELECT count(*) FROM documents) * count(*) FILTER (quality = 1) / count(*) + 0.5) AS n FROM lab JOIN documents USING (doc_id))
    SELECT doc_id, lw / 1e6 AS log_weight FROM (SELECT *, row_number() OVER (ORDER BY key DESC, doc_id) AS rank FROM k) WHERE rank <= (SELECT n FROM n)"""
