"""Dense search in bounded memory, and labels as gold without pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
from conftest import SMALL, rows_of

from lakeglass.operators import dense, metrics
from lakeglass.operators.best import Best
from lakeglass.sources.tables import table


def test_a_task_holds_tiles_of_scores(spark):
    """4,000 queries and a batch of 10,000 vectors: all scores at once would be 320 MB."""
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(4000, 8)), rng.integers(-2, 3, size=(10_000, 8)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)[::-1].copy()), pa.array(list(v))], ["doc_id", "embedding"])
    tracemalloc.start()
    got = next(dense._searcher(np.arange(4000), q, 5)(iter([b])))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    docs, n = got["doc_id"].to_numpy().reshape(4000, 5), np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    unit = np.divide(v, n, out=np.zeros((10_000, 8)), where=n > 0)
    for i in (0, 17, 3999):
        s = np.round(unit @ q[i], 6) + 0.0
        assert list(docs[i]) == list(9_999 - np.lexsort((np.arange(10_000)[::-1], -s))[:5])


def test_best_breaks_ties_by_document_in_any_order():
    rng = np.random.default_rng(5)
    for docs in (np.arange(300), np.array([f"d{i:03}" for i in range(300)], object)):
        scores, order = rng.integers(-2, 3, size=(7, 300)).astype(float), rng.permutation(300)
        best = Best(7, 12, docs.dtype)
        for at in range(0, 300, 37):
            part = order[at : at + 37]
            for q in range(0, 7, 3):
                best.add(q, scores[q : q + 3, part], docs[part])
        for q in range(7):
            want = sorted(range(300), key=lambda i: (-scores[q, i], docs[i]))[:12]
            assert list(best.docs[q]) == [docs[i] for i in want]


def test_labels_judge_as_all_their_pairs_do(spark):
    e = table(spark, SMALL, "embeddings").filter("vec_id < 120").selectExpr("vec_id", "CASE WHEN vec_id % 17 <> 0 THEN CASE WHEN vec_id = 7 THEN 99 ELSE label END END AS label")
    asked = e.filter("vec_id % 3 = 1")
    ranked = spark.createDataFrame([(q, r + 1, (q * 7 + r * 11) % 130) for q in range(0, 110, 4) for r in range(8)] + [(1, 9, 1)], "query_id long, rank long, doc_id long").filter("query_id % 3 = 1")
    gold = metrics.gold_by_label(e, "label", "vec_id").filter("query_id % 3 = 1")
    want, got = metrics.judged(ranked, gold), metrics.judged_by_label(ranked, e, asked, "label", "vec_id")
    cols = ["query_id", "n_gold", "places"]
    assert rows_of(got.select(cols).collect()) == rows_of(want.select(cols).collect())
