import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF, rows_of

from lakeglass.llm import queries as Q
from lakeglass.llm import topk as K
from lakeglass.llm.common import WORD


def test_equals_sql(spark, duck):
    got = Q.QUERIES["op3_topk_search"](spark, SF)
    want = duck.execute(Q.ORACLES["op3_topk_search"])
    assert got.columns == [c[0] for c in want.description]
    assert rows_of(got.collect()) == rows_of(want.fetchall())


def full(docs, queries, k):
    """Scores of all documents for all queries, by plain loops."""
    words = [WORD.findall((t or "").lower()) for _, t in docs]
    n, df = len(docs), Counter(w for ws in words for w in set(ws))
    mean = sum(map(len, words)) / n
    out = []
    for q, text in queries:
        for (i, _), ws in zip(docs, words):
            c = Counter(ws)
            parts = [np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (K.K1 + 1) / (c[w] + K.K1 * (1 - K.B + K.B * len(ws) / mean)) for w in WORD.findall((text or "").lower()) if c[w]]
            if parts:
                out.append((q, i, round(float(sum(parts)), 6)))
    best = {}
    for q, i, s in out:
        best.setdefault(q, []).append((-s, i is not None, i or 0, i))
    return sorted([(q, r + 1, x[3], -x[0]) for q, xs in best.items() for r, x in enumerate(sorted(xs)[:k])], key=repr)


@pytest.mark.parametrize("k", [1, 3, 500])
def test_equals_full_scoring(spark, monkeypatch, k):
    monkeypatch.setattr(K, "BLOCK", 4)
    r = random.Random(8)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(800)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(6)] + [(None, docs[7][1]), (7, docs[7][1]), (800, None), (801, ""), (802, "w1 w2 " * 100_000)]
    queries = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for i in range(20)] + [(50, "w1 w1 w1 w3"), (51, "zzz"), (52, ""), (53, None), (54, docs[7][1])]
    df = spark.createDataFrame([(*d, 1, 2.0, "t") for d in docs], "doc_id long, text string, rank int, score double, term string").repartition(5)
    qs = spark.createDataFrame([(*q, 9) for q in queries], "query_id long, text string, doc_id int")
    got = sorted(map(tuple, K.search(df, qs, k).collect()), key=repr)
    want = full(docs, queries, k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    assert K.search(df.limit(0), qs, k).collect() == [] and K.search(df, qs.limit(0), k).collect() == []


def test_blocks_are_passed_over(monkeypatch):
    r = random.Random(9)
    docs = [[f"w{r.randint(0, 300)}" for _ in range(40)] for _ in range(20_000)]
    for i in range(100, 115):
        docs[i] = ["rare", "words", "w1", "w2"] * 3
    index = K.Index.of(docs, list(range(len(docs))))
    df = Counter(w for d in docs for w in set(d))
    query = Counter(["rare", "words", "w1", "w2"])
    index.impacts(40.0, {w: float(np.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))) for w in query})
    assert [d for _, d in index.top(query, 10)] == list(range(100, 110))
    assert index.read < 0.1 * index.passed
