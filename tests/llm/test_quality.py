import math
import random

import numpy as np
from conftest import SF, SMALL, rows_of

from lakeglass.llm import quality as X
from lakeglass.llm import queries as Q


def test_equals_sql(spark, duck):
    got = Q.QUERIES["op4_importance_resampling"](spark, SF)
    want = duck.execute(Q.ORACLES["op4_importance_resampling"])
    assert got.columns == [c[0] for c in want.description]
    assert rows_of(got.collect()) == rows_of(want.fetchall())


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = Q.table(spark, SF, "documents"), Q.table(spark, SF, "labels")
    kept = {r["doc_id"] for r in Q.QUERIES["op4_importance_resampling"](spark, SF).collect()}
    q = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = [i for i in q if q[i] == 1], [i for i in q if q[i] == 0]
    assert sum(i in kept for i in good) / len(good) > 0.95
    assert sum(i in kept for i in bad) / len(bad) < 0.2
    assert {r["doc_id"] for r in X.sample(docs, labels).collect()} == kept


def test_limit_equals_sorting(spark):
    r = random.Random(5)
    rows = [(r.choice([None, *range(50)]), r.choice([-(10**13), -5, 0, 0, 0, 3, 10**9, r.randint(-100, 100)])) for _ in range(300)]
    keys = spark.createDataFrame(rows, "doc_id long, key long").cache()
    order = sorted(rows, key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
    for k in (0, 1, 7, 60, 150, 299, 300, 400):
        got = sorted(map(tuple, keys.filter(X.taken(X.limit_of(keys, k))).collect()), key=repr)
        want = [x for x in rows if x in set(order[:k])]
        assert got == sorted(want, key=repr)


def test_gumbel_draws_in_proportion():
    u = np.array([X.gumbel(i) / 1e6 for i in range(20_000)])
    assert abs(u.mean() - 0.5772) < 0.05 and abs(u.var() - math.pi**2 / 6) < 0.1
    w = np.log(np.array([1.0, 3.0]))
    wins = (w[1] + u[1::2] > w[0] + u[::2]).mean()
    assert abs(wins - 0.75) < 0.02


def test_edge_cases(spark):
    docs = [(i, f"good words here {i}", 0, "x") for i in range(20)] + [(i, f"## !! ## %% {i}", 1, "y") for i in range(20, 30)]
    docs += [(40, None, 2, ""), (41, "", 2, ""), (None, "good words here", 2, ""), (3, "good words here 3", 3, ""), (42, "filler matter " * 200, 4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, key int, bucket string")
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(30)] + [(None, 1, 0), (24, None, 0)], "doc_id long, quality int, toxic int")
    got = X.sample(df, labels)
    assert got.columns == df.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} >= {*range(20), None} and not {r["doc_id"] for r in rows} & {*range(20, 30), 42}
    assert sorted([r["doc_id"] for r in rows], key=repr) == sorted([r["doc_id"] for r in X.resampled(df, labels).collect()], key=repr)
    assert X.sample(df.limit(0), labels).collect() == [] and X.resampled(df.limit(0), labels).collect() == []
    assert X.sample(df, labels.limit(0)).count() == len(docs)
    assert X.sample(df, labels, k=0).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word other, " * 300_000), (2, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert X.resampled(df, labels).count() == 1
