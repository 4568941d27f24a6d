import random
import re
from collections import defaultdict

import pytest
from conftest import SMALL

from lakeglass.llm import packing as P
from lakeglass.llm import queries as Q


def pieces_of(rows):
    bins, of = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
        of[r["doc_id"]].append((r["start"], r["n_words"]))
    return bins, of


def check(rows, words, capacity):
    """Every word of every row once, no bin over capacity, slots and sizes right."""
    bins, of = pieces_of(rows)
    for rs in bins.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert {r["bin_words"] for r in rs} == {sum(r["n_words"] for r in rs)} and rs[0]["bin_words"] <= capacity
    for i, ns in words.items():
        want = sorted((s, min(capacity, n - s)) for n in ns for s in range(0, n, capacity))
        assert sorted(of[i]) == want
    assert sum(map(len, of.values())) == sum(-(-n // capacity) for ns in words.values() for n in ns)
    return len(bins)


def test_best_fit_equals_plain_search():
    r = random.Random(3)
    for _ in range(200):
        c = r.randint(1, 60)
        sizes = sorted((r.randint(1, c) for _ in range(r.randint(0, 80))), reverse=True)
        rooms, want = [], []
        for n in sizes:
            fit = [b for b, x in enumerate(rooms) if x >= n]
            if fit:
                least = min(rooms[b] for b in fit)
                rooms[next(b for b in fit if rooms[b] == least)] -= n
            else:
                rooms.append(c - n)
        got = P.best_fit(sizes, c)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= c for b in got)
        assert sorted(c - sum(sizes[i] for i in b) for b in got) == sorted(rooms)


@pytest.mark.parametrize("per_group,fan", [(20_000, 4), (10, 2), (7, 8)])
def test_whole_table(spark, per_group, fan):
    docs = Q.table(spark, SMALL, "documents")
    words = {r["doc_id"]: [len(re.findall(r"\S+", r["text"]))] for r in docs.collect()}
    n = check(P.packed(docs, per_group=per_group, fan=fan).collect(), words, P.CAPACITY)
    total = sum(n[0] for n in words.values())
    assert n <= (1.05 if per_group == P.PER_GROUP else 1.3) * total / P.CAPACITY + 2


def test_edge_cases(spark):
    rows = [(1, "a " * 25), (2, None), (3, ""), (4, "  \n "), (None, "x y z"), (5, "b c"), (5, "b c"), (6, "w" * 100_000), (7, "a b c d e f g h i j"), (8, "a " * 20), (8, "a " * 20)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "p") for r in rows], "doc_id long, text string, n int, g int, row int, pieces string")
    got = P.packed(df, capacity=10, per_group=3, fan=2).collect()
    check(got, {1: [25], None: [3], 5: [2, 2], 6: [1], 7: [10], 8: [20, 20]}, 10)
    assert P.packed(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        P.packed(df, capacity=0)
