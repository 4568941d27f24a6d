import numpy as np
import pytest
from conftest import SF, rows_of

from lakeglass.llm import queries as Q
from lakeglass.llm import urls as U

URL_ROWS = [
    (1, "http://www.A.example.com/x/?utm_source=feed"), (2, "https://a.example.com:443/x.html#top"), (3, "https://m.a.example.com/x?ref=x"), (4, "https://a.example.com/x?b=2&a=1"),
    (5, "https://blog.a.example.com/x"), (6, None), (7, ""), (8, "no scheme"), (9, "https:///path"), (None, "http://bad.example.net/é"), (10, "http://x.bad.example.net/"), (10, "http://x.bad.example.net/"),
    (11, "http://notbad.example.net/"), (12, "http://long.example.org/" + "p" * 500_000), (13, "http://localhost/x"),
]


def plain(rows, entries):
    return sorted(((i, u, next(k for k in U.keys_of(c) if k in entries)) for i, u, c in rows if any(k in entries for k in U.keys_of(c))), key=repr)


@pytest.mark.parametrize("per_shard,digest", [(U.ENTRIES, U.digests), (1, U.digests), (2, lambda s: np.array([7 << 61] * len(s), np.uint64))], ids=["one shard", "shards", "all collide"])
def test_equals_plain_sets(spark, tmp_path, per_shard, digest):
    entries = ["a.example.com/x", "bad.example.net", "bad.example.net", None, "", "b.example.com/y?q=1", "long.example.org/" + "p" * 500_000, "localhost"]
    df = spark.createDataFrame([(*r, "e", "c") for r in URL_ROWS], "page_id long, url string, entry string, canonical string")
    folder = f"file://{tmp_path}/list"
    bits = U.build(spark.createDataFrame([(e, 1) for e in entries], "entry string, digest int"), folder, per_shard=per_shard, digest=digest)
    got = sorted(map(tuple, U.blocked(df, folder, bits, digest).collect()), key=repr)
    rows = [(r["page_id"], r["url"], r["c"]) for r in df.select("page_id", "url", U.canonical("url").alias("c")).collect()]
    assert got == plain(rows, {e for e in entries if e})
    assert [g[0] for g in got] == [1, 10, 10, 12, 13, 2, 3, None]
    assert U.blocked(df.limit(0), folder, bits, digest).collect() == []


def test_empty_list(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    bits = U.build(spark.createDataFrame([], "entry string"), folder)
    assert U.blocked(spark.createDataFrame(URL_ROWS, "page_id long, url string"), folder, bits).collect() == []


def test_equals_sql(spark, duck):
    got = Q.QUERIES["op9_url_filter"](spark, SF)
    want = duck.execute(Q.ORACLES["op9_url_filter"])
    assert got.columns == [c[0] for c in want.description]
    rows = got.collect()
    assert rows_of(rows) == rows_of(want.fetchall())
    assert {r["entry"] for r in rows} > set(U.HOSTS)
