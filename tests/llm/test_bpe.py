import random

from conftest import SMALL

from lakeglass.llm import bpe as B
from lakeglass.llm import queries as Q


def test_whole_table_equals_the_library_and_comes_back(spark):
    enc = B.encoder(B.ranks_of(B.VOCABULARY))
    text = {r["doc_id"]: r["text"] for r in Q.table(spark, SMALL, "documents").collect()}
    rows = Q.QUERIES["op2_bpe"](spark, SMALL).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r["ids"] == enc.encode_ordinary(text[r["doc_id"]]) and r["decoded"] == text[r["doc_id"]] and r["n_tokens"] == len(r["ids"])


def test_any_text_comes_back(spark):
    r = random.Random(1)
    marks = ["a", "Ab", "é", "ß", "中", "😀", " ", "\n", "\t", "\r", " ", "　", "'s", "'LL", "123", "!?", "\x00", "<|endoftext|>", "é", "‍", " ", "_"]
    docs = [(i, "".join(r.choices(marks, k=r.randint(1, 60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (None, "no id"), (902, "same"), (902, "same"), (903, "word " * 200_000), (904, "x" * 20_000), (905, "   "), (906, "".join(chr(c) for c in range(1, 0x2FF)))]
    df = spark.createDataFrame([(*d, [1], "b", 3) for d in docs], "doc_id long, text string, ids array<int>, block string, n_tokens int")
    got = B.decoded(B.encoded(df, block_bytes=4_000)).collect()
    assert sorted(((r["doc_id"], r["decoded"]) for r in got), key=repr) == sorted(docs, key=repr)
    enc = B.encoder(B.ranks_of(B.VOCABULARY))
    for row in got:
        assert row["ids"] == (None if row["decoded"] is None else enc.encode_ordinary(row["decoded"]))
    assert B.round_trip(df.limit(0)).collect() == []
    assert B.round_trip(df).columns == ["doc_id", "ids", "n_tokens", "decoded"]


def test_decoding_other_ids(spark):
    df = spark.createDataFrame([(1, [255, 64], "old"), (2, None, "old"), (3, [], "old")], "doc_id long, ids array<int>, decoded string")
    ranks = {v: k for k, v in B.ranks_of(B.VOCABULARY).items()}
    got = {r["doc_id"]: r["decoded"] for r in B.decoded(df).collect()}
    assert got == {1: (ranks[255] + ranks[64]).decode("utf-8", "replace"), 2: None, 3: ""}
