import struct

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lakeglass.llm import bpe
from lakeglass.llm import queries as Q
from lakeglass.llm import records as R


def plain_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    raw = np.frombuffer(b"123456789", np.uint8)
    assert R.crc32c(raw, np.array([0]), np.array([9]))[0] == 0xE3069283
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 40_000, dtype=np.uint8)
    ends = np.array([0, 1, 3, 4, 5, 8, 511, 512, 513, 1024, 1025, 2500, 5000, 0])
    starts = r.integers(0, 30_000, len(ends))
    got = R.crc32c(data, starts, starts + ends)
    assert got.tolist() == [plain_crc(data[s : s + n].tobytes()) for s, n in zip(starts, ends)]


def test_round_trip_in_shuffled_order(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    docs = Q.table(spark, SMALL, "documents").repartition(3)
    index = R.write_records(docs, folder)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    enc = bpe.encoder(bpe.ranks_of(bpe.VOCABULARY))
    got = R.read_records(index.orderBy(F.xxhash64("doc_id")).repartition(5), folder).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: enc.encode_ordinary(t) for i, t in text.items()}
    assert len(got) == len(text) and not list((tmp_path / "out/records").glob("_*"))


def test_files_follow_the_format(spark, tmp_path):
    R.write_records(Q.table(spark, SMALL, "documents"), f"file://{tmp_path}/out")
    mask = lambda c: (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    n = 0
    for p in (tmp_path / "out/records").iterdir():
        raw, at = p.read_bytes(), 0
        while at < len(raw):
            (size,), (a,) = struct.unpack_from("<Q", raw, at), struct.unpack_from("<I", raw, at + 8)
            assert a == mask(plain_crc(raw[at : at + 8]))
            if n < 20:
                assert struct.unpack_from("<I", raw, at + 12 + size)[0] == mask(plain_crc(raw[at + 12 : at + 12 + size]))
            at, n = at + 16 + size, n + 1
        assert at == len(raw)
    assert n == 200


def test_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "word " * 200_000), (5, "é😀")]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, shard string, record int, length int")
    folder = f"file://{tmp_path}/a"
    index = R.write_records(df, folder)
    assert sorted(((r["doc_id"], r["n_tokens"] is None) for r in index.collect()), key=repr) == sorted(((i, t is None) for i, t in rows), key=repr)
    ranks = {v: k for k, v in bpe.ranks_of(bpe.VOCABULARY).items()}
    got = [(r["doc_id"], b"".join(ranks[i] for i in r["ids"]).decode()) for r in R.read_records(index, folder).collect()]
    assert sorted(got, key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert R.write_records(df.limit(0), f"file://{tmp_path}/b").collect() == []
    with pytest.raises(ValueError):
        R.write_records(df, f"file://{tmp_path}/c", width=1)
    shard = next((tmp_path / "a/records").iterdir())
    raw = bytearray(shard.read_bytes())
    raw[-10] ^= 1
    shard.write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        R.read_records(index, folder).collect()


def test_whole_table(spark):
    rows = Q.QUERIES["op5_records"](spark, SMALL).collect()
    assert len(rows) == 200 and all(r["length"] == R.WIDTH * r["n_tokens"] for r in rows)
