from collections import Counter, defaultdict

from conftest import SMALL

from lakeglass.llm import queries as Q
from lakeglass.llm import transport as X


def expected(doc_id, text):
    """Units and faults as they were put in."""
    frames, fault, at = X.frames_of(doc_id, text)
    out = []
    for k, (pid, data, pts, dts, random) in enumerate(frames):
        lost = fault == "lost" and k == at and len(data) > 3 * 184
        out.append((pid, data, pts, dts, random, lost))
    return out


def test_whole_table_equals_what_was_put_in(spark):
    text = {r["doc_id"]: r["text"] for r in Q.table(spark, SMALL, "documents").collect()}
    got = defaultdict(list)
    for r in Q.QUERIES["op6_transport"](spark, SMALL).collect():
        got[r["doc_id"]].append(r)
    assert set(got) == set(text)
    faults = Counter()
    for i, t in text.items():
        faults[X.frames_of(i, t)[1]] += 1
        want = expected(i, t)
        for pid, kind in zip(X.PIDS, X.KINDS):
            rows = sorted((r for r in got[i] if r["pid"] == pid), key=lambda r: r["unit"])
            mine = [w for w in want if w[0] == pid]
            assert len(rows) == len(mine)
            for k, (r, w) in enumerate(zip(rows, mine)):
                assert (r["unit"], r["stream_type"], r["pts"], r["dts"], r["random_access"]) == (k, kind, w[2], w[3], w[4])
                if r["lost"]:
                    assert X.frames_of(i, t)[1] == "lost" and len(r["data"]) < len(w[1])
                else:
                    assert bytes(r["data"]) == w[1]
        assert sum(r["lost"] > 0 for r in got[i]) >= sum(w[5] for w in want)
    assert set(faults) == set(X.FAULTS)


def test_program_tables(spark):
    docs = Q.table(spark, SMALL, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in X.programs(X.muxed(docs)).collect():
        frames, fault, _ = X.frames_of(r["doc_id"], text[r["doc_id"]])
        assert (r["program"], dict(zip(X.PIDS, X.KINDS))[r["pid"]], r["bad_tables"]) == (1, r["stream_type"], 0)
        assert r["units"] == sum(f[0] == r["pid"] for f in frames)
        assert r["repeats"] <= (fault == "repeated") and r["gaps"] <= (fault == "lost")


def run(raw):
    d = X.Demuxer()
    d.feed(raw)
    return d.end(), d


def test_counters_flags_and_sync():
    text = "some words of a text " * 400
    raw = X.mux(None, text)
    clean = [raw[k : k + 188] for k in range(0, len(raw), 188) if raw[k] == 0x47]
    m = X.Muxer()
    for k in range(40):
        if k == 0:
            m.tables()
        m.unit(X.PIDS[0], b"x" * 700, 3000 * k, None, False)
    base, _ = run(b"".join(m.out))
    assert len(base) == 40 and not any(r[6] for r in base) and [r[3] for r in base] == [3000 * k for k in range(40)]
    one = lambda parts: run(b"".join(parts))
    assert sum(r[6] for r in one(m.out[:20] + m.out[21:])[0]) >= 1
    got, d = one(m.out[:20] + [m.out[19]] + m.out[20:])
    assert got == base and d.streams[X.PIDS[0]].repeats == 1
    got, d = one(m.out[:20] + [m.out[19]] * 2 + m.out[20:])
    assert sum(r[6] for r in got) >= 1 and d.streams[X.PIDS[0]].gaps >= 1
    empty = bytes([0x47, 1, 0, 0x20 | m.out[19][3] & 15, 183, 0]) + b"\xff" * 182
    assert one(m.out[:20] + [empty] + m.out[20:])[0] == base
    bad = bytearray(m.out[20])
    bad[1] |= 0x80
    assert sum(r[6] for r in one(m.out[:20] + [bytes(bad)] + m.out[21:])[0]) >= 1
    assert one(m.out[:20] + [b"\0\x47\0garbage\x47"] + m.out[20:])[0] == base
    assert one([b"\0" * 77] + m.out + [b"\x47tail"])[0] == base
    broken = bytearray(m.out[1])
    broken[20] ^= 1
    got, d = one([m.out[0], bytes(broken)] + m.out[2:])
    assert got == [] and d.bad_tables == 1
    assert clean


def test_wrap_of_time_stamps():
    m = X.Muxer()
    m.tables()
    for k in range(6):
        m.unit(X.PIDS[0], b"a", (X.WRAP - 6000 + 3000 * k) % X.WRAP, (X.WRAP - 7500 + 3000 * k) % X.WRAP, k == 0)
    got, _ = run(b"".join(m.out))
    assert [r[3] for r in got] == [X.WRAP - 6000 + 3000 * k for k in range(6)]
    assert [r[4] for r in got] == [X.WRAP - 7500 + 3000 * k for k in range(6)]


def test_edge_cases(spark):
    long = "long text " * 100_000
    rows = [(1, None), (2, b""), (3, b"no stream at all"), (4, X.mux(4, "short")), (4, X.mux(4, "short")), (None, X.mux(None, "no id")), (5, X.mux(5, long)), (6, b"\x47" * 1000)]
    df = spark.createDataFrame([(i, m, 7, "d", True) for i, m in rows], "doc_id long, media binary, pid int, data string, lost boolean")
    got = X.units(df).collect()
    assert {(r["doc_id"], bytes(r["data"])) for r in got if r["doc_id"] != 5} == {(4, b"short"), (None, b"no id")} and sum(r["doc_id"] == 4 for r in got) == 2
    parts = [r for r in got if r["doc_id"] == 5]
    assert len(parts) == 1000
    assert X.units(df.limit(0)).collect() == [] and X.programs(df.limit(0)).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r["doc_id"], None if r["media"] is None else bytes(r["media"])) for r in X.muxed(none).collect()} == {(1, None), (2, b"")}
