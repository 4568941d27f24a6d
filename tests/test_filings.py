"""Extraction, sections, gates, windows and sources on texts of our own, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lakeglass.functions import text as X
from lakeglass.functions.items import item_order, standard_items
from lakeglass.operators import chunking as C
from lakeglass.operators import gates as G
from lakeglass.operators import manifest as M
from lakeglass.operators import sections as S
from lakeglass.operators import serve
from lakeglass.sources import filings as L

HEADER = re.compile(r"^\s*item\s+(\d{1,2}[a-c]?)\b\.?\s*(.*?)\s*$", re.I | re.M)


def find(text):
    last = {}
    for m in HEADER.finditer(text):
        last[m[1].upper()] = m
    rows = sorted(last.items(), key=lambda kv: kv[1].start())
    ends = [m.start() for _, m in rows[1:]] + [len(text)]
    return [(k, m.start(), e, m[2].strip() or standard_items().get(k, "Unknown")) for (k, m), e in zip(rows, ends)]


TEXTS = [
    "Item 1. Business\ncontents\nItem 7. MD&A\n\nItem 1. Business\nbody of one\n\n\nItem 7. MD&A\nbody", "Item\xa01A\xa0Risk\nx", "pre\n\n  \nitem 2\nTitle on the next line\nmore", "ITEM 1. A\nItem 1A. B\nItem 12D no\nsee item 9 here\nItem 99C\n",
    "", "no items", "Item 3\n", "\U0001f600 text\nItem 4. \U0001f600\nbody \U0001f600\nItem 5: x", "Item 6\n\n\nItem 6. again",
]


def test_sections_equal_a_plain_search(spark):
    r = random.Random(1)
    texts = TEXTS + ["\n".join(r.choice([f"Item {r.choice(list(standard_items()))}. T", "item 7", "  ", "words and words", "ITEM 10.", "x Item 3"]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    df = S.with_sections(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x["doc_id"]: [(s["item"], s["start"], s["end"], s["title"]) for s in x["sections"]] for x in df.collect()}
    assert got == {i: find(t) for i, t in enumerate(texts)}


def test_very_long_texts(spark):
    df = spark.createDataFrame([("<b>" * 200_000 + "x" + "\n" * 200_000 + "<p>" * 5 + "y " * 200_000,)], "t string")
    a, b = df.select(X.html_text_v2("t"), X.word_count("t")).first()
    assert a.startswith("x\n\n") and b > 200_000
    many = "\n".join(f"Item {i % 20 + 1}. t\nbody" for i in range(3000))
    assert len(S.with_sections(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()["sections"]) == 20


def gate(sections, total):
    if not total or not sections:
        return "no sections detected"
    size = {k: e - s for k, s, e, _ in sections}
    if (cov := sum(size.values()) / total) < 0.65:
        return f"low coverage ({cov:.1%})"
    big = max(size, key=size.get)
    seven = size.get("7", 0)
    if size[big] / total > 0.5 and not (big in ("8", "15") and size[big] / total <= 0.75 and len(size) >= 12 and seven >= 5000):
        return f"section dominance: Item {big} ({size[big] / total:.1%})"
    return "all signals pass" if seven >= 5000 else f"Item 7 too small ({seven:,} chars)"


def maps():
    r = random.Random(2)
    out = [([], 0), ([], 10)]
    for _ in range(300):
        items = r.sample(list(standard_items()), r.choice([3, 9, 10, 11, 12, 15]))
        at = r.choice([0, 100, 40_000])
        rows = []
        for k in items:
            n = r.choice([10, 4999, 5000, 6000, 50_000, 90_000 if k in ("8", "15") else 20])
            rows.append((k, at, at + n, "t"))
            at += n
        out.append((rows, at))
    return out


def test_gates_equal_plain_rules(spark):
    cases = maps()
    df = spark.createDataFrame([(i, rows, total) for i, (rows, total) in enumerate(cases)], "i int, sections array<struct<item:string,start:int,end:int,title:string>>, total_chars int")
    seen = set()
    for r in G.routed(df).collect():
        rows, total = cases[r["i"]]
        want = gate(rows, total)
        seen.add(want.split(" (")[0].split(":")[0])
        assert r["quality_check_reason"] == want
        size = {k: e - s for k, s, e, _ in rows}
        usable = bool(total and rows) and len(rows) >= 10 and sum(size.values()) / total >= 0.5 and any(size.get(k, 0) >= 5000 for k in ("1", "1A", "7", "8"))
        assert r["method_used"] == ("section_aware" if want == "all signals pass" else "hybrid_section_aware" if usable else "fixed_size")
        assert r["item_7_chars"] == (size.get("7", 0) if total and rows else 0)
        assert r["largest_section_item"] == (max(size, key=size.get) if total and rows else "")
    assert seen == {"no sections detected", "low coverage", "section dominance", "Item 7 too small", "all signals pass"}


@pytest.mark.parametrize("n", [0, 1, 448, 449, 500, 512, 513, 960])
def test_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([("T", "10-K", "A", " ".join(words))], "ticker string, filing_type string, accession string, text string")
    got = sorted(C.fixed_chunks(df).collect(), key=lambda r: r["chunk_id"])
    want = [words[i : i + 512] for i in range(0, n, 448)]
    assert [r["text"].split() for r in got] == want and [r["chunk_id"] for r in got] == [f"T_A_fixed_{i:04d}" for i in range(len(want))]


def test_short_tails_are_joined(spark):
    text = "Item 1. B\n" + " ".join(f"w{i}" for i in range(22))
    df = S.with_sections(spark.createDataFrame([("T", "10-K", "A", text)], "ticker string, filing_type string, accession string, text string")).withColumn("method_used", F.lit("section_aware"))
    plain, joined = (sorted(C.section_chunks(df, 10, 2, least=n).collect(), key=lambda r: r["chunk_id"]) for n in (0, 5))
    assert [r["token_count"] for r in plain] == [10, 10, 9, 1] and [r["token_count"] for r in joined] == [10, 10, 9]
    assert joined[-1]["text"].split()[-1] == "w21"


def test_bpe_windows(spark):
    path, pattern = "/opt/tokenizers/byte_bpe_50k.tiktoken", r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    df = spark.createDataFrame([("some text, é and <|endoftext|>",), ("",), (None,)], "t string")
    rows = df.select("t", C.bpe_encode(path, pattern)("t").alias("ids")).withColumn("back", C.bpe_decode(path)("ids")).collect()
    assert all(r["back"] == (r["t"] or "") for r in rows)


def test_submissions_end_to_end(spark, tmp_path):
    body = "".join(f"<p>Item {k}. {t}</p><p>{'word ' * 1500}</p>" for k, t in standard_items().items())
    doc = lambda kind, text: f"<DOCUMENT>\n<TYPE>{kind}\n<TEXT>\n{text}\n</TEXT>\n</DOCUMENT>\n"
    files = {"AAA/10-K/0000000001-24-000001": "head\r\n" + doc("EX-21", "exhibit") + doc("10-K", "<XBRL><html>" + body + "</html></XBRL>"), "AAA/10-K/0000000001-23-000001": doc("8-K", "x"), "BBB/10-K/0000000002-24-000001": "<DOCUMENT>\n<TYPE>10-K\n</DOCUMENT>" + doc("10-K", "<p>no items</p>" * 50)}
    for k, v in files.items():
        (tmp_path / "in" / k).mkdir(parents=True)
        (tmp_path / "in" / k / "full-submission.txt").write_bytes(v.encode() + b"\xff\xfe")
    (tmp_path / "in" / "stray.txt").write_text("x")
    stats = {r["accession"]: r for r in serve.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert {k: v["method_used"] for k, v in stats.items()} == {"0000000001-24-000001": "section_aware", "0000000001-23-000001": None, "0000000002-24-000001": "fixed_size"}
    assert "no document" in stats["0000000001-23-000001"]["error"] and stats["0000000001-24-000001"]["sections_detected"] == 23
    chunks = L.read_chunks(spark, str(tmp_path / "out/chunks"))
    assert chunks.count() == sum(r["chunks_produced"] or 0 for r in stats.values()) and chunks.filter("char_end <> length(text)").isEmpty()
    index = serve.index(spark, str(tmp_path / "out/chunks"), str(tmp_path / "ix"))
    top = serve.ask(spark, "Item 7 MD&A", index, 3).collect()
    assert len(top) == 3
    again = type(index)()
    with pytest.raises(RuntimeError):
        again.retrieve(None)
    again.load(str(tmp_path / "ix"), spark)
    assert serve.ask(spark, "Item 7 MD&A", again, 3).collect() == top
    m = M.manifest(serve.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out2")))
    L.write_manifest(m, str(tmp_path / "m"))
    back = L.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(r["filing_id"] for r in back.collect()) == ["AAA_0000000001-24-000001", "BBB_0000000002-24-000001"]


def test_stats_lines(spark, tmp_path):
    row = ("T", "10-K", "A", 10, 1, False, "Item 7 too small (2,600 chars)", "fixed_size", 1, 0.5, "8", 0.25, 2600, None)
    df = spark.createDataFrame([row], L.STATS)
    assert L.stats_lines(df).first()[0] == "T,10-K,A,10,1,false,Item 7 too small (2;600 chars),fixed_size,1,0.5,8,0.25,2600,"
    L.write_stats(df, str(tmp_path / "s"))
    back = L.read_stats(spark, str(tmp_path / "s")).first()
    assert back["quality_check_reason"] == "Item 7 too small (2;600 chars)" and back["largest_section_item"] == "8"


def test_questions(spark, tmp_path):
    pair = {"qa_id": "q1", "question": "?", "gold_answer": "!", "gold_evidence": [{"chunk_id": "c", "filing_accession": "a", "ticker": "T", "section": None, "quote": None}], "question_type": "factual_lookup", "difficulty": "easy", "notes": None}
    (tmp_path / "qa.jsonl").write_text(json.dumps(pair) + "\n\n{broken\n" + json.dumps(pair | {"qa_id": "q2", "difficulty": "hard"}) + "\n")
    lines = L.qa_lines(spark, str(tmp_path / "qa.jsonl"))
    assert [r["line"] for r in lines.orderBy("line").collect()] == [1, 3, 4]
    qa = L.QADataset(L.QADataset.load(spark, str(tmp_path / "qa.jsonl")).rows.filter("qa_id IS NOT NULL"))
    assert len(qa) == 2 and len(qa.filter(difficulty="hard")) == 1 and len(list(qa)) == 2
    qa.save(str(tmp_path / "saved"))
    assert len(L.QADataset.load(spark, str(tmp_path / "saved"))) == 2


def test_filing_years_and_item_order(spark):
    df = spark.createDataFrame([("0000000001-24-000001",), ("x-ab-1",), ("none",), ("a-5-b",)], "a string")
    assert [r[0] for r in df.select(M.filing_year("a")).collect()] == ["2024", "unknown", "unknown", "unknown"]
    items = spark.createDataFrame([(k,) for k in sorted(standard_items())], "item string")
    assert [r["item"] for r in items.orderBy(*item_order(F.col("item"))).collect()] == list(standard_items())
    assert serve.health() == {"status": "ok"} and serve.ask_endpoint("q")["config"] == "hybrid"
