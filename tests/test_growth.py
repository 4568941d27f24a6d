"""Plans whose cost grows no faster than the input."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lakeglass.functions.text import let
from lakeglass.operators import chunking
from lakeglass.plans import documents as D
from lakeglass.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["a14_of_interest", "a16_relaxed_rows", "a17_item_composition", "a18_top_items", "a20_recipe_strict", "c9_batch_summary", "r11_strategy_subset", "s7_chunk_defaults"])
def test_headers_are_matched_once_for_a_text(spark, name):
    """The pattern stands in the plan for one split, one match and two groups of the match, and not again in a filter."""
    made = plan(registry.queries()[name](spark, SMALL))
    assert made.count("item\\s+(") == 4


def test_let_and_windows_name_their_tokens_once(spark):
    df = spark.createDataFrame([("a b c d e",)], "text string")
    ws = df.select(chunking.windows(chunking.white_space_tokens("text"), 2, 1).alias("w"))
    assert plan(ws).count("split(") == 1
    assert [w["tokens"] for w in ws.first()["w"]] == [["a", "b"], ["b", "c"], ["c", "d"], ["d", "e"], ["e"]]
    assert df.select(let(F.col("text"), lambda x: F.concat(x, x)).alias("x")).first()["x"] == "a b c d ea b c d e"


def test_counted_stats_are_those_of_the_chunks(spark):
    """Also for filings that share an accession, have none, have no text or no tier."""
    f = D.routed(spark, SMALL).filter("doc_id < 60").withColumn("accession", F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") % 40).cast("string")))
    f = f.withColumn("method_used", F.when(F.col("doc_id") % 11 != 0, F.col("method_used"))).withColumn("text", F.when(F.col("doc_id") % 13 != 0, F.col("text")))
    f = f.withColumn("sections", F.when(F.col("text").isNotNull(), F.col("sections")))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(chunking.counted_stats(f, 64, 8)) == rows(chunking.corpus_stats(f, chunking.chunks(f, 64, 8)))


def test_offsets_of_a_long_text(spark):
    text = "".join(f"{' ' * (i % 3 + 1)}w{i}" for i in range(3000)) + " \n"
    got = chunking.fixed_chunks_with_offsets(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string"), 64, 8).orderBy("i").collect()
    assert len(got) == -(-3000 // 56) and [r["i"] for r in got] == list(range(len(got)))
    for r in got:
        words = [f"w{j}" for j in range(r["i"] * 56, min(r["i"] * 56 + 64, 3000))]
        assert text[r["char_start"] : r["char_end"]] == r["text"] and r["text"].split() == words and r["token_count"] == len(words) and r["text"] == r["text"].strip()
