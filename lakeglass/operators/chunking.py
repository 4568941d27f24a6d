"""Token windows over texts and over their sections. Windows are cut inside arrays and exploded last, so no text is shuffled and the running index of a filing needs no window function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.functions.items import standard_title
from lakeglass.functions.text import col, let, once, word_count

SIZE, OVERLAP = 512, 64


def white_space_tokens(text: str | Column) -> Column:
    """The default tokenizer: words by white space. They are joined again by one space."""
    return F.array_remove(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), "")


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def bpe_encode(rank_file: str, pattern: str):
    """A column function: token ids by a byte-level BPE vocabulary. rank_file: lines of base64 and rank. The text of special tokens is ordinary text."""
    import base64

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield texts.map(lambda t: enc.encode_ordinary(t or ""))

    return encode


def bpe_decode(rank_file: str):
    """The inverse: bytes that a window's edge cuts become U+FFFD."""
    import base64

    with open(rank_file, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in parts:
            yield ids.map(lambda x: b"".join(table[int(i)] for i in x).decode("utf-8", "replace"))

    return decode


def windows(tokens: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array of (at, tokens): windows from 0, size - overlap, …; the last can be shorter, and lie in the one before. No tokens, no window."""
    step = size - overlap
    if step < 1:
        raise ValueError("overlap must be less than size")
    starts = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return let(tokens, lambda tk: F.transform(starts(F.size(tk)), lambda i: F.struct(i.alias("at"), F.slice(tk, i + 1, size).alias("tokens"))))


KEYS = ("ticker", "filing_type", "accession")


def fixed_chunks(filings: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text", with_accession: bool = True) -> DataFrame:
    """Fixed windows over the whole text. Ids end in fixed_0000, …"""
    return _rows(filings.withColumn("method_used", F.lit("fixed_size")), _fixed_windows(size, overlap, text), with_accession)


def section_chunks(filings: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text", with_accession: bool = True, least: int = 0) -> DataFrame:
    """Windows inside each section, in the order of sections; the index runs on across sections. Needs sections and method_used.

    Windows that are shorter than least are joined to the one before, if the section has one.
    """
    return _rows(filings, _section_windows(size, overlap, text, least), with_accession)


def _fixed_windows(size: int, overlap: int, text: str) -> Column:
    return F.transform(windows(white_space_tokens(text), size, overlap), lambda w: F.struct(F.lit(None).cast("string").alias("item"), w["tokens"].alias("tokens")))


def _section_windows(size: int, overlap: int, text: str, least: int = 0) -> Column:
    cut = lambda s: F.transform(_merged(windows(white_space_tokens(_part(text, s)), size, overlap), least), lambda w: F.struct(s["item"].alias("item"), w["tokens"].alias("tokens")))
    return F.flatten(F.transform("sections", cut))


def _part(text: str, section: Column) -> Column:
    return F.substring(F.col(text), section["start"] + 1, section["end"] - section["start"])


def _rows(filings: DataFrame, cut: Column, with_accession: bool = True) -> DataFrame:
    """A row for each (item, tokens) of an array; without an item it is a window over the whole text."""
    rows = filings.select(*KEYS, "method_used", F.posexplode(cut).alias("i", "w"))
    name = ["ticker", "accession"] if with_accession else ["ticker"]
    kind, label = F.concat(F.lit("item"), "w.item"), F.concat(F.lit("Item "), "w.item", F.lit(" - "), standard_title(F.col("w.item")))
    return rows.select(
        *KEYS, F.concat_ws("_", *name, F.coalesce(kind, F.lit("fixed")), F.format_string("%04d", "i")).alias("chunk_id"), join_tokens(F.col("w.tokens")).alias("text"),
        F.coalesce(label, F.concat(F.lit("chunk_"), "i")).alias("section_label"), F.col("method_used").alias("chunking_method"), F.size("w.tokens").alias("token_count"),
    )


def _merged(windows_: Column, least: int) -> Column:
    return windows_ if least < 1 else let(windows_, lambda ws: _with_tail(ws, least))


def _with_tail(ws: Column, least: int) -> Column:
    tail, n = F.element_at(ws, -1), F.size(ws)
    before = F.element_at(ws, F.lit(-2))
    # The overlap that the tail repeats is left out.
    joined = F.struct(before["at"].alias("at"), F.concat(before["tokens"], F.slice(tail["tokens"], F.greatest(before["at"] + F.size(before["tokens"]) - tail["at"], F.lit(0)) + 1, 1 << 30)).alias("tokens"))
    return F.when((n > 1) & (F.size(tail["tokens"]) < least), F.concat(F.slice(ws, 1, n - 2), F.array(joined))).otherwise(ws)


def chunks(filings: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """By tier: sections where the gates allow it, fixed windows elsewhere, in one pass. filings: as routed() returns them."""
    fixed = F.col("method_used") == "fixed_size"
    return _rows(filings.filter("method_used IS NOT NULL"), F.when(fixed, _fixed_windows(size, overlap, "text")).otherwise(_section_windows(size, overlap, "text")))


def chunk_count(size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> Column:
    """How many rows chunks() makes of a filing, by counting words; no window is cut."""
    n = lambda words: F.when(words > 0, F.floor((words - 1) / (size - overlap)) + 1).otherwise(0)
    sections = F.aggregate("sections", F.lit(0).cast("long"), lambda s, x: s + let(word_count(_part(text, x)), n))
    made = F.when(F.col("method_used") == "fixed_size", let(word_count(text), n)).when(F.col("method_used").isNotNull(), sections)
    return F.coalesce(made, F.lit(0)).cast("long")


def fixed_chunks_with_offsets(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, i, char_start, char_end, token_count, text): windows of words as they stand in the text, white space and all."""
    t, step = F.coalesce(F.col(text), F.lit("")), size - overlap
    gaps, words = F.split(t, r"(?U)\S++", -1), F.regexp_extract_all(t, F.lit(r"(?U)\S++"), 0)
    rows = docs.select(key, once(gaps).alias("gaps"), once(words).alias("words")).filter(F.size("words") > 0)
    # A piece is a word with the white space before it; of a window's steps, only sums over whole steps are added again.
    rows = rows.select(key, once(F.transform("gaps", lambda g: F.length(g))).alias("before"), once(F.zip_with(F.slice("gaps", 1, F.size("words")), "words", lambda g, w: F.concat(g, w))).alias("pieces"))
    joined = lambda at, n: F.array_join(F.slice("pieces", at + 1, n), "")
    starts = F.sequence(F.lit(0), F.size("pieces") - 1, F.lit(step))
    rows = rows.select("*", once(F.transform(starts, lambda at: F.length(joined(at, step)))).alias("steps"))

    def window(at: Column, i: Column) -> Column:
        gap = F.get("before", at)
        begin = F.aggregate(F.slice("steps", 1, i), F.lit(0), lambda s, x: s + x) + gap
        return let(F.substring(joined(at, size), gap + 1, F.lit((1 << 31) - 1)), lambda x: F.struct(begin.alias("char_start"), (begin + F.length(x)).alias("char_end"), F.least(F.lit(size), F.size("pieces") - at).alias("token_count"), x.alias("text")))

    rows = rows.select(key, F.posexplode(F.transform(starts, window)).alias("i", "w"))
    return rows.select(key, "i", "w.char_start", "w.char_end", "w.token_count", "w.text")


def chunk_summary(chunks: DataFrame, key: str = "accession") -> DataFrame:
    """(key, n_chunks, avg_chars): the mean in whole characters."""
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.floor(F.sum(F.length("text")) / F.count("*")).alias("avg_chars"))


def sample_chunks(filings: DataFrame, size: int = SIZE, overlap: int = OVERLAP, chars: int = 500, text: str = "text") -> DataFrame:
    """(accession, place, i, text): the first, middle and last window of each filing, cut to so many characters."""
    step = size - overlap
    rows = filings.select("accession", once(white_space_tokens(text)).alias("tk")).filter(F.size("tk") > 0)
    n = F.floor((F.size("tk") - 1) / step).cast("int") + 1
    # Only the three windows are cut, and no row carries all of them.
    cut = lambda i: F.substring(join_tokens(F.slice("tk", i * step + 1, size)), 1, chars)
    places = F.array(*(F.struct(F.lit(p).alias("place"), i.alias("i"), cut(i).alias("text")) for p, i in (("first", F.lit(0)), ("middle", F.floor(n / 2).cast("int")), ("last", n - 1))))
    return rows.select("accession", F.explode(places).alias("p")).select("accession", "p.place", "p.i", "p.text")


def corpus_stats(filings: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a filing, the fourteen columns of the stats table."""
    made = chunks.groupBy("accession").agg(F.count("*").alias("chunks_produced"))
    return _stats(filings.join(made, "accession", "left"))


def counted_stats(filings: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """corpus_stats of chunks(filings, size, overlap), without making them: the texts are gone through once, and none is shuffled."""
    rows = filings.select("ticker", "filing_type", "accession", *_GATED, chunk_count(size, overlap).alias("n"))
    # Filings of one accession share their chunks; those without one have none.
    made = F.when(F.col("accession").isNotNull(), F.sum("n").over(Window.partitionBy("accession")))
    return _stats(rows.withColumn("chunks_produced", made))


_GATED = ("total_chars", "sections_detected", "quality_check_passed", "quality_check_reason", "method_used", "captured_ratio", "largest_section_item", "largest_section_ratio", "item_7_chars")


def _stats(rows: DataFrame) -> DataFrame:
    return rows.select(
        "ticker", "filing_type", "accession", "total_chars", "sections_detected", "quality_check_passed", "quality_check_reason", "method_used",
        F.coalesce("chunks_produced", F.lit(0)).alias("chunks_produced"), "captured_ratio", "largest_section_item", "largest_section_ratio", "item_7_chars", F.lit("").alias("error"),
    )


def batch_summary(stats: DataFrame) -> DataFrame:
    """One row: filings that worked and failed, by tier with shares, and all chunks."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    n = F.count_if(ok)
    tiers = {t: F.count_if(ok & (F.col("method_used") == t)) for t in ("section_aware", "hybrid_section_aware", "fixed_size")}
    return stats.agg(
        n.alias("successful"), F.count_if(~ok).alias("failed"), *(x.alias(t) for t, x in tiers.items()), *(F.round(F.coalesce(F.try_divide(100.0 * x, n), F.lit(0.0)), 4).alias(f"{t}_pct") for t, x in tiers.items()),
        F.coalesce(F.sum(F.when(ok, F.col("chunks_produced"))), F.lit(0)).cast("long").alias("total_chunks"),
    )
