"""Sections of a filing, kept as an array of structs (item, start, end, title) in the order of start: nothing is exploded or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeglass.functions.items import item_order, standard_title
from lakeglass.functions.text import col, first_sentence, let, once

HEADER = r"(?imdU)^\s*item\s+(\d{1,2}[a-c]?)\b\.?\s*(.*?)\s*$"


def headers(text: str | Column) -> Column:
    """All header matches (item, start, title) in order. Offsets come from the lengths of matches and of what is between them."""
    t = col(text)

    def found(between: Column, whole: Column) -> Column:
        # Running sums in one pass: each step appends the next start.
        steps = F.zip_with(between, whole, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(steps, start, lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["g"])).alias("out")))["out"]
        # A match matches by itself with the same groups, so the text is gone through for its matches once.
        return F.zip_with(whole, F.slice(starts, 1, F.size(whole)), lambda m, at: F.struct(F.upper(F.regexp_extract(m, HEADER, 1)).alias("item"), at.alias("start"), F.regexp_extract(m, HEADER, 2).alias("title")))

    return let(F.split(t, HEADER, -1), lambda between: let(F.regexp_extract_all(t, F.lit(HEADER), 0), lambda whole: found(between, whole)))


def section_map(text: str | Column) -> Column:
    """The last header of each item; a section ends where the next begins. Title: the header's, else the standard one, else Unknown.

    One pass over the headers from the last to the first; the state holds the codes seen and where the next section starts.
    """
    t = col(text)
    kind = "array<struct<item:string,start:int,end:int,title:string>>"
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.length(t).alias("next"), F.array().cast(kind).alias("out"))

    def step(s: Column, h: Column) -> Column:
        title = F.when(h["title"] != "", h["title"]).otherwise(standard_title(h["item"]))
        one = F.struct(h["item"].alias("item"), h["start"].alias("start"), s["next"].alias("end"), title.alias("title"))
        new = F.struct(F.concat(s["seen"], F.array(h["item"])).alias("seen"), h["start"].alias("next"), F.concat(F.array(one), s["out"]).alias("out"))
        return F.when(F.array_contains(s["seen"], h["item"]), s).otherwise(new)

    return F.aggregate(F.reverse(headers(t)), start, step, lambda s: s["out"])


def with_sections(filings: DataFrame, text: str = "text") -> DataFrame:
    """filings with total_chars and sections. Built in two steps, so that the matches are worked out once."""
    return filings.withColumn("total_chars", F.length(text)).withColumn("sections", once(section_map(text)))


def section_rows(filings: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item, title, chars, preview) of each section."""
    part = lambda s: F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])
    # Previews are made before sections become rows: no row carries the whole text.
    made = F.transform("sections", lambda s: F.struct(s["item"].alias("item"), s["title"].alias("title"), (s["end"] - s["start"]).alias("chars"), first_sentence(part(s)).alias("preview")))
    return filings.select(key, F.explode(made).alias("s")).select(key, "s.item", "s.title", "s.chars", "s.preview")


def section_totals(filings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, captured_chars, coverage, unassigned_chars)."""
    captured = F.aggregate("sections", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return filings.select(key, captured.alias("captured_chars"), F.round(F.coalesce(F.try_divide(captured, F.col("total_chars")), F.lit(0.0)), 6).alias("coverage"), (F.col("total_chars") - captured).alias("unassigned_chars"))


def top_sections(filings: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, rank, item, chars): the k largest of each filing, equal ones by start."""
    by_size = F.array_sort(F.transform("sections", lambda s: F.struct((s["start"] - s["end"]).alias("neg"), s["start"].alias("start"), s["item"].alias("item"))))
    rows = filings.select(key, F.posexplode(F.slice(by_size, 1, k)).alias("rank", "s"))
    return rows.select(key, (F.col("rank") + 1).alias("rank"), "s.item", (-F.col("s.neg")).alias("chars"))


def section_keys(filings: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, n_sections, first_keys): the count, and the first k codes sorted as strings."""
    return filings.select(key, F.size("sections").alias("n_sections"), F.slice(F.array_sort(F.transform("sections", lambda s: s["item"])), 1, k).alias("first_keys"))


def key_item_status(filings: DataFrame, items: tuple[str, ...] = ("1", "1A", "7", "8"), key: str = "doc_id", least: int = 1) -> DataFrame:
    """(key, item, status): MISSING, or the number of characters, or 'present' if it has fewer than least."""
    wanted = F.explode(F.array(*map(F.lit, items))).alias("item")
    rows = filings.select(key, "sections", wanted)
    s = F.get(F.filter("sections", lambda x: x["item"] == F.col("item")), F.lit(0))
    n = s["end"] - s["start"]
    return rows.select(key, "item", F.when(s.isNull(), "MISSING").when(n < least, "present").otherwise(F.concat(n.cast("string"), F.lit(" chars"))).alias("status"))


def ordered_items(sections: DataFrame, column: str = "item") -> DataFrame:
    return sections.orderBy(*item_order(F.col(column)))
