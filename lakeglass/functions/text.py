"""Scalar text functions as column expressions; none is a Python UDF. Repeated groups in patterns are possessive, so that long texts don't exhaust the stack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column) -> Column:
    """The same value, worked out in the step that names it and nowhere else.

    The optimizer moves filters below a step by putting its expressions in their place, as often as the filter names them, down to
    the patterns over a text. It leaves an expression alone that is not deterministic, and the number of a partition passes for that.
    """
    return F.when(F.spark_partition_id() >= 0, x)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x worked out once for a row, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def decode_text(content: str | Column) -> Column:
    """Bytes as UTF-8 without malformed parts, line ends as newline. A genuine U+FFFD goes too."""
    text = F.make_valid_utf8(col(content).cast("string"))
    return F.regexp_replace(F.replace(text, F.lit("�"), F.lit("")), r"\r\n?", "\n")


def char_count(text: str | Column) -> Column:
    return F.length(col(text))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit(r"(?U)\S++"))


def squeeze(text: Column) -> Column:
    """More than two newlines become two, then runs of spaces and tabs one space; in this order, so lines of spaces survive."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}+", "\n\n"), r"[ \t]++", " ")


def _entities(text: Column) -> Column:
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", "\u00a0"), ("#160", "\u00a0"), ("copy", "©"), ("middot", "·"), ("mdash", "—"), ("ndash", "–"), ("rsquo", "’"), ("lsquo", "‘"), ("rdquo", "”"), ("ldquo", "“"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(mark))
    return text


def _tags(text: Column) -> Column:
    """Runs of comments and tags become one newline, none at the edges."""
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "<c>")
    text = F.regexp_replace(text, r"(?:<[^>]*+>)++", "\n")
    return F.regexp_replace(text, r"\A\n|\n\z", "")


def html_text_v0(html: str | Column) -> Column:
    """All text nodes, those of scripts and styles too."""
    return squeeze(_entities(_tags(col(html))))


def html_text_v1(html: str | Column) -> Column:
    """Without scripts and styles."""
    return html_text_v0(F.regexp_replace(col(html), r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>", "<c>"))


def html_text_v2(html: str | Column) -> Column:
    """As v1, without the SEC's wrapper and the machine-readable blocks of inline XBRL; the text inside other ix tags stays."""
    bare = F.regexp_replace(col(html), r"(?i)</?XBRL>", "")
    return html_text_v1(F.regexp_replace(bare, r"(?is)<(ix:(?:hidden|references|resources|header))\b[^>]*+>.*?</\1\s*>", "<c>"))


def xbrl_contaminated(text: str | Column) -> Column:
    return F.contains(F.lower(F.substring(col(text), 1, 5000)), F.lit("us-gaap"))


def primary_document(submission: str | Column, doc_type: str | Column) -> Column:
    """The text of the first document of this type that has one; null if there is none."""
    kind = F.lit(doc_type) if isinstance(doc_type, str) else doc_type
    parts = F.split(col(submission), "<DOCUMENT>")
    blocks = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    fits = F.filter(blocks, lambda b: (F.trim(F.regexp_extract(b, r"<TYPE>([^\n<]++)", 1)) == kind) & b.rlike(r"(?s)<TEXT>.*?</TEXT>"))
    return F.regexp_extract(F.get(fits, F.lit(0)), r"(?s)<TEXT>\s*(.*?)\s*</TEXT>", 1)


def first_sentence(section: str | Column, max_len: int = 80) -> Column:
    """The first sentence after the header line, in quotes; '(empty)' if there is no line after it."""
    lines = F.array_remove(F.transform(F.split(col(section), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s++|\s++$", "")), "")

    def quoted(body: Column) -> Column:
        picked = let(F.regexp_extract(body, r"^(.{20,}?[.!?])(?:\s|$)", 1), lambda found: F.when(found != "", found).otherwise(F.substring(body, 1, 80)))
        return let(picked, lambda p: F.concat(F.lit('"'), F.when(F.length(p) > max_len, F.concat(F.substring(p, 1, max_len - 1), F.lit("…"))).otherwise(p), F.lit('"')))

    return let(lines, lambda ls: F.when(F.size(ls) < 2, F.lit("(empty)")).otherwise(let(F.array_join(F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))), " "), quoted)))


def normalize_for_search(text: str | Column) -> Column:
    """Straight quotes, plain spaces, one space for any white space, lower case, trimmed."""
    plain = F.translate(col(text), "\u2018\u2019\u201c\u201d\u00a0", "''\"\" ")
    return F.trim(F.lower(F.regexp_replace(plain, r"(?U)\s++", " ")))
