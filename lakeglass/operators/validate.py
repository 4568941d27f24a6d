"""Integrity of question pairs against the corpus of chunks, as one table of violations.

The chunks that are cited are picked first by a semi join with the few cited ids; only these take part in the checks, so the
text of the corpus isn't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.functions.text import normalize_for_search
from lakeglass.operators.evaluate import DIFFICULTIES, QUESTION_TYPES

TOP_FIELDS = ("difficulty", "gold_answer", "gold_evidence", "qa_id", "question", "question_type")
EVIDENCE_FIELDS = ("chunk_id", "filing_accession", "ticker")
PAIR = "qa_id string, question_type string, difficulty string, gold_evidence string, _corrupt_record string"


def _absent(keys: Column, wanted: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(keys, F.array().cast("array<string>")))


def chunk_index(chunks: DataFrame) -> DataFrame:
    """One chunk for each id: of repeated ids the one that comes last by (file, line), or whatever sorts last of ticker, accession, text."""
    order = [c for c in ("file", "line") if c in chunks.columns] + ["ticker", "accession", "text"]
    return chunks.groupBy("chunk_id").agg(F.max_by(F.struct("ticker", "accession", "text"), F.struct(*order)).alias("c")).select("chunk_id", "c.*")


def violations(lines: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """(line, tag, check, severity, detail). lines: (line, value) of JSON; chunks: (chunk_id, ticker, accession, text), None for the schema alone."""
    parsed = lines.select("line", "value", F.json_object_keys("value").alias("keys"), F.from_json("value", PAIR, {"mode": "PERMISSIVE"}).alias("p"))
    # The list of keys is laxer than a parse: a record that doesn't parse has none.
    parsed = parsed.withColumn("keys", F.when(F.col("p._corrupt_record").isNull(), F.col("keys")))
    none = F.lit(None).cast("string")

    def found(df: DataFrame, tag: Column, check: str, detail: Column = none, severity: str = "error") -> DataFrame:
        return df.select("line", tag.alias("tag"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))

    at_line = F.format_string("<line %d>", F.col("line").cast("long"))
    ok = parsed.filter(F.col("keys").isNotNull())
    ok = ok.select("line", F.coalesce("p.qa_id", at_line).alias("qa_id"), "p.question_type", "p.difficulty", F.col("p.gold_evidence").alias("ev"), _absent(F.col("keys"), TOP_FIELDS).alias("absent"))
    whole = ok.filter(F.size("absent") == 0)
    out = [
        found(parsed.filter(F.col("keys").isNull()), at_line, "invalid JSON"),
        found(ok.filter(F.size("absent") > 0), F.col("qa_id"), "missing fields", F.array_join("absent", ", ")),
        found(whole.withColumn("n", F.row_number().over(Window.partitionBy("qa_id").orderBy("line"))).filter("n > 1"), F.col("qa_id"), "duplicate qa_id"),
        *(found(whole.filter(F.coalesce(~F.col(c).isin(*allowed), F.lit(True))), F.col("qa_id"), c, F.col(c)) for c, allowed in (("question_type", QUESTION_TYPES), ("difficulty", DIFFICULTIES))),
    ]
    items = F.from_json("ev", "array<string>")
    listed = whole.withColumn("items", F.when(F.col("ev").startswith("["), items))
    out.append(found(listed.filter(F.coalesce(F.size("items"), F.lit(0)) <= 0), F.col("qa_id"), "empty evidence"))
    each = listed.select("line", "qa_id", F.posexplode("items").alias("i", "e"))
    each = each.select("line", F.format_string("%s.evidence[%d]", "qa_id", F.col("i")).alias("tag"), F.json_object_keys("e").alias("keys"), F.from_json("e", "chunk_id string, filing_accession string, ticker string, quote string").alias("c"))
    each = each.select("line", "tag", _absent(F.col("keys"), EVIDENCE_FIELDS).alias("absent"), "c.*")
    out.append(found(each.filter(F.size("absent") > 0), F.col("tag"), "missing evidence fields", F.array_join("absent", ", ")))
    cited = each.filter(F.size("absent") == 0)
    if chunks is None:
        out.append(found(cited.filter(F.coalesce(F.col("chunk_id"), F.lit("")) == ""), F.col("tag"), "chunk_id is empty", F.col("chunk_id")))
    else:
        ids = cited.select("chunk_id").distinct()
        few = chunk_index(chunks.join(ids, "chunk_id", "left_semi"))
        few = few.select("chunk_id", F.col("ticker").alias("ticker_"), F.col("accession").alias("accession_"), F.col("text").alias("text_"), F.lit(True).alias("there"))
        both = cited.join(few, "chunk_id", "left")
        there = both.filter("there")
        quote = (F.coalesce(F.col("quote"), F.lit("")) != "") & ~F.contains(normalize_for_search("text_"), normalize_for_search("quote"))
        out += [
            found(both.filter(F.col("there").isNull()), F.col("tag"), "chunk not found", F.col("chunk_id")),
            found(there.filter(~F.col("ticker").eqNullSafe(F.col("ticker_"))), F.col("tag"), "ticker mismatch", F.col("ticker_")),
            found(there.filter(~F.col("filing_accession").eqNullSafe(F.col("accession_"))), F.col("tag"), "accession mismatch", F.col("accession_")),
            found(there.filter(quote), F.col("tag"), "quote not found", none, "warning"),
        ]
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


def summary(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(n_pairs, errors, warnings, exit_status): pairs are the lines that are JSON; the status is 1 if there is an error."""
    whole = F.json_object_keys("value").isNotNull() & F.from_json("value", PAIR, {"mode": "PERMISSIVE"})["_corrupt_record"].isNull()
    pairs = lines.agg(F.count_if(whole).alias("n_pairs"))
    counts = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return pairs.crossJoin(counts).withColumn("exit_status", F.when(F.col("errors") > 0, 1).otherwise(0))
