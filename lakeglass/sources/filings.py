"""Sources and sinks of the corpus: landed submissions, chunks, statistics, questions, reports."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.functions import text as X

CHUNK = "ticker string, filing_type string, accession string, chunk_id string, text string, section_label string, chunking_method string, token_count int, char_start int, char_end int"
STATS = (
    "ticker string, filing_type string, accession string, total_chars int, sections_detected int, quality_check_passed boolean, quality_check_reason string, method_used string, "
    "chunks_produced int, captured_ratio double, largest_section_item string, largest_section_ratio double, item_7_chars int, error string"
)
MANIFEST = (
    "filing_id string, ticker string, filing_type string, accession_number string, filing_year string, chunking_method string, failure_mode string, sections_detected int, chunks_produced int, "
    "total_chars int, captured_ratio double, largest_section_item string, largest_section_ratio double, item_7_chars int, quality_check_passed boolean, quality_check_reason string"
)
QA = (
    "qa_id string, question string, gold_answer string, gold_evidence array<struct<chunk_id:string,filing_accession:string,ticker:string,section:string,quote:string>>, "
    "question_type string, difficulty string, notes string"
)


def landed_submissions(spark: SparkSession, root: str) -> DataFrame:
    """(ticker, filing_type, accession, path, text): full-submission.txt under ticker/type/accession. A file that isn't under three folders is skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "full-submission.txt").load(root)
    parts = r"([^/]+)/([^/]+)/([^/]+)/full-submission\.txt$"
    return files.select(*(F.regexp_extract("path", parts, i + 1).alias(n) for i, n in enumerate(("ticker", "filing_type", "accession"))), "path", X.decode_text("content").alias("text")).filter("ticker <> ''")


def extracted(submissions: DataFrame) -> DataFrame:
    """Adds html and the clean text, or an error where there is no document of the type: a bad filing doesn't fail the job."""
    out = submissions.withColumn("html", X.primary_document("text", F.col("filing_type")))
    error = F.when(F.col("html").isNull(), F.concat(F.lit("no document of type "), "filing_type")).otherwise("")
    return out.withColumn("error", error).withColumn("text", X.html_text_v2("html"))


def largest_file(files: DataFrame, key: str = "accession") -> DataFrame:
    """(key, path): the largest text or HTML file of each filing; equal ones by path. files: (key, path, length)."""
    fits = files.filter(F.lower("path").rlike(r"\.(txt|htm[^/.]*)$"))
    return fits.groupBy(key).agg(F.max_by("path", F.struct("length", "path")).alias("path"))


def latest_submission(submissions: DataFrame) -> DataFrame:
    """(ticker, filing_type, accession): the latest accession of each company and type."""
    return submissions.groupBy("ticker", "filing_type").agg(F.max("accession").alias("accession"))


def fetch_filing(filings: DataFrame, ticker: str, filing_type: str, year: int) -> DataFrame:
    return filings.filter((F.col("ticker") == ticker) & (F.col("filing_type") == filing_type) & (F.year("filing_date") == year))


def fetch_company_filings(filings: DataFrame, ticker: str, filing_types: list[str], start: str, end: str) -> DataFrame:
    return filings.filter((F.col("ticker") == ticker) & F.col("filing_type").isin(*filing_types) & F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines in a folder for each filing; filings without chunks get none."""
    chunks.select("*", F.concat_ws("_", "ticker", "filing_type", "accession").alias("filing")).write.mode("overwrite").partitionBy("filing").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as retrieval takes them: accession and label renamed, missing offsets 0 and the text's length, missing counts 0."""
    raw = spark.read.schema(CHUNK).option("recursiveFileLookup", True).json(path)
    return raw.select(
        "chunk_id", F.col("accession").alias("filing_accession"), "ticker", "filing_type", F.col("section_label").alias("section"), "text", "chunking_method",
        F.coalesce("char_start", F.lit(0)).alias("char_start"), F.coalesce("char_end", F.length("text")).alias("char_end"), F.coalesce("token_count", F.lit(0)).alias("token_count"),
    )


def stats_lines(stats: DataFrame) -> DataFrame:
    """The lines of the statistics file, without its header: commas in values become semicolons, nulls are empty, nothing is quoted."""
    names = [f.split()[0] for f in STATS.split(", ")]
    return stats.select(F.concat_ws(",", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit(","), F.lit(";")), F.lit("")) for c in names)).alias("value"))


def write_stats(stats: DataFrame, path: str) -> None:
    """CSV with the fourteen columns; each part file has the header."""
    names = [f.split()[0] for f in STATS.split(", ")]
    clean = stats.select(*(F.replace(F.col(c).cast("string"), F.lit(","), F.lit(";")).alias(c) for c in names))
    clean.write.mode("overwrite").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Codes of items stay strings: 8, 1A."""
    return spark.read.schema(STATS).option("header", True).csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """CSV in the manifest's order, sorted by ranges: part files follow each other, and no task holds all."""
    from lakeglass.operators.manifest import tier_order

    manifest.orderBy(tier_order("chunking_method"), "ticker", "accession_number").write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).option("nullValue", "").csv(path)


def qa_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): non-blank lines with their number. A file of questions is small; its lines are numbered within the file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line", "value"))
    return raw.select("file", (F.col("line") + 1).alias("line"), F.trim("value").alias("value")).filter("value <> ''")


class QADataset:
    """Questions with gold evidence."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QADataset:
        return cls(spark.read.schema(QA).json(path))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)

    def __len__(self) -> int:
        return self.rows.count()

    def __iter__(self):
        return self.rows.toLocalIterator()

    def filter(self, question_type: str | None = None, difficulty: str | None = None) -> QADataset:
        from lakeglass.operators.evaluate import filter_questions

        return QADataset(filter_questions(self.rows, question_type, difficulty))


def save_report(report: DataFrame, per_question: DataFrame, path: str) -> None:
    """A JSON document for each configuration, with its questions, in a folder named after it."""
    asked = per_question.groupBy("config").agg(F.sort_array(F.collect_list(F.struct(*[c for c in per_question.columns if c != "config"]))).alias("per_question"))
    out = report.join(asked, "config", "left").withColumn("timestamp", F.current_timestamp())
    out.withColumn("of", F.col("config")).write.mode("append").partitionBy("of").json(path)


