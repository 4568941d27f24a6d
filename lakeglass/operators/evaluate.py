"""Evaluation beyond ranking metrics: runs, reports, latency, cost, frontier, agreement, composition, prompts.

Where the reference leaves something open (rates, bins of the kappa), it is an argument, and its default is ours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakeglass.operators import metrics

QUESTION_TYPES = ("factual_lookup", "multi_doc_synthesis", "numerical_reasoning", "temporal_comparison")
DIFFICULTIES = ("easy", "medium", "hard")


def latency_percentiles(rows: DataFrame, group: str, value: str = "latency_ms") -> DataFrame:
    """(group, n, mean, p50, p95, p99), exact. Exact percentiles hold a count for each distinct value of a group: for runs of questions, not for logs."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), p.alias("p"))
    return out.select(group, "n", "mean", *(F.round(F.get("p", F.lit(i)), 6).alias(f"p{n}") for i, n in enumerate((50, 95, 99))))


def cost(runs: DataFrame, rates: DataFrame) -> DataFrame:
    """runs(model, input_tokens, output_tokens, …) with cost_usd; rates(model, usd_per_m_input, usd_per_m_output). A model without a rate has null."""
    usd = (F.col("input_tokens") * F.col("usd_per_m_input") + F.col("output_tokens") * F.col("usd_per_m_output")) / 1e6
    return runs.join(rates, "model", "left").withColumn("cost_usd", F.round(usd, 8)).drop("usd_per_m_input", "usd_per_m_output")


def pareto_frontier(points: DataFrame, quality: str = "quality", cost_: str = "cost") -> DataFrame:
    """Points that no other beats: none has more quality at no more cost, or less cost at no less quality. Equal points stay together.

    Sorted by cost, a point stays if its quality is above all of lower cost. A pass per partition first leaves only its own
    frontier, so the last pass, over one partition, sees few rows.
    """
    names = points.columns

    def skyline(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in parts:
            p = p.dropna(subset=[quality, cost_])
            p = p if held is None else pd.concat([held, p])
            p = p.sort_values([cost_, quality], ascending=[True, False], kind="stable")
            q, c = p[quality].to_numpy(), p[cost_].to_numpy()
            best, keep, last = float("-inf"), [], None
            for x, y in zip(q, c):
                ok = x > best or (x, y) == last
                keep.append(ok)
                if ok:
                    best, last = x, (x, y)
            held = p[keep]
        if held is not None and len(held):
            yield held[names]

    return points.mapInPandas(skyline, points.schema).repartition(1).mapInPandas(skyline, points.schema)


def abstention_outcome(abstained: str | Column, has_gold: str | Column) -> Column:
    a, g = (F.col(x) if isinstance(x, str) else x for x in (abstained, has_gold))
    return F.when(~a & g, "answered").when(~a & ~g, "should_have_abstained").when(a & g, "wrong_abstention").when(a & ~g, "correct_abstention")


def abstention_correct(abstained: str | Column, has_gold: str | Column) -> Column:
    return abstention_outcome(abstained, has_gold).isin("answered", "correct_abstention")


def binned(value: str | Column, edges: tuple[float, ...] = (1 / 3, 2 / 3)) -> Column:
    """0, 1, … : how many edges the value reaches. The default three bins are ours."""
    v = F.col(value) if isinstance(value, str) else value
    return sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0))


def cohens_kappa(pairs: DataFrame, a: str, b: str, group: str | None = None) -> DataFrame:
    """(group, n, agreement, kappa, accepted): 1 where both raters always say one and the same; accepted from 0.5."""
    g = F.col(group) if group else F.lit("all")
    counts = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(g.alias("group"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = counts.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ma = counts.groupBy("group", F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    mb = counts.groupBy("group", F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, ["group", "v"]).groupBy("group").agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("x", F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))
    out = total.join(chance, "group", "left").select("group", "n", F.round(po, 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))
    return out.withColumn("accepted", F.col("kappa") >= 0.5)


def filter_questions(qa: DataFrame, question_type: str | None = None, difficulty: str | None = None) -> DataFrame:
    for name, value in (("question_type", question_type), ("difficulty", difficulty)):
        if value is not None:
            qa = qa.filter(F.col(name) == value)
    return qa


TARGETS = {**{("question_type", t): 25 for t in QUESTION_TYPES}, ("difficulty", "easy"): 40, ("difficulty", "medium"): 40, ("difficulty", "hard"): 20, ("companies", "all"): 30}


def composition(qa: DataFrame, targets: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """(dimension, value, n, target, met): questions by type and difficulty and companies that the evidence names, against their targets."""
    spark = qa.sparkSession
    dims = qa.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("question_type", "difficulty")))).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    firms = qa.select(F.explode("gold_evidence.ticker").alias("t")).agg(F.count_distinct("t").alias("n")).select(F.lit("companies").alias("dimension"), F.lit("all").alias("value"), "n")
    want = spark.createDataFrame([(*k, v) for k, v in (targets or TARGETS).items()], "dimension string, value string, target long")
    return want.join(dims.unionByName(firms), ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"), "target", (F.coalesce("n", F.lit(0)) >= F.col("target")).alias("met"))


def per_question(ranked: DataFrame, gold: DataFrame, answers: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall_at_10, mrr, ndcg_at_10, evidence_hit, faithfulness, correctness, cost_usd, latency_ms)."""
    m = metrics.at_k(ranked, gold, k).select("query_id", F.col("recall").alias("recall_at_10"), "mrr", F.col("ndcg").alias("ndcg_at_10"), F.col("hit").alias("evidence_hit"))
    return m.join(answers.select("query_id", "faithfulness", "correctness", "cost_usd", "latency_ms"), "query_id", "left")


def report(results: DataFrame, config: str = "config") -> DataFrame:
    """A row for each configuration: means, total cost, mean and p95 latency."""
    means = ("recall_at_10", "mrr", "ndcg_at_10", "evidence_hit", "faithfulness", "correctness")
    return results.groupBy(config).agg(
        F.count("*").alias("n_questions"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in means), F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"), F.round(F.percentile("latency_ms", F.lit(0.95)), 6).alias("p95_latency_ms"),
    )


def comparison_table(results: DataFrame, metric: str, retrievers: tuple[str, ...], chunkers: tuple[str, ...] = ()) -> DataFrame:
    """(chunker, a column for each retriever): the mean of a metric."""
    return results.groupBy("chunker").pivot("retriever", list(retrievers)).agg(F.round(F.avg(metric), 6))


def reproducible_sample(qa: DataFrame, n: int = 5, seed: int = 0, key: str = "qa_id") -> DataFrame:
    """n questions in the order of a hash: the same ones every time."""
    return qa.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def grounding(checked: DataFrame, match: str = "matches", need: int = 4) -> DataFrame:
    """(n, matching, rate, passed) of a human check."""
    return checked.agg(F.count("*").alias("n"), F.count_if(match).alias("matching"), F.round(F.coalesce(F.try_divide(F.count_if(match), F.count("*")), F.lit(0.0)), 6).alias("rate"), (F.count_if(match) >= need).alias("passed"))


QA_TEMPLATE = (
    "You answer questions about company filings. Rely on nothing but the numbered passages.\n\nPassages:\n{passages}\n\nQuestion: {question}\n\n"
    'Reply as JSON with the keys "answer", "citations" (list of passage names), "abstain" (true if the passages do not settle it) and "abstention_reason".'
)
SUFFICIENCY_TEMPLATE = 'Do these passages settle the question?\n\n{passages}\n\nQuestion: {question}\n\nReply as JSON with the keys "sufficient_evidence" and "reason".'
ANSWER = "answer string, citations array<string>, abstain boolean, abstention_reason string"


def prompts(questions: DataFrame, passages: DataFrame, template: str = QA_TEMPLATE) -> DataFrame:
    """(query_id, prompt, doc_ids): passages(query_id, rank, doc_id, text) named P1, P2, … in the order of rank."""
    ps = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("ps"))
    kind = ps.schema["ps"].dataType.simpleString()
    both = questions.select("query_id", "text").join(ps, "query_id", "left").withColumn("ps", F.coalesce(F.col("ps").cast(kind), F.array().cast(kind)))
    listed = F.array_join(F.transform("ps", lambda p, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("] "), p["text"])), "\n")
    head, rest = template.split("{passages}")
    middle, tail = rest.split("{question}")
    return both.select("query_id", F.concat(F.lit(head), listed, F.lit(middle), F.coalesce("text", F.lit("")), F.lit(tail)).alias("prompt"), F.transform("ps", lambda p: p["doc_id"]).alias("doc_ids"))


def parsed_answers(replies: DataFrame) -> DataFrame:
    """(query_id, answer_text, abstained, abstention_reason, cited): replies(query_id, reply, doc_ids); names of passages become doc_ids, unknown ones are left out. A reply that isn't JSON abstains."""
    r = replies.withColumn("a", F.from_json("reply", ANSWER, {"mode": "PERMISSIVE"}))
    bad = F.col("a.answer").isNull() & F.col("a.abstain").isNull()
    number = lambda c: F.regexp_extract(c, r"^\[?P(\d{1,6})\]?$", 1)
    cited = F.filter(F.transform(F.coalesce("a.citations", F.array().cast("array<string>")), lambda c: F.get("doc_ids", F.when(number(c) != "", number(c)).cast("int") - 1)), lambda x: x.isNotNull())
    return r.select(
        "query_id", F.coalesce("a.answer", F.lit("")).alias("answer_text"), F.when(bad, True).otherwise(F.coalesce("a.abstain", F.lit(False))).alias("abstained"),
        F.when(bad, "reply is not the JSON asked for").otherwise(F.col("a.abstention_reason")).alias("abstention_reason"), cited.alias("cited"),
    )


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents (doc_id, text) that hold a passage (query_id, text) word for word. Python's search skips ahead, where Spark's looks at each byte."""
    docs, asked = docs.select("doc_id", "text").filter("text IS NOT NULL"), [tuple(r) for r in passages.select("query_id", "text").filter("text IS NOT NULL").collect()]
    types = [to_arrow_type(x.schema[c].dataType) for x, c in ((passages, "query_id"), (docs, "doc_id"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(q, i) for i, t in enumerate(map(str, b["text"])) for q, p in asked if p in t]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], types[0]), b["doc_id"].take(pa.array([i for _, i in found], pa.int64()))], ["query_id", "doc_id"])

    return docs.mapInArrow(run, f"query_id {passages.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def judged_answers(answers: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """answers with the five dimensions of the rubric, by a model's function or as they stand, checked to lie in 0 to 1."""
    out = score(answers) if score else answers
    for c in ("correctness", "completeness", "faithfulness", "citation_support"):
        out = out.withColumn(c, F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("abstention_correct", F.col("abstention_correct").cast("boolean"))


def run_harness(questions: DataFrame, gold: DataFrame, retrieve: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame, DataFrame], DataFrame], config: str) -> tuple[DataFrame, DataFrame]:
    """(a row for each question, the report): retrieve, answer and judge, measure, aggregate. answer(questions, ranked) returns query_id, faithfulness, correctness, cost_usd, latency_ms."""
    ranked = retrieve(questions)
    rows = per_question(ranked, gold, answer(questions, ranked)).withColumn("config", F.lit(config))
    return rows, report(rows)
