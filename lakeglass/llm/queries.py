"""The operators as queries over whole tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, licenses, packing, quality, records, topk, toxicity, transport, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {
    "op1_toxicity": lambda s, d: toxicity.toxic_documents(table(s, d, "documents"), table(s, d, "labels")),
    "op2_bpe": lambda s, d: bpe.round_trip(table(s, d, "documents")),
    "op3_topk_search": lambda s, d: topk.search(table(s, d, "documents"), table(s, d, "benchmark").withColumnRenamed("item_id", "query_id")),
    "op4_importance_resampling": lambda s, d: quality.resampled(table(s, d, "documents"), table(s, d, "labels")),
    "op5_records": lambda s, d: records.records(table(s, d, "documents")),
    "op6_transport": lambda s, d: transport.units(transport.muxed(table(s, d, "documents"))),
    "op7_licenses": lambda s, d: licenses.licenses(table(s, d, "documents")),
    "op8_jaccard_join": lambda s, d: jaccard.jaccard_join(table(s, d, "documents")),
    "op9_url_filter": lambda s, d: urls.listed_pages(table(s, d, "pages")),
    "op10_packing": lambda s, d: packing.packed(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {"op3_topk_search": topk.SQL, "op4_importance_resampling": quality.SQL, "op9_url_filter": urls.SQL}
