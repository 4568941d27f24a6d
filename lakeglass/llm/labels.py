"""Labels that a model is fitted on: a bounded sample, held as sorted arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about so many labelled rows are used for fitting; of more, those with the smallest hashes of doc_id.
LABELLED = 1_000_000


@dataclass(frozen=True)
class Labels:
    ids: np.ndarray
    values: np.ndarray

    def of(self, ids: list[int | None]) -> np.ndarray:
        """1, 0, or -1 where there is no label."""
        out = np.full(len(ids), -1, np.int64)
        if len(self.ids):
            at = np.array([k for k, i in enumerate(ids) if i is not None], np.int64)
            if len(at):
                x = np.array([ids[k] for k in at], np.int64)
                p = np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1)
                out[at] = np.where(self.ids[p] == x, self.values[p], -1)
        return out


def sampled(labels: DataFrame, column: str, bound: int = LABELLED) -> Labels:
    """A label that repeats for a doc_id counts as 1 if any is 1; nulls don't count."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("long").alias("v")).filter("doc_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.max("v").alias("v"))
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < bound)
    t = rows.toArrow()
    ids, v = t["doc_id"].to_numpy(), t["v"].to_numpy()
    o = np.argsort(ids)
    return Labels(ids[o], v[o])
