"""The k best documents of many queries, kept while scores come in tiles of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores of a tile, queries times documents: 8 MB.
TILE = 1 << 20


class Best:
    """Of each query the k best scores, ties by document. Documents: whole numbers, or strings as an object array."""

    def __init__(self, queries: int, k: int, dtype: np.dtype):
        self.k, self.scores = k, np.full((queries, k), -np.inf)
        self.docs = np.zeros((queries, k), dtype) if dtype != object else np.full((queries, k), "", object)
        self.count = np.zeros(queries, np.int64)

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores of the queries from number first (rows) and of documents (columns), finite. Only scores that beat a query's k-th are sorted."""
        if not self.k or not len(docs):
            return
        rows = slice(first, first + len(scores))
        least, worst = self.scores[rows, -1:], self.docs[rows, -1:]
        fits = (scores > least) | ((scores == least) & (docs < worst))
        for r in np.flatnonzero(fits.any(axis=1)):
            q, at = first + r, np.flatnonzero(fits[r])
            n = self.count[q]
            s, d = np.concatenate([self.scores[q, :n], scores[r, at]]), np.concatenate([self.docs[q, :n], docs[at]])
            o = _order(s, d, self.k)
            self.count[q] = n = len(o)
            self.scores[q, :n], self.docs[q, :n] = s[o], d[o]

    def rows(self, ids: np.ndarray, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        """(query, document, score) of all that is kept; ids by number of the query."""
        held = np.arange(self.k) < self.count[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, self.count), types[0]), pa.array(self.docs[held], types[1]), pa.array(self.scores[held])], names)


def _order(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:  # all that ties with the k-th stays until documents decide
        at = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
        return at[np.lexsort((docs[at], -scores[at]))[:k]]
    return np.lexsort((docs, -scores))[:k]
