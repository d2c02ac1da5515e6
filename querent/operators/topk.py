"""Top-k with ties broken by id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.errors import InvalidParameter

#: Scores count as equal in ranking if they agree in so many decimals: sums of doubles in other orders differ further behind.
EXACT = 12
#: Scores that are given out have so many decimals.
DECIMALS = 6


def ranked(scores: DataFrame, k: int | None, by: str = "query_id", id_col: str = "doc_id", score: str = "score", ascending: bool = False) -> DataFrame:
    """``scores`` with rank (from 1) within ``by``, and the score rounded; the first k if given. Partial top-k runs before the shuffle."""
    if k is not None and k < 0:
        raise InvalidParameter("k must not be negative")
    exact = scores.withColumn(score, F.round(score, EXACT))
    order = F.col(score).asc() if ascending else F.col(score).desc()
    out = exact.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col(id_col).asc())))
    out = out if k is None else out.filter(F.col("rank") <= k)
    return out.withColumn(score, F.round(score, DECIMALS))


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k largest scores of each row of a matrix, ranked as ``ranked`` does: by ``EXACT`` decimals, of
    ties the first column, NaN before all."""
    n, k = scores.shape[1], min(k, scores.shape[1])
    s = np.round(scores, EXACT)
    s[np.isnan(s)] = np.inf
    if 0 < k < n:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero(s >= least)
    else:
        row, column = np.nonzero(np.full(s.shape, k > 0))
    order = np.lexsort((column, -s[row, column], row))
    row, column = row[order], column[order]
    some = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[some], column[some], scores[row[some], column[some]]
