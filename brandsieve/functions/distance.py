"""Unrestricted Damerau-Levenshtein distance as an Arrow UDF.

Spark's ``levenshtein`` has no transposition. The distance is filled in for all pairs of an
Arrow batch at once, cell by cell over numpy vectors, so the cost per pair is a few microseconds.
Callers put the native ``levenshtein(a, b, 2k) >= 0`` filter ahead of it: a transposition costs 1
here and at most 2 there, so that filter loses nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROWS = 4096
# Distances a worker keeps from batch to batch: hot labels repeat, in every batch and task.
_KEPT = 100_000
_known: dict[tuple[str, str], int] = {}


def _codes(words: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    out = np.full((len(words), int(lengths.max(initial=0))), fill, dtype=np.int64)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(ch) for ch in w]
    return out, lengths


def pairwise_distance(left: list[str], right: list[str]) -> np.ndarray:
    """Distances of ``zip(left, right)``."""
    a, la = _codes(left, -1)
    b, lb = _codes(right, -2)
    n, na, nb = len(left), a.shape[1], b.shape[1]
    rows = np.arange(n)
    # table[:, i, j] is the distance of the first i and j letters. The swap term looks up
    # the cell just before the last equal letter on either side.
    table = np.zeros((n, na + 1, nb + 1), dtype=np.int32)
    table[:, :, 0] = np.arange(na + 1)
    table[:, 0, :] = np.arange(nb + 1)
    seen_row = np.zeros((n, nb), dtype=np.int64)  # last row whose letter equals b[j]
    for i in range(1, na + 1):
        seen_col = np.zeros(n, dtype=np.int64)  # last column in this row that matched
        for j in range(1, nb + 1):
            equal = a[:, i - 1] == b[:, j - 1]
            r, c = seen_row[:, j - 1], seen_col
            best = np.minimum(table[:, i - 1, j], table[:, i, j - 1]) + 1
            best = np.minimum(best, table[:, i - 1, j - 1] + ~equal)
            swap = np.where(
                (r > 0) & (c > 0),
                table[rows, np.maximum(r - 1, 0), np.maximum(c - 1, 0)] + (i - r - 1) + 1 + (j - c - 1),
                na + nb + 1,
            )
            table[:, i, j] = np.minimum(best, swap)
            seen_col = np.where(equal, j, seen_col)
        seen_row = np.where(a[:, i - 1 : i] == b, i, seen_row)
    return table[rows, la, lb]


@F.pandas_udf(T.IntegerType())
def damerau_levenshtein(left: pd.Series, right: pd.Series) -> pd.Series:
    out = pd.Series(pd.NA, index=left.index, dtype="Int32")
    pairs = pd.DataFrame({"l": left, "r": right}).dropna()
    if not len(pairs):
        return out
    keys = list(zip(pairs["l"], pairs["r"]))
    new = sorted({k for k in keys if k not in _known}, key=lambda k: len(k[0]) + len(k[1]))
    found = dict(_known) if len(_known) + len(new) > _KEPT else _known
    if found is not _known:
        _known.clear()
    for i in range(0, len(new), _ROWS):
        part = new[i : i + _ROWS]
        found.update(zip(part, pairwise_distance([a for a, _ in part], [b for _, b in part]).tolist()))
    out.loc[pairs.index] = [found[key] for key in keys]
    return out
