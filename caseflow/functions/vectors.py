"""Small numpy helpers that run inside Spark tasks on one batch or block of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

DECIMALS = 10
# Scores held at once.
_CELLS = 1_000_000


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column, or of a pandas column of arrays, as float64."""
    if isinstance(column, (pa.ListArray, pa.ChunkedArray)):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def unit(rows: np.ndarray, zero_slot: int) -> np.ndarray:
    """Rows scaled to length 1, with two spare dimensions.

    A zero row becomes the unit vector of a spare dimension, one for queries and another for
    stored vectors, so that its cosine with everything on the other side is 0.
    """
    norms = np.linalg.norm(rows, axis=1)
    out = np.zeros((rows.shape[0], rows.shape[1] + 2))
    filled = norms > 0
    out[filled, : rows.shape[1]] = rows[filled] / norms[filled, None]
    out[~filled, rows.shape[1] + zero_slot] = 1.0
    return out


def best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k highest scores per query; equal scores go by id."""
    ordered = found.sort_values(["query", "score", "id"], ascending=[True, False, True])
    return ordered.groupby("query", sort=False).head(k)


def nearest(
    queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, visited: np.ndarray | None = None, lists: np.ndarray | None = None
) -> pd.DataFrame:
    """Top k of one block of unit vectors for each unit query: (query = row number, id, score).

    With ``visited`` (query, list) only vectors whose list, in ``lists``, the query visits count.
    """
    parts = []
    step = max(1, _CELLS // max(1, len(ids)))
    keep = min(k, len(ids))
    for start in range(0, len(queries), step):
        scores = queries[start : start + step] @ vectors.T
        if visited is not None:
            scores[~visited[start : start + step][:, lists]] = -np.inf
        # Rounding keeps the order, so the k-th rounded score is the k-th score, rounded; only those near it are rounded.
        floor = np.round(np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep], DECIMALS)
        row, col = np.nonzero(scores >= (floor - 10.0**-DECIMALS)[:, None])
        value = np.round(scores[row, col], DECIMALS) + 0.0
        close = (value >= floor[row]) & (value > -np.inf)
        row, col, value = row[close], col[close], value[close]
        found = pd.DataFrame({"query": row + start, "id": ids[col], "score": value})
        parts.append(best(found, k))
    return pd.concat(parts) if parts else pd.DataFrame({"query": [], "id": [], "score": []})
