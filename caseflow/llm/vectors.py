"""Vectors that can be compared, with equal ones folded into one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import ship

ship(__name__)


def usable(column: str = "embedding") -> Column:
    """True for vectors that are not null, not zero, and hold finite numbers only."""
    vector = F.col(column)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def folded(rows: DataFrame, keep: int = 1) -> DataFrame:
    """(embedding, node, copies, ids): one row per different vector of ``rows`` (vec_id, embedding).

    ``node`` is its smallest vec_id, ``ids`` its ``keep`` smallest different ones, ``copies`` the
    number of rows. Ids are cut to ``keep`` before the shuffle, so a vector that is everywhere
    needs no room.
    """
    counted = rows.groupBy("embedding", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    first = counted.withColumn("nth", nth).filter(F.col("nth") <= keep)
    ids = first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    copies = rows.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("node"))
    return copies.join(ids, "embedding").select("embedding", "node", "copies", "ids")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column of one length, as float64."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(len(column), width)
