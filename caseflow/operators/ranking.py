"""Ranks and running values that never need a whole key in one task.

Rows are cut into cells: key, order value, and a slice of md5(id). A cell is ranked by one
task; the number of rows in earlier cells of the same key is added from a small per-cell
table. A key that holds a third of all rows is therefore spread over all its cells, and the
order inside equal order values is md5(id), which is stable and evenly spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_HEX = 3


def tie_break(unique: str) -> Column:
    return F.md5(F.col(unique).cast("string"))


def cell(keys: list[str], order: str | None, unique: str, slice_hex: int = SLICE_HEX) -> Column:
    """The cell of a row; a struct, so that NULL keys compare equal to each other."""
    parts = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    if order is not None:
        parts.append(F.col(order).alias("at"))
    return F.struct(*parts, F.substring(tie_break(unique), 1, slice_hex).alias("slice"))


def cell_window(keys: list[str], ordered: bool):
    """Cells of one key, in order."""
    by = [F.col(f"_cell.k{i}") for i in range(len(keys))]
    order = [F.col("_cell.at")] if ordered else []
    return Window.partitionBy(*by).orderBy(*order, F.col("_cell.slice"))


def rank_in_cell(unique: str) -> Column:
    return F.row_number().over(Window.partitionBy("_cell").orderBy(tie_break(unique), F.col(unique)))


def with_rank(
    df: DataFrame,
    keys: list[str],
    order: str | None,
    unique: str,
    out: str,
    size: str | None = None,
    slice_hex: int = SLICE_HEX,
) -> DataFrame:
    """``row_number()`` per ``keys`` ordered by ``order``, then md5(``unique``).

    ``size`` names an optional column with the number of rows of the key.
    """
    work = df.withColumn("_cell", cell(keys, order, unique, slice_hex))
    cells = work.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"))
    ordered = cell_window(keys, order is not None)
    before = F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    extra = [whole.alias(size)] if size else []
    cells = cells.select("_cell", F.coalesce(before, F.lit(0)).alias("_before"), *extra)
    return (
        work.withColumn("_in_cell", rank_in_cell(unique))
        .join(cells, "_cell")
        .withColumn(out, F.col("_before") + F.col("_in_cell"))
        .drop("_cell", "_before", "_in_cell")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str) -> DataFrame:
    """First ``n`` rows per key. Spark keeps at most ``n`` rows per key before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= n)


def latest_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """DDP-1: one row per key, the one with the greatest ``order`` (combined before the shuffle)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(key).agg(F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return best.select("_row.*")
