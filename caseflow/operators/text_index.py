"""A stored index for substring searches (INV-6, DSH-3): which rows hold which three characters.

A text that holds a term holds all of the term's runs of three characters. The rows that hold the rarest of
them are few, and only their texts are looked at. Terms of one or two characters have no such run, so they
scan, as ``investigate.keyword_search`` and ``dashboards.text_search`` do.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import dashboards, investigate
from caseflow.sources import store

# Tasks get the helpers with their function, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Folders that the postings are dealt to by the hash of their characters.
BUCKETS = 64
#: Runs of a term that are intersected: its rarest.
RAREST = 8
#: Pairs of a run and a row that a task puts together before it passes them on.
BLOCK = 2_000_000
#: Bits of a code point.
POINT = 21


def grams(text: Column) -> Column:
    """The different runs of three characters of a text, in lower case; none of a NULL or shorter one."""
    chars = F.split(F.lower(text), "")
    size = F.greatest(F.size(chars) - 2, F.lit(0))
    # Three copies, shifted, side by side: every run is made once, however long the text is.
    shifted = F.arrays_zip(*[F.slice(chars, i, size).alias(name) for i, name in ((1, "a"), (2, "b"), (3, "c"))])
    return F.array_distinct(F.transform(shifted, lambda x: F.concat(x["a"], x["b"], x["c"])))


def _codes(text: str) -> np.ndarray:
    """``grams`` of a lower-case text, each as one number."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return np.unique(points[:-2] << 2 * POINT | points[1:-1] << POINT | points[2:])


def _spelled(codes: np.ndarray) -> list[str]:
    points = [codes >> 2 * POINT, codes >> POINT & (1 << POINT) - 1, codes & (1 << POINT) - 1]
    text = np.stack(points, axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _block(keys: pa.Array, codes: list[np.ndarray]) -> pa.RecordBatch:
    """One row per run: its bucket, its number of rows and their keys."""
    rows, runs = np.repeat(np.arange(len(codes)), [len(c) for c in codes]), np.concatenate(codes)
    order = np.argsort(runs, kind="stable")
    found, starts, counts = np.unique(runs[order], return_index=True, return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(runs)), pa.int32()), keys.take(pa.array(rows[order])))
    spelled = _spelled(found)
    buckets = [zlib.crc32(g.encode()) % BUCKETS for g in spelled]
    columns = [pa.array(spelled, pa.string()), pa.array(buckets, pa.int32()), pa.array(counts, pa.int64()), lists]
    return pa.RecordBatch.from_arrays(columns, ["gram", "bucket", "rows", "keys"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, lower-case text) to blocks of postings, however many of them a task has."""
    keys, codes, held = [], [], 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for key, text in zip(batch.column(0), batch.column(1)):
            keys.append(key.as_py())
            codes.append(_codes(text.as_py() or ""))
            held += len(codes[-1])
            if held >= BLOCK:
                yield _block(pa.array(keys, kind), codes)
                keys, codes, held = [], [], 0
    if keys:
        yield _block(pa.array(keys, kind), codes)


def _row_text(df: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])


def build(df: DataFrame, root: str, name: str, key: str, text: Column | None = None) -> None:
    """Write the postings of ``text``, or of the values of all columns as DSH-3 searches them: lists of the rows
    that hold a run, as many lists as blocks of rows were put together. Parts of a bucket that are too large for
    one task are split; inside a file postings are sorted by their characters."""
    content = _row_text(df) if text is None else text
    texts = df.select(F.col(key).alias("key"), F.lower(content).alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    lists = texts.mapInArrow(_postings, f"gram string, bucket int, rows long, keys array<{kind}>")
    store.save(lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram"), root, name, partition_by=("bucket",))
    counts = store.load(df.sparkSession, root, name).groupBy("gram", "bucket").agg(F.sum("rows").alias("rows"))
    store.save(counts.sortWithinPartitions("bucket", "gram"), root, f"{name}_sizes", partition_by=("bucket",))


def _of_grams(table: DataFrame, wanted: list[str]) -> DataFrame:
    buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in wanted})
    return table.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))


def candidates(spark: SparkSession, root: str, name: str, term: str) -> DataFrame | None:
    """(key) of the rows that may hold a term: all that do, and few others. None where the term is too short."""
    row = spark.range(1).select(grams(F.lit(term)).alias("grams")).first()
    if not row["grams"]:
        return None
    # One row per run of the term.
    known = {r["gram"]: r["rows"] for r in _of_grams(store.load(spark, root, f"{name}_sizes"), row["grams"]).collect()}
    rarest = sorted(row["grams"], key=lambda g: (known.get(g, 0), g))[:RAREST]
    found = _of_grams(store.load(spark, root, name), rarest).select(F.explode("keys").alias("key"), "gram").distinct()
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest)).select("key")


def _narrowed(df: DataFrame, root: str, name: str, key: str, terms: list[str]) -> DataFrame:
    """Rows that may hold any of the terms."""
    found = [candidates(df.sparkSession, root, name, t) for t in terms]
    if any(f is None for f in found) or not found:
        return df
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    every = every.distinct()
    # A row without key is in no join; it is looked at whatever it holds.
    return df.join(every.withColumnRenamed("key", key), key, "left_semi").unionByName(df.filter(F.col(key).isNull()))


def keyword_search(df: DataFrame, root: str, name: str, text: str, k: int = 5, column: str = "description", key: str = "claim_id") -> DataFrame:
    """INV-6 through the index ``name`` of ``column``: the same rows."""
    narrow = _narrowed(df, root, name, key, text.lower().split()[:3])
    return investigate.keyword_search(narrow, text, k, column, key)


def text_search(df: DataFrame, root: str, name: str, term: str, key: str) -> DataFrame:
    """DSH-3 through the index ``name`` of all columns of ``df``: the same rows."""
    columns = df.columns
    return dashboards.text_search(_narrowed(df, root, name, key, [term.lower()]).select(columns), term)
