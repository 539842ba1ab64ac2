"""Structured Streaming versions of the ingest, aggregate and merge jobs (STR-*).

Every job runs with ``availableNow``: it takes what has arrived since the last run, keeps its
position and state in the checkpoint folder, and stops. State lies in RocksDB on the executors' disks, and
its changes in the checkpoint folder: memory does not grow with the number of keys, a restart goes on where
the last run stopped. Per key, STR-2 keeps the key and its time for as long as ``delay``; STR-3 one sum and count per
open window and kind; STR-4 one row per open hour and per open window, however many rows there are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.features import count_where
from caseflow.operators import audit, bronze, ranking
from caseflow.sources import store


def read_files(
    spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Stream of new parquet files in a folder; ``files_per_batch`` cuts a large backlog into batches."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_files(df: DataFrame, target: str, checkpoint: str) -> None:
    """Append the stream's output to a parquet folder, exactly once per file."""
    (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
        .awaitTermination()
    )


def with_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def ingest_stream(df: DataFrame, target: str, checkpoint: str, source: str, as_of=None) -> None:
    """STR-1: new rows to bronze with ingestion metadata and record hash."""
    run_to_files(bronze.with_ingest_meta(bronze.with_record_hash(df), source, as_of), target, checkpoint)


def dedupe_stream(df: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """STR-2: the first row per key; repeats within ``delay`` are dropped."""
    return with_event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(
    df: DataFrame, ts: str, kind: str, value: str, length: str, delay: str, start: str | None = None
) -> DataFrame:
    """STR-3: count and sum per tumbling window and kind; a window is given out once it is closed."""
    return (
        with_event_time(df, ts)
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, length, length, start or "0 seconds"), kind)
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum(value).alias("total_value"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            kind,
            "row_count",
            "total_value",
        )
    )


def rolling_monitor(df: DataFrame, ts: str, value: str, error, delay: str) -> DataFrame:
    """STR-4: 24-hour windows every hour with count, average and number of errors.

    Rows are added up in panes of one hour, which the state keeps; a closed pane, not its rows, goes to the 24
    windows that hold it. A window is given out once it is closed.
    """
    panes = (
        with_event_time(df, ts)
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 hour"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(value).alias("total"),
            F.count(value).alias("values"),
            count_where(error).alias("errors"),
        )
    )
    return (
        panes.groupBy(F.window(F.window_time("window"), "24 hours", "1 hour"))
        .agg(
            F.sum("rows").alias("row_count"),
            F.try_divide(F.sum("total"), F.sum("values")).alias("avg_value"),
            F.sum("errors").alias("error_count"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "row_count", "avg_value", "error_count")
    )


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that Spark gave the stream of this checkpoint folder."""
    lines = [row[0] for row in spark.read.text(f"{checkpoint}/metadata").collect()]  # one short file
    return json.loads("".join(lines))["id"]


def upsert_stream(
    updates: DataFrame, root: str, table: str, checkpoint: str, order: list[str]
) -> None:
    """STR-5: collect status changes next to a stored table.

    A micro-batch writes only its own changes, the last one per claim by ``order``, into the folder
    of its stream and number, so a repeated batch replaces itself, a new checkpoint begins a
    folder of its own, and the table is not rewritten. ``upserted`` reads table and changes
    together, ``compact`` folds them into a new snapshot.
    """
    spark = updates.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        stream = _stream_id(spark, checkpoint)
        last = ranking.latest_by(batch, "claim_id", order)
        last.write.mode("overwrite").parquet(f"{store.changes_path(root, table)}/stream={stream}/batch={number}")

    (
        updates.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _pending(spark: SparkSession, root: str, table: str) -> dict[str, list[int]]:
    """Finished batches by stream that the newest version does not count yet."""
    counted = store.newest(spark, root, table)[1].positions
    found = store.change_batches(spark, root, table)
    return {stream: [n for n in batches if n > counted.get(stream, -1)] for stream, batches in found.items()}


def _changes(spark: SparkSession, root: str, table: str, pending: dict[str, list[int]]) -> DataFrame | None:
    folder = store.changes_path(root, table)
    paths = [f"{folder}/stream={s}/batch={n}" for s, batches in pending.items() for n in batches]
    return spark.read.option("basePath", folder).parquet(*paths) if paths else None


def _apply(claims: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Claims with their last change. ``updated_at`` is its time, the first timestamp in ``order``."""
    times = [c for c in order if changes.schema[c].dataType.typeName().startswith("timestamp")]
    if not times:
        return audit.merge_status(claims, changes, order)
    timed = changes.withColumn("_changed_at", F.col(times[0]).cast("timestamp"))
    return audit.merge_status(claims, timed, order, at="_changed_at")


def upserted(spark: SparkSession, root: str, table: str, order: list[str]) -> DataFrame:
    """The table with all changes its newest version does not count yet; the last by ``order`` wins.

    ``order`` belongs to the changes, whichever stream or batch brought them. What a version
    counts has no order any more: a change that comes after it wins.
    """
    base = store.load(spark, root, table)
    changes = _changes(spark, root, table, _pending(spark, root, table))
    return base if changes is None else _apply(base, changes, order)


def compact(spark: SparkSession, root: str, table: str, order: list[str], attempts: int = 5) -> int:
    """Fold the changes into a new version of the table; returns its number.

    The version names the batches it holds, so changes that arrive meanwhile stay pending. Rows appended
    meanwhile get the changes too. A run that fails leaves table and changes as they were; one that finds
    the table replaced begins again, ``attempts`` times.
    """
    for attempt in range(attempts):
        number, _ = store.newest(spark, root, table)
        pending = _pending(spark, root, table)
        changes = _changes(spark, root, table, pending)
        if number >= 0 and changes is None:
            return number
        counted = {stream: max(batches) for stream, batches in pending.items() if batches}
        try:
            return store.rewrite(
                spark, root, table, lambda rows: rows if changes is None else _apply(rows, changes, order), counted
            )
        except store.Conflict:
            if attempt + 1 == attempts:
                raise
    raise ValueError("attempts must be positive")
