"""Audited writes (WRT-*) and the status merge (SNK-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.features import preview
from caseflow.sources import dims


def merge_status(
    claims: DataFrame, updates: DataFrame, order: list[str] | None = None, as_of=None, at: str | None = None
) -> DataFrame:
    """SNK-5: set ``status`` on matching claims; the last update per claim by ``order`` wins.

    The touched claims also get ``updated_at``: ``as_of``, or the value of the update's column ``at``.
    """
    rank = F.struct(*[F.col(c) for c in [*(order or []), "status"]])
    when = F.col(at) if at else F.lit(as_of).cast("timestamp")
    last = updates.groupBy("claim_id").agg(F.max_by(F.struct("status", when.alias("at")), rank).alias("_last"))
    merged = claims.join(last, "claim_id", "left").withColumn("status", F.coalesce("_last.status", "status"))
    if at is not None or as_of is not None:
        kept = F.col("updated_at") if "updated_at" in claims.columns else F.lit(None).cast("timestamp")
        touched = F.col("_last.status").isNotNull()
        merged = merged.withColumn("updated_at", F.when(touched, F.col("_last.at")).otherwise(kept))
    return merged.drop("_last")


def _previous_status(accepted: DataFrame) -> DataFrame:
    """Status before each request. Requests of one claim are cut by minute, so that a claim
    with very many requests is not handled by one task."""
    work = accepted.withColumn("_minute", F.date_trunc("minute", "requested_at"))
    order = ["requested_at", "request_id"]
    last = work.groupBy("claim_id", "_minute").agg(
        F.max_by("new_status", F.struct(*order)).alias("_last")
    )
    carried = last.withColumn(
        "_carried", F.lag("_last").over(Window.partitionBy("claim_id").orderBy("_minute"))
    ).drop("_last")
    inside = F.lag("new_status").over(Window.partitionBy("claim_id", "_minute").orderBy(*order))
    return (
        work.withColumn("_inside", inside)
        .join(carried, ["claim_id", "_minute"])
        .withColumn("previous_status", F.coalesce("_inside", "_carried", "current_status"))
        .drop("_minute", "_inside", "_carried")
    )


# The messages, id prefixes and default author below are fixed values.


def apply_status(claims: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """WRT-1: (claims with new status, audit rows, rejected requests).

    ``requests`` has request_id, claim_id, new_status, reason, updated_by, requested_at. The time of the
    last applied request becomes ``updated_at``. A request without a time has no place in the order
    of changes and is rejected, so that no change goes without its audit row.
    """
    current = claims.select("claim_id", F.col("status").alias("current_status"), F.lit(True).alias("_exists"))
    allowed = F.col("new_status").isin(dims.CLAIM_STATUSES)
    checked = requests.join(current, "claim_id", "left").withColumn(
        "message",
        F.when(
            ~F.coalesce(allowed, F.lit(False)),
            F.lit(f"Invalid status. Must be one of: {', '.join(dims.CLAIM_STATUSES)}"),
        )
        .when(F.col("_exists").isNull(), F.concat(F.lit("Claim "), F.coalesce(F.col("claim_id").cast("string"), F.lit("NULL")), F.lit(" not found")))
        .when(F.col("requested_at").isNull(), F.lit("Request without a time")),
    )
    accepted = checked.filter(F.col("message").isNull())
    rejected = checked.filter(F.col("message").isNotNull()).select(*requests.columns, "message")
    audit = _previous_status(accepted).select(
        F.concat_ws(
            "_", F.col("claim_id").cast("string"), "new_status", F.date_format("requested_at", "yyyyMMddHHmmss")
        ).alias("audit_id"),
        "claim_id",
        F.lit("status_update").alias("action_type"),
        "previous_status",
        "new_status",
        "reason",
        F.coalesce("updated_by", F.lit("ai_agent")).alias("updated_by"),
        F.col("requested_at").alias("update_timestamp"),
    )
    updates = accepted.select("claim_id", F.col("new_status").alias("status"), "requested_at", "request_id")
    return merge_status(claims, updates, ["requested_at", "request_id"], at="requested_at"), audit, rejected


def _stable_id(prefix: str, parts: list[str]):
    """Twelve upper-case hex digits from the request itself, so that a retried write keeps its id."""
    text = F.concat_ws("||", *[F.col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(text), 1, 12)))


def _split_valid(requests: DataFrame, column: str, allowed: list[str], label: str):
    good = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    message = F.lit(f"Invalid {label}. Must be one of: {', '.join(allowed)}")
    return requests.filter(good), requests.filter(~good).withColumn("message", message)


def add_notes(requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """WRT-2: (notes, rejected) from request_id, claim_id, note_type, note, author."""
    valid, rejected = _split_valid(requests, "note_type", dims.NOTE_TYPES, "note_type")
    notes = valid.select(
        _stable_id("NOTE_", ["request_id", "claim_id", "note_type", "note"]).alias("note_id"),
        "claim_id",
        "note_type",
        F.col("note").alias("note_content"),
        F.coalesce("author", F.lit("ai_agent")).alias("author"),
        F.lit(as_of).cast("timestamp").alias("created_timestamp"),
        F.lit(False).alias("is_deleted"),
        preview(F.col("note")).alias("note_preview"),
    )
    return notes, rejected


def assign_tasks(requests: DataFrame, as_of, due_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """WRT-3: (tasks, rejected) from request_id, claim_id, task_description, assigned_to, priority."""
    valid, rejected = _split_valid(requests, "priority", dims.TASK_PRIORITIES, "priority")
    now = F.lit(as_of).cast("timestamp")
    tasks = valid.select(
        _stable_id("TASK_", ["request_id", "claim_id", "task_description"]).alias("task_id"),
        "claim_id",
        "task_description",
        "assigned_to",
        "priority",
        F.lit("Open").alias("status"),
        now.alias("created_timestamp"),
        F.date_add(now.cast("date"), due_days).alias("due_date"),
        F.lit(None).cast("timestamp").alias("completed_timestamp"),
        preview(F.col("task_description")).alias("task_preview"),
    )
    return tasks, rejected
