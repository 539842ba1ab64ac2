"""Streaming jobs replayed over the event table (STR)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from caseflow.plans.base import CLAIMS, instant, num, plain, query
from caseflow.plans.raw import MERGED, UPDATES, hash_sql, updates
from caseflow.session import work_dir
from caseflow.sources import store
from caseflow.streaming import streams


def _events(v):
    return streams.read_files(v.spark, v.sf_dir, v.table("events").schema, "events.parquet")


def _collected(v, stream, purpose):
    folder = work_dir(v.spark, purpose)
    streams.run_to_files(stream, f"{folder}/out", f"{folder}/checkpoint")
    return v.spark.read.schema(stream.schema).parquet(f"{folder}/out")


EVENT_HASH = hash_sql("event_id ts user_id event_type value props")


@query(
    "str1_incremental_ingest",
    f"SELECT event_id, event_type, 'event_feed' AS _source_system, {EVENT_HASH} AS _record_hash FROM events",
)
def _(v):
    folder = work_dir(v.spark, "str1")
    target, checkpoint = f"{folder}/bronze", f"{folder}/checkpoint"
    streams.ingest_stream(_events(v), target, checkpoint, "event_feed")
    # The second run finds no new file and adds nothing.
    streams.ingest_stream(_events(v), target, checkpoint, "event_feed")
    return v.spark.read.parquet(target).select("event_id", "event_type", "_source_system", "_record_hash")


@query("str2_streaming_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(v):
    first = streams.dedupe_stream(_events(v), ["user_id", "event_type"], "ts", "60 days")
    return _collected(v, first.select("user_id", "event_type"), "str2")


@query(
    "str3_weekly_windows",
    f"""WITH weeks AS (SELECT date_trunc('week', ts) AS week, event_type, count(*) AS row_count, sum(value) AS total FROM events GROUP BY ALL),
seen AS (SELECT max(ts) - INTERVAL 1 DAY AS closed FROM events)
SELECT strftime(CAST(week AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS window_start,
strftime(CAST(week AS TIMESTAMP) + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, row_count, {num('total', 'total_value')}
FROM weeks, seen WHERE CAST(week AS TIMESTAMP) + INTERVAL 7 DAY <= closed""",
)
def _(v):
    # Windows count from the epoch, a Thursday; four days later they start on Mondays.
    weekly = streams.windowed_counts(_events(v), "ts", "event_type", "value", "7 days", "1 day", "4 days")
    return plain(_collected(v, weekly, "str3"))


@query(
    "str4_rolling_monitor",
    f"""WITH slots AS (SELECT date_trunc('hour', ts) - to_hours(CAST(h AS INT)) AS started, value, event_type
FROM events, range(24) AS r(h)), seen AS (SELECT max(ts) - INTERVAL 1 HOUR AS closed FROM events)
SELECT strftime(started, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(started + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
count(*) AS row_count, {num('avg(value)', 'avg_value')}, count(*) FILTER (WHERE event_type='error') AS error_count
FROM slots, seen WHERE started + INTERVAL 24 HOUR <= closed GROUP BY started""",
)
def _(v):
    rolling = streams.rolling_monitor(_events(v), "ts", "value", F.col("event_type") == "error", "1 hour")
    return plain(_collected(v, rolling, "str4"))


@query("str5_streaming_upsert", f"WITH {MERGED}")
def _(v):
    root, order = work_dir(v.spark, "str5"), ["ts", "event_id"]
    # Two saves before the stream starts, a run, a compaction, and a second stream over the same files.
    store.save(v.claims.limit(0), root, "claims")
    store.save(v.claims, root, "claims")
    streams.upsert_stream(updates(_events(v)), root, "claims", f"{root}/first", order)
    streams.compact(v.spark, root, "claims", order)
    streams.upsert_stream(updates(_events(v)), root, "claims", f"{root}/first", order)
    streams.upsert_stream(updates(_events(v)), root, "claims", f"{root}/second", order)
    return streams.upserted(v.spark, root, "claims", order).select("claim_id", "status")


@query(
    "str5_append_during_compaction",
    f"""WITH {CLAIMS}, {UPDATES}, last AS (SELECT claim_id, max_by(status, event_id) AS new_status, max_by(ts, event_id) AS changed_at
FROM updates GROUP BY claim_id) SELECT claims.claim_id, coalesce(new_status, status) AS status, {instant("changed_at", "updated_at")}
FROM claims LEFT JOIN last ON claims.claim_id=last.claim_id""",
)
def _(v):
    root, order = work_dir(v.spark, "str5"), ["ts", "event_id"]
    store.save(v.claims.filter("NOT is_fraud"), root, "claims")
    streams.upsert_stream(updates(_events(v)), root, "claims", f"{root}/first", order)
    # Whichever of the two publishes first, no row and no change is lost.
    with ThreadPoolExecutor(2) as pool:
        compacted = pool.submit(streams.compact, v.spark, root, "claims", order)
        appended = pool.submit(store.append, v.claims.filter("is_fraud"), root, "claims")
        compacted.result(), appended.result()
    streams.upsert_stream(updates(_events(v)), root, "claims", f"{root}/second", order)
    return plain(streams.upserted(v.spark, root, "claims", order).select("claim_id", "status", "updated_at"))
