import datetime as dt

from builders import claims, column, policies
from pyspark.sql import functions as F

from caseflow.operators import audit, bronze, quality

T0 = dt.datetime(2024, 1, 1, 9, 0)
REQUEST = "request_id long, claim_id long, new_status string, reason string, updated_by string, requested_at timestamp"


def _requests(spark, *rows):
    return spark.createDataFrame(
        [(i, c, s, "why", None, T0 + dt.timedelta(seconds=t)) for i, (c, s, t) in enumerate(rows)], REQUEST
    )


def test_status_changes_are_audited_in_order(spark):
    data = claims(spark, dict(claim_id=1), dict(claim_id=2), dict(claim_id=3))
    asked = _requests(
        spark, (1, "Pending", 0), (1, "Escalated", 30), (1, "Denied", 300), (2, "Bogus", 0), (9, "Closed", 0), (2, "Approved", 5)
    )
    changed, log, rejected = audit.apply_status(data, asked)
    assert column(changed, "status") == {1: "Denied", 2: "Approved", 3: "Submitted"}
    chain = [(r.previous_status, r.new_status) for r in log.filter("claim_id = 1").orderBy("update_timestamp").collect()]
    assert chain == [("Submitted", "Pending"), ("Pending", "Escalated"), ("Escalated", "Denied")]
    assert log.filter("claim_id = 2").first().audit_id == "2_Approved_20240101090005"
    messages = column(rejected, "message")
    assert messages[2].startswith("Invalid status") and messages[9] == "Claim 9 not found"


def test_many_requests_for_one_claim(spark):
    steps = ["Pending", "Escalated", "Approved", "Denied"]
    asked = _requests(spark, *[(1, steps[i % 4], 7 * i) for i in range(200)])
    _, log, _ = audit.apply_status(claims(spark, dict(claim_id=1)), asked)
    rows = log.orderBy("update_timestamp").collect()
    assert [r.previous_status for r in rows] == ["Submitted", *[r.new_status for r in rows[:-1]]]


def test_merge_is_idempotent_and_ignores_unknown_claims(spark):
    data = claims(spark, dict(claim_id=1), dict(claim_id=2))
    updates = spark.createDataFrame([(1, "Paid", 1), (1, "Closed", 2), (7, "Closed", 1)], "claim_id long, status string, v int")
    once = audit.merge_status(data, updates, ["v"], as_of=T0)
    twice = audit.merge_status(once, updates, ["v"], as_of=T0)
    assert column(once, "status") == {1: "Closed", 2: "Submitted"} == column(twice, "status")
    assert column(once, "updated_at") == {1: T0, 2: None}


def test_notes_and_tasks(spark):
    notes = spark.createDataFrame(
        [(1, 1, "general", "x" * 100, None), (2, 1, "evidence", "y" * 101, "me"), (3, 1, "gossip", "z", None), (4, 1, None, "z", None)],
        "request_id int, claim_id int, note_type string, note string, author string",
    )
    good, bad = audit.add_notes(notes, T0)
    rows = {r.note_type: r for r in good.collect()}
    assert rows["general"].note_preview == "x" * 100 and rows["general"].author == "ai_agent"
    assert rows["evidence"].note_preview == "y" * 100 + "..." and len(rows["evidence"].note_id) == 17
    assert bad.count() == 2
    assert {r.note_id for r in good.collect()} == {r.note_id for r in audit.add_notes(notes, T0)[0].collect()}
    tasks = spark.createDataFrame(
        [(1, 1, "call", "a", "low"), (2, 1, "visit", "a", "now")],
        "request_id int, claim_id int, task_description string, assigned_to string, priority string",
    )
    good, bad = audit.assign_tasks(tasks, T0, due_days=3)
    row = good.first()
    assert row.due_date == dt.date(2024, 1, 4) and row.status == "Open" and row.completed_timestamp is None
    assert bad.first().message == "Invalid priority. Must be one of: low, medium, high, urgent"


def test_record_hash_marks_nulls_and_ignores_metadata(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    hashes = [r._record_hash for r in bronze.with_record_hash(df).collect()]
    assert hashes[0] != hashes[1]
    tagged = bronze.with_ingest_meta(df, "s", T0)
    assert [r._record_hash for r in bronze.with_record_hash(tagged).collect()] == hashes


def test_metadata_is_added_once(spark):
    df = bronze.with_ingest_meta(bronze.with_ingest_meta(spark.range(1), "first", T0), "second")
    assert df.first()._source_system == "first" and df.first()._ingestion_timestamp == T0


def test_cdc_diff(spark):
    old = claims(spark, dict(claim_id=1), dict(claim_id=2), dict(claim_id=3))
    new = claims(spark, dict(claim_id=2), dict(claim_id=3, claim_amount=1000.01), dict(claim_id=4))
    assert column(bronze.cdc_diff(old, new, "claim_id"), "change_type") == {1: "delete", 2: "unchanged", 3: "update", 4: "insert"}


def test_quality_report_counts_every_rule(spark):
    data = claims(
        spark, dict(claim_id=1), dict(claim_id=1, claim_amount=0.0), dict(claim_id=2, policy_id=99, claim_amount=-1.0),
        dict(claim_id=3, policy_id=None, filing_date=dt.date(2000, 1, 9)))
    report = {r.rule: (r.violations, r.passed) for r in quality.dq_report(data, policies(spark)).collect()}
    assert report == {"duplicate_claim_id": (1, False), "missing_policy": (2, False), "filed_before_incident": (1, False),
                      "non_positive_amount": (2, False)}
    empty = {r.violations for r in quality.dq_report(data.limit(0), policies(spark)).collect()}
    assert empty == {0}
    assert quality.null_counts(data).first().policy_id == 1
    filled = {r.column_name: r.completeness_pct for r in quality.completeness(data, ["policy_id", "claim_id"]).collect()}
    assert filled == {"policy_id": 75.0, "claim_id": 100.0}


def test_no_change_without_an_audit_row(spark):
    data = claims(spark, dict(claim_id=1), dict(claim_id=2))
    asked = _requests(spark, (1, "Pending", 0), (1, "Denied", 60), (2, "Closed", 0), (None, "Closed", 0))
    asked = asked.withColumn("requested_at", F.when(F.col("claim_id") != 2, F.col("requested_at")).otherwise(F.when(F.col("claim_id").isNull(), F.lit(T0))))
    changed, log, rejected = audit.apply_status(data, asked)
    assert column(changed, "status") == {1: "Denied", 2: "Submitted"}
    assert column(changed, "updated_at") == {1: T0 + dt.timedelta(seconds=60), 2: None}
    assert log.count() == 2 and rejected.count() == 2
    assert column(rejected, "message")[2] == "Request without a time"
