import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from caseflow.operators import bronze, dashboards
from caseflow.sources import dims, store
from caseflow.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def test_save_replaces_and_may_read_itself(spark, root):
    store.save(spark.range(5), root, "t")
    store.save(store.load(spark, root, "t").filter("id > 2").withColumn("x", F.lit(1)), root, "t")
    assert store.load(spark, root, "t").columns == ["id", "x"] and store.load(spark, root, "t").count() == 2
    assert store.snapshots(spark, root, "t") == [0, 1]


def test_unfinished_snapshot_is_ignored(spark, root):
    store.save(spark.range(5), root, "t")
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/t/snapshot=1")
    assert store.load(spark, root, "t").count() == 5


def test_append_with_new_columns(spark, root):
    store.append(spark.range(2), root, "log")
    store.append(spark.range(1).withColumn("x", F.lit("new")), root, "log")
    assert sorted(r.x or "" for r in store.load(spark, root, "log", merge=True).collect()) == ["", "", "new"]


def test_ensure_keeps_existing_rows(spark, root):
    store.ensure(spark, root, "f", dims.EXPERIMENT_SCHEMA)
    assert store.load(spark, root, "f").count() == 0
    store.append(spark.createDataFrame([("e", "n", "{}", "{}", 0.5, "", T0, "ACTIVE")], dims.EXPERIMENT_SCHEMA), root, "f")
    store.ensure(spark, root, "f", dims.EXPERIMENT_SCHEMA)
    assert store.load(spark, root, "f").count() == 1


def test_rows_with_null_only_columns(spark):
    assert store.rows_df(spark, [(1, None)], "a int, b timestamp").first().b is None


def test_bound_parameters_are_values_not_text(spark):
    df = store.query(spark, "SELECT * FROM {t} WHERE name = :n", {"n": "x' OR '1'='1"}, t=store.rows_df(spark, [("x",)], "name string"))
    assert df.isEmpty()


def test_fallback(spark):
    assert store.first_non_empty(None, spark.range(2)).count() == 2
    assert store.first_non_empty(spark.range(0), spark.range(2)).count() == 2
    assert store.first_non_empty(spark.range(1), spark.range(2)).count() == 1


def test_search_filters(spark):
    rows = [(1, "Paid", 0.0, "CA", True, dt.date(2024, 1, 1)), (2, "Paid", 5.0, "NY", False, dt.date(2024, 1, 2)), (3, "Open", 9.0, "CA", False, dt.date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "claim_id int, status string, claim_amount double, address_state string, is_fraud boolean, filing_date date")

    def ids(**filters):
        return [r.claim_id for r in dashboards.search(df, **filters).collect()]

    assert ids() == [2, 3, 1]
    assert ids(min_amount=0.0, max_amount=0.0) == [1]
    assert ids(status="Paid", state="CA") == [1] == ids(fraud_only=True)
    assert ids(text="PAID", limit=1) == [2]
    empty = dashboards.kpis(df.limit(0)).first()
    assert (empty.total_claims, empty.fraud_count, empty.fraud_rate_pct) == (0, 0, 0.0)


def test_recent_hides_deleted(spark):
    df = spark.createDataFrame([(1, T0, False), (2, T0, True)], "id int, created_timestamp timestamp, is_deleted boolean")
    assert [r.id for r in dashboards.recent(df, "created_timestamp").collect()] == [1]


SCHEMA = "claim_id long, ts timestamp, status string, value double"


def _land(spark, folder, *rows):
    data = [(c, T0 + dt.timedelta(hours=h), s, v) for c, h, s, v in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_takes_each_file_once(spark, root):
    for hour in (1, 2):
        _land(spark, f"{root}/in", (hour, hour, "a", 1.0))
        streams.ingest_stream(streams.read_files(spark, f"{root}/in", SCHEMA), f"{root}/out", f"{root}/cp", "feed")
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == 2 and "_record_hash" in out.columns


def test_late_rows_are_dropped_from_closed_windows(spark, root):
    def run():
        stream = streams.windowed_counts(streams.read_files(spark, f"{root}/in", SCHEMA), "ts", "status", "value", "24 hours", "1 hour")
        streams.run_to_files(stream, f"{root}/out", f"{root}/cp")
        return {r.window_start: r.row_count for r in spark.read.schema(stream.schema).parquet(f"{root}/out").collect()}

    _land(spark, f"{root}/in", (1, 1, "a", 1.0), (2, 2, "a", 1.0), (3, 30, "a", 1.0))
    assert run() == {T0: 2}
    _land(spark, f"{root}/in", (4, 3, "a", 1.0), (5, 60, "a", 1.0))  # the first row comes too late
    assert run() == {T0: 2, T0 + dt.timedelta(days=1): 1}


def test_dedupe_spans_runs(spark, root):
    for _ in range(2):
        _land(spark, f"{root}/in", (1, 1, "a", 1.0), (1, 2, "a", 1.0), (2, 1, "a", 1.0))
        stream = streams.dedupe_stream(streams.read_files(spark, f"{root}/in", SCHEMA), ["claim_id"], "ts", "10 days")
        streams.run_to_files(stream, f"{root}/out", f"{root}/cp")
    assert spark.read.parquet(f"{root}/out").count() == 2


def test_upsert_collects_changes_and_compacts(spark, root):
    store.save(spark.createDataFrame([(1, "new"), (2, "new")], "claim_id long, status string"), root, "claims")
    order = ["ts"]

    def run():
        streams.upsert_stream(streams.read_files(spark, f"{root}/in", SCHEMA), root, "claims", f"{root}/cp", order)
        return {r.claim_id: r.status for r in streams.upserted(spark, root, "claims", order).collect()}

    assert {r.claim_id for r in streams.upserted(spark, root, "claims", order).collect()} == {1, 2}
    _land(spark, f"{root}/in", (1, 1, "first", 0.0), (1, 2, "second", 0.0), (9, 1, "unknown", 0.0))
    assert run() == {1: "second", 2: "new"}
    streams.compact(spark, root, "claims", order)
    assert {r.claim_id: r.status for r in store.load(spark, root, "claims").collect()} == {1: "second", 2: "new"}
    _land(spark, f"{root}/in", (2, 5, "third", 0.0))
    assert run() == {1: "second", 2: "third"}


CLAIM = "claim_id long, status string"


def _statuses(df):
    return {r.claim_id: r.status for r in df.collect()}


def _stream(spark, root, checkpoint="cp"):
    streams.upsert_stream(streams.read_files(spark, f"{root}/in", SCHEMA), root, "claims", f"{root}/{checkpoint}", ["ts"])
    return _statuses(streams.upserted(spark, root, "claims", ["ts"]))


def test_append_to_a_saved_table(spark, root):
    store.save(spark.range(3), root, "t")
    store.append(spark.range(3, 5), root, "t")
    assert sorted(r.id for r in store.load(spark, root, "t").collect()) == [0, 1, 2, 3, 4]
    store.save(spark.range(1), root, "t")
    assert store.load(spark, root, "t").count() == 1


def test_a_number_is_never_used_twice(spark, root):
    store.save(spark.range(1), root, "t")
    number, content = store.newest(spark, root, "t")
    assert not store._publish(spark, root, "t", number, content)
    assert store.save(spark.range(2), root, "t") == number + 1
    assert store.load(spark, root, "t").count() == 2
    # Other file systems than the local one decide by a rename.
    name = f"{root}/t/{store._LOG}/"
    (_, taken), (_, free) = (store._folder(spark, name + f) for f in ("000000000000.json", "000000000002.json"))
    for file, allowed in ((taken, False), (free, True)):
        fs, draft = store._folder(spark, name + ".draft-x")
        fs.create(draft, True).close()
        if allowed:
            store._rename_new(spark, draft, file)
        else:
            with pytest.raises(FileExistsError):
                store._rename_new(spark, draft, file)


def test_changes_after_several_saves(spark, root):
    for status in ("old", "newer"):
        store.save(spark.createDataFrame([(1, status), (2, status)], CLAIM), root, "claims")
    _land(spark, f"{root}/in", (1, 1, "changed", 0.0))
    assert _stream(spark, root) == {1: "changed", 2: "newer"}


def test_a_save_replaces_streamed_changes(spark, root):
    store.save(spark.createDataFrame([(1, "old"), (2, "old")], CLAIM), root, "claims")
    for at in (1, 2, 3):
        _land(spark, f"{root}/in", (1, at, f"change {at}", 0.0))
        _stream(spark, root)
    store.save(spark.createDataFrame([(1, "replaced"), (2, "replaced")], CLAIM), root, "claims")
    assert _statuses(streams.upserted(spark, root, "claims", ["ts"])) == {1: "replaced", 2: "replaced"}
    _land(spark, f"{root}/in", (2, 4, "after", 0.0))
    assert _stream(spark, root) == {1: "replaced", 2: "after"}


def test_compact_in_any_order_and_pruning(spark, root):
    store.save(spark.createDataFrame([(1, "old"), (2, "old")], CLAIM), root, "claims")
    store.save(spark.createDataFrame([(1, "old"), (2, "old")], CLAIM), root, "claims")
    assert streams.compact(spark, root, "claims", ["ts"]) == 1
    _land(spark, f"{root}/in", (1, 1, "first", 0.0))
    _stream(spark, root)
    assert streams.compact(spark, root, "claims", ["ts"]) == 2
    assert streams.compact(spark, root, "claims", ["ts"]) == 2
    store.save(store.load(spark, root, "claims"), root, "claims")
    _land(spark, f"{root}/in", (2, 2, "second", 0.0))
    assert _stream(spark, root) == {1: "first", 2: "second"}
    streams.compact(spark, root, "claims", ["ts"])
    store.prune(spark, root, "claims", keep=1)
    assert len(store.snapshots(spark, root, "claims")) == 1
    assert not any(store.change_batches(spark, root, "claims").values())
    assert _statuses(streams.upserted(spark, root, "claims", ["ts"])) == {1: "first", 2: "second"}


def test_a_new_checkpoint_keeps_earlier_changes(spark, root):
    store.save(spark.createDataFrame([(1, "old"), (2, "old")], CLAIM), root, "claims")
    _land(spark, f"{root}/in", (1, 5, "late", 0.0))
    _stream(spark, root, "one")
    _land(spark, f"{root}/in", (2, 1, "other", 0.0))
    assert _stream(spark, root, "two") == {1: "late", 2: "other"}
    assert len(store.change_batches(spark, root, "claims")) == 2


def test_a_failed_compaction_leaves_the_table(spark, root):
    store.save(spark.createDataFrame([(1, "old")], CLAIM), root, "claims")
    _land(spark, f"{root}/in", (1, 1, "changed", 0.0))
    _stream(spark, root)
    # What a compaction leaves that dies while it writes: files that no version lists.
    spark.createDataFrame([(1, "half")], CLAIM).write.parquet(f"{root}/claims/parts/_store_part=half")
    number = store.newest(spark, root, "claims")[0]
    assert _statuses(store.load(spark, root, "claims")) == {1: "old"}
    assert _statuses(streams.upserted(spark, root, "claims", ["ts"])) == {1: "changed"}
    assert streams.compact(spark, root, "claims", ["ts"]) == number + 1
    assert _statuses(store.load(spark, root, "claims")) == {1: "changed"}
    store.prune(spark, root, "claims", keep=1, abandoned_hours=0)
    assert store._children(spark, f"{root}/claims/parts") == [p.removeprefix("parts/") for p in store.newest(spark, root, "claims")[1].parts]
    assert _statuses(store.load(spark, root, "claims")) == {1: "changed"}


def _ids(spark, root, merge=False):
    return sorted(r.id for r in store.load(spark, root, "t", merge).collect())


class _Meanwhile:
    """Lets another writer act between a writer's part and its version."""

    def __init__(self, monkeypatch, action):
        self.publish, self.action, self.done = store._publish, action, False
        monkeypatch.setattr(store, "_publish", self)

    def __call__(self, *args):
        if not self.done:
            self.done = True
            self.action()
        return self.publish(*args)


def test_rows_appended_during_a_save_stay(spark, root, monkeypatch):
    store.save(spark.range(3), root, "t")
    _Meanwhile(monkeypatch, lambda: store.append(spark.range(10, 12), root, "t"))
    store.save(spark.range(1), root, "t")
    assert _ids(spark, root) == [0, 10, 11]


def test_a_save_during_an_append_keeps_the_appended_rows(spark, root, monkeypatch):
    store.save(spark.range(3), root, "t")
    _Meanwhile(monkeypatch, lambda: store.save(spark.range(1), root, "t"))
    store.append(spark.range(10, 12).withColumn("x", F.lit(1)), root, "t")
    assert _ids(spark, root) == [0, 10, 11]
    assert store.load(spark, root, "t").columns == ["id"] and store.load(spark, root, "t", merge=True).columns == ["id", "x"]


def test_of_two_replacements_one_fails(spark, root, monkeypatch):
    store.save(spark.range(3), root, "t")
    old = store.newest(spark, root, "t")[0]
    _Meanwhile(monkeypatch, lambda: store.save(spark.range(5), root, "t"))
    with pytest.raises(store.Conflict):
        store.save(spark.range(1), root, "t")
    assert _ids(spark, root) == [0, 1, 2, 3, 4]
    with pytest.raises(store.Conflict):
        store.save(spark.range(1), root, "t", base=old)
    # Rows appended since the version a plan was made from are no conflict.
    base = store.newest(spark, root, "t")[0]
    plan = store.load(spark, root, "t").filter("id > 2")
    store.append(spark.range(7, 8), root, "t")
    store.save(plan, root, "t", base=base)
    assert _ids(spark, root) == [3, 4, 7]


def test_many_writers_append_at_once(spark, root):
    store.ensure(spark, root, "t", "id long")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: store.append(spark.range(i, i + 1), root, "t"), range(18)))
    assert _ids(spark, root) == list(range(18)) and store.snapshots(spark, root, "t") == list(range(19))


def test_an_unfinished_append_is_invisible(spark, root):
    store.save(spark.range(2), root, "t")
    store._write(spark.range(5, 9), root, "t", ())
    assert _ids(spark, root) == [0, 1]
    store.append(spark.range(2, 3), root, "t")
    assert _ids(spark, root) == [0, 1, 2]


def test_a_column_keeps_its_type(spark, root):
    store.save(spark.range(2), root, "t")
    with pytest.raises(ValueError, match="id is bigint, not string"):
        store.append(spark.createDataFrame([("x",)], "id string"), root, "t")
    assert _ids(spark, root) == [0, 1]


def test_partitioned_tables_and_plain_folders(spark, root):
    rows = spark.range(6).withColumn("day", (F.col("id") % 3).cast("int")).withColumn("x", F.lit("a"))
    store.append(rows, root, "t", partition_by=("day",))
    store.append(rows.withColumn("id", F.col("id") + 10), root, "t")
    df = store.load(spark, root, "t")
    assert df.columns == ["id", "day", "x"] and df.filter("day = 1").count() == 4
    assert "PartitionFilters: [isnotnull(day" in df.filter("day = 1")._jdf.queryExecution().toString()
    # A folder that somebody else wrote becomes the first part.
    spark.range(2).write.parquet(f"{root}/plain")
    store.append(spark.range(2, 3), root, "plain")
    assert sorted(r.id for r in store.load(spark, root, "plain").collect()) == [0, 1, 2]


def test_rows_appended_during_a_compaction_are_kept_and_changed(spark, root, monkeypatch):
    store.save(spark.createDataFrame([(1, "old"), (2, "old")], CLAIM), root, "claims")
    _land(spark, f"{root}/in", (1, 1, "changed", 0.0), (3, 2, "early", 0.0))
    assert _stream(spark, root) == {1: "changed", 2: "old"}

    def late():
        store.append(spark.createDataFrame([(3, "old"), (4, "old")], CLAIM), root, "claims")
        # A batch that arrives now stays pending.
        _land(spark, f"{root}/in", (4, 9, "later", 0.0))
        _stream(spark, root)

    _Meanwhile(monkeypatch, late)
    streams.compact(spark, root, "claims", ["ts"])
    assert _statuses(store.load(spark, root, "claims")) == {1: "changed", 2: "old", 3: "early", 4: "old"}
    assert _statuses(streams.upserted(spark, root, "claims", ["ts"])) == {1: "changed", 2: "old", 3: "early", 4: "later"}


def test_a_compaction_begins_again_after_a_save(spark, root, monkeypatch):
    store.save(spark.createDataFrame([(1, "old")], CLAIM), root, "claims")
    _land(spark, f"{root}/in", (1, 1, "changed", 0.0))
    _stream(spark, root)
    _Meanwhile(monkeypatch, lambda: store.save(spark.createDataFrame([(1, "replaced")], CLAIM), root, "claims"))
    streams.compact(spark, root, "claims", ["ts"])
    assert _statuses(store.load(spark, root, "claims")) == {1: "replaced"}


def test_a_streamed_change_sets_the_time(spark, root):
    rows = [(1, "old", T0), (2, "old", T0)]
    store.save(spark.createDataFrame(rows, f"{CLAIM}, updated_at timestamp"), root, "claims")
    _land(spark, f"{root}/in", (1, 3, "changed", 0.0), (1, 2, "earlier", 0.0))
    _stream(spark, root)
    expected = {1: T0 + dt.timedelta(hours=3), 2: T0}
    assert {r.claim_id: r.updated_at for r in streams.upserted(spark, root, "claims", ["ts"]).collect()} == expected
    streams.compact(spark, root, "claims", ["ts"])
    assert {r.claim_id: r.updated_at for r in store.load(spark, root, "claims").collect()} == expected


def test_record_hash_sees_every_change(spark):
    def diff(old, new):
        schema = "id int, x double, a string, b string"
        frames = [spark.createDataFrame([(1, *r)], schema) for r in (old, new)]
        return bronze.cdc_diff(*frames, "id").first()["change_type"]

    assert diff((0.1234, "a", "b"), (0.1244, "a", "b")) == "update"
    assert diff((10.0, "a", "b"), (10.004, "a", "b")) == "update"
    assert diff((1e17, "a", "b"), (1e17, "a", "b")) == "unchanged"
    assert diff((1.0, "a|b", "c"), (1.0, "a", "b|c")) == "update"
    assert diff((1.0, "a||b", "c"), (1.0, "a", "b||c")) == "update"
    assert diff((1.0, "-", "c"), (1.0, None, "c")) == "update" and diff((1.0, "", "c"), (1.0, None, "c")) == "update"


def test_panes_are_spread_not_rows(spark, root):
    rows = spark.createDataFrame([(1, T0, "a", 1.0)], SCHEMA)
    plan = streams.rolling_monitor(rows, "ts", "value", F.col("status") == "error", "1 hour")._jdf.queryExecution().optimizedPlan().toString()
    # Top down: the windows, the copies, the panes, the rows.
    spread, panes = plan.index("Expand"), plan.rindex("Aggregate")
    assert plan.index("Aggregate") < spread < panes and plan.count("Expand") == 1


def test_rolling_windows_over_runs_and_late_rows(spark, root):
    def run():
        stream = streams.rolling_monitor(streams.read_files(spark, f"{root}/in", SCHEMA), "ts", "value", F.col("status") == "error", "1 hour")
        streams.run_to_files(stream, f"{root}/out", f"{root}/cp")
        rows = spark.read.schema(stream.schema).parquet(f"{root}/out").collect()
        return {(r.window_start - T0) // dt.timedelta(hours=1): (r.row_count, r.avg_value, r.error_count) for r in rows}

    def expected(rows, closed):
        out = {}
        for start in range(-23, closed - 24 + 1):
            mine = [(s, v) for h, s, v in rows if start <= h < start + 24]
            if mine:
                values = [v for _, v in mine if v is not None]
                out[start] = (len(mine), sum(values) / len(values) if values else None, sum(s == "error" for s, _ in mine))
        return out

    first = [(1, "a", 1.0), (1, "error", 4.0), (3, "a", None), (30, "error", 2.0)]
    _land(spark, f"{root}/in", *[(i, *r) for i, r in enumerate(first)])
    assert run() == expected(first, 29)
    # Hour 28 closed with the first run, hour 29 is open still; the state of open panes and windows was kept.
    later = [(29.5, "a", 8.0), (80, "a", 1.0)]
    _land(spark, f"{root}/in", (7, 28, "a", 100.0), *[(i, *r) for i, r in enumerate(later)])
    assert run() == expected([*first, *later], 79)


def test_state_lies_in_rocksdb(spark, root):
    _land(spark, f"{root}/in", (1, 1, "a", 1.0))
    stream = streams.dedupe_stream(streams.read_files(spark, f"{root}/in", SCHEMA), ["claim_id"], "ts", "10 days")
    streams.run_to_files(stream, f"{root}/out", f"{root}/cp")
    files = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/cp/state").select("path").collect()]
    assert any(f.endswith((".changelog", ".zip")) for f in files) and not any(f.endswith(".delta") for f in files)
