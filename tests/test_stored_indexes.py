"""Postings, digests and day partitions: the same rows as the scan, from less of the table."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from caseflow.operators import bronze, dashboards, investigate, silver, text_index
from caseflow.plans import registry
from caseflow.sources import store


def _pruned(df, column):
    return re.search(rf"PartitionFilters: \[[^]]*{column}#", df._jdf.queryExecution().toString()) is not None


# ---------------------------------------------------------------- postings

TEXTS = ["Water damage", "WATER in the CELLAR", None, "", "ab", "slip and fall", "wat erdam", "caf\u00e9 \U0001f600\U0001f601 noir", "water" * 3000]


def _texts(spark):
    rows = [(i, t, f"p{i % 3}") for i, t in enumerate(TEXTS * 3)] + [(None, "water damage", "p9")]
    return spark.createDataFrame(rows, "id long, text string, place string")


@pytest.mark.parametrize("term", ["water", "WATER damage", "ab", "a", "slip", "nothing like it", "\u00e9 \U0001f600\U0001f601", "water cellar noir", "aterw"])
def test_postings_find_what_a_scan_finds(spark, root, term):
    df = _texts(spark)
    text_index.build(df, root, "texts", "id", F.col("text"))
    scan = investigate.keyword_search(df, term, 50, "text", "id")
    found = text_index.keyword_search(df, root, "texts", term, 50, "text", "id")
    assert sorted(map(str, found.collect())) == sorted(map(str, scan.collect()))


@pytest.mark.parametrize("term", ["water", "p1", "7 wat", "in the cellar p", "x", "zzz"])
def test_postings_of_whole_rows(spark, root, term):
    df = _texts(spark)
    text_index.build(df, root, "rows", "id")
    assert sorted(map(str, text_index.text_search(df, root, "rows", term, "id").collect())) == sorted(
        map(str, dashboards.text_search(df, term).collect())
    )


def test_few_texts_are_looked_at(spark, root):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text_index.build(documents, root, "documents", "doc_id", F.col("text"))
    rows = documents.count()
    words = documents.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("length(word) >= 8").distinct()
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rare, common = (counted.filter(w).orderBy("word").first()["word"] for w in ("n between 3 and 10", "n > 40"))
    for term, share in ((rare, 0.3), (common, 0.5)):
        wanted = documents.filter(F.lower("text").contains(term)).select("doc_id").distinct().count()
        seen = text_index.candidates(spark, root, "documents", term).count()
        print(term, "of", rows, "looked at", seen, "found", wanted)
        assert 0 < wanted <= seen <= share * rows
    assert text_index.candidates(spark, root, "documents", "ab") is None
    assert _pruned(text_index._of_grams(store.load(spark, root, "documents"), ["pas"]), "bucket")


def test_postings_are_lists_of_every_run_and_row(spark, root, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 50)
    df = _texts(spark).repartition(2)
    text_index.build(df, root, "texts", "id", F.col("text"))
    found = store.load(spark, root, "texts")
    pairs = {(r["key"], r["gram"]) for r in found.select(F.explode("keys").alias("key"), "gram").collect()}
    rows = df.select("id", F.lower("text").alias("text")).collect()
    assert pairs == {(r["id"], r["text"][i : i + 3]) for r in rows for i in range(len(r["text"] or "") - 2)}
    assert pairs == {(r["id"], r["gram"]) for r in df.select("id", F.explode(text_index.grams(F.col("text"))).alias("gram")).collect()}
    # Fewer rows than pairs, and more than runs, since there are several blocks.
    assert len({g for _, g in pairs}) < found.count() < len(pairs)
    sizes = {r["gram"]: r["rows"] for r in store.load(spark, root, "texts_sizes").collect()}
    assert sizes == {g: sum(1 for _, x in pairs if x == g) for g in sizes} and len(sizes) == len({g for _, g in pairs})


# ---------------------------------------------------------------- digests


def test_equal_buckets_are_not_read(spark, root):
    schema = "id long, x double, name string"
    old = [(i, float(i), f"n{i}") for i in range(400)]
    new = [(i, float(i) + (i == 7), f"n{i}") for i in range(400) if i != 30] + [(900, 1.0, None)]
    before, after = (spark.createDataFrame(r, schema) for r in (old, new))
    bronze.keep_snapshot(before, root, "t", "id", 32)
    buckets = bronze.changed_buckets(after, root, "t", "id", 32)
    assert 1 <= len(buckets) <= 3
    found = bronze.cdc_diff_stored(after, root, "t", "id", 32)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, bronze.cdc_diff(before, after, "id").collect()))
    assert _pruned(found, "bucket")
    assert bronze.changed_buckets(before, root, "t", "id", 32) == []
    assert {r.change_type for r in bronze.cdc_diff_stored(before, root, "t", "id", 32).collect()} == {"unchanged"}
    assert {r.change_type for r in bronze.cdc_diff_stored(before.limit(0), root, "t", "id", 32).collect()} == {"delete"}


# ---------------------------------------------------------------- logs by day

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("period", ["day", "month"])
def test_logs_read_the_days_they_need(spark, root, period):
    rows = [(i, T0 + dt.timedelta(hours=7 * i), i % 4 == 0) for i in range(60)] + [(99, None, False)]
    df = spark.createDataFrame(rows, "id long, at timestamp, is_deleted boolean")
    store.append_log(df.filter("id < 30"), root, "log", "at", period)
    store.append_log(df.filter("id >= 30"), root, "log", "at", period)
    since = T0 + dt.timedelta(hours=300)
    recent = store.load_log(spark, root, "log", "at", since, period)
    assert recent.columns == df.columns
    assert sorted(r.id for r in recent.collect()) == [i for i, at, _ in rows if at and at >= since]
    assert _pruned(recent, "_period")
    for n in (1, 5, 20, 44, 200):
        live = store.load_newest(spark, root, "log", n, ~F.col("is_deleted"))
        assert dashboards.recent(live, "at", n, "id").collect() == dashboards.recent(df, "at", n, "id").collect()
    few = store.load_newest(spark, root, "log", 1)
    assert _pruned(few, "_period")


# ---------------------------------------------------------------- providers before a day


def test_providers_are_counted_without_growing_sets(spark):
    pick = random.Random(1)
    rows = [
        (i, pick.choice([1, 2, None]), pick.choice(["A", "B", "C", None]), pick.choice([None, *range(9)]), 1.0, False)
        for i in range(200)
    ]
    rows = [(i, c, p, None if d is None else (T0 + dt.timedelta(days=d)).date(), a, f) for i, c, p, d, a, f in rows]
    schema = "claim_id long, claimant_id long, insurance_provider string, filing_date date, claim_amount double, is_fraud boolean"
    df = spark.createDataFrame(rows, schema)
    history = silver.history_before(df)
    for r in history.collect():
        if r.claimant_id is None or r.filing_date is None:
            assert r.provider_count is None
            continue
        earlier = {p for _, c, p, d, _, _ in rows if c == r.claimant_id and d is not None and d < r.filing_date and p is not None}
        assert r.provider_count == len(earlier)
    assert "collect_" not in history._jdf.queryExecution().toString()


def test_the_latest_call_of_one_instant_does_not_depend_on_the_order_of_rows(spark, root):
    rows = [(2 * i + j, dt.datetime(2024, 1, 1), 1, kind, 1.0, '{"k": 1}') for i in range(20) for j, kind in enumerate(("view", "click"))]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for name, found in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(found, schema).coalesce(1).write.parquet(f"{root}/{name}/events.parquet")
        latest = registry.QUERIES["ddp1_latest_per_key"](spark, f"{root}/{name}")
        assert {r.conditions_summary for r in latest.collect()} == {"view"}
