"""Gold tables made batch by batch against those made at once."""

import datetime as dt

import pytest
from builders import CLAIM
from pyspark.sql import functions as F

from caseflow.operators import gold, incremental
from caseflow.sources import store
from caseflow.streaming import streams

AS_OF = dt.datetime(2024, 1, 1)
SCHEMA = (
    "claim_id long, claimant_id long, full_name string, address_state string, claim_type string, insurance_provider string, "
    "incident_date date, claim_amount double, status string, is_fraud boolean, days_to_file int"
)


def _claims(spark, numbers):
    rows = [
        (
            i, i % 5, "Ann" if i % 5 else None, "CA" if i % 3 else None, "Auto" if i % 2 else "Home", ["P1", "P2", None][i % 3],
            CLAIM["incident_date"] + dt.timedelta(days=3 * i), None if i % 7 == 0 else float(i), ["Approved", "Denied", None][i % 3],
            [True, False, None][i % 3], None if i % 4 == 0 else i % 9,
        )
        for i in numbers
    ]
    return spark.createDataFrame(rows, SCHEMA)


TABLES = {
    "summary": (incremental.claims_summary, gold.claims_summary),
    "profiles": (incremental.claimant_profiles, gold.claimant_profiles),
    "providers": (incremental.provider_metrics, gold.provider_metrics),
    "weeks": (incremental.weekly_series, gold.weekly_series),
}


def _rows(df):
    names = sorted(df.columns)
    plain = [tuple(round(r[c], 9) if isinstance(r[c], float) else str(r[c]) for c in names) for r in df.collect()]
    return names, sorted(plain, key=str)


@pytest.mark.parametrize("name", TABLES)
def test_batches_add_up(spark, root, name):
    make, whole = TABLES[name][0](), TABLES[name][1]
    every = _claims(spark, range(60))

    def check(limit):
        assert _rows(incremental.current(spark, root, name, make, AS_OF)) == _rows(whole(every.filter(F.col("claim_id") < limit), as_of=AS_OF))

    incremental.add(every.filter("claim_id < 25"), root, name, make, ("feed", 0))
    check(25)
    incremental.add(every.filter("claim_id >= 25 and claim_id < 40"), root, name, make, ("feed", 1))
    # Given again, whole or after a failure in between, a batch changes nothing.
    incremental.add(every.filter("claim_id >= 25 and claim_id < 40"), root, name, make, ("feed", 1))
    incremental.add(every.filter("claim_id < 25"), root, name, make, ("feed", 0))
    check(40)
    incremental.fold(spark, root, name, make)
    assert len(store.newest(spark, root, f"{name}_states")[1].parts) == 1
    incremental.add(every.filter("claim_id >= 25 and claim_id < 40"), root, name, make, ("feed", 1))
    check(40)
    # An empty batch, and another feed with numbers of its own.
    incremental.add(every.limit(0), root, name, make, ("feed", 2))
    incremental.add(every.filter("claim_id >= 40"), root, name, make, ("other", 0))
    check(60)


def test_a_batch_that_stopped_halfway_is_completed(spark, root):
    make, claims = incremental.claimant_profiles(), _claims(spark, range(20))
    store.append(make.partial(claims), root, "t_states", batch=("feed", 0))
    incremental.add(claims, root, "t", make, ("feed", 0))
    assert _rows(incremental.current(spark, root, "t", make, AS_OF)) == _rows(gold.claimant_profiles(claims, as_of=AS_OF))


def test_of_two_writers_of_a_batch_one_fails(spark, root, monkeypatch):
    publish, again = store._publish, []

    def meanwhile(*args):
        if not again:
            again.append(True)
            store.append(spark.range(3), root, "t", batch=("feed", 0))
        return publish(*args)

    monkeypatch.setattr(store, "_publish", meanwhile)
    with pytest.raises(store.Conflict):
        store.append(spark.range(3), root, "t", batch=("feed", 0))
    assert store.load(spark, root, "t").count() == 3


def test_a_stream_refreshes_the_table(spark, root):
    make = incremental.provider_metrics()
    for part in (range(30), range(30, 50)):
        _claims(spark, part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = streams.read_files(spark, f"{root}/in", SCHEMA)
        incremental.refresh_stream(stream, root, "p", make, f"{root}/cp", "claims")
        seen = _claims(spark, range(part[-1] + 1))
        assert _rows(incremental.current(spark, root, "p", make, AS_OF)) == _rows(gold.provider_metrics(seen, as_of=AS_OF))
