import datetime as dt

import pytest
from pyspark.sql import functions as F

from builders import claims, column, people, policies
from caseflow.operators import gold, ranking, silver
from caseflow.sources import fixtures


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def test_enrich_keeps_claims_without_policy_or_claimant(spark):
    df = silver.enrich(
        claims(spark, dict(claim_id=1), dict(claim_id=2, policy_id=99, claimant_id=None)), policies(spark), people(spark)
    )
    assert column(df, "insurance_provider") == {1: "P1", 2: None}
    assert column(df, "full_name") == {1: "Ann Lee", 2: None}
    assert "email" not in df.columns and "phone" not in df.columns
    assert len(df.columns) == 24


def test_enrich_carries_ingestion_metadata(spark):
    tagged = claims(spark, {}).withColumns({"_ingestion_timestamp": F.current_timestamp(), "_source_system": F.lit("x")})
    assert len(silver.enrich(tagged, policies(spark), people(spark)).columns) == 26


def test_mask_pii_null_name_and_bad_mail(spark):
    df = silver.mask_pii(people(spark, dict(first_name=None), dict(claimant_id=2, email="nothing")))
    assert column(df, "full_name", "claimant_id") == {100: None, 2: "Ann Lee"}
    assert column(df, "email_domain", "claimant_id") == {100: "example.com", 2: ""}
    assert "date_of_birth" not in silver.mask_pii(people(spark), strict=True).columns


def test_financial_thresholds(spark):
    amounts = {1: 4999.99, 2: 5000.0, 3: 19999.99, 4: 20000.0, 5: 50000.0, 6: 9000.0, 7: 8999.99, 8: 10000.0, 9: 10000.01}
    rows = [dict(claim_id=k, claim_amount=a) for k, a in amounts.items()] + [dict(claim_id=10, policy_id=11)]
    terms = silver.with_policy(claims(spark, *rows), policies(spark, {}, dict(policy_id=11, policy_limit=0.0)))
    df = silver.financial_features(terms)
    category = column(df, "amount_category")
    assert [category[k] for k in range(1, 6)] == ["Low", "Medium", "Medium", "High", "Very High"]
    near, over = column(df, "claim_near_limit"), column(df, "claim_exceeds_limit")
    assert (near[6], near[7]) == (1, 0)
    assert (over[8], over[9]) == (0, 1)
    assert column(df, "claim_to_limit_ratio")[10] is None


def test_risk_flag_thresholds_and_nulls(spark):
    rows = [(1, 1, 29, 29, 4, 100000.01, 1), (2, 2, 30, 30, 3, 100000.0, 0), (3, 30, None, None, None, None, None), (4, 31, 0, 0, 0, 0.0, 0)]
    df = silver.risk_flags(
        spark.createDataFrame(
            rows,
            "claim_id int, days_to_file int, days_since_policy_start int, days_until_policy_end int, "
            "total_claims_count int, total_claimed_amount double, prior_fraud_count int",
        )
    )
    assert column(df, "rapid_filing") == {1: 1, 2: 0, 3: 0, 4: 0}
    assert column(df, "delayed_filing") == {1: 0, 2: 0, 3: 0, 4: 1}
    for flag in ("policy_new_incident", "policy_expiring_soon", "frequent_claimant", "high_value_claimant", "has_prior_fraud"):
        assert [column(df, flag)[k] for k in (1, 2, 3)] == [1, 0, 0], flag


def test_weekend_and_text(spark):
    rows = [dict(claim_id=1, incident_date=dt.date(2024, 1, 6)), dict(claim_id=2, incident_date=dt.date(2024, 1, 7)),
            dict(claim_id=3, incident_date=dt.date(2024, 1, 8), diagnosis_code="M54.5", description="a b  c")]
    df = silver.text_features(silver.temporal_features(silver.with_policy(claims(spark, *rows), policies(spark))))
    assert column(df, "is_weekend_incident") == {1: 1, 2: 1, 3: 0}
    assert column(df, "description_word_count")[3] == 4
    assert column(df, "has_medical_code") == {1: 0, 2: 0, 3: 1}


def _hot_claims(spark, n=600):
    """One claimant with a third of all rows, mostly on one day, and claims without a claimant."""
    rows = []
    for i in range(n):
        who = 7 if i % 3 == 0 else None if i % 10 == 1 else 100 + i % 50
        rows.append(dict(claim_id=i, claimant_id=who, policy_id=10 + i % 4, filing_date=day(i % 2 if who == 7 else i % 90),
                         claim_amount=float(i), is_fraud=i % 11 == 0))
    return claims(spark, *rows)


@pytest.mark.parametrize("hot", [100, 1000])
def test_sequence_of_a_hot_claimant_is_exact(spark, hot):
    data = _hot_claims(spark)
    df = silver.claim_sequence(data, silver.hot_claimants(data, hot))
    rows = df.select("claim_id", "claimant_id", "filing_date", "claim_sequence_num", F.md5(F.col("claim_id").cast("string")).alias("m")).collect()
    groups = {}
    for row in rows:
        groups.setdefault(row.claimant_id, []).append(row)
    assert len(rows) == 600 and len(groups[7]) == 200
    for members in groups.values():
        ordered = sorted(members, key=lambda r: (r.filing_date, r.m))
        assert [r.claim_sequence_num for r in ordered] == list(range(1, len(members) + 1))


def test_no_cell_holds_a_hot_day(spark):
    cells = _hot_claims(spark).groupBy(ranking.cell(["claimant_id"], "filing_date", "claim_id")).count()
    assert cells.agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("hot", [0, 30, 100, 1000])
def test_build_equals_the_single_steps(spark, hot):
    data, terms = _hot_claims(spark), policies(spark, *[dict(policy_id=10 + i, provider=f"P{i}") for i in range(3)])
    who = people(spark, *[dict(claimant_id=i) for i in (7, *range(100, 140))])
    built = silver.build(data, terms, who, hot=hot)
    assert column(built, "policy_found") == {i: i % 4 < 3 for i in range(600)}
    built = built.drop("policy_found")
    steps = silver.enrich(data, terms, who)
    for step in (silver.temporal_features, silver.financial_features, silver.claim_sequence, silver.claimant_history,
                 silver.risk_flags, silver.text_features, silver.with_weather):
        steps = step(steps)
    assert set(built.columns) == set(steps.columns)
    names = [c for c in built.columns if c not in ("avg_claim_amount", "provider_count")]
    assert built.select(names).exceptAll(steps.select(names)).isEmpty()
    assert steps.select(names).exceptAll(built.select(names)).isEmpty()
    averages, expected = column(built, "avg_claim_amount"), column(steps, "avg_claim_amount")
    assert all(averages[k] == pytest.approx(expected[k]) for k in expected)
    assert column(built, "provider_count") == column(steps, "provider_count")
    assert built.count() == 600


def test_hot_claimants_are_few_and_their_days_are_sliced(spark):
    data = _hot_claims(spark)
    assert [r[0] for r in silver.hot_claimants(data, 100).collect()] == [7]
    assert {r[0] for r in silver.hot_claimants(data, 30).collect()} == {7, None}
    slices = data.filter("claimant_id = 7").groupBy(ranking.cell(["claimant_id"], "filing_date", "claim_id")).count()
    assert slices.agg(F.max("count")).first()[0] <= 4


def test_the_ordinary_plan_moves_claims_twice(spark):
    """Ordinary claimants: by policy, then by claimant for sequence and totals alike."""
    data, terms = _hot_claims(spark), policies(spark)
    plan = silver._total(silver._number(silver.with_policy(data, terms)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(claimant_id") == 1
    assert text.count("Exchange hashpartitioning(policy_id") <= 2


def test_many_policies_are_not_taken_for_few(spark, root):
    """Eight policies a customer: an estimate that stays at the customers' bytes lets Spark broadcast millions of them."""
    spark.range(0, 1_000_000, 1, 4).select(F.col("id").alias("c_custkey")).write.parquet(f"{root}/customer.parquet")
    terms = fixtures.policies(spark.read.parquet(f"{root}/customer.parquet")).select("policy_id", "provider")
    size = int(terms._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size > 8_000_000 * 16
    assert terms.count() == terms.select("policy_id").distinct().count() == 8_000_000


def test_history_before_knows_earlier_days_only(spark):
    rows = [
        dict(claim_id=1, filing_date=day(0), claim_amount=10.0, is_fraud=True), dict(claim_id=2, filing_date=day(0), claim_amount=20.0),
        dict(claim_id=3, filing_date=day(1), claim_amount=40.0, policy_id=11), dict(claim_id=4, filing_date=day(5), claim_amount=None),
        dict(claim_id=5, filing_date=None), dict(claim_id=6, filing_date=day(9), claimant_id=None),
    ]
    df = silver.history_before(silver.with_policy(claims(spark, *rows), policies(spark, {}, dict(policy_id=11, provider="P2"))))
    assert column(df, "total_claims_count") == {1: 0, 2: 0, 3: 2, 4: 3, 5: None, 6: None}
    assert column(df, "total_claimed_amount") == {1: 0.0, 2: 0.0, 3: 30.0, 4: 70.0, 5: None, 6: None}
    assert column(df, "avg_claim_amount") == {1: None, 2: None, 3: 15.0, 4: pytest.approx(70 / 3), 5: None, 6: None}
    assert column(df, "prior_fraud_count") == {1: 0, 2: 0, 3: 1, 4: 1, 5: None, 6: None}
    assert column(df, "provider_count") == {1: 0, 2: 0, 3: 1, 4: 2, 5: None, 6: None}
    built = silver.build(claims(spark, *rows), policies(spark), people(spark), point_in_time=True)
    assert column(built, "prior_fraud_count")[4] == 1 and column(built, "claim_sequence_num")[4] == 5


def test_weather_keeps_the_latest_success_and_survives_bad_json(spark):
    log = spark.createDataFrame(
        [
            (1, "weather", '{"precipitation_inches": 0.6, "conditions_summary": "Rain"}', "2024-01-01", "success"),
            (1, "weather", '{"wind_speed_mph": 25.0, "conditions_summary": "Windy"}', "2024-01-02", "success"),
            (1, "weather", '{"wind_speed_mph": 99}', "2024-01-03", "failed"),
            (2, "geocoding", "{}", "2024-01-01", "success"),
            (3, "weather", '{"wind_speed_mph": "n/a", "conditions_summary": "?"}', "2024-01-01", "success"),
            (4, "weather", '{"precipitation_inches": 0.51, "conditions_summary": "Rain"}', "2024-01-01", "success"),
        ],
        "claim_id long, enrichment_source string, enrichment_data string, enrichment_timestamp string, api_status string",
    )
    df = silver.with_weather(claims(spark, *[dict(claim_id=i) for i in range(1, 5)]), silver.parse_weather(log))
    assert column(df, "weather_conditions") == {1: "Windy", 2: None, 3: "?", 4: "Rain"}
    assert column(df, "had_severe_weather") == {1: 0, 2: 0, 3: 0, 4: 1}
    assert column(df, "weather_enriched") == {1: 1, 2: 0, 3: 1, 4: 1}


def test_coordinates_fall_back(spark):
    df = silver.with_coordinates(
        spark.createDataFrame([(1, "TX", "NY"), (2, None, "NY"), (3, None, None), (4, "ZZ", "NY")], "claim_id int, a string, b string"),
        "a", "b",
    )
    assert column(df, "latitude") == {1: 29.7604, 2: 40.7128, 3: 34.0522, 4: 34.0522}


def test_alert_thresholds(spark):
    columns = (
        "claim_id int, is_fraud boolean, claim_to_limit_ratio double, rapid_filing int, has_prior_fraud int, "
        "total_claims_count int, claimant_id int, policy_id int, full_name string, insurance_provider string, "
        "claim_amount double, status string, description string"
    )
    rest = (0, 0, "n", "p", 1.0, "s", "d")
    rows = [(1, False, 0.85, 0, 0, 5, *rest), (2, False, 0.86, 0, 0, 5, *rest), (3, False, None, 1, 0, 0, *rest),
            (4, True, 2.5, 0, 0, 0, *rest), (5, False, 0.0, 0, 1, 6, *rest), (6, False, 1.0, 1, 1, 0, *rest)]
    df = gold.fraud_alerts(spark.createDataFrame(rows, columns))
    assert column(df, "alert_priority") == {2: "Low", 3: "Low", 4: "Critical", 5: "Medium", 6: "Critical"}
    assert column(df, "investigation_required") == {2: False, 3: False, 4: True, 5: False, 6: True}


def test_profile_tiers(spark):
    def rows(who, n, fraud, gap):
        return [dict(claim_id=who * 100 + i, claimant_id=who, is_fraud=fraud and i == 0, incident_date=day(i * gap)) for i in range(n)]

    data = claims(spark, *rows(1, 2, True, 400), *rows(2, 6, False, 500), *rows(3, 3, False, 100), *rows(4, 2, False, 365), *rows(5, 1, False, 0))
    who = people(spark, *[dict(claimant_id=i) for i in range(1, 6)])
    df = gold.claimant_profiles(silver.temporal_features(silver.enrich(data, policies(spark), who)))
    assert column(df, "risk_tier", "claimant_id") == {
        1: "High Risk - Known Fraud", 2: "High Risk - Frequent", 3: "Medium Risk - Active", 4: "Low Risk", 5: "Low Risk"}


def test_moving_average_counts_rows(spark):
    data = claims(spark, *[dict(claim_id=i, incident_date=day(7 * w), claim_amount=float(w)) for i, w in enumerate([0, 1, 2, 8, 9])])
    df = gold.weekly_series(data).orderBy("incident_week")
    assert [r.amount_4week_avg for r in df.collect()] == [0.0, 0.5, 1.0, 2.75, 5.0]


def test_empty_input(spark):
    none = claims(spark, {}).limit(0)
    assert silver.build(none, policies(spark), people(spark)).count() == 0
