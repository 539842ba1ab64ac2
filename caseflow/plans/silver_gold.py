"""Silver features and gold aggregates (SLV, GLD, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import gold, incremental, investigate, quality, silver
from caseflow.functions.features import weather_summary
from caseflow.plans.base import (
    ORACLES,
    AS_OF,
    CLAIMANTS,
    CLAIMS,
    ENRICHED,
    ICD,
    POLICIES,
    SILVER,
    WEATHER,
    day,
    instant,
    num,
    nums,
    plain,
    query,
)
from caseflow.session import work_dir
from caseflow.sources import store

ENRICHED_SQL = f"""WITH {ENRICHED} SELECT claim_id, policy_id, claimant_id, claim_type, {day('incident_date')},
{day('filing_date')}, {num('claim_amount')}, description, diagnosis_code, procedure_code, status, is_fraud,
insurance_provider, {nums('policy_limit deductible premium_annual')}, {day('policy_start_date')}, {day('policy_end_date')},
first_name, last_name, full_name, {day('date_of_birth')}, email_domain, address_state FROM enriched"""


@query("slv1_enrich", ENRICHED_SQL)
def _(v):
    return plain(v.enriched)


@query(
    "slv2_mask_pii",
    f"""WITH {CLAIMANTS} SELECT claimant_id, first_name, last_name, {day('date_of_birth')}, address_state,
first_name || ' ' || last_name AS full_name, regexp_extract(email, '@(.+)', 1) AS email_domain FROM claimants""",
)
def _(v):
    return plain(silver.mask_pii(v.claimants))


TEMPORAL = (
    "days_to_file days_since_policy_start days_until_policy_end incident_year incident_month "
    "incident_day_of_week filing_year filing_month is_weekend_incident"
).split()
FINANCIAL = "claim_exceeds_limit claim_near_limit amount_category".split()
RISK_FLAGS = (
    "rapid_filing delayed_filing policy_new_incident policy_expiring_soon frequent_claimant "
    "high_value_claimant has_prior_fraud"
).split()
TEXT = "description_length description_word_count has_medical_code".split()


@query("slv3_temporal_features", f"WITH {ENRICHED} SELECT claim_id, {', '.join(TEMPORAL)} FROM dated")
def _(v):
    return v.dated.select("claim_id", *TEMPORAL)


@query(
    "slv4_financial_features",
    f"WITH {SILVER} SELECT claim_id, {nums('claim_to_limit_ratio claim_to_premium_ratio')}, {', '.join(FINANCIAL)} FROM silver",
)
def _(v):
    featured = silver.financial_features(silver.with_policy(v.claims, v.policies))
    return plain(featured.select("claim_id", "claim_to_limit_ratio", "claim_to_premium_ratio", *FINANCIAL))


@query(
    "slv5_claim_sequence",
    f"""WITH {SILVER} SELECT claim_id, claimant_id, claim_sequence_num,
CASE WHEN claim_sequence_num=1 THEN 1 ELSE 0 END AS is_first_claim FROM silver""",
)
def _(v):
    return silver.claim_sequence(v.claims).select("claim_id", "claimant_id", "claim_sequence_num", "is_first_claim")


HISTORY_SQL = f"""WITH {SILVER} SELECT claim_id, claimant_id, total_claims_count,
{nums('total_claimed_amount avg_claim_amount max_claim_amount')}, prior_fraud_count, provider_count FROM silver"""
HISTORY = (
    "total_claims_count total_claimed_amount avg_claim_amount max_claim_amount prior_fraud_count provider_count"
).split()


@query("slv6_claimant_history", HISTORY_SQL)
def _(v):
    history = silver.claimant_history(silver.with_policy(v.claims, v.policies), silver.hot_claimants(v.claims))
    return plain(history.select("claim_id", "claimant_id", *HISTORY))


@query(
    "slv6_history_point_in_time",
    f"""WITH {ENRICHED} SELECT claim_id, claimant_id, count(*) OVER earlier AS total_claims_count,
{num('coalesce(sum(claim_amount) OVER earlier, 0)', 'total_claimed_amount')}, {num('avg(claim_amount) OVER earlier', 'avg_claim_amount')},
{num('max(claim_amount) OVER earlier', 'max_claim_amount')}, count(*) FILTER (WHERE is_fraud) OVER earlier AS prior_fraud_count,
coalesce(len(list_distinct(list(insurance_provider) OVER earlier)), 0) AS provider_count FROM enriched
WINDOW earlier AS (PARTITION BY claimant_id ORDER BY filing_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
)
def _(v):
    history = silver.history_before(silver.with_policy(v.claims, v.policies))
    return plain(history.select("claim_id", "claimant_id", *HISTORY))


@query("slv7_risk_flags", f"WITH {SILVER} SELECT claim_id, {', '.join(RISK_FLAGS)} FROM silver")
def _(v):
    timed = silver.temporal_features(silver.with_policy(v.claims, v.policies))
    history = silver.claimant_history(timed, silver.hot_claimants(v.claims))
    return silver.risk_flags(history).select("claim_id", *RISK_FLAGS)


@query("slv8_text_features", f"WITH {SILVER} SELECT claim_id, {', '.join(TEXT)} FROM silver")
def _(v):
    return silver.text_features(v.claims).select("claim_id", *TEXT)


WEATHER_LATEST = f"""{WEATHER}, latest AS (SELECT claim_id, CAST(precipitation_inches AS FLOAT) AS weather_precipitation_in,
CAST(wind_speed_mph AS FLOAT) AS weather_wind_speed_mph, conditions_summary AS weather_conditions,
CAST(NULL AS DOUBLE) AS weather_temp_max_f, CAST(NULL AS DOUBLE) AS weather_temp_min_f, {instant('enrichment_timestamp', 'weather_api_timestamp')} FROM weather
WHERE enrichment_source='weather' AND api_status='success'
QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY enrichment_timestamp DESC)=1)"""


@query(
    "slv9_parse_weather",
    f"""WITH {WEATHER_LATEST} SELECT claim_id, {nums('weather_precipitation_in weather_wind_speed_mph weather_temp_max_f weather_temp_min_f')},
weather_conditions, weather_api_timestamp FROM latest""",
)
def _(v):
    parsed = silver.parse_weather(v.weather)
    return plain(parsed.withColumn("weather_api_timestamp", F.col("weather_api_timestamp").cast("timestamp")))


WEATHER_NAMES = "weather_precipitation_in weather_wind_speed_mph weather_temp_max_f weather_temp_min_f"


@query(
    "slv13_silver_with_weather",
    f"""WITH {SILVER}, {WEATHER_LATEST} SELECT silver.claim_id, claimant_id, claim_sequence_num, total_claims_count, full_name,
{num('claim_to_limit_ratio')}, {nums(WEATHER_NAMES)}, weather_conditions, weather_api_timestamp,
CASE WHEN weather_precipitation_in>0.5 OR weather_wind_speed_mph>25 THEN 1 ELSE 0 END AS had_severe_weather,
CASE WHEN weather_conditions IS NOT NULL THEN 1 ELSE 0 END AS weather_enriched
FROM silver LEFT JOIN latest ON silver.claim_id=latest.claim_id""",
)
def _(v):
    whole = silver.build(v.claims, v.policies, v.claimants, silver.parse_weather(v.weather))
    return plain(
        whole.select(
            "claim_id", "claimant_id", "claim_sequence_num", "total_claims_count", "full_name", "claim_to_limit_ratio",
            *WEATHER_NAMES.split(), "weather_conditions",
            F.col("weather_api_timestamp").cast("timestamp").alias("weather_api_timestamp"),
            "had_severe_weather", "weather_enriched",
        )
    )


@query(
    "slv10_weather_flags",
    f"""WITH {CLAIMS}, {WEATHER_LATEST} SELECT claims.claim_id, weather_conditions,
CASE WHEN weather_precipitation_in>0.5 OR weather_wind_speed_mph>25 THEN 1 ELSE 0 END AS had_severe_weather,
CASE WHEN weather_conditions IS NOT NULL THEN 1 ELSE 0 END AS weather_enriched
FROM claims LEFT JOIN latest ON claims.claim_id=latest.claim_id""",
)
def _(v):
    joined = silver.with_weather(v.claims, silver.parse_weather(v.weather))
    return joined.select("claim_id", "weather_conditions", "had_severe_weather", "weather_enriched")


@query(
    "slv11_weather_summary",
    f"""WITH {WEATHER_LATEST} SELECT claim_id, CASE WHEN weather_precipitation_in>1.0 THEN 'Heavy Rain'
WHEN weather_precipitation_in>0.5 THEN 'Rain' WHEN weather_wind_speed_mph>25 THEN 'High Wind'
WHEN weather_wind_speed_mph>15 THEN 'Windy' ELSE 'Clear' END AS summary FROM latest""",
)
def _(v):
    words = weather_summary(F.col("weather_precipitation_in"), F.col("weather_wind_speed_mph"))
    return silver.parse_weather(v.weather).select("claim_id", words.alias("summary"))


# The test claimants live in nations; every second one gets a state code, cycling through known and unknown ones.
STATES = "CA,TX,FL,NY,IL,PA,OH,GA,NC,MI,WA,OR"


@query(
    "slv12_coordinates",
    f"""WITH {CLAIMANTS}, coded AS (SELECT claimant_id, CASE WHEN claimant_id%2=0
THEN split_part('{STATES}',',',CAST(1+floor(claimant_id/2)%12 AS INT)) END AS state_code FROM claimants),
places(state, latitude, longitude) AS (VALUES ('CA',34.0522e0,-118.2437e0),('TX',29.7604e0,-95.3698e0),('FL',25.7617e0,-80.1918e0),
('NY',40.7128e0,-74.006e0),('IL',41.8781e0,-87.6298e0),('PA',39.9526e0,-75.1652e0),('OH',39.9612e0,-82.9988e0),
('GA',33.749e0,-84.388e0),('NC',35.7796e0,-78.6382e0),('MI',42.3314e0,-83.0458e0))
SELECT claimant_id, coalesce(state_code,'CA') AS lookup_state, {num('coalesce(latitude,34.0522e0)', 'latitude')},
{num('coalesce(longitude,-118.2437e0)', 'longitude')} FROM coded LEFT JOIN places ON coalesce(state_code,'CA')=state""",
)
def _(v):
    code = F.split_part(F.lit(STATES), F.lit(","), (F.floor(F.col("claimant_id") / 2) % 12 + 1).cast("int"))
    coded = v.claimants.select("claimant_id", F.when(F.col("claimant_id") % 2 == 0, code).alias("state_code"))
    placed = silver.with_coordinates(coded, "state_code")
    return plain(placed.select("claimant_id", "lookup_state", "latitude", "longitude"))


DOUBLES = "claim_amount claim_to_limit_ratio claim_to_premium_ratio avg_claim_amount max_claim_amount".split()
FEATURE_SQL = ", ".join(
    num(f) if f in DOUBLES
    else "CASE WHEN claim_sequence_num=1 THEN 1 ELSE 0 END AS is_first_claim" if f == "is_first_claim"
    else f
    for f in silver.FEATURES
)


@query("slv13_feature_table", f"WITH {SILVER} SELECT claim_id, is_fraud, {FEATURE_SQL} FROM silver")
def _(v):
    return plain(v.features)


# For the tables of the tests; a bucket should hold some hundred megabytes.
BUCKETS = 8


@query("slv13_feature_table_bucketed", f"WITH {SILVER} SELECT claim_id, is_fraud, {FEATURE_SQL} FROM silver")
def _(v):
    root = work_dir(v.spark, "buckets")
    for table, frame in (("claims", v.claims), ("policies", v.policies)):
        store.save(frame, root, table, bucket_by=("policy_id",), buckets=BUCKETS)
    claims, policies = (store.load(v.spark, root, table) for table in ("claims", "policies"))
    silver.stage(claims, policies, v.claimants, root, BUCKETS)
    return plain(silver.feature_table(silver.build_staged(v.spark, root)))


SUMMARY = f"""WITH {ENRICHED}, grouped AS (SELECT claim_type, insurance_provider, address_state,
date_trunc('month', incident_date) AS incident_month, count(*) AS total_claims, sum(claim_amount) AS total_claimed_amount,
avg(claim_amount) AS avg_claim_amount, min(claim_amount) AS min_claim_amount, max(claim_amount) AS max_claim_amount,
count(*) FILTER (WHERE is_fraud) AS fraud_count,
sum(CASE WHEN status='Approved' THEN claim_amount ELSE 0 END) AS approved_amount,
count(*) FILTER (WHERE status='Denied') AS denied_count, avg(days_to_file) AS avg_days_to_file
FROM dated GROUP BY ALL), summary AS (SELECT claim_type, insurance_provider, address_state, {day('incident_month')},
total_claims, {nums('total_claimed_amount avg_claim_amount min_claim_amount max_claim_amount')}, fraud_count,
{num('approved_amount')}, denied_count, {num('avg_days_to_file')},
{num('fraud_count*100e0/total_claims', 'fraud_rate_pct')},
{num('(total_claims-denied_count)*100e0/total_claims', 'approval_rate_pct')},
{num('approved_amount/greatest(total_claims-denied_count, 1)', 'avg_approved_amount')} FROM grouped)"""
STAMP = instant(f"'{AS_OF}'", "{}")


@query("gld1_claims_summary", f"{SUMMARY} SELECT *, {STAMP.format('created_at')} FROM summary")
def claims_summary(v):
    return plain(gold.claims_summary(v.dated, AS_OF))


ALERTS = f"""{SILVER}, scored AS (SELECT *, claim_to_limit_ratio*0.3e0+rapid_filing*0.2e0+has_prior_fraud*0.3e0
+CASE WHEN total_claims_count>5 THEN 0.2e0 ELSE 0e0 END AS risk_score FROM silver
WHERE is_fraud OR claim_to_limit_ratio>0.85 OR rapid_filing=1 OR has_prior_fraud=1 OR total_claims_count>5), alerts AS (
SELECT claim_id, claimant_id, policy_id, full_name, insurance_provider, {nums('claim_amount risk_score')},
CASE WHEN risk_score>0.7 THEN 'Critical' WHEN risk_score>0.5 THEN 'High' WHEN risk_score>0.3 THEN 'Medium' ELSE 'Low' END AS alert_priority,
coalesce(is_fraud OR risk_score>0.6, false) AS investigation_required, is_fraud, status, description,
{num('claim_to_limit_ratio')}, rapid_filing, has_prior_fraud, total_claims_count FROM scored)"""


@query("gld2_fraud_alerts", f"WITH {ALERTS} SELECT *, {STAMP.format('alert_timestamp')} FROM alerts")
def _(v):
    return plain(gold.fraud_alerts(v.silver, as_of=AS_OF))


PROFILES = f"""{ENRICHED}, grouped AS (SELECT claimant_id, full_name, address_state, count(*) AS lifetime_claims,
sum(claim_amount) AS lifetime_claimed, avg(claim_amount) AS avg_claim_size, max(claim_amount) AS max_claim_size,
count(*) FILTER (WHERE is_fraud) AS fraud_claims_count, min(incident_date) AS first_claim_date, max(incident_date) AS last_claim_date,
count(DISTINCT insurance_provider) AS unique_providers, count(DISTINCT claim_type) AS unique_claim_types,
avg(days_to_file) AS avg_filing_delay FROM dated GROUP BY ALL), rated AS (
SELECT *, fraud_claims_count/lifetime_claims AS fraud_rate, CAST(date_diff('day', first_claim_date, last_claim_date) AS INT) AS days_active
FROM grouped), paced AS (SELECT *, lifetime_claims/(CASE WHEN days_active>0 THEN days_active/365 ELSE 1e0 END) AS claims_per_year FROM rated),
profiles AS (SELECT *, CASE WHEN fraud_rate>0 THEN 'High Risk - Known Fraud' WHEN lifetime_claims>5 THEN 'High Risk - Frequent'
WHEN claims_per_year>2 THEN 'Medium Risk - Active' ELSE 'Low Risk' END AS risk_tier FROM paced)"""


@query(
    "gld3_claimant_profiles",
    f"""WITH {PROFILES} SELECT claimant_id, full_name, address_state, lifetime_claims,
{nums('lifetime_claimed avg_claim_size max_claim_size')}, fraud_claims_count, {day('first_claim_date')}, {day('last_claim_date')},
unique_providers, unique_claim_types, {nums('avg_filing_delay fraud_rate')}, days_active, {num('claims_per_year')}, risk_tier,
{STAMP.format('profile_updated_at')} FROM profiles""",
)
def _(v):
    timed = silver.temporal_features(silver.with_policy(v.claims, v.policies))
    return plain(gold.claimant_profiles(timed, silver.mask_pii(v.claimants), AS_OF))


PROVIDERS = f"""{ENRICHED}, grouped AS (SELECT insurance_provider, date_trunc('quarter', incident_date) AS quarter,
count(*) AS total_claims, sum(claim_amount) AS total_exposure, avg(claim_amount) AS avg_claim_size,
sum(CASE WHEN is_fraud THEN claim_amount ELSE 0 END) AS fraud_losses, count(*) FILTER (WHERE is_fraud) AS fraud_count,
count(*) FILTER (WHERE status='Approved') AS approved_count, count(*) FILTER (WHERE status='Denied') AS denied_count,
avg(days_to_file) AS avg_processing_time, count(DISTINCT claimant_id) AS unique_claimants FROM dated GROUP BY ALL),
providers AS (SELECT insurance_provider, {day('quarter')}, total_claims, {nums('total_exposure avg_claim_size fraud_losses')},
fraud_count, approved_count, denied_count, {num('avg_processing_time')}, unique_claimants,
{num('fraud_count*100e0/total_claims', 'fraud_rate_pct')}, {num('fraud_losses/total_exposure', 'fraud_loss_ratio')},
{num('approved_count*100e0/total_claims', 'approval_rate_pct')}, {num('total_claims/unique_claimants', 'claims_per_claimant')} FROM grouped)"""


@query("gld4_provider_metrics", f"WITH {PROVIDERS} SELECT *, {STAMP.format('metrics_date')} FROM providers")
def _(v):
    terms = silver.temporal_features(silver.with_policy(v.claims, v.policies))
    return plain(gold.provider_metrics(terms, AS_OF))


WEEKS = f"""{CLAIMS}, grouped AS (SELECT date_trunc('week', incident_date) AS incident_week, claim_type, count(*) AS claims_count,
sum(claim_amount) AS total_amount, avg(claim_amount) AS avg_amount, count(*) FILTER (WHERE is_fraud) AS fraud_count,
count(*) FILTER (WHERE status='Approved') AS approved_count FROM claims GROUP BY ALL), weeks AS (
SELECT {day('incident_week')}, claim_type, claims_count, {nums('total_amount avg_amount')}, fraud_count, approved_count,
{num('avg(claims_count) OVER recent', 'claims_4week_avg')}, {num('avg(total_amount) OVER recent', 'amount_4week_avg')},
{num('fraud_count*100e0/claims_count', 'fraud_rate_pct')} FROM grouped
WINDOW recent AS (PARTITION BY claim_type ORDER BY grouped.incident_week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


@query("gld5_weekly_series", f"WITH {WEEKS} SELECT *, {STAMP.format('created_at')} FROM weeks")
def _(v):
    return plain(gold.weekly_series(v.claims, AS_OF))


def _in_batches(v, claims, name, table):
    """A gold table made in two batches, the second one given twice, with its states folded in between."""
    root = work_dir(v.spark, name)
    for number, rest in ((0, 0), (1, 1), (1, 1)):
        incremental.add(claims.filter(F.col("claim_id") % 2 == rest), root, name, table, ("feed", number))
        if number == 0:
            incremental.fold(v.spark, root, name, table)
    return plain(incremental.current(v.spark, root, name, table, AS_OF))


@query("gld1_incremental", f"{SUMMARY} SELECT *, {STAMP.format('created_at')} FROM summary")
def _(v):
    return _in_batches(v, v.dated, "summary", incremental.claims_summary())


@query("gld2_incremental", f"WITH {ALERTS} SELECT *, {STAMP.format('alert_timestamp')} FROM alerts")
def _(v):
    root = work_dir(v.spark, "alerts")
    for number, rest in ((0, 0), (1, 1), (1, 1)):
        incremental.add_alerts(v.silver.filter(F.col("claim_id") % 2 == rest), root, "alerts", ("feed", number), AS_OF)
    return plain(store.load(v.spark, root, "alerts"))


@query("gld3_incremental", ORACLES["gld3_claimant_profiles"])
def _(v):
    return _in_batches(v, v.dated, "profiles", incremental.claimant_profiles())


@query("gld4_incremental", f"WITH {PROVIDERS} SELECT *, {STAMP.format('metrics_date')} FROM providers")
def _(v):
    return _in_batches(v, v.dated, "providers", incremental.provider_metrics())


@query("gld5_incremental", f"WITH {WEEKS} SELECT *, {STAMP.format('created_at')} FROM weeks")
def _(v):
    return _in_batches(v, v.claims, "weeks", incremental.weekly_series())


@query(
    "gld6_alert_priorities",
    f"WITH {ALERTS} SELECT alert_priority, count(*) AS row_count FROM alerts GROUP BY alert_priority",
)
def _(v):
    return quality.value_counts(gold.fraud_alerts(v.silver), "alert_priority")


@query(
    "gld6_risk_tiers", f"WITH {PROFILES} SELECT risk_tier, count(*) AS row_count FROM profiles GROUP BY risk_tier"
)
def _(v):
    return quality.value_counts(gold.claimant_profiles(v.dated), "risk_tier")


@query(
    "gld7_top_summaries",
    f"""{SUMMARY} SELECT * FROM summary ORDER BY total_claims DESC, claim_type, insurance_provider NULLS FIRST,
address_state, incident_month LIMIT 10""",
)
def _(v):
    tie = ["claim_type", "insurance_provider", "address_state", "incident_month"]
    return plain(gold.top(gold.claims_summary(v.dated), "total_claims", 10, tie).drop("created_at"))


@query(
    "gld7_top_providers",
    f"WITH {PROVIDERS} SELECT * FROM providers ORDER BY total_exposure DESC, insurance_provider, quarter LIMIT 10",
)
def _(v):
    terms = silver.temporal_features(silver.with_policy(v.claims, v.policies))
    return plain(gold.top(gold.provider_metrics(terms), "total_exposure", 10, ["insurance_provider", "quarter"]).drop("metrics_date"))


@query("gld7_newest_weeks", f"WITH {WEEKS} SELECT * FROM weeks ORDER BY incident_week DESC, claim_type LIMIT 10")
def _(v):
    return plain(gold.top(gold.weekly_series(v.claims), "incident_week", 10, ["claim_type"]).drop("created_at"))


# Joins as such: each runs the operator that owns the join shape.


@query(
    "j1_left_using_key",
    f"""WITH {CLAIMS}, {POLICIES} SELECT claim_id, claims.policy_id, provider AS insurance_provider, {num('policy_limit')}
FROM claims LEFT JOIN policies ON claims.policy_id=policies.policy_id""",
)
def _(v):
    joined = silver.with_policy(v.claims, v.policies)
    return plain(joined.select("claim_id", "policy_id", "insurance_provider", "policy_limit"))


@query(
    "j2_left_same_named_columns",
    f"""WITH {ENRICHED} SELECT claim_id, claimant_id, insurance_provider, full_name, address_state, status FROM enriched""",
)
def _(v):
    return v.enriched.select("claim_id", "claimant_id", "insurance_provider", "full_name", "address_state", "status")


@query(
    "j3_left_anti",
    f"""WITH {CLAIMS}, {POLICIES} SELECT claim_id, policy_id FROM claims
WHERE policy_id NOT IN (SELECT policy_id FROM policies)""",
)
def _(v):
    return quality.orphans(v.claims, v.policies, "policy_id").select("claim_id", "policy_id")


@query("j4_inner_features_silver", f"WITH {ALERTS} SELECT * FROM alerts")
def _(v):
    return plain(gold.fraud_alerts(v.features, v.enriched).drop("alert_timestamp"))


@query(
    "j5_claim_policy_claimant",
    f"""WITH {ENRICHED} SELECT claim_id, coalesce(full_name,'N/A') AS claimant_name, coalesce(address_state,'N/A') AS state,
coalesce(insurance_provider,'N/A') AS provider, {num('coalesce(policy_limit,0)', 'policy_limit')} FROM enriched""",
)
def _(v):
    record = investigate.claim_details(v.enriched)
    return plain(
        record.select(
            "claim_id",
            F.col("claimant.name").alias("claimant_name"),
            F.col("claimant.state").alias("state"),
            F.col("policy.provider").alias("provider"),
            F.col("policy.limit").alias("policy_limit"),
        )
    )


@query("j6_aggregate_join_back", HISTORY_SQL)
def _(v):
    return plain(v.cases.select("claim_id", "claimant_id", *HISTORY))


@query(
    "j7_dimension_lookup",
    f"""WITH {CLAIMS}, {ICD} SELECT claim_id, claims.diagnosis_code,
CASE WHEN diagnosis_code IS NOT NULL THEN coalesce(icd.description,'Code not in database') END AS diagnosis_description,
icd.severity AS diagnosis_severity FROM claims LEFT JOIN icd ON diagnosis_code=code""",
)
def _(v):
    looked_up = investigate.medical_lookup(v.claims)
    return looked_up.select("claim_id", "diagnosis_code", "diagnosis_description", "diagnosis_severity")


@query(
    "j9_join_with_date_range",
    f"""WITH {CLAIMS}, {POLICIES} SELECT claim_id, claims.policy_id, CASE WHEN provider IS NULL THEN NULL
WHEN incident_date BETWEEN start_date AND end_date THEN 'PASS' ELSE 'FAIL' END AS period_status
FROM claims LEFT JOIN policies ON claims.policy_id=policies.policy_id""",
)
def _(v):
    checked = investigate.verify_policy(v.claims, v.policies)
    return checked.select("claim_id", "policy_id", "period_status")
