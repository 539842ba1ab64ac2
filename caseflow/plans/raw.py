"""Sources, sinks, bronze ingestion and data quality (SRC, SNK, BRZ, DQ, PRF, DDP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import audit, bronze, evaluate, quality, ranking, silver
from caseflow.plans.base import (
    AS_OF,
    ORACLES,
    CLAIMANTS,
    CLAIMS,
    ENRICHED,
    FEEDBACK,
    ICD,
    POLICIES,
    SILVER,
    WEATHER,
    day,
    instant,
    num,
    plain,
    query,
)
from caseflow.session import work_dir
from caseflow.sources import dims, store


@query("src1_table_scan", f"SELECT o_orderkey, o_orderstatus, {num('o_totalprice')}, {day('o_orderdate')} FROM orders")
def _(v):
    scanned = store.load(v.spark, v.sf_dir, "orders.parquet")
    dated = scanned.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return plain(dated.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"))


@query(
    "src2_sql_scan",
    f"""WITH {ENRICHED} SELECT claim_type, count(*) AS claim_count, {num('sum(claim_amount)', 'total_amount')}
FROM claims c LEFT JOIN policies p ON c.policy_id=p.policy_id WHERE claim_amount >= 20000 AND p.provider <> 'PROVIDER_0'
GROUP BY claim_type""",
)
def _(v):
    text = """SELECT claim_type, count(*) AS claim_count, sum(claim_amount) AS total_amount
        FROM {claims} c LEFT JOIN {policies} p ON c.policy_id = p.policy_id
        WHERE claim_amount >= :least AND p.provider <> :provider GROUP BY claim_type"""
    params = {"least": 20000.0, "provider": "PROVIDER_0"}
    return plain(store.query(v.spark, text, params, claims=v.claims, policies=v.policies))


@query(
    "src3_literal_rows",
    f"""WITH {CLAIMS}, {ICD} SELECT severity, count(*) AS claim_count, {num('sum(claim_amount)', 'total_amount')}
FROM claims JOIN icd ON diagnosis_code=code GROUP BY severity""",
)
def _(v):
    codes = store.rows_df(v.spark, dims.ICD10, "code string, description string, category string, severity string")
    coded = v.claims.join(codes.select(F.col("code").alias("diagnosis_code"), "severity"), "diagnosis_code")
    grouped = coded.groupBy("severity").agg(
        F.count(F.lit(1)).alias("claim_count"), F.sum("claim_amount").alias("total_amount")
    )
    return plain(grouped)


@query(
    "src4_optional_source",
    f"""WITH {CLAIMS} SELECT claim_id, 0 AS had_severe_weather, 0 AS weather_enriched, CAST(NULL AS VARCHAR) AS weather_conditions
FROM claims""",
)
def _(v):
    return silver.with_weather(v.claims).select(
        "claim_id", "had_severe_weather", "weather_enriched", "weather_conditions"
    )


STATUS_COUNTS = "SELECT status, count(*) AS row_count FROM {} GROUP BY status"


@query("src5_source_fallback", f"WITH {CLAIMS} {STATUS_COUNTS.format('claims')}")
def _(v):
    missing = v.claims.filter(F.col("claim_amount") < 0)
    return quality.value_counts(store.first_non_empty(missing, v.claims), "status")


@query(
    "src6_table_counts",
    f"""WITH {CLAIMS}, {POLICIES}, {CLAIMANTS} SELECT 'claims' AS table_name, count(*) AS row_count FROM claims
UNION ALL SELECT 'policies', count(*) FROM policies UNION ALL SELECT 'claimants', count(*) FROM claimants""",
)
def _(v):
    return store.table_counts({"claims": v.claims, "policies": v.policies, "claimants": v.claimants})


CLOSED = "status IN ('Closed', 'Paid')"


@query("snk1_overwrite", f"WITH {CLAIMS} {STATUS_COUNTS.format('claims')} HAVING NOT ({CLOSED})")
def _(v):
    root = work_dir(v.spark, "snk1")
    store.save(v.claims, root, "claims")
    # The second write reads the table it replaces.
    store.save(store.load(v.spark, root, "claims").filter(f"NOT ({CLOSED})"), root, "claims")
    return quality.value_counts(store.load(v.spark, root, "claims"), "status")


@query("snk2_overwrite_new_columns", f"WITH {ENRICHED} SELECT claim_id, days_to_file, is_weekend_incident FROM dated")
def _(v):
    root = work_dir(v.spark, "snk2")
    store.save(v.claims, root, "claims")
    current = store.load(v.spark, root, "claims")
    store.save(silver.temporal_features(silver.with_policy(current, v.policies)), root, "claims")
    return store.load(v.spark, root, "claims").select("claim_id", "days_to_file", "is_weekend_incident")


@query(
    "snk3_append",
    f"""WITH {CLAIMS}, log AS (SELECT claim_id, claim_type FROM claims WHERE is_fraud
UNION ALL SELECT claim_id, claim_type FROM claims) SELECT claim_type, count(*) AS row_count FROM log GROUP BY claim_type""",
)
def _(v):
    root = work_dir(v.spark, "snk3")
    rows = v.claims.select("claim_id", "claim_type", "is_fraud")
    store.append(rows.filter("is_fraud"), root, "log")
    store.append(rows, root, "log")
    return quality.value_counts(store.load(v.spark, root, "log"), "claim_type")


@query(
    "snk4_append_new_columns",
    f"""WITH {CLAIMS}, log AS (SELECT claim_id, NULL AS status FROM claims UNION ALL SELECT claim_id, status FROM claims)
SELECT coalesce(status, 'none') AS status, count(*) AS row_count FROM log GROUP BY ALL""",
)
def _(v):
    root = work_dir(v.spark, "snk4")
    store.append(v.claims.select("claim_id"), root, "log")
    store.append(v.claims.select("claim_id", "status"), root, "log")
    merged = store.load(v.spark, root, "log", merge=True)
    return quality.value_counts(merged.withColumn("status", F.coalesce("status", F.lit("none"))), "status")


# One update per weather event; some claims get several, some updates match no claim.
UPDATES = """updates AS (SELECT CAST(floor(event_id/2) AS BIGINT) AS claim_id, event_id, ts,
CASE event_type WHEN 'view' THEN 'Pending' WHEN 'click' THEN 'Under Investigation' WHEN 'purchase' THEN 'Approved'
WHEN 'error' THEN 'Escalated' ELSE 'Denied' END AS status FROM events)"""
MERGED = f"""{CLAIMS}, {UPDATES}, last AS (SELECT claim_id, max_by(status, event_id) AS new_status FROM updates GROUP BY claim_id)
SELECT claims.claim_id, coalesce(new_status, status) AS status FROM claims LEFT JOIN last ON claims.claim_id=last.claim_id"""


def updates(events):
    status = (
        F.when(F.col("event_type") == "view", "Pending")
        .when(F.col("event_type") == "click", "Under Investigation")
        .when(F.col("event_type") == "purchase", "Approved")
        .when(F.col("event_type") == "error", "Escalated")
        .otherwise("Denied")
    )
    return events.select(
        F.floor(F.col("event_id") / 2).cast("bigint").alias("claim_id"), "event_id", "ts", status.alias("status")
    )


@query(
    "snk5_merge_status",
    f"WITH {MERGED}".replace(
        "AS status FROM claims LEFT", f"AS status, CASE WHEN new_status IS NOT NULL THEN '{AS_OF}' END AS updated_at FROM claims LEFT"
    ),
)
def _(v):
    merged = audit.merge_status(v.claims, updates(v.table("events")), ["ts", "event_id"], as_of=AS_OF)
    return plain(merged.select("claim_id", "status", "updated_at"))


@query("snk6_create_if_absent", f"WITH {FEEDBACK} SELECT agent_recommendation, count(*) AS row_count FROM feedback GROUP BY ALL")
def _(v):
    root = work_dir(v.spark, "snk6")
    store.ensure(v.spark, root, "feedback", dims.FEEDBACK_SCHEMA)
    rows = evaluate.normalise_feedback(v.feedback).withColumns(
        {"feedback_id": F.col("feedback_id").cast("string"), "claim_id": F.col("claim_id").cast("string")}
    )
    store.append(rows, root, "feedback")
    store.ensure(v.spark, root, "feedback", dims.FEEDBACK_SCHEMA)  # the second call changes nothing
    return quality.value_counts(store.load(v.spark, root, "feedback"), "agent_recommendation")


@query("snk7_csv_export", f"""WITH {CLAIMS} SELECT claim_type, status, CAST(count(*) AS VARCHAR) AS row_count FROM claims GROUP BY ALL""")
def _(v):
    path = f"{work_dir(v.spark, 'snk7')}/report"
    store.to_csv(v.claims.groupBy("claim_type", "status").agg(F.count(F.lit(1)).alias("row_count")), path)
    return v.spark.read.option("header", True).csv(path)


@query(
    "brz1_ingest_metadata",
    f"""WITH {CLAIMS} SELECT claim_id, {instant(f"'{AS_OF}'", '_ingestion_timestamp')}, 'claims_export' AS _source_system FROM claims""",
)
def _(v):
    once = bronze.with_ingest_meta(v.claims, "claims_export", AS_OF)
    twice = bronze.with_ingest_meta(once, "another_source", "1999-01-01")
    return plain(twice.select("claim_id", "_ingestion_timestamp", "_source_system"))


def hash_sql(columns: str) -> str:
    parts = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns.split()]
    return f"md5(concat_ws('|', {', '.join(parts)}))"


CLAIM_HASH = hash_sql(
    "claim_id policy_id claimant_id claim_type incident_date filing_date claim_amount description "
    "diagnosis_code procedure_code status is_fraud"
)


@query("brz2_record_hash", f"WITH {CLAIMS} SELECT claim_id, {CLAIM_HASH} AS _record_hash FROM claims")
def _(v):
    staged = bronze.with_ingest_meta(v.claims, "claims_export", AS_OF)
    return bronze.with_record_hash(staged).select("claim_id", "_record_hash")


@query(
    "brz3_cdc_diff",
    f"""WITH {CLAIMS} SELECT claim_id, CASE WHEN incident_date >= DATE '2001-01-01' THEN 'insert' WHEN status='Closed' THEN 'delete'
WHEN status='Submitted' THEN 'update' ELSE 'unchanged' END AS change_type FROM claims
WHERE NOT (incident_date >= DATE '2001-01-01' AND status='Closed')""",
)
def _(v):
    old = v.claims.filter("incident_date < DATE '2001-01-01'")
    moved = F.when(F.col("status") == "Submitted", "Under Review").otherwise(F.col("status"))
    new = v.claims.filter("status <> 'Closed'").withColumn("status", moved)
    return bronze.cdc_diff(old, new, "claim_id")


@query("brz3_cdc_diff_by_digests", ORACLES["brz3_cdc_diff"])
def _(v):
    root = work_dir(v.spark, "brz3")
    bronze.keep_snapshot(v.claims.filter("incident_date < DATE '2001-01-01'"), root, "claims", "claim_id", 64)
    moved = F.when(F.col("status") == "Submitted", "Under Review").otherwise(F.col("status"))
    new = v.claims.filter("status <> 'Closed'").withColumn("status", moved)
    return bronze.cdc_diff_stored(new, root, "claims", "claim_id", 64)


CLAIM_COLUMNS = (
    "claim_id policy_id claimant_id claim_type incident_date filing_date claim_amount description "
    "diagnosis_code procedure_code status is_fraud"
).split()


@query(
    "dq1_null_counts",
    f"WITH {CLAIMS} SELECT {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in CLAIM_COLUMNS)} FROM claims",
)
def _(v):
    return quality.null_counts(v.claims)


@query(
    "dq2_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def _(v):
    return quality.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dq3_orphans",
    f"""WITH {CLAIMS}, {POLICIES} SELECT claim_id, policy_id, status FROM claims
WHERE NOT EXISTS (SELECT 1 FROM policies WHERE policies.policy_id=claims.policy_id)""",
)
def _(v):
    return quality.orphans(v.claims, v.policies, "policy_id").select("claim_id", "policy_id", "status")


@query(
    "dq4_date_order",
    f"""WITH {CLAIMS} SELECT claim_id, {day('incident_date')}, {day('filing_date')} FROM claims WHERE filing_date < incident_date""",
)
def _(v):
    wrong = quality.violations(v.claims, F.col("filing_date") < F.col("incident_date"))
    return plain(wrong.select("claim_id", "incident_date", "filing_date"))


@query("dq5_non_positive_amount", "SELECT c_custkey, " + num("c_acctbal") + " FROM customer WHERE c_acctbal <= 0")
def _(v):
    # No claim has such an amount, some account balances do.
    return plain(quality.violations(v.table("customer"), F.col("c_acctbal") <= 0).select("c_custkey", "c_acctbal"))


CHECKED = ["claim_id", "is_fraud", *silver.FEATURES]


@query(
    "dq6_completeness",
    f"WITH {SILVER} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {f} IS NULL) AS null_count, "
        + num(f"(1 - count(*) FILTER (WHERE {f} IS NULL) / count(*)) * 100", "completeness_pct")
        + " FROM silver"
        for c, f in ((c, "claim_sequence_num" if c == "is_first_claim" else c) for c in CHECKED)
    ),
)
def _(v):
    return plain(quality.completeness(v.features, CHECKED))


@query(
    "dq7_rule_report",
    f"""WITH {CLAIMS}, {POLICIES}, report AS (
SELECT 'duplicate_claim_id' AS rule, count(*) AS violations FROM (SELECT claim_id FROM claims GROUP BY claim_id HAVING count(*)>1)
UNION ALL SELECT 'missing_policy', count(*) FROM claims WHERE policy_id NOT IN (SELECT policy_id FROM policies)
UNION ALL SELECT 'filed_before_incident', count(*) FROM claims WHERE filing_date < incident_date
UNION ALL SELECT 'non_positive_amount', count(*) FROM claims WHERE claim_amount <= 0)
SELECT *, violations = 0 AS passed FROM report""",
)
def _(v):
    return quality.dq_report(v.claims, v.policies)


@query(
    "prf1_label_profile",
    f"""WITH {SILVER} SELECT is_fraud, count(*) AS row_count, {num('avg(claim_amount)', 'avg_amount')},
{num('avg(days_to_file)', 'avg_days_to_file')}, {num('avg(claim_to_limit_ratio)', 'avg_claim_to_limit_ratio')} FROM silver GROUP BY is_fraud""",
)
def _(v):
    featured = silver.financial_features(silver.temporal_features(silver.with_policy(v.claims, v.policies)))
    wanted = {
        "avg_amount": F.avg("claim_amount"),
        "avg_days_to_file": F.avg("days_to_file"),
        "avg_claim_to_limit_ratio": F.avg("claim_to_limit_ratio"),
    }
    return plain(quality.profile_by(featured, "is_fraud", wanted))


@query("prf2_status_distribution", f"WITH {CLAIMS} {STATUS_COUNTS.format('claims')}")
def _(v):
    return quality.value_counts(v.claims, "status")


@query(
    "prf3_type_profile",
    f"""WITH {CLAIMS} SELECT claim_type, count(*) AS row_count, {num('avg(claim_amount)', 'avg_amount')},
{num('sum(claim_amount)', 'total_amount')} FROM claims GROUP BY claim_type""",
)
def _(v):
    wanted = {"avg_amount": F.avg("claim_amount"), "total_amount": F.sum("claim_amount")}
    return plain(quality.profile_by(v.claims, "claim_type", wanted))


PROFILED = "claim_amount days_to_file claim_to_limit_ratio rapid_filing total_claims_count".split()


@query(
    "prf4_feature_profile",
    f"""WITH {SILVER} SELECT is_fraud, count(*) AS row_count, {', '.join(num(f'avg({c})', f'avg_{c}') for c in PROFILED)}
FROM silver GROUP BY is_fraud""",
)
def _(v):
    return plain(quality.profile_by(v.features, "is_fraud", {f"avg_{c}": F.avg(c) for c in PROFILED}))


@query(
    "ddp1_latest_per_key",
    f"""WITH {WEATHER} SELECT claim_id, enrichment_source, api_status, {instant('enrichment_timestamp')},
{num('precipitation_inches')}, {num('wind_speed_mph')}, conditions_summary FROM weather
QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY enrichment_timestamp DESC)=1""",
)
def _(v):
    # Calls of one instant: the greatest of their other columns, so that reruns agree.
    rest = [c for c in v.weather.columns if c not in ("claim_id", "enrichment_timestamp")]
    latest = ranking.latest_by(v.weather, "claim_id", ["enrichment_timestamp", *rest])
    payload = F.from_json("enrichment_data", "precipitation_inches double, wind_speed_mph double, conditions_summary string")
    return plain(latest.withColumn("payload", payload).select("*", "payload.*").drop("enrichment_data", "payload"))
