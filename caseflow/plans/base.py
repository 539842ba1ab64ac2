"""Query registry and the SQL building blocks shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import features
from caseflow.sources.fixtures import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Feedback and logs are evaluated as of this instant.
AS_OF = "2001-08-01 00:00:00"


def query(name: str, sql: str | None = None):
    """Register a query over ``Views`` together with the SQL that must give the same rows."""

    def register(function: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns as every engine prints them: dates as text, doubles rounded.

    Doubles keep six decimals, from 1,000 on four: sums of many amounts differ beyond that with the
    order in which they were added. Halves are decided in decimals, see ``features.rounded``.
    """
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("double", "float"):
            value = column.cast("double")
            column = F.when(F.abs(value) < 1000, features.rounded(value, 6)).otherwise(features.rounded(value, 4))
        elif kind == "date":
            column = column.cast("string")
        elif kind.startswith("timestamp"):
            column = F.date_format(column.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def num(expression: str, name: str | None = None) -> str:
    value = f"CAST({expression} AS DOUBLE)"
    return f"CASE WHEN abs({value}) < 1000 THEN {rounded(value, 6)} ELSE {rounded(value, 4)} END AS {name or expression}"


def nums(names: str) -> str:
    return ", ".join(num(n) for n in names.split())


def day(expression: str, name: str | None = None) -> str:
    return f"CAST(CAST({expression} AS DATE) AS VARCHAR) AS {name or expression}"


def instant(expression: str, name: str | None = None) -> str:
    return f"strftime(CAST({expression} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {name or expression}"


def rounded(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(30,8)), {digits}) AS DOUBLE)"


def cents(expression: str) -> str:
    return rounded(expression, 2)


CLAIMANTS = """claimants AS (
SELECT c_custkey*4+a AS claimant_id, 'Customer' AS first_name, substr(c_name,10) AS last_name,
  CAST('1950-01-01' AS DATE)+CAST((c_custkey*4+a)%18000 AS INT) AS date_of_birth,
  concat('c',CAST(c_custkey*4+a AS VARCHAR(20)),'@',lower(c_mktsegment),'.example.com') AS email,
  n_name AS address_state
FROM customer CROSS JOIN (VALUES (0),(1),(2),(3)) AS r(a) JOIN nation ON c_nationkey=n_nationkey)"""

POLICIES = """policies AS (
SELECT policy_id, claimant_id,
  split_part('Auto,Property,Health,Workers Comp,Liability',',',CAST(1+policy_id%5 AS INT)) AS policy_type,
  concat('PROVIDER_',CAST(policy_id%6 AS VARCHAR(20))) AS provider,
  CAST(100000*(1+policy_id%8) AS DOUBLE) AS policy_limit,
  CASE WHEN policy_id%50=0 THEN 0e0
       ELSE CAST(split_part('500,1000,2500,5000',',',CAST(1+policy_id%4 AS INT)) AS DOUBLE) END AS deductible,
  CAST(1500*(1+policy_id%8) AS DOUBLE) AS premium_annual,
  CAST('1995-01-01' AS DATE)+CAST((policy_id*37)%1500 AS INT) AS start_date,
  CAST('1995-01-01' AS DATE)+CAST((policy_id*37)%1500+1460 AS INT) AS end_date, 'Active' AS status
FROM (SELECT (c_custkey*4+a)*2+k AS policy_id, c_custkey*4+a AS claimant_id FROM customer
      CROSS JOIN (VALUES (0),(1),(2),(3)) AS r(a) CROSS JOIN (VALUES (0),(1)) AS s(k)) t)"""

CLAIMS = """claims AS (
SELECT o_orderkey AS claim_id,
  CASE WHEN o_orderkey%97=0 THEN -o_orderkey-1
       ELSE (o_custkey*4+o_orderkey%4)*2+CAST(floor(o_orderkey/4) AS BIGINT)%2 END AS policy_id,
  o_custkey*4+o_orderkey%4 AS claimant_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Auto' WHEN '2-HIGH' THEN 'Property' WHEN '3-MEDIUM' THEN 'Health'
       WHEN '4-NOT SPECIFIED' THEN 'Workers Comp' ELSE 'Liability' END AS claim_type,
  CAST(o_orderdate AS DATE) AS incident_date,
  CAST(o_orderdate AS DATE)+CAST((o_orderkey*13)%95-1 AS INT) AS filing_date,
  o_totalprice AS claim_amount,
  split_part('Vehicle accident on highway rear-end collision|Slip and fall incident at retail store|Property damage due to water damage|Medical treatment for Low back pain|Work-related injury requiring MRI lumbar spine','|',CAST(1+o_orderkey%5 AS INT)) AS description,
  CASE WHEN o_orderpriority IN ('3-MEDIUM','4-NOT SPECIFIED')
       THEN split_part('S06.9,S83.5,M54.5,S52.5,T14.9,S43.4,S93.4,M79.3,S72.0,S82.5,Z99.9',',',CAST(1+o_orderkey%11 AS INT)) END AS diagnosis_code,
  CASE WHEN o_orderpriority IN ('3-MEDIUM','4-NOT SPECIFIED')
       THEN split_part('99285,73610,29881,20610,97110,72148,97140,29125,27447,73562,00000',',',CAST(1+o_orderkey%11 AS INT)) END AS procedure_code,
  split_part('Submitted,Under Review,Approved,Paid,Closed,Under Investigation,Denied',',',CAST(1+o_orderkey%7 AS INT)) AS status,
  o_orderkey%13=0 AS is_fraud
FROM orders)"""

WEATHER = """weather AS (
SELECT CAST(floor(event_id/2) AS BIGINT) AS claim_id,
  CASE WHEN event_type='signup' THEN 'geocoding' ELSE 'weather' END AS enrichment_source,
  CAST(json_extract_string(props,'$.k') AS DOUBLE) AS wind_speed_mph,
  value/200 AS precipitation_inches, event_type AS conditions_summary,
  ts AS enrichment_timestamp,
  CASE WHEN event_type='error' THEN 'failed' ELSE 'success' END AS api_status
FROM events)"""

FEEDBACK = """raw_feedback AS (
SELECT o_orderkey AS feedback_id, o_orderkey AS claim_id,
  split_part('APPROVE,REVIEW,INVESTIGATE,DENY',',',CAST(1+o_orderkey%4 AS INT)) AS agent_recommendation,
  split_part('APPROVE,REVIEW,INVESTIGATE,DENY',',',CAST(1+(o_orderkey+CASE WHEN o_orderkey%5=0 THEN 1 ELSE 0 END)%4 AS INT)) AS adjuster_decision,
  CAST(o_orderkey%7 AS INT) AS raw_rating,
  o_orderdate AS feedback_timestamp,
  CASE WHEN o_orderkey%11=0 THEN NULL ELSE CAST(o_orderkey%480 AS DOUBLE)/10 END AS time_to_decision_hours
FROM orders), feedback AS (
SELECT feedback_id, claim_id, upper(agent_recommendation) AS agent_recommendation,
  upper(adjuster_decision) AS adjuster_decision, greatest(1, least(5, raw_rating)) AS rating,
  feedback_timestamp, time_to_decision_hours,
  upper(agent_recommendation)=upper(adjuster_decision) AS recommendation_correct
FROM raw_feedback)"""

ENRICHED = f"""{CLAIMANTS}, {POLICIES}, {CLAIMS}, enriched AS (
SELECT c.*, p.provider AS insurance_provider, p.policy_limit, p.deductible, p.premium_annual,
  p.start_date AS policy_start_date, p.end_date AS policy_end_date,
  m.first_name, m.last_name, m.first_name || ' ' || m.last_name AS full_name, m.date_of_birth,
  regexp_extract(m.email, '@(.+)', 1) AS email_domain, m.address_state
FROM claims c LEFT JOIN policies p ON c.policy_id = p.policy_id
LEFT JOIN claimants m ON c.claimant_id = m.claimant_id), dated AS (
SELECT *, CAST(date_diff('day', incident_date, filing_date) AS INT) AS days_to_file,
  CAST(date_diff('day', policy_start_date, incident_date) AS INT) AS days_since_policy_start,
  CAST(date_diff('day', incident_date, policy_end_date) AS INT) AS days_until_policy_end,
  CAST(year(incident_date) AS INT) AS incident_year, CAST(month(incident_date) AS INT) AS incident_month,
  CAST(dayofweek(incident_date) + 1 AS INT) AS incident_day_of_week,
  CAST(year(filing_date) AS INT) AS filing_year, CAST(month(filing_date) AS INT) AS filing_month,
  CASE WHEN dayofweek(incident_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend_incident
FROM enriched)"""

SILVER = f"""{ENRICHED}, history AS (
SELECT claimant_id, count(*) AS total_claims_count, sum(claim_amount) AS total_claimed_amount,
  avg(claim_amount) AS avg_claim_amount, max(claim_amount) AS max_claim_amount,
  count(*) FILTER (WHERE is_fraud) AS prior_fraud_count,
  count(DISTINCT insurance_provider) AS provider_count
FROM enriched GROUP BY claimant_id), silver AS (
SELECT d.*, h.total_claims_count, h.total_claimed_amount, h.avg_claim_amount, h.max_claim_amount,
  h.prior_fraud_count, h.provider_count,
  claim_amount / policy_limit AS claim_to_limit_ratio, claim_amount / premium_annual AS claim_to_premium_ratio,
  CASE WHEN claim_amount > policy_limit THEN 1 ELSE 0 END AS claim_exceeds_limit,
  CASE WHEN claim_amount / policy_limit >= 0.9 THEN 1 ELSE 0 END AS claim_near_limit,
  CASE WHEN claim_amount < 5000 THEN 'Low' WHEN claim_amount < 20000 THEN 'Medium'
       WHEN claim_amount < 50000 THEN 'High' ELSE 'Very High' END AS amount_category,
  row_number() OVER (PARTITION BY d.claimant_id ORDER BY filing_date, md5(CAST(claim_id AS VARCHAR))) AS claim_sequence_num,
  CASE WHEN days_to_file <= 1 THEN 1 ELSE 0 END AS rapid_filing,
  CASE WHEN days_to_file > 30 THEN 1 ELSE 0 END AS delayed_filing,
  CASE WHEN days_since_policy_start < 30 THEN 1 ELSE 0 END AS policy_new_incident,
  CASE WHEN days_until_policy_end < 30 THEN 1 ELSE 0 END AS policy_expiring_soon,
  CASE WHEN h.total_claims_count > 3 THEN 1 ELSE 0 END AS frequent_claimant,
  CASE WHEN h.total_claimed_amount > 100000 THEN 1 ELSE 0 END AS high_value_claimant,
  CASE WHEN h.prior_fraud_count > 0 THEN 1 ELSE 0 END AS has_prior_fraud,
  CAST(length(description) AS INT) AS description_length,
  CAST(len(string_split(description, ' ')) AS INT) AS description_word_count,
  CASE WHEN diagnosis_code IS NOT NULL THEN 1 ELSE 0 END AS has_medical_code
FROM dated d JOIN history h ON d.claimant_id = h.claimant_id)"""

# Rule score of every claim; the shares are whole hundredths, so the rounded sum is exact.
RISK = f"""{SILVER}, risk AS (
SELECT *, round(least(1e0, CASE WHEN rapid_filing=1 THEN 0.15e0 ELSE 0e0 END
  + CASE WHEN coalesce(claim_to_limit_ratio,0)>0.9 THEN 0.2e0 ELSE 0e0 END
  + CASE WHEN has_prior_fraud=1 THEN 0.25e0 ELSE 0e0 END
  + CASE WHEN total_claims_count>5 THEN 0.1e0 ELSE 0e0 END
  + CASE WHEN days_to_file>60 THEN 0.1e0 ELSE 0e0 END), 3) AS fraud_risk_score
FROM silver)"""

# The two code tables.
ICD = """icd(code, description, category, severity) AS (VALUES
('S06.9','Head injury, unspecified','Traumatic injury','High'), ('S83.5','Sprain of knee','Soft tissue injury','Medium'),
('M54.5','Low back pain','Musculoskeletal','Low'), ('S52.5','Fracture of lower end of radius','Fracture','High'),
('T14.9','Injury, unspecified','General injury','Medium'), ('S43.4','Sprain of shoulder joint','Soft tissue injury','Medium'),
('S93.4','Sprain of ankle','Soft tissue injury','Low'), ('M79.3','Panniculitis, unspecified','Inflammatory','Low'),
('S72.0','Fracture of femur','Fracture','High'), ('S82.5','Fracture of tibia','Fracture','High'))"""

CPT = """cpt(code, description, cost_min, cost_max) AS (VALUES
('99285','Emergency department visit, high severity',800e0,2000e0), ('73610','Radiologic examination, ankle',100e0,300e0),
('29881','Arthroscopy, knee, surgical',3000e0,8000e0), ('20610','Arthrocentesis, major joint',200e0,500e0),
('97110','Therapeutic exercises',50e0,150e0), ('72148','MRI lumbar spine',800e0,2500e0),
('97140','Manual therapy techniques',60e0,180e0), ('29125','Application of short arm splint',100e0,300e0),
('27447','Total knee arthroplasty',15000e0,40000e0), ('73562','Radiologic examination, knee',100e0,300e0))"""

def votes_sql(urgent: str) -> str:
    """Verdict and confidence of the four reviewers, and the vote; ``urgent`` says which claims are."""
    return f"""{RISK}, {CPT}, checked AS (
SELECT r.*, cpt.cost_min, cpt.cost_max, {urgent} AS urgent,
  insurance_provider IS NOT NULL AS policy_found,
  CASE WHEN incident_date < policy_start_date OR incident_date > policy_end_date THEN 'FAIL' ELSE 'PASS' END AS period_status,
  CASE WHEN coalesce(policy_limit,0)=0 OR claim_amount > policy_limit THEN 'WARN' ELSE 'PASS' END AS limit_status,
  CASE WHEN coalesce(deductible,0)=0 OR claim_amount < deductible THEN 'WARN' ELSE 'PASS' END AS deductible_status,
  CASE WHEN coalesce(policy_limit,0) > 0 THEN claim_amount/policy_limit ELSE 0 END AS exposure,
  {cents('total_claimed_amount')} AS total_claimed, {cents('avg_claim_amount')} AS average_claim
FROM risk r LEFT JOIN cpt ON r.procedure_code = cpt.code), verdicts AS (
SELECT *, CASE WHEN fraud_risk_score>0.7 THEN 'DENY' WHEN fraud_risk_score>0.5 THEN 'INVESTIGATE' ELSE 'APPROVE' END AS fraud_verdict,
  CASE WHEN policy_found AND period_status='FAIL' THEN 'DENY'
       WHEN policy_found AND (limit_status='WARN' OR deductible_status='WARN') THEN 'REVIEW' ELSE 'APPROVE' END AS legal_verdict,
  CASE WHEN claim_type NOT IN ('Health','Workers Comp') THEN 'N/A' WHEN cost_max IS NULL THEN 'REVIEW'
       WHEN claim_amount > cost_max*1.5 THEN 'INVESTIGATE' WHEN claim_amount < cost_min*0.5 THEN 'REVIEW' ELSE 'APPROVE' END AS medical_verdict,
  CASE WHEN exposure>0.9 THEN 'INVESTIGATE' WHEN claim_amount > average_claim*3 AND average_claim > 0 THEN 'REVIEW'
       WHEN total_claimed > coalesce(policy_limit,0)*2 THEN 'INVESTIGATE' ELSE 'APPROVE' END AS financial_verdict
FROM checked), weighed AS (
SELECT *, CASE fraud_verdict WHEN 'DENY' THEN 0.9e0 WHEN 'INVESTIGATE' THEN 0.75e0 ELSE 0.85e0 END AS fraud_confidence,
  CASE legal_verdict WHEN 'DENY' THEN 0.95e0 WHEN 'REVIEW' THEN 0.7e0 ELSE 0.9e0 END AS legal_confidence,
  CASE WHEN medical_verdict='N/A' THEN 1e0 WHEN cost_max IS NULL THEN 0.5e0 WHEN medical_verdict='INVESTIGATE' THEN 0.7e0
       WHEN medical_verdict='REVIEW' THEN 0.6e0 ELSE 0.85e0 END AS medical_confidence,
  CASE WHEN exposure>0.9 THEN 0.8e0 WHEN financial_verdict='REVIEW' THEN 0.7e0 WHEN financial_verdict='INVESTIGATE' THEN 0.75e0
       ELSE 0.85e0 END AS financial_confidence
FROM verdicts), reviews AS (
SELECT claim_id, 'Fraud Detection Agent' AS agent, fraud_verdict AS recommendation, fraud_confidence AS confidence FROM weighed
UNION ALL SELECT claim_id, 'Legal Compliance Agent', legal_verdict, legal_confidence FROM weighed
UNION ALL SELECT claim_id, 'Financial Analysis Agent', financial_verdict, financial_confidence FROM weighed
UNION ALL SELECT claim_id, 'Medical Review Agent', medical_verdict, medical_confidence FROM weighed
  WHERE urgent OR claim_type IN ('Health','Workers Comp')), votes AS (
SELECT claim_id, CAST(count(*) AS INT) AS agent_count,
  CAST(count(*) FILTER (WHERE recommendation='DENY') AS INT) AS deny_votes,
  CAST(count(*) FILTER (WHERE recommendation='INVESTIGATE') AS INT) AS investigate_votes,
  CAST(count(*) FILTER (WHERE recommendation='REVIEW') AS INT) AS review_votes,
  CAST(count(*) FILTER (WHERE recommendation='APPROVE') AS INT) AS approve_votes
FROM reviews GROUP BY claim_id), decisions AS (
SELECT w.*, agent_count, deny_votes, investigate_votes, review_votes, approve_votes,
  CASE WHEN claim_type IN ('Health','Workers Comp')
       THEN CAST(round(CAST(CAST(CASE WHEN urgent THEN fraud_confidence+legal_confidence+medical_confidence+financial_confidence
         ELSE fraud_confidence+legal_confidence+financial_confidence+medical_confidence END/4 AS VARCHAR) AS DECIMAL(20,18)), 3) AS DOUBLE)
       ELSE CAST(round(CAST(CAST((fraud_confidence+legal_confidence+financial_confidence)/3 AS VARCHAR) AS DECIMAL(20,18)), 3) AS DOUBLE) END AS confidence,
  CASE WHEN deny_votes>0 THEN 'DENY' WHEN investigate_votes>=2 OR (urgent AND investigate_votes>=1) THEN 'INVESTIGATE'
       WHEN review_votes+investigate_votes>approve_votes THEN 'REVIEW' ELSE 'APPROVE' END AS final_recommendation
FROM weighed w JOIN votes v ON w.claim_id = v.claim_id)"""


VOTES = votes_sql("false")
# Claims under investigation are critical, all others normal.
MIXED_VOTES = votes_sql("status='Under Investigation'")
