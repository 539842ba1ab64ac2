"""Small literal frames shared by the tests."""

import datetime as dt

CLAIM = dict(
    claim_id=1,
    policy_id=10,
    claimant_id=100,
    claim_type="Auto",
    incident_date=dt.date(2000, 1, 10),
    filing_date=dt.date(2000, 1, 20),
    claim_amount=1000.0,
    description="Slip and fall",
    diagnosis_code=None,
    procedure_code=None,
    status="Submitted",
    is_fraud=False,
)
CLAIM_SCHEMA = (
    "claim_id long, policy_id long, claimant_id long, claim_type string, incident_date date, filing_date date, "
    "claim_amount double, description string, diagnosis_code string, procedure_code string, status string, is_fraud boolean"
)
POLICY = dict(
    policy_id=10,
    claimant_id=100,
    policy_type="Auto",
    provider="P1",
    policy_limit=10000.0,
    deductible=500.0,
    premium_annual=1000.0,
    start_date=dt.date(1999, 6, 1),
    end_date=dt.date(2001, 6, 1),
    status="Active",
)
POLICY_SCHEMA = (
    "policy_id long, claimant_id long, policy_type string, provider string, policy_limit double, deductible double, "
    "premium_annual double, start_date date, end_date date, status string"
)
PERSON = dict(
    claimant_id=100,
    first_name="Ann",
    last_name="Lee",
    date_of_birth=dt.date(1970, 1, 1),
    email="ann@example.com",
    phone="1",
    address_state="CA",
)
PERSON_SCHEMA = (
    "claimant_id long, first_name string, last_name string, date_of_birth date, email string, phone string, address_state string"
)


def _frame(spark, defaults, schema, rows):
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple({**defaults, **row}[n] for n in names) for row in rows], schema)


def claims(spark, *rows):
    return _frame(spark, CLAIM, CLAIM_SCHEMA, rows)


def policies(spark, *rows):
    return _frame(spark, POLICY, POLICY_SCHEMA, rows or [{}])


def people(spark, *rows):
    return _frame(spark, PERSON, PERSON_SCHEMA, rows or [{}])


def column(df, name, key="claim_id"):
    return {row[key]: row[name] for row in df.select(key, name).collect()}
