"""Dashboard queries (DSH-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.features import count_where, sum_where

FRAUD = "is_fraud"


def kpis(df: DataFrame) -> DataFrame:
    """DSH-1: one row of headline numbers."""

    def with_status(name):
        return F.coalesce(count_where(F.col("status") == name), F.lit(0))

    return df.agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.sum("claim_amount").alias("total_amount"),
        F.avg("claim_amount").alias("avg_amount"),
        F.coalesce(count_where(FRAUD), F.lit(0)).alias("fraud_count"),
        F.coalesce(sum_where(FRAUD, "claim_amount"), F.lit(0.0)).alias("fraud_amount"),
        with_status("Approved").alias("approved_count"),
        with_status("Denied").alias("denied_count"),
        with_status("Pending").alias("pending_count"),
    ).withColumn(
        "fraud_rate_pct", F.col("fraud_count") / F.greatest(F.col("total_claims"), F.lit(1)) * 100
    )


def search(
    df: DataFrame,
    status: str | None = None,
    min_amount: float | None = None,
    max_amount: float | None = None,
    state: str | None = None,
    fraud_only: bool = False,
    text: str | None = None,
    limit: int = 500,
) -> DataFrame:
    """DSH-2: newest claims that pass every given filter. An amount of 0 is a filter."""
    if status:
        df = df.filter(F.col("status") == status)
    if min_amount is not None:
        df = df.filter(F.col("claim_amount") >= min_amount)
    if max_amount is not None:
        df = df.filter(F.col("claim_amount") <= max_amount)
    if state:
        df = df.filter(F.col("address_state") == state)
    if fraud_only:
        df = df.filter(FRAUD)
    if text:
        df = text_search(df, text)
    return df.orderBy(F.desc("filing_date"), "claim_id").limit(limit)


def text_search(df: DataFrame, term: str) -> DataFrame:
    """DSH-3: rows with the term anywhere in their values, ignoring case."""
    row = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))
    return df.filter(row.contains(term.lower()))


def high_risk(silver: DataFrame, n: int = 10) -> DataFrame:
    """DSH-4: the largest claims with a risk sign."""
    risky = (F.col("rapid_filing") == 1) | (F.col("claim_to_limit_ratio") > 0.8) | (F.col("has_prior_fraud") == 1)
    wanted = ["claim_id", "claim_amount", "status", "rapid_filing", "claim_to_limit_ratio", "has_prior_fraud"]
    return silver.filter(risky).select(*wanted).orderBy(F.desc("claim_amount"), "claim_id").limit(n)


def monthly_trend(df: DataFrame) -> DataFrame:
    """DSH-5."""
    return (
        df.groupBy(F.date_trunc("month", "incident_date").cast("date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("claim_count"),
            F.sum("claim_amount").alias("total_amount"),
            count_where(FRAUD).alias("fraud_count"),
        )
        .orderBy("month")
    )


# Factor label and the 0/1 feature behind it.
FACTORS = {
    "Rapid Filing": "rapid_filing",
    "High Claim/Limit Ratio": "claim_near_limit",
    "Prior Fraud": "has_prior_fraud",
}


def factor_rates(features: DataFrame) -> DataFrame:
    """DSH-6: fraud rate where each factor is set, in one pass over the features."""
    counted = features.agg(
        *[
            F.struct(
                F.lit(label).alias("factor"),
                F.coalesce(count_where((F.col(name) == 1) & F.col(FRAUD)), F.lit(0)).alias("fraud_count"),
                F.coalesce(count_where(F.col(name) == 1), F.lit(0)).alias("total_count"),
            ).alias(name)
            for label, name in FACTORS.items()
        ]
    )
    rate = F.round(F.try_divide("fraud_count", "total_count") * 100, 1)
    return counted.select(F.inline(F.array(*FACTORS.values()))).withColumn("fraud_rate", rate)


def top_states(df: DataFrame, n: int = 10) -> DataFrame:
    """DSH-7."""
    return (
        df.groupBy("address_state")
        .agg(F.count(F.lit(1)).alias("claim_count"), F.sum("claim_amount").alias("total_amount"))
        .orderBy(F.desc("claim_count"), "address_state")
        .limit(n)
    )


def recent(df: DataFrame, timestamp: str, n: int = 50, tie: str | None = None) -> DataFrame:
    """DSH-8, DSH-9: newest rows of a log, without the ones marked as deleted."""
    if "is_deleted" in df.columns:
        df = df.filter(~F.col("is_deleted"))
    return df.orderBy(F.desc(timestamp), *([tie] if tie else [])).limit(n)


def status_split(kpi_row: DataFrame) -> DataFrame:
    """DSH-10: KPI counts in long form for the two charts."""
    pairs = {
        ("status", "Approved"): F.col("approved_count"),
        ("status", "Denied"): F.col("denied_count"),
        ("status", "Pending"): F.col("pending_count"),
        ("validity", "Valid Claims"): F.col("total_claims") - F.col("fraud_count"),
        ("validity", "Fraudulent Claims"): F.col("fraud_count"),
    }
    rows = [
        F.struct(F.lit(chart).alias("chart"), F.lit(label).alias("category"), value.alias("claim_count"))
        for (chart, label), value in pairs.items()
    ]
    return kpi_row.select(F.inline(F.array(*rows)))
