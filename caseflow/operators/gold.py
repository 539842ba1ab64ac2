"""Business aggregates (GLD-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.features import count_where, ratio, sum_where

FRAUD = "is_fraud"


def _status(name: str):
    return F.col("status") == name


def _month(column: str):
    return F.date_trunc("month", column).cast("date")


def _stamp(as_of):
    """Load time; now unless given."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def claims_summary(df: DataFrame, as_of=None) -> DataFrame:
    """GLD-1: by type, provider, state and incident month."""
    return summary_rates(
        df.groupBy("claim_type", "insurance_provider", "address_state", _month("incident_date").alias("incident_month"))
        .agg(
            F.count(F.lit(1)).alias("total_claims"),
            F.sum("claim_amount").alias("total_claimed_amount"),
            F.avg("claim_amount").alias("avg_claim_amount"),
            F.min("claim_amount").alias("min_claim_amount"),
            F.max("claim_amount").alias("max_claim_amount"),
            count_where(FRAUD).alias("fraud_count"),
            sum_where(_status("Approved"), "claim_amount").alias("approved_amount"),
            count_where(_status("Denied")).alias("denied_count"),
            F.avg("days_to_file").alias("avg_days_to_file"),
        ),
        as_of,
    )


def summary_rates(sums: DataFrame, as_of=None) -> DataFrame:
    n, denied = F.col("total_claims"), F.col("denied_count")
    return sums.withColumns(
        {
            "fraud_rate_pct": F.col("fraud_count") / n * 100,
            "approval_rate_pct": (n - denied) / n * 100,
            "avg_approved_amount": F.col("approved_amount") / F.greatest(n - denied, F.lit(1)),
            "created_at": _stamp(as_of),
        }
    )


def fraud_alerts(features: DataFrame, silver: DataFrame | None = None, as_of=None) -> DataFrame:
    """GLD-2: claims worth a look, with a composite score and priority.

    ``features`` may already carry the descriptive columns (the silver table does); give
    ``silver`` when they are stored apart.
    """
    to_limit, many = F.col("claim_to_limit_ratio"), F.col("total_claims_count") > 5
    rapid, prior = F.col("rapid_filing"), F.col("has_prior_fraud")
    alerts = features.filter(F.col(FRAUD) | (to_limit > 0.85) | (rapid == 1) | (prior == 1) | many)
    if silver is not None:
        described = silver.select(
            "claim_id", "claimant_id", "policy_id", "insurance_provider", "full_name", "description", "status"
        )
        alerts = alerts.join(described, "claim_id")
    score = to_limit * 0.3 + rapid * 0.2 + prior * 0.3 + F.when(many, 0.2).otherwise(0.0)
    risk = F.col("risk_score")
    return alerts.withColumn("risk_score", score).select(
        "claim_id",
        "claimant_id",
        "policy_id",
        "full_name",
        "insurance_provider",
        "claim_amount",
        "risk_score",
        F.when(risk > 0.7, "Critical")
        .when(risk > 0.5, "High")
        .when(risk > 0.3, "Medium")
        .otherwise("Low")
        .alias("alert_priority"),
        F.coalesce(F.col(FRAUD) | (risk > 0.6), F.lit(False)).alias("investigation_required"),
        "is_fraud",
        "status",
        "description",
        "claim_to_limit_ratio",
        "rapid_filing",
        "has_prior_fraud",
        "total_claims_count",
        _stamp(as_of).alias("alert_timestamp"),
    )


def claimant_profiles(df: DataFrame, claimants: DataFrame | None = None, as_of=None) -> DataFrame:
    """GLD-3: lifetime behaviour and risk tier per claimant.

    With ``claimants`` (claimant_id, full_name, address_state) the name and state are joined to the
    finished profiles, one row per claimant; without, they come from the claims.
    """
    attributes = ["full_name", "address_state"]
    profiles = profile_tiers(
        df.groupBy("claimant_id", *([] if claimants is not None else attributes))
        .agg(
            F.count(F.lit(1)).alias("lifetime_claims"),
            F.sum("claim_amount").alias("lifetime_claimed"),
            F.avg("claim_amount").alias("avg_claim_size"),
            F.max("claim_amount").alias("max_claim_size"),
            count_where(FRAUD).alias("fraud_claims_count"),
            F.min("incident_date").alias("first_claim_date"),
            F.max("incident_date").alias("last_claim_date"),
            # Few different values each: sets cost less than expanding every claim.
            F.size(F.collect_set("insurance_provider")).cast("long").alias("unique_providers"),
            F.size(F.collect_set("claim_type")).cast("long").alias("unique_claim_types"),
            F.avg("days_to_file").alias("avg_filing_delay"),
        ),
        as_of,
    )
    if claimants is None:
        return profiles
    named = profiles.join(claimants.select("claimant_id", *attributes), "claimant_id", "left")
    return named.select("claimant_id", *attributes, *[c for c in profiles.columns if c != "claimant_id"])


def profile_tiers(sums: DataFrame, as_of=None) -> DataFrame:
    n, days = F.col("lifetime_claims"), F.col("days_active")
    return (
        sums.withColumn("fraud_rate", F.col("fraud_claims_count") / n)
        .withColumn("days_active", F.datediff("last_claim_date", "first_claim_date"))
        .withColumn("claims_per_year", n / F.when(days > 0, days / 365).otherwise(1.0))
        .withColumn(
            "risk_tier",
            F.when(F.col("fraud_rate") > 0, "High Risk - Known Fraud")
            .when(n > 5, "High Risk - Frequent")
            .when(F.col("claims_per_year") > 2, "Medium Risk - Active")
            .otherwise("Low Risk"),
        )
        .withColumn("profile_updated_at", _stamp(as_of))
    )


def provider_metrics(df: DataFrame, as_of=None) -> DataFrame:
    """GLD-4: exposure, losses and rates per provider and quarter."""
    return provider_rates(
        df.groupBy("insurance_provider", F.date_trunc("quarter", "incident_date").cast("date").alias("quarter"))
        .agg(
            F.count(F.lit(1)).alias("total_claims"),
            F.sum("claim_amount").alias("total_exposure"),
            F.avg("claim_amount").alias("avg_claim_size"),
            sum_where(FRAUD, "claim_amount").alias("fraud_losses"),
            count_where(FRAUD).alias("fraud_count"),
            count_where(_status("Approved")).alias("approved_count"),
            count_where(_status("Denied")).alias("denied_count"),
            F.avg("days_to_file").alias("avg_processing_time"),
            F.countDistinct("claimant_id").alias("unique_claimants"),
        ),
        as_of,
    )


def provider_rates(sums: DataFrame, as_of=None) -> DataFrame:
    n = F.col("total_claims")
    return sums.withColumns(
        {
            "fraud_rate_pct": F.col("fraud_count") / n * 100,
            "fraud_loss_ratio": ratio(F.col("fraud_losses"), F.col("total_exposure")),
            "approval_rate_pct": F.col("approved_count") / n * 100,
            "claims_per_claimant": ratio(n, F.col("unique_claimants")),
            "metrics_date": _stamp(as_of),
        }
    )


def weekly_series(df: DataFrame, as_of=None) -> DataFrame:
    """GLD-5: weekly counts per type with averages over the last four rows.

    The window runs over the aggregate, one row per week and type.
    """
    return weekly_rates(
        df.groupBy(F.date_trunc("week", "incident_date").cast("date").alias("incident_week"), "claim_type")
        .agg(
            F.count(F.lit(1)).alias("claims_count"),
            F.sum("claim_amount").alias("total_amount"),
            F.avg("claim_amount").alias("avg_amount"),
            count_where(FRAUD).alias("fraud_count"),
            count_where(_status("Approved")).alias("approved_count"),
        ),
        as_of,
    )


def weekly_rates(sums: DataFrame, as_of=None) -> DataFrame:
    recent = Window.partitionBy("claim_type").orderBy("incident_week").rowsBetween(-3, 0)
    return sums.withColumns(
        {
            "claims_4week_avg": F.avg("claims_count").over(recent),
            "amount_4week_avg": F.avg("total_amount").over(recent),
            "fraud_rate_pct": F.col("fraud_count") / F.col("claims_count") * 100,
            "created_at": _stamp(as_of),
        }
    )


def top(df: DataFrame, by: str, n: int, tie: list[str]) -> DataFrame:
    """GLD-7: the ``n`` rows with the greatest ``by``."""
    return df.orderBy(F.col(by).desc(), *tie).limit(n)
