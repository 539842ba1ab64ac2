"""Investigation lookups for all claims at once (INV-*). A single claim is a filter on the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.features import cents, count_where, money, percent
from caseflow.operators import ranking
from caseflow.operators.silver import with_policy
from caseflow.sources import dims

# Confidence and tag of the rule score.
RULE_CONFIDENCE = 0.85
RULE_VERSION = "rule_based_v1"
UNKNOWN_CODE = "Code not in database"
UNKNOWN_NOTE = "Verify code validity"

# Names of the three policy checks.
CHECK_PERIOD = "Policy active on incident date"
CHECK_LIMIT = "Claim within policy limit"
CHECK_DEDUCTIBLE = "Meets deductible"


def claim_details(enriched: DataFrame) -> DataFrame:
    """INV-1: nested record per claim."""
    return enriched.select(
        "claim_id",
        F.struct(
            F.col("claimant_id").alias("id"),
            F.coalesce("full_name", F.lit("N/A")).alias("name"),
            F.coalesce("address_state", F.lit("N/A")).alias("state"),
        ).alias("claimant"),
        F.struct(
            F.col("policy_id").alias("id"),
            F.coalesce("insurance_provider", F.lit("N/A")).alias("provider"),
            F.coalesce("policy_limit", F.lit(0.0)).alias("limit"),
            F.coalesce("deductible", F.lit(0.0)).alias("deductible"),
        ).alias("policy"),
        F.struct(
            F.col("claim_type").alias("type"),
            F.col("claim_amount").alias("amount"),
            "incident_date",
            "filing_date",
            "status",
            "description",
        ).alias("claim"),
        F.struct("diagnosis_code", "procedure_code").alias("medical"),
    )


def rule_risk(features: DataFrame) -> DataFrame:
    """INV-2: additive rule score with level, recommendation and reasons."""
    to_limit = F.coalesce("claim_to_limit_ratio", F.lit(0.0))
    claims = F.coalesce("total_claims_count", F.lit(0))
    days = F.coalesce("days_to_file", F.lit(0))
    # Weight, condition and wording of each risk factor, in scoring order.
    factors = [
        (0.15, F.col("rapid_filing") == 1, F.lit("Filed within 24 hours of incident")),
        (0.20, to_limit > 0.9, F.concat(F.lit("Claim amount is "), percent(to_limit), F.lit(" of policy limit"))),
        (0.25, F.col("has_prior_fraud") == 1, F.lit("Claimant has prior fraud history")),
        (0.10, claims > 5, F.concat(F.lit("Claimant has "), claims.cast("string"), F.lit(" total claims"))),
        (0.10, days > 60, F.concat(F.lit("Filed "), days.cast("string"), F.lit(" days after incident"))),
    ]
    score = F.lit(0.0)
    for weight, condition, _ in factors:
        score = score + F.when(condition, weight).otherwise(0.0)
    none = F.array().cast("array<string>")
    reasons = F.concat(*[F.when(condition, F.array(text)).otherwise(none) for _, condition, text in factors])
    # Levels compare the rounded score: the sums are exact to two decimals.
    risk = F.col("fraud_risk_score")
    return features.withColumn("fraud_risk_score", F.round(F.least(score, F.lit(1.0)), 3)).withColumns(
        {
            "risk_level": F.when(risk < 0.3, "Low").when(risk < 0.6, "Medium").otherwise("High"),
            "recommendation": F.when(risk < 0.3, "Approve").when(risk < 0.6, "Review").otherwise("Investigate"),
            "confidence": F.lit(RULE_CONFIDENCE),
            "risk_factors": reasons,
            "model_version": F.lit(RULE_VERSION),
        }
    )


def policy_checks(df: DataFrame) -> DataFrame:
    """The three policy checks on rows that already carry the policy terms, and ``policy_found``
    if the join marked it.

    Adds policy_found, policy_valid and, per check, a status and a message. The statuses are
    NULL where there is no policy.
    """
    incident, amount = F.col("incident_date"), F.col("claim_amount")
    start, end = F.col("policy_start_date"), F.col("policy_end_date")
    limit = F.when(F.col("policy_limit") != 0, F.col("policy_limit"))
    deductible = F.when(F.col("deductible") != 0, F.col("deductible"))
    if "policy_found" in df.columns:
        found = F.coalesce("policy_found", F.lit(False))
    else:  # a table from elsewhere: any term tells of a policy
        terms = ["insurance_provider", "policy_limit", "deductible", "premium_annual", "policy_start_date"]
        found = F.coalesce(*[F.col(c).cast("string") for c in terms]).isNotNull()

    undated = start.isNull() | end.isNull()
    outside = (incident < start) | (incident > end)
    over, under = amount > limit, amount < deductible
    return (
        df.withColumn("policy_found", found)
        .withColumns(
            {
                "period_status": F.when(
                    F.col("policy_found"), F.when(undated, "WARN").when(outside, "FAIL").otherwise("PASS")
                ),
                "limit_status": F.when(
                    F.col("policy_found"), F.when(limit.isNull() | over, "WARN").otherwise("PASS")
                ),
                "deductible_status": F.when(
                    F.col("policy_found"), F.when(deductible.isNull() | under, "WARN").otherwise("PASS")
                ),
                "period_message": F.when(undated, "Policy dates not available for validation")
                .when(
                    outside,
                    F.concat(
                        F.lit("Incident date "), incident.cast("string"), F.lit(" outside policy period "),
                        start.cast("string"), F.lit(" to "), end.cast("string"),
                    ),
                )
                .otherwise("Policy was active"),
                "limit_message": F.when(limit.isNull(), "Policy limit not available for validation")
                .when(over, F.concat(F.lit("Claim "), money(amount), F.lit(" exceeds limit "), money(limit)))
                .otherwise(F.concat(F.lit("Claim within "), money(limit), F.lit(" limit"))),
                "deductible_message": F.when(deductible.isNull(), "Deductible not available for validation")
                .when(
                    under,
                    F.concat(F.lit("Claim "), money(amount), F.lit(" below "), money(deductible), F.lit(" deductible")),
                )
                .otherwise(F.concat(F.lit("Exceeds "), money(deductible), F.lit(" deductible"))),
            }
        )
        .withColumn("policy_valid", F.coalesce(F.col("period_status") != "FAIL", F.lit(False)))
    )


CHECKS = {"period": CHECK_PERIOD, "limit": CHECK_LIMIT, "deductible": CHECK_DEDUCTIBLE}


def validations():
    """The checks of a row as an array; empty where there is no policy."""
    checks = [
        F.struct(
            F.lit(label).alias("check"), F.col(f"{name}_status").alias("status"), F.col(f"{name}_message").alias("message")
        )
        for name, label in CHECKS.items()
    ]
    nothing = F.array().cast("array<struct<check:string,status:string,message:string>>")
    return F.when(F.col("policy_found"), F.array(*checks)).otherwise(nothing)


def verify_policy(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """INV-3, J-9: policy terms and checks per claim; a claim without a policy has no checks."""
    joined = with_policy(claims, policies, {"policy_type": "policy_type", "status": "policy_status"}, marked=True)
    checked = policy_checks(joined)
    return checked.select(
        "claim_id",
        "policy_id",
        "policy_found",
        "policy_valid",
        F.struct(
            F.coalesce("insurance_provider", F.lit("N/A")).alias("provider"),
            F.coalesce("policy_type", F.lit("N/A")).alias("type"),
            F.col("policy_limit").alias("limit"),
            "deductible",
            F.coalesce("policy_status", F.lit("N/A")).alias("status"),
        ).alias("policy_details"),
        validations().alias("validations"),
        *[f"{name}_{part}" for name in CHECKS for part in ("status", "message")],
    )


def medical_lookup(claims: DataFrame) -> DataFrame:
    """INV-4, J-7: attributes of the diagnosis and procedure codes."""
    spark = claims.sparkSession
    icd = dims.icd10(spark).select(
        F.col("code").alias("diagnosis_code"),
        F.col("description").alias("diagnosis_description"),
        F.col("category").alias("diagnosis_category"),
        F.col("severity").alias("diagnosis_severity"),
    )
    cpt = dims.cpt(spark).select(
        F.col("code").alias("procedure_code"),
        F.col("description").alias("procedure_description"),
        F.col("cost_min").alias("procedure_cost_min"),
        F.col("cost_max").alias("procedure_cost_max"),
        ((F.col("cost_min") + F.col("cost_max")) / 2).alias("procedure_cost_avg"),
    )
    looked_up = claims.join(F.broadcast(icd), "diagnosis_code", "left").join(
        F.broadcast(cpt), "procedure_code", "left"
    )
    unknown = {}
    for kind in ("diagnosis", "procedure"):
        missing = F.col(f"{kind}_code").isNotNull() & F.col(f"{kind}_description").isNull()
        unknown[f"{kind}_note"] = F.when(missing, UNKNOWN_NOTE)
        unknown[f"{kind}_description"] = F.when(missing, UNKNOWN_CODE).otherwise(F.col(f"{kind}_description"))
    return looked_up.withColumns(unknown)


def risk_pattern(fraud, total):
    """Words for a claimant's history. Fixed values."""
    return (
        F.when(fraud > 0, "High - Prior fraud detected").when(total > 5, "Medium - Frequent claimant").otherwise("Low - Normal history")
    )


def payment_history(claims: DataFrame, n: int = 5) -> DataFrame:
    """INV-5: totals, risk pattern and the ``n`` latest claims per claimant; claims without a claimant
    are one history.

    Both sides are cut down before their shuffle, to one row and to ``n`` rows per claimant and task,
    so that a claimant with very many claims is no load; their join moves these few rows only.
    """
    totals = claims.groupBy("claimant_id").agg(
        F.count(F.lit(1)).alias("total_claims"),
        cents(F.sum("claim_amount")).alias("total_claimed"),
        cents(F.avg("claim_amount")).alias("average_claim"),
        count_where(F.col("is_fraud")).alias("fraud_count"),
    )
    narrow = claims.select("claimant_id", "claim_id", "claim_amount", "filing_date", "status")
    latest = ranking.top_per_key(
        narrow, ["claimant_id"], [F.col("filing_date").desc(), F.col("claim_id")], n, "position"
    )
    recent = latest.groupBy("claimant_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "position", "claim_id", F.col("claim_amount").alias("amount"),
                    F.col("filing_date").alias("date"), "status",
                )
            )
        ).alias("recent_claims")
    )
    described = totals.withColumn("risk_pattern", risk_pattern(F.col("fraud_count"), F.col("total_claims")))
    recent = recent.withColumnRenamed("claimant_id", "_of")
    return described.join(recent, F.col("claimant_id").eqNullSafe(F.col("_of")), "left").drop("_of")


def keyword_search(
    df: DataFrame, text: str, k: int = 5, column: str = "description", key: str = "claim_id"
) -> DataFrame:
    """INV-6: rows whose text holds any of the first three query words, most matches first."""
    words = text.lower().split()[:3]
    hits = F.lit(0)
    for word in words:
        hits = hits + F.lower(column).contains(word).cast("int")
    found = df.withColumn("matched_words", hits).filter("matched_words > 0")
    top = found.orderBy(F.desc("matched_words"), key).limit(k)
    # The window sees the k rows of the limit only.
    position = F.row_number().over(ranking.Window.orderBy(F.desc("matched_words"), key)) - 1
    return top.withColumn("similarity_score", F.round(F.greatest(F.lit(0.45), 0.85 - position * 0.08), 2))
