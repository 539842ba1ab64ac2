"""Data quality checks and profiles (DQ-*, PRF-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """DQ-1: one row, the number of NULLs per column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """DQ-2: key values that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """DQ-3, J-3: child rows whose key has no parent."""
    return child.join(parent.select(key), key, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Number of orphans; children are counted per key first, so a hot key moves as one row."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return orphans(per_key, parent, key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


def violations(df: DataFrame, predicate: Column) -> DataFrame:
    """DQ-4, DQ-5: rows that break a rule."""
    return df.filter(predicate)


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """DQ-6: share of filled values per column, one aggregate for all columns."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    return counted.unpivot("_rows", cols, "column_name", "null_count").select(
        "column_name",
        "null_count",
        ((1 - F.try_divide("null_count", "_rows")) * 100).alias("completeness_pct"),
    )


def dq_report(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """DQ-7: every bronze rule with its number of violations."""
    duplicates = duplicate_keys(claims, ["claim_id"]).agg(F.count(F.lit(1)).alias("violations"))
    rows = claims.agg(
        F.count_if(F.col("filing_date") < F.col("incident_date")).alias("filed_before_incident"),
        F.count_if(F.col("claim_amount") <= 0).alias("non_positive_amount"),
    ).unpivot([], ["filed_before_incident", "non_positive_amount"], "rule", "violations")
    named = [
        duplicates.select(F.lit("duplicate_claim_id").alias("rule"), "violations"),
        orphan_count(claims, policies, "policy_id").select(F.lit("missing_policy").alias("rule"), "violations"),
    ]
    report = rows
    for part in named:
        report = report.unionByName(part)
    return report.withColumn("passed", F.col("violations") == 0)


def profile_by(df: DataFrame, key: str, aggregates: dict[str, Column]) -> DataFrame:
    """PRF-1, PRF-3, PRF-4: row count and named aggregates per key."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"), *[column.alias(name) for name, column in aggregates.items()]
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """PRF-2, GLD-6: rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.desc("row_count"), col)
