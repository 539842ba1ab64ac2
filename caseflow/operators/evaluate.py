"""Reviewer feedback, experiments and quality metrics (EVL-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.features import cents, count_where, md5_mod_1000, rounded


def _time(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


def _accuracy_pct() -> Column:
    return count_where(F.col("recommendation_correct")) / F.count(F.lit(1)) * 100


def normalise_feedback(raw: DataFrame) -> DataFrame:
    """EVL-1: upper-case verdicts, rating within 1..5, default adjuster, agreement flag."""
    optional = {"adjuster_notes": "", "adjuster_id": "anonymous"}
    for name, default in optional.items():
        given = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        raw = raw.withColumn(name, F.coalesce(given, F.lit(default)))
    agent, adjuster = F.upper("agent_recommendation"), F.upper("adjuster_decision")
    return raw.select(
        "feedback_id",
        "claim_id",
        agent.alias("agent_recommendation"),
        adjuster.alias("adjuster_decision"),
        "adjuster_notes",
        F.greatest(F.lit(1), F.least(F.lit(5), F.col("raw_rating"))).alias("rating"),
        "feedback_timestamp",
        "adjuster_id",
        "time_to_decision_hours",
        (agent == adjuster).alias("recommendation_correct"),
    )


def since_days(days: int, as_of):
    """Midnight ``days`` days before ``as_of``."""
    return F.date_sub(_time(as_of).cast("date"), days).cast("timestamp")


def feedback_summary(feedback: DataFrame, days: int, as_of) -> DataFrame:
    """EVL-2: by recommendation, since midnight ``days`` days before ``as_of``."""
    start = since_days(days, as_of)
    correct = count_where(F.col("recommendation_correct"))
    n = F.count(F.lit(1))
    return (
        feedback.filter(F.col("feedback_timestamp") >= start)
        .groupBy("agent_recommendation")
        .agg(
            n.alias("total_feedback"),
            F.avg("rating").alias("avg_rating"),
            correct.alias("correct_recommendations"),
            (n - correct).alias("incorrect_recommendations"),
            _accuracy_pct().alias("accuracy_pct"),
            F.avg("time_to_decision_hours").alias("avg_decision_time_hours"),
            n.alias("recommendation_count"),
        )
        .orderBy(F.desc("recommendation_count"), "agent_recommendation")
    )


def quality_summary(feedback: DataFrame, days: int, as_of) -> DataFrame:
    """EVL-3: one row for the last ``days`` days; status 'no_data' when there is nothing."""
    n = F.col("total_evaluations")
    recent = feedback.filter(F.col("feedback_timestamp") >= _time(as_of) - F.make_dt_interval(F.lit(days)))
    return recent.agg(
        F.count(F.lit(1)).alias("total_evaluations"),
        rounded(F.try_divide(count_where("recommendation_correct"), F.count(F.lit(1))), 4).alias("accuracy"),
        cents(F.avg("rating")).alias("avg_rating"),
        cents(F.avg("time_to_decision_hours")).alias("avg_decision_time_hours"),
    ).select(F.lit(days).alias("period_days"), F.when(n > 0, "ok").otherwise("no_data").alias("status"), "*")


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """EVL-5, ML-7: counts per (truth, predicted) pair."""
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("row_count"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """EVL-4, ML-10: per-label precision, recall, F1 and support, then accuracy and averages.

    One scan: each (truth, predicted) pair is counted once, then credited to both its labels.
    """
    n, hit = F.col("row_count"), F.col(truth) == F.col(predicted)
    credits = F.array(
        F.struct(
            F.col(truth).cast("string").alias("label"), n.alias("support"), F.lit(0).cast("long").alias("guessed"),
            F.when(hit, n).otherwise(0).alias("hits"),
        ),
        F.struct(
            F.col(predicted).cast("string").alias("label"), F.lit(0).cast("long").alias("support"), n.alias("guessed"),
            F.lit(0).cast("long").alias("hits"),
        ),
    )
    per_label = (
        confusion_matrix(df, truth, predicted)
        .select(F.inline(credits))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hits")])
        .withColumns(
            {
                "precision": F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0)),
                "recall": F.coalesce(F.try_divide("hits", "support"), F.lit(0.0)),
                "f1_score": F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("guessed")), F.lit(0.0)),
            }
        )
    )
    scores = ["precision", "recall", "f1_score"]
    total = F.sum("support")
    rolled = per_label.rollup("label").agg(
        F.grouping("label").alias("overall"),
        total.alias("support"),
        F.try_divide(F.sum("hits"), total).alias("accuracy"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[F.try_divide(F.sum(F.col(s) * F.col("support")), total).alias(f"weighted_{s}") for s in scores],
    )

    def row(label, values):
        return F.struct(label.alias("label"), *[v.alias(s) for s, v in zip(scores, values)], "support")

    nothing = F.lit(None).cast("double")
    macro = [F.col(f"macro_{s}") for s in scores]
    weighted = [F.col(f"weighted_{s}") for s in scores]
    rows = F.when(
        F.col("overall") == 1,
        F.array(
            row(F.lit("accuracy"), [nothing, nothing, F.col("accuracy")]),
            row(F.lit("macro avg"), macro),
            row(F.lit("weighted avg"), weighted),
        ),
    ).otherwise(F.array(row(F.col("label"), macro)))
    return rolled.select(F.inline(rows))


def performance_report(feedback: DataFrame, as_of) -> DataFrame:
    """EVL-6: by verdict pair, the last 30 days before the day of ``as_of``."""
    start = F.date_sub(_time(as_of).cast("date"), 30).cast("timestamp")
    return (
        feedback.filter(F.col("feedback_timestamp") >= start)
        .groupBy("agent_recommendation", "adjuster_decision")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.avg("rating").alias("avg_rating"),
            _accuracy_pct().alias("accuracy_pct"),
            F.avg("time_to_decision_hours").alias("avg_decision_hours"),
        )
        .orderBy(F.desc("row_count"), "agent_recommendation", "adjuster_decision")
    )


def create_experiment(df: DataFrame, as_of) -> DataFrame:
    """EVL-7: registry rows from experiment_name, variant_a, variant_b (structs), allocation_ratio, description."""
    started = _time(as_of)
    return df.select(
        F.md5(F.concat_ws("||", "experiment_name", started.cast("string"))).alias("experiment_id"),
        "experiment_name",
        F.to_json("variant_a").alias("variant_a_config"),
        F.to_json("variant_b").alias("variant_b_config"),
        F.coalesce("allocation_ratio", F.lit(0.5)).alias("allocation_ratio"),
        F.coalesce("description", F.lit("")).alias("description"),
        started.alias("start_timestamp"),
        F.lit("ACTIVE").alias("status"),
    )


def assign_variant(claims: DataFrame, experiments: DataFrame) -> DataFrame:
    """EVL-8: A or B from the md5 of the claim id; an unknown experiment gives A."""
    known = experiments.select("experiment_id", "allocation_ratio")
    share = md5_mod_1000(F.col("claim_id").cast("string")) / 1000.0
    return (
        claims.join(known, "experiment_id", "left")
        .withColumn("variant", F.when(share < F.col("allocation_ratio"), "B").otherwise("A"))
        .drop("allocation_ratio")
    )


def log_results(df: DataFrame, outcome: list[str], as_of) -> DataFrame:
    """EVL-9: result rows with the outcome columns as JSON."""
    return df.select(
        "experiment_id",
        "claim_id",
        "variant",
        F.to_json(F.struct(*outcome)).alias("outcome_json"),
        _time(as_of).alias("timestamp"),
    )


def _last_day(df: DataFrame, column: str, as_of) -> DataFrame:
    return df.filter(F.col(column) >= _time(as_of) - F.expr("INTERVAL 24 HOURS"))


def monitor_investigations(log: DataFrame, as_of) -> DataFrame:
    """EVL-10, first half: verdicts of the last 24 hours."""
    n = F.count(F.lit(1))
    return (
        _last_day(log, "investigation_timestamp", as_of)
        .groupBy("final_recommendation")
        .agg(
            n.alias("total_claims_investigated"),
            F.avg("confidence").alias("avg_confidence"),
            n.alias("recommendation_count"),
        )
    )


def monitor_feedback(feedback: DataFrame, as_of) -> DataFrame:
    """EVL-10, second half: feedback of the last 24 hours."""
    n = F.count(F.lit(1))
    return _last_day(feedback, "feedback_timestamp", as_of).agg(
        n.alias("total_feedback"),
        F.avg("rating").alias("avg_rating"),
        (F.try_divide(count_where(F.col("recommendation_correct")), n) * 100).alias("accuracy_pct"),
    )
