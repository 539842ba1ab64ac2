"""Feedback, experiments and dashboards (EVL, DSH)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import adjudicate, audit, dashboards, evaluate, text_index
from caseflow.plans.base import (
    AS_OF,
    CLAIMS,
    ENRICHED,
    FEEDBACK,
    ORACLES,
    SILVER,
    VOTES,
    cents,
    day,
    instant,
    num,
    nums,
    plain,
    query,
    rounded,
)
from caseflow.plans.cases import NOTES, REQUESTS, TASKS, notes, requests, tasks
from caseflow.session import work_dir
from caseflow.sources import store


def _feedback(v):
    return evaluate.normalise_feedback(v.feedback)


@query(
    "evl1_normalise_feedback",
    f"""WITH {FEEDBACK} SELECT feedback_id, claim_id, agent_recommendation, adjuster_decision, '' AS adjuster_notes, rating,
{instant('feedback_timestamp')}, 'anonymous' AS adjuster_id, {num('time_to_decision_hours')}, recommendation_correct FROM feedback""",
)
def _(v):
    return plain(_feedback(v))


ACCURACY = num("count(*) FILTER (WHERE recommendation_correct)*100e0/count(*)", "accuracy_pct")


@query(
    "evl2_feedback_summary",
    f"""WITH {FEEDBACK} SELECT agent_recommendation, count(*) AS total_feedback, {num('avg(rating)', 'avg_rating')},
count(*) FILTER (WHERE recommendation_correct) AS correct_recommendations,
count(*) - count(*) FILTER (WHERE recommendation_correct) AS incorrect_recommendations, {ACCURACY},
{num('avg(time_to_decision_hours)', 'avg_decision_time_hours')}, count(*) AS recommendation_count FROM feedback
WHERE feedback_timestamp >= DATE '{AS_OF[:10]}' - 30 GROUP BY agent_recommendation""",
)
def _(v):
    return plain(evaluate.feedback_summary(_feedback(v), 30, AS_OF))


@query(
    "evl3_quality_summary",
    f"""WITH {FEEDBACK} SELECT 30 AS period_days, 'ok' AS status, count(*) AS total_evaluations,
{num(rounded('count(*) FILTER (WHERE recommendation_correct)/count(*)', 4), 'accuracy')}, {num(cents('avg(rating)'), 'avg_rating')},
{num(cents('avg(time_to_decision_hours)'), 'avg_decision_time_hours')} FROM feedback
WHERE feedback_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""",
)
def _(v):
    return plain(evaluate.quality_summary(_feedback(v), 30, AS_OF))


def report_sql(source: str, truth: str, predicted: str) -> str:
    """Per-label scores and averages; ``source`` is the text after WITH that defines ``truth_table``."""
    return f"""WITH {source}, labels AS (SELECT {truth} AS label FROM truth_table UNION SELECT {predicted} FROM truth_table),
counted AS (SELECT label, (SELECT count(*) FROM truth_table WHERE {truth}=label) AS support,
(SELECT count(*) FROM truth_table WHERE {predicted}=label) AS guessed,
(SELECT count(*) FROM truth_table WHERE {truth}=label AND {predicted}=label) AS hits FROM labels),
rated AS (SELECT label, support, hits, CASE WHEN guessed=0 THEN 0 ELSE hits/guessed END AS precision,
CASE WHEN support=0 THEN 0 ELSE hits/support END AS recall,
CASE WHEN support+guessed=0 THEN 0 ELSE 2*hits/(support+guessed) END AS f1_score FROM counted),
report AS (SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1_score, support FROM rated
UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits)/sum(support), CAST(sum(support) AS BIGINT) FROM rated
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM rated
UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support),
sum(f1_score*support)/sum(support), CAST(sum(support) AS BIGINT) FROM rated)
SELECT label, {nums('precision recall f1_score')}, support FROM report"""


@query(
    "evl4_class_report",
    report_sql(f"{FEEDBACK}, truth_table AS (SELECT * FROM feedback)", "adjuster_decision", "agent_recommendation"),
)
def _(v):
    return plain(evaluate.class_report(_feedback(v), "adjuster_decision", "agent_recommendation"))


@query(
    "evl5_confusion_matrix",
    f"WITH {FEEDBACK} SELECT adjuster_decision, agent_recommendation, count(*) AS row_count FROM feedback GROUP BY ALL",
)
def _(v):
    return evaluate.confusion_matrix(_feedback(v), "adjuster_decision", "agent_recommendation")


@query(
    "evl6_performance_report",
    f"""WITH {FEEDBACK} SELECT agent_recommendation, adjuster_decision, count(*) AS row_count, {num('avg(rating)', 'avg_rating')},
{ACCURACY}, {num('avg(time_to_decision_hours)', 'avg_decision_hours')} FROM feedback
WHERE feedback_timestamp >= DATE '{AS_OF[:10]}' - 30 GROUP BY ALL""",
)
def _(v):
    return plain(evaluate.performance_report(_feedback(v), AS_OF))


def _experiments(v):
    """One experiment per market segment; the share of B grows with the number of customers."""
    rated = v.table("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.create_experiment(
        rated.select(
            F.col("c_mktsegment").alias("experiment_name"),
            F.struct(F.lit("strict").alias("routing")).alias("variant_a"),
            F.struct(F.lit("fast").alias("routing")).alias("variant_b"),
            (F.col("n") % 100 / 100).alias("allocation_ratio"),
            F.lit(None).cast("string").alias("description"),
        ),
        AS_OF,
    )


EXPERIMENTS = f"""experiments AS (SELECT md5(concat_ws('||', c_mktsegment, '{AS_OF}')) AS experiment_id, c_mktsegment AS experiment_name,
'{{"routing":"strict"}}' AS variant_a_config, '{{"routing":"fast"}}' AS variant_b_config, count(*)%100/100 AS allocation_ratio,
'' AS description, 'ACTIVE' AS status FROM customer GROUP BY c_mktsegment)"""


@query(
    "evl7_create_experiment",
    f"""WITH {EXPERIMENTS} SELECT experiment_id, experiment_name, variant_a_config, variant_b_config, {num('allocation_ratio')},
description, {instant(f"'{AS_OF}'", 'start_timestamp')}, status FROM experiments""",
)
def _(v):
    root = work_dir(v.spark, "evl7")
    store.append(_experiments(v), root, "experiments")
    return plain(store.load(v.spark, root, "experiments"))


ASSIGNED = f"""{CLAIMS}, {EXPERIMENTS}, asked AS (SELECT claim_id, c_mktsegment AS segment,
CASE WHEN claim_type='Auto' THEN 'unknown' ELSE md5(concat_ws('||', c_mktsegment, '{AS_OF}')) END AS experiment_id
FROM claims JOIN customer ON CAST(floor(claimant_id/4) AS BIGINT)=c_custkey), hashed AS (SELECT *, md5(CAST(claim_id AS VARCHAR)) AS digest FROM asked),
assigned AS (SELECT claim_id, hashed.experiment_id, CASE WHEN ((CAST('0x' || substr(digest,1,16) AS UBIGINT)%1000)*616
 + CAST('0x' || substr(digest,17,16) AS UBIGINT)%1000)%1000/1000 < allocation_ratio THEN 'B' ELSE 'A' END AS variant
FROM hashed LEFT JOIN experiments ON hashed.experiment_id=experiments.experiment_id)"""


def _assigned(v):
    segments = v.table("customer").select(F.col("c_custkey").alias("customer"), "c_mktsegment")
    asked = v.claims.withColumn("customer", F.floor(F.col("claimant_id") / 4).cast("bigint")).join(segments, "customer")
    known = F.md5(F.concat_ws("||", "c_mktsegment", F.lit(AS_OF)))
    asked = asked.select(
        "claim_id",
        F.when(F.col("claim_type") == "Auto", "unknown").otherwise(known).alias("experiment_id"),
    )
    return evaluate.assign_variant(asked, _experiments(v))


@query("evl8_assign_variant", f"WITH {ASSIGNED} SELECT claim_id, experiment_id, variant FROM assigned")
def _(v):
    return _assigned(v).select("claim_id", "experiment_id", "variant")


@query(
    "evl9_experiment_results",
    f"""WITH {ASSIGNED} SELECT assigned.claim_id, experiment_id, variant, '{{"status":"' || status || '"}}' AS outcome_json,
{instant(f"'{AS_OF}'", 'timestamp')} FROM assigned JOIN claims ON assigned.claim_id=claims.claim_id""",
)
def _(v):
    outcome = _assigned(v).join(v.claims.select("claim_id", "status"), "claim_id")
    return plain(evaluate.log_results(outcome, ["status"], AS_OF))


MONITORED = "2001-07-20 12:00:00"


@query(
    "evl10_monitor_investigations",
    f"""WITH {VOTES} SELECT final_recommendation, count(*) AS total_claims_investigated, {num('avg(confidence)', 'avg_confidence')},
count(*) AS recommendation_count FROM decisions WHERE CAST(filing_date AS TIMESTAMP) >= TIMESTAMP '{MONITORED}' - INTERVAL 24 HOUR
GROUP BY final_recommendation""",
)
def _(v):
    # Claims are taken as investigated on their filing day.
    decided = adjudicate.decide(adjudicate.reviewed(v.cases))
    log = decided.withColumn("investigation_timestamp", F.col("filing_date").cast("timestamp"))
    return plain(evaluate.monitor_investigations(log, MONITORED))


@query(
    "evl10_monitor_feedback",
    f"""WITH {FEEDBACK} SELECT count(*) AS total_feedback, {num('avg(rating)', 'avg_rating')}, {ACCURACY} FROM feedback
WHERE feedback_timestamp >= TIMESTAMP '{MONITORED}' - INTERVAL 24 HOUR""",
)
def _(v):
    return plain(evaluate.monitor_feedback(_feedback(v), MONITORED))


def _feedback_log(v):
    # The test tables hold a few rows a day.
    root = work_dir(v.spark, "feedback")
    store.append_log(_feedback(v), root, "feedback", "feedback_timestamp", "year")
    return root


@query("evl2_feedback_summary_from_log", ORACLES["evl2_feedback_summary"])
def _(v):
    rows = store.load_log(v.spark, _feedback_log(v), "feedback", "feedback_timestamp", evaluate.since_days(30, AS_OF), "year")
    return plain(evaluate.feedback_summary(rows, 30, AS_OF))


@query("evl10_monitor_feedback_from_log", ORACLES["evl10_monitor_feedback"])
def _(v):
    rows = store.load_log(v.spark, _feedback_log(v), "feedback", "feedback_timestamp", evaluate.since_days(1, MONITORED), "year")
    return plain(evaluate.monitor_feedback(rows, MONITORED))


KPIS = f"""{CLAIMS}, kpis AS (SELECT count(*) AS total_claims, sum(claim_amount) AS total_amount, avg(claim_amount) AS avg_amount,
count(*) FILTER (WHERE is_fraud) AS fraud_count, sum(CASE WHEN is_fraud THEN claim_amount ELSE 0 END) AS fraud_amount,
count(*) FILTER (WHERE status='Approved') AS approved_count, count(*) FILTER (WHERE status='Denied') AS denied_count,
count(*) FILTER (WHERE status='Pending') AS pending_count FROM claims)"""


@query(
    "dsh1_kpis",
    f"""WITH {KPIS} SELECT total_claims, {nums('total_amount avg_amount')}, fraud_count, {num('fraud_amount')}, approved_count,
denied_count, pending_count, {num('fraud_count*100e0/total_claims', 'fraud_rate_pct')} FROM kpis""",
)
def _(v):
    return plain(dashboards.kpis(v.claims))


LISTED = f"claim_id, {num('claim_amount')}, status, {day('incident_date')}, claim_type, is_fraud, full_name, address_state"
LIST_COLUMNS = "claim_id claim_amount status incident_date claim_type is_fraud full_name address_state".split()


@query(
    "dsh2_filtered_listing",
    f"""WITH {ENRICHED}, top AS (SELECT * FROM enriched WHERE status='Under Review' AND claim_amount>=0 AND claim_amount<=200000
AND is_fraud ORDER BY filing_date DESC, claim_id LIMIT 500) SELECT {LISTED} FROM top""",
)
def _(v):
    found = dashboards.search(v.enriched, status="Under Review", min_amount=0, max_amount=200000, fraud_only=True)
    return plain(found.select(*LIST_COLUMNS))


@query(
    "dsh2_newest_listing",
    f"""WITH {ENRICHED}, top AS (SELECT * FROM enriched ORDER BY filing_date DESC, claim_id LIMIT 500) SELECT {LISTED} FROM top""",
)
def _(v):
    return plain(dashboards.search(v.enriched).select(*LIST_COLUMNS))


@query(
    "dsh3_text_search",
    f"""WITH {ENRICHED}, top AS (SELECT * FROM enriched WHERE contains(lower(concat_ws(' ', claim_type, status, description, full_name)), 'water')
ORDER BY filing_date DESC, claim_id LIMIT 500) SELECT {LISTED} FROM top""",
)
def _(v):
    return plain(dashboards.search(v.enriched, text="WATER").select(*LIST_COLUMNS))


@query(
    "dsh3_text_search_documents",
    "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(concat_ws(' ', doc_id, text, lang, source, n_chars)), 'the on')",
)
def _(v):
    return dashboards.text_search(v.table("documents"), "The ON").select("doc_id", "lang", "n_chars")


@query("dsh3_text_search_indexed", ORACLES["dsh3_text_search_documents"])
def _(v):
    root, documents = work_dir(v.spark, "dsh3"), v.table("documents")
    text_index.build(documents, root, "documents", "doc_id")
    return text_index.text_search(documents, root, "documents", "The ON", "doc_id").select("doc_id", "lang", "n_chars")


@query(
    "dsh4_high_risk",
    f"""WITH {SILVER}, top AS (SELECT * FROM silver WHERE rapid_filing=1 OR claim_to_limit_ratio>0.8 OR has_prior_fraud=1
ORDER BY claim_amount DESC, claim_id LIMIT 10) SELECT claim_id, {num('claim_amount')}, status, rapid_filing,
{num('claim_to_limit_ratio')}, has_prior_fraud FROM top""",
)
def _(v):
    return plain(dashboards.high_risk(v.cases))


@query(
    "dsh5_monthly_trend",
    f"""WITH {CLAIMS} SELECT {day("date_trunc('month', incident_date)", 'month')}, count(*) AS claim_count,
{num('sum(claim_amount)', 'total_amount')}, count(*) FILTER (WHERE is_fraud) AS fraud_count FROM claims
GROUP BY date_trunc('month', incident_date)""",
)
def _(v):
    return plain(dashboards.monthly_trend(v.claims))


@query(
    "dsh6_factor_rates",
    f"WITH {SILVER}, counted AS ("
    + " UNION ALL ".join(
        f"SELECT '{label}' AS factor, count(*) FILTER (WHERE {name}=1 AND is_fraud) AS fraud_count, "
        f"count(*) FILTER (WHERE {name}=1) AS total_count FROM silver"
        for label, name in dashboards.FACTORS.items()
    )
    + f") SELECT factor, fraud_count, total_count, {num('round(fraud_count*100e0/total_count, 1)', 'fraud_rate')} FROM counted",
)
def _(v):
    return plain(dashboards.factor_rates(v.features))


@query(
    "dsh7_top_states",
    f"""WITH {ENRICHED} SELECT address_state, count(*) AS claim_count, {num('sum(claim_amount)', 'total_amount')} FROM enriched
GROUP BY address_state ORDER BY claim_count DESC, address_state LIMIT 10""",
)
def _(v):
    return plain(dashboards.top_states(v.enriched))


@query(
    "dsh8_recent_notes", f"WITH {NOTES} SELECT * FROM notes ORDER BY created_timestamp DESC, note_id LIMIT 50"
)
def _(v):
    return plain(dashboards.recent(audit.add_notes(notes(v), AS_OF)[0], "created_timestamp", 50, "note_id"))


@query(
    "dsh9_recent_tasks", f"WITH {TASKS} SELECT * FROM tasks ORDER BY created_timestamp DESC, task_id LIMIT 50"
)
def _(v):
    return plain(dashboards.recent(audit.assign_tasks(tasks(v), AS_OF)[0], "created_timestamp", 50, "task_id"))


@query(
    "dsh9_recent_audit",
    f"""WITH {REQUESTS}, audit AS (SELECT CAST(claim_id AS VARCHAR) || '_' || new_status || '_' || strftime(requested_at, '%Y%m%d%H%M%S') AS audit_id,
claim_id, new_status, {instant('requested_at', 'update_timestamp')} FROM valid)
SELECT * FROM audit ORDER BY update_timestamp DESC, audit_id LIMIT 50""",
)
def _(v):
    log = audit.apply_status(v.claims, requests(v))[1]
    newest = dashboards.recent(log, "update_timestamp", 50, "audit_id")
    return plain(newest.select("audit_id", "claim_id", "new_status", "update_timestamp"))


@query("dsh9_recent_audit_from_log", ORACLES["dsh9_recent_audit"])
def _(v):
    root = work_dir(v.spark, "audit")
    store.append_log(audit.apply_status(v.claims, requests(v))[1], root, "audit", "update_timestamp", "year")
    newest = dashboards.recent(store.load_newest(v.spark, root, "audit", 50), "update_timestamp", 50, "audit_id")
    return plain(newest.select("audit_id", "claim_id", "new_status", "update_timestamp"))


@query("dsh8_recent_notes_from_log", ORACLES["dsh8_recent_notes"])
def _(v):
    root = work_dir(v.spark, "notes")
    store.append_log(audit.add_notes(notes(v), AS_OF)[0], root, "notes", "created_timestamp")
    live = store.load_newest(v.spark, root, "notes", 50, ~F.col("is_deleted"))
    return plain(dashboards.recent(live, "created_timestamp", 50, "note_id"))


@query(
    "dsh10_status_split",
    f"""WITH {KPIS} SELECT 'status' AS chart, 'Approved' AS category, approved_count AS claim_count FROM kpis
UNION ALL SELECT 'status', 'Denied', denied_count FROM kpis UNION ALL SELECT 'status', 'Pending', pending_count FROM kpis
UNION ALL SELECT 'validity', 'Valid Claims', total_claims-fraud_count FROM kpis
UNION ALL SELECT 'validity', 'Fraudulent Claims', fraud_count FROM kpis""",
)
def _(v):
    return dashboards.status_split(dashboards.kpis(v.claims))
