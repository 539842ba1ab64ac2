"""Investigation, adjudication and audited writes (INV, ADJ, WRT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import adjudicate, audit, investigate, similarity, text_index
from caseflow.plans.base import (
    AS_OF,
    CLAIMS,
    CPT,
    ENRICHED,
    ICD,
    POLICIES,
    RISK,
    MIXED_VOTES,
    ORACLES,
    VOTES,
    cents,
    day,
    instant,
    num,
    plain,
    query,
    rounded,
)
from caseflow.session import work_dir


@query(
    "inv1_claim_details",
    f"""WITH {ENRICHED} SELECT claim_id, claimant_id, coalesce(full_name,'N/A') AS claimant_name, coalesce(address_state,'N/A') AS state,
policy_id, coalesce(insurance_provider,'N/A') AS provider, {num('coalesce(policy_limit,0)', 'policy_limit')},
{num('coalesce(deductible,0)', 'deductible')}, claim_type, {num('claim_amount')}, {day('incident_date')}, {day('filing_date')},
status, description, diagnosis_code, procedure_code FROM enriched""",
)
def _(v):
    record = investigate.claim_details(v.enriched)
    return plain(
        record.select(
            "claim_id",
            F.col("claimant.id").alias("claimant_id"),
            F.col("claimant.name").alias("claimant_name"),
            F.col("claimant.state").alias("state"),
            F.col("policy.id").alias("policy_id"),
            F.col("policy.provider").alias("provider"),
            F.col("policy.limit").alias("policy_limit"),
            F.col("policy.deductible").alias("deductible"),
            F.col("claim.type").alias("claim_type"),
            F.col("claim.amount").alias("claim_amount"),
            "claim.incident_date",
            "claim.filing_date",
            "claim.status",
            "claim.description",
            "medical.*",
        )
    )


@query(
    "inv2_rule_risk",
    f"""WITH {RISK} SELECT claim_id, {num('fraud_risk_score')},
CASE WHEN fraud_risk_score<0.3 THEN 'Low' WHEN fraud_risk_score<0.6 THEN 'Medium' ELSE 'High' END AS risk_level,
CASE WHEN fraud_risk_score<0.3 THEN 'Approve' WHEN fraud_risk_score<0.6 THEN 'Review' ELSE 'Investigate' END AS recommendation,
{num('0.85', 'confidence')}, 'rule_based_v1' AS model_version, concat_ws('; ',
CASE WHEN rapid_filing=1 THEN 'Filed within 24 hours of incident' END,
CASE WHEN claim_to_limit_ratio>0.9 THEN 'Claim amount is ' || printf('%.1f', claim_to_limit_ratio*100) || '% of policy limit' END,
CASE WHEN has_prior_fraud=1 THEN 'Claimant has prior fraud history' END,
CASE WHEN total_claims_count>5 THEN 'Claimant has ' || total_claims_count || ' total claims' END,
CASE WHEN days_to_file>60 THEN 'Filed ' || days_to_file || ' days after incident' END) AS risk_factors FROM risk""",
)
def _(v):
    scored = investigate.rule_risk(v.features).withColumn("risk_factors", F.array_join("risk_factors", "; "))
    wanted = "claim_id fraud_risk_score risk_level recommendation confidence model_version risk_factors".split()
    return plain(scored.select(*wanted))


def _money(column: str) -> str:
    return "'$' || format('{:,.2f}', " + column + ")"


CHECKS = f"""{CLAIMS}, {POLICIES}, joined AS (SELECT c.claim_id, c.policy_id, c.incident_date, c.claim_amount, p.* EXCLUDE (policy_id, claimant_id),
p.policy_id IS NOT NULL AS policy_found FROM claims c LEFT JOIN policies p ON c.policy_id=p.policy_id), checks AS (
SELECT *, CASE WHEN incident_date<start_date OR incident_date>end_date THEN 'FAIL' ELSE 'PASS' END AS period_status,
CASE WHEN incident_date<start_date OR incident_date>end_date THEN 'Incident date ' || incident_date || ' outside policy period '
 || start_date || ' to ' || end_date ELSE 'Policy was active' END AS period_message,
CASE WHEN claim_amount>policy_limit THEN 'WARN' ELSE 'PASS' END AS limit_status,
CASE WHEN claim_amount>policy_limit THEN 'Claim ' || {_money('claim_amount')} || ' exceeds limit ' || {_money('policy_limit')}
 ELSE 'Claim within ' || {_money('policy_limit')} || ' limit' END AS limit_message,
CASE WHEN deductible=0 OR claim_amount<deductible THEN 'WARN' ELSE 'PASS' END AS deductible_status,
CASE WHEN deductible=0 THEN 'Deductible not available for validation' WHEN claim_amount<deductible
 THEN 'Claim ' || {_money('claim_amount')} || ' below ' || {_money('deductible')} || ' deductible'
 ELSE 'Exceeds ' || {_money('deductible')} || ' deductible' END AS deductible_message FROM joined)"""


@query(
    "inv3_verify_policy",
    f"""WITH {CHECKS} SELECT claim_id, policy_id, policy_found, policy_found AND period_status<>'FAIL' AS policy_valid,
coalesce(provider,'N/A') AS provider, coalesce(policy_type,'N/A') AS policy_type, coalesce(status,'N/A') AS policy_status,
CASE WHEN policy_found THEN period_status || ': ' || period_message || '; ' || limit_status || ': ' || limit_message || '; '
 || deductible_status || ': ' || deductible_message ELSE '' END AS validations FROM checks""",
)
def _(v):
    checked = investigate.verify_policy(v.claims, v.policies)
    texts = F.transform("validations", lambda c: F.concat(c["status"], F.lit(": "), c["message"]))
    return checked.select(
        "claim_id",
        "policy_id",
        "policy_found",
        "policy_valid",
        F.col("policy_details.provider").alias("provider"),
        F.col("policy_details.type").alias("policy_type"),
        F.col("policy_details.status").alias("policy_status"),
        F.array_join(texts, "; ").alias("validations"),
    )


@query(
    "inv4_medical_lookup",
    f"""WITH {CLAIMS}, {ICD}, {CPT} SELECT claim_id, diagnosis_code, procedure_code,
CASE WHEN diagnosis_code IS NOT NULL THEN coalesce(icd.description,'Code not in database') END AS diagnosis_description,
icd.category AS diagnosis_category, icd.severity AS diagnosis_severity,
CASE WHEN diagnosis_code IS NOT NULL AND icd.code IS NULL THEN 'Verify code validity' END AS diagnosis_note,
CASE WHEN procedure_code IS NOT NULL THEN coalesce(cpt.description,'Code not in database') END AS procedure_description,
CASE WHEN procedure_code IS NOT NULL AND cpt.code IS NULL THEN 'Verify code validity' END AS procedure_note,
{num('cost_min', 'procedure_cost_min')}, {num('cost_max', 'procedure_cost_max')}, {num('(cost_min+cost_max)/2', 'procedure_cost_avg')}
FROM claims LEFT JOIN icd ON diagnosis_code=icd.code LEFT JOIN cpt ON procedure_code=cpt.code""",
)
def _(v):
    wanted = (
        "claim_id diagnosis_code procedure_code diagnosis_description diagnosis_category diagnosis_severity diagnosis_note "
        "procedure_description procedure_note procedure_cost_min procedure_cost_max procedure_cost_avg"
    ).split()
    return plain(investigate.medical_lookup(v.claims).select(*wanted))


@query(
    "inv5_payment_history",
    f"""WITH {CLAIMS}, totals AS (SELECT claimant_id, count(*) AS total_claims, sum(claim_amount) AS total_claimed,
avg(claim_amount) AS average_claim, count(*) FILTER (WHERE is_fraud) AS fraud_count FROM claims GROUP BY claimant_id),
ranked AS (SELECT claimant_id, claim_id, row_number() OVER (PARTITION BY claimant_id ORDER BY filing_date DESC, claim_id) AS position FROM claims),
recent AS (SELECT claimant_id, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY position) AS recent_claims FROM ranked WHERE position<=5 GROUP BY claimant_id)
SELECT totals.claimant_id, total_claims, {num('total_claimed')}, {num(cents('average_claim'), 'average_claim')}, fraud_count,
CASE WHEN fraud_count>0 THEN 'High - Prior fraud detected' WHEN total_claims>5 THEN 'Medium - Frequent claimant'
ELSE 'Low - Normal history' END AS risk_pattern, recent_claims FROM totals JOIN recent ON totals.claimant_id=recent.claimant_id""",
)
def _(v):
    history = investigate.payment_history(v.claims)
    ids = F.array_join(F.transform("recent_claims", lambda c: c["claim_id"].cast("string")), ",")
    return plain(history.withColumn("recent_claims", ids))


@query(
    "inv6_keyword_search",
    f"""WITH {CLAIMS}, hits AS (SELECT claim_id, description, status, is_fraud, CAST(contains(lower(description),'slip') AS INT)
+CAST(contains(lower(description),'water') AS INT)+CAST(contains(lower(description),'damage') AS INT) AS matched_words FROM claims),
top AS (SELECT *, row_number() OVER (ORDER BY matched_words DESC, claim_id) AS position FROM hits WHERE matched_words>0
ORDER BY matched_words DESC, claim_id LIMIT 5)
SELECT claim_id, description, status, is_fraud, matched_words, {num('round(greatest(0.45e0, 0.85e0-0.08e0*(position-1)), 2)', 'similarity_score')} FROM top""",
)
def _(v):
    found = investigate.keyword_search(v.claims, "Slip WATER damage on floor", k=5)
    return plain(found.select("claim_id", "description", "status", "is_fraud", "matched_words", "similarity_score"))


@query(
    "inv6_keyword_search_documents",
    f"""WITH hits AS (SELECT doc_id, CAST(contains(lower(text),'the') AS INT)+CAST(contains(lower(text),'eau') AS INT)
+CAST(contains(lower(text),'ing') AS INT) AS matched_words FROM documents), top AS (
SELECT *, row_number() OVER (ORDER BY matched_words DESC, doc_id) AS position FROM hits WHERE matched_words>0
ORDER BY matched_words DESC, doc_id LIMIT 20)
SELECT doc_id, matched_words, {num('round(greatest(0.45e0, 0.85e0-0.08e0*(position-1)), 2)', 'similarity_score')} FROM top""",
)
def _(v):
    found = investigate.keyword_search(v.table("documents"), "the eau ing", k=20, column="text", key="doc_id")
    return plain(found.select("doc_id", "matched_words", "similarity_score"))


@query("inv6_keyword_search_indexed", ORACLES["inv6_keyword_search_documents"])
def _(v):
    root, documents = work_dir(v.spark, "inv6"), v.table("documents")
    text_index.build(documents, root, "documents", "doc_id", F.col("text"))
    found = text_index.keyword_search(documents, root, "documents", "the eau ing", k=20, column="text", key="doc_id")
    return plain(found.select("doc_id", "matched_words", "similarity_score"))


def _similar(v):
    vectors = v.table("embeddings").select(
        F.col("vec_id").alias("claim_id"), "embedding", (F.col("label") == 0).alias("is_fraud")
    )
    return similarity.similar_fraud(vectors)


def _review(kind):
    return [
        F.col(f"{kind}_verdict").alias("recommendation"),
        F.col(f"{kind}_confidence").alias("confidence"),
        F.col(f"{kind}_rationale").alias("rationale"),
    ]


SHOWN_SCORE = "printf('%.2f', fraud_risk_score)"
PAIRS = """pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS claim_id, b.label,
round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 10) AS score
FROM embeddings a, embeddings b), near AS (SELECT * FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) <= 5), similar_claims AS (
SELECT query_id AS claim_id, count(*) FILTER (WHERE label=0) AS similar_fraud_count, count(*) AS total_similar_claims
FROM near GROUP BY query_id)"""


@query(
    "adj1_fraud_review",
    f"""WITH {VOTES}, {PAIRS} SELECT w.claim_id, fraud_verdict AS recommendation, {num('fraud_confidence', 'confidence')},
CASE fraud_verdict WHEN 'INVESTIGATE' THEN 'Medium fraud risk (score: ' || {SHOWN_SCORE} || '). Further investigation recommended.'
ELSE 'Low fraud risk (score: ' || {SHOWN_SCORE} || '). Claim appears legitimate.' END AS rationale,
coalesce(similar_fraud_count, 0) AS similar_fraud_count, coalesce(total_similar_claims, 0) AS total_similar_claims
FROM weighed w LEFT JOIN similar_claims s ON w.claim_id=s.claim_id""",
)
def _(v):
    reviewed = adjudicate.review_fraud(investigate.rule_risk(v.features), _similar(v))
    return plain(
        reviewed.select(
            "claim_id",
            *_review("fraud"),
            "similar_fraud_count",
            "total_similar_claims",
        )
    )


@query(
    "adj2_legal_review",
    f"""WITH {CHECKS} SELECT claim_id, policy_found,
CASE WHEN policy_found AND period_status='FAIL' THEN 'DENY' WHEN policy_found AND 'WARN' IN (limit_status, deductible_status) THEN 'REVIEW'
 ELSE 'APPROVE' END AS recommendation,
{num("CASE WHEN policy_found AND period_status='FAIL' THEN 0.95 WHEN policy_found AND 'WARN' IN (limit_status, deductible_status) THEN 0.7 ELSE 0.9 END", 'confidence')},
CASE WHEN policy_found AND period_status='FAIL' THEN 'Policy validation failed: ' || period_message
 WHEN policy_found AND limit_status='WARN' THEN 'Policy warnings detected: ' || limit_message
 WHEN policy_found AND deductible_status='WARN' THEN 'Policy warnings detected: ' || deductible_message
 ELSE 'All policy validations passed. Claim compliant with policy terms.' END AS rationale FROM checks""",
)
def _(v):
    reviewed = adjudicate.review_legal(investigate.verify_policy(v.claims, v.policies))
    return plain(
        reviewed.select(
            "claim_id", "policy_found", *_review("legal")
        )
    )


@query(
    "adj3_medical_review",
    f"""WITH {VOTES} SELECT claim_id, medical_verdict AS recommendation, {num('medical_confidence', 'confidence')},
CASE WHEN medical_verdict='N/A' THEN 'Not a medical claim - no medical review required.'
 WHEN cost_max IS NULL THEN 'Medical codes not in database - manual review recommended.'
 WHEN medical_verdict='INVESTIGATE' THEN 'Claim amount ' || {_money('claim_amount')} || ' significantly exceeds typical range '
  || {_money('cost_min')} || '-' || {_money('cost_max')}
 WHEN medical_verdict='REVIEW' THEN 'Claim amount unusually low for procedure ' || procedure_code
 ELSE 'Medical codes valid and claim amount within expected range.' END AS rationale FROM weighed""",
)
def _(v):
    reviewed = adjudicate.review_medical(investigate.medical_lookup(v.claims))
    return plain(
        reviewed.select("claim_id", *_review("medical"))
    )


FINANCIAL_TEXT = f"""CASE WHEN exposure>0.9 THEN 'Claim represents ' || format('{{:.1f}}', exposure*100) || '% of policy limit - high financial exposure'
WHEN financial_verdict='REVIEW' THEN 'Claim ' || {_money('claim_amount')} || ' is 3x claimant''s average ' || {_money('average_claim')}
WHEN financial_verdict='INVESTIGATE' THEN 'Claimant''s lifetime claims ' || {_money('total_claimed')} || ' exceed 2x policy limit'
ELSE 'Financial metrics within acceptable parameters.' END"""


@query(
    "adj4_financial_review",
    f"""WITH {VOTES} SELECT claim_id, financial_verdict AS recommendation, {num('financial_confidence', 'confidence')}, {FINANCIAL_TEXT} AS rationale,
{num(rounded('exposure', 4), 'exposure_ratio')}, {num(cents('claim_amount*1.1e0'), 'recommended_reserve')} FROM weighed""",
)
def _(v):
    reviewed = adjudicate.review_financial(v.cases)
    return plain(reviewed.select("claim_id", *_review("financial"), "exposure_ratio", "recommended_reserve"))


def _priority(column="status"):
    return F.when(F.col(column) == "Under Investigation", "critical").otherwise("normal")


@query(
    "adj5_route",
    f"""WITH {CLAIMS}, routed AS (SELECT claim_id, CASE WHEN status='Under Investigation' THEN 'critical' ELSE 'normal' END AS priority,
claim_type IN ('Health','Workers Comp') AS medical FROM claims)
SELECT claim_id, priority, unnest(CASE WHEN priority='critical' THEN ['fraud','legal','medical','financial']
WHEN medical THEN ['fraud','legal','financial','medical'] ELSE ['fraud','legal','financial'] END) AS reviewer FROM routed""",
)
def _(v):
    routed = adjudicate.route(v.claims, _priority())
    return routed.select("claim_id", "priority", F.explode("reviewers").alias("reviewer"))


# The reviews' texts: each reviewer's own query checks every case of its rationale.
MEDICAL_TEXT = f"""CASE WHEN medical_verdict='N/A' THEN 'Not a medical claim - no medical review required.'
 WHEN cost_max IS NULL THEN 'Medical codes not in database - manual review recommended.'
 WHEN medical_verdict='INVESTIGATE' THEN 'Claim amount ' || {_money('claim_amount')} || ' significantly exceeds typical range '
  || {_money('cost_min')} || '-' || {_money('cost_max')}
 WHEN medical_verdict='REVIEW' THEN 'Claim amount unusually low for procedure ' || procedure_code
 ELSE 'Medical codes valid and claim amount within expected range.' END"""
LONG = f"""SELECT r.claim_id, CASE WHEN urgent THEN 'critical' ELSE 'normal' END AS priority, agent, recommendation, {num('r.confidence', 'confidence')},
CASE agent WHEN 'Financial Analysis Agent' THEN {FINANCIAL_TEXT} WHEN 'Medical Review Agent' THEN {MEDICAL_TEXT}
 ELSE split_part(agent, ' ', 1) END AS rationale
FROM reviews r JOIN weighed w ON r.claim_id=w.claim_id"""


def _long(reviews):
    # Fraud and legal texts are checked by adj1 and adj2.
    text = F.when(F.col("agent").isin(adjudicate.FINANCIAL, adjudicate.MEDICAL), F.col("rationale"))
    return plain(
        reviews.select(
            "claim_id", "priority", "agent", "recommendation", "confidence",
            F.coalesce(text, F.substring_index("agent", " ", 1)).alias("rationale"),
        )
    )


@query("adj5_reviews_long", f"WITH {VOTES} {LONG}")
def _(v):
    return _long(adjudicate.reviews_long(adjudicate.reviewed(v.cases)))


@query("adj5_reviews_mixed_priority", f"WITH {MIXED_VOTES} {LONG}")
def _(v):
    return _long(adjudicate.reviews_long(adjudicate.reviewed(v.cases, _priority())))


RATIONALE = """CASE final_recommendation WHEN 'DENY' THEN 'Denial recommended by Legal Compliance Agent'
WHEN 'INVESTIGATE' THEN 'Multiple agents flagged concerns requiring investigation'
WHEN 'REVIEW' THEN 'Mixed signals from agents - manual review recommended'
ELSE 'Majority of agents recommend approval with no major concerns' END AS rationale"""


DECISIONS = f"""SELECT claim_id, final_recommendation, {num('confidence')}, {RATIONALE},
CASE final_recommendation WHEN 'DENY' THEN 'Send denial letter|Document denial reason|Close claim'
WHEN 'INVESTIGATE' THEN 'Assign to senior adjuster|Request additional documentation|Conduct field investigation if needed'
WHEN 'REVIEW' THEN 'Senior adjuster review|Verify documentation|Contact claimant for clarification'
ELSE 'Process payment|Update claim status|Notify claimant of approval' END AS next_actions,
deny_votes, investigate_votes, review_votes, approve_votes, agent_count FROM decisions"""


def _decisions(decided):
    return plain(
        decided.select(
            "claim_id", "final_recommendation", "confidence", "rationale",
            F.array_join("next_actions", "|").alias("next_actions"),
            "deny_votes", "investigate_votes", "review_votes", "approve_votes", "agent_count",
        )
    )


@query("adj6_vote", f"WITH {VOTES} {DECISIONS}")
def _(v):
    return _decisions(adjudicate.decide(adjudicate.reviewed(v.cases)))


@query("adj6_vote_mixed_priority", f"WITH {MIXED_VOTES} {DECISIONS}")
def _(v):
    return _decisions(adjudicate.decide(adjudicate.reviewed(v.cases, _priority())))


AGENTS = """CASE WHEN urgent THEN 'Fraud Detection Agent, Legal Compliance Agent, Medical Review Agent, Financial Analysis Agent'
WHEN claim_type IN ('Health','Workers Comp') THEN 'Fraud Detection Agent, Legal Compliance Agent, Financial Analysis Agent, Medical Review Agent'
ELSE 'Fraud Detection Agent, Legal Compliance Agent, Financial Analysis Agent' END AS agents_consulted"""
# What the JSON says: the claim, the order of the answers, and a value of every reviewer's analysis.
LOG = f"""SELECT claim_id, {instant(f"'{AS_OF}'", 'investigation_timestamp')}, CASE WHEN urgent THEN 'critical' ELSE 'normal' END AS priority,
final_recommendation, {num('confidence')}, {RATIONALE}, agent_count, {AGENTS}, claim_type AS json_claim_type, legal_verdict AS json_legal_verdict,
{num('fraud_risk_score', 'json_risk_score')}, CAST(total_claims_count AS BIGINT) AS json_total_claims,
CASE WHEN policy_found THEN 3 ELSE 0 END AS json_checks, {num(cents('claim_amount*1.1e0'), 'json_reserve')},
CASE WHEN urgent OR claim_type IN ('Health','Workers Comp') THEN procedure_code END AS json_procedure, status AS json_status FROM decisions"""


def _log(decided, similar=False):
    log = adjudicate.investigation_log(decided, AS_OF)
    record = F.from_json(
        "investigation_json",
        "claim_data struct<claim_type:string,status:string>, agent_responses array<struct<agent:string,recommendation:string,"
        "analysis:struct<fraud_risk_score:double,similar_fraud_count:bigint,total_similar_claims:bigint,claimant_history:struct<total_claims:bigint>,"
        "validations:array<struct<check:string>>,recommended_reserve:double,procedure:struct<code:string>>>>",
    )

    def answer_of(agent):
        return F.get(F.filter("_record.agent_responses", lambda x: x["agent"] == agent), F.lit(0))

    answer = {name: answer_of(agent) for name, agent in adjudicate.REVIEWERS.items()}
    return plain(
        log.withColumn("_record", record)
        .withColumns(
            {
                "json_claim_type": F.col("_record.claim_data.claim_type"),
                "json_status": F.col("_record.claim_data.status"),
                "json_legal_verdict": answer["legal"]["recommendation"],
                "json_risk_score": answer["fraud"]["analysis"]["fraud_risk_score"],
                "json_total_claims": answer["fraud"]["analysis"]["claimant_history"]["total_claims"],
                "json_checks": F.size(answer["legal"]["analysis"]["validations"]),
                "json_reserve": answer["financial"]["analysis"]["recommended_reserve"],
                "json_procedure": answer["medical"]["analysis"]["procedure"]["code"],
                **(
                    {
                        "json_similar_fraud": answer["fraud"]["analysis"]["similar_fraud_count"],
                        "json_similar": answer["fraud"]["analysis"]["total_similar_claims"],
                    }
                    if similar
                    else {}
                ),
            }
        )
        .drop("investigation_json", "_record")
    )


@query("adj7_investigation_log", f"WITH {VOTES} {LOG}")
def _(v):
    return _log(adjudicate.decide(adjudicate.reviewed(v.cases)))


@query("adj7_log_mixed_priority", f"WITH {MIXED_VOTES} {LOG}")
def _(v):
    return _log(adjudicate.decide(adjudicate.reviewed(v.cases, _priority())))


@query(
    "adj7_log_with_similar_claims",
    f"""WITH {VOTES}, {PAIRS}, log AS ({LOG}) SELECT log.*, coalesce(similar_fraud_count, 0) AS json_similar_fraud,
coalesce(total_similar_claims, 0) AS json_similar FROM log LEFT JOIN similar_claims USING (claim_id)""",
)
def _(v):
    return _log(adjudicate.decide(adjudicate.reviewed(v.cases, similar=_similar(v))), similar=True)


# Every claim asks for a status by its present one; fraud claims ask again an hour later;
# liability claims ask under an id that does not exist.
REQUESTS = f"""{CLAIMS}, requests AS (
SELECT claim_id AS request_id, claim_id, CASE status WHEN 'Submitted' THEN 'Pending' WHEN 'Under Review' THEN 'Under Investigation'
 WHEN 'Approved' THEN 'Closed' WHEN 'Paid' THEN 'Archived' WHEN 'Under Investigation' THEN 'Escalated' ELSE status END AS new_status,
 CAST(filing_date AS TIMESTAMP) + INTERVAL 9 HOUR AS requested_at FROM claims
UNION ALL SELECT -claim_id-1, claim_id, 'Denied', CAST(filing_date AS TIMESTAMP) + INTERVAL 10 HOUR FROM claims WHERE is_fraud
UNION ALL SELECT 1000000000+claim_id, -claim_id-1, 'Approved', CAST(filing_date AS TIMESTAMP) + INTERVAL 9 HOUR FROM claims WHERE claim_type='Liability'),
valid AS (SELECT r.*, c.status AS current_status FROM requests r JOIN claims c ON r.claim_id=c.claim_id
WHERE new_status IN ('Pending','Under Investigation','Approved','Denied','Escalated','Closed'))"""


def requests(v):
    filed = F.col("filing_date").cast("timestamp")
    key = F.col("claim_id")
    status = F.col("status")
    wanted = (
        F.when(status == "Submitted", "Pending")
        .when(status == "Under Review", "Under Investigation")
        .when(status == "Approved", "Closed")
        .when(status == "Paid", "Archived")
        .when(status == "Under Investigation", "Escalated")
        .otherwise(status)
    )

    def request(df, request_id, claim_id, new_status, hours):
        return df.select(
            request_id.alias("request_id"),
            claim_id.alias("claim_id"),
            new_status.alias("new_status"),
            F.lit("review").alias("reason"),
            F.lit(None).cast("string").alias("updated_by"),
            (filed + F.expr(f"INTERVAL {hours} HOURS")).alias("requested_at"),
        )

    first = request(v.claims, key, key, wanted, 9)
    again = request(v.claims.filter("is_fraud"), -key - 1, key, F.lit("Denied"), 10)
    unknown = request(v.claims.filter("claim_type = 'Liability'"), key + 1000000000, -key - 1, F.lit("Approved"), 9)
    return first.unionByName(again).unionByName(unknown)


@query(
    "wrt1_status_claims",
    f"""WITH {REQUESTS}, last AS (SELECT claim_id, max_by(new_status, requested_at) AS new_status,
max(requested_at) AS asked FROM valid GROUP BY claim_id)
SELECT claims.claim_id, coalesce(new_status, status) AS status, {instant('asked', 'updated_at')} FROM claims LEFT JOIN last ON claims.claim_id=last.claim_id""",
)
def _(v):
    return plain(audit.apply_status(v.claims, requests(v))[0].select("claim_id", "status", "updated_at"))


@query(
    "wrt1_status_audit",
    f"""WITH {REQUESTS} SELECT CAST(claim_id AS VARCHAR) || '_' || new_status || '_' || strftime(requested_at, '%Y%m%d%H%M%S') AS audit_id,
claim_id, 'status_update' AS action_type,
coalesce(lag(new_status) OVER (PARTITION BY claim_id ORDER BY requested_at), current_status) AS previous_status, new_status,
'review' AS reason, 'ai_agent' AS updated_by, {instant('requested_at', 'update_timestamp')} FROM valid""",
)
def _(v):
    return plain(audit.apply_status(v.claims, requests(v))[1])


@query(
    "wrt1_status_rejected",
    f"""WITH {REQUESTS} SELECT request_id, r.claim_id, new_status,
CASE WHEN new_status='Archived' THEN 'Invalid status. Must be one of: Pending, Under Investigation, Approved, Denied, Escalated, Closed'
ELSE 'Claim ' || r.claim_id || ' not found' END AS message FROM requests r LEFT JOIN claims c ON r.claim_id=c.claim_id
WHERE c.claim_id IS NULL OR new_status='Archived'""",
)
def _(v):
    rejected = audit.apply_status(v.claims, requests(v))[2]
    return rejected.select("request_id", "claim_id", "new_status", "message")


def notes(v):
    note_type = (
        F.when(F.col("is_fraud"), "fraud_indicator")
        .when(F.col("status") == "Denied", "recommendation")
        .when(F.col("status") == "Paid", "rumour")
        .otherwise("general")
    )
    text = F.concat_ws(" - ", F.col("description"), F.col("description"), F.col("description"))
    return v.claims.select(
        F.col("claim_id").alias("request_id"),
        "claim_id",
        note_type.alias("note_type"),
        text.alias("note"),
        F.lit(None).cast("string").alias("author"),
    )


NOTES = f"""{CLAIMS}, requests AS (SELECT claim_id AS request_id, claim_id, CASE WHEN is_fraud THEN 'fraud_indicator'
WHEN status='Denied' THEN 'recommendation' WHEN status='Paid' THEN 'rumour' ELSE 'general' END AS note_type,
description || ' - ' || description || ' - ' || description AS note FROM claims), notes AS (
SELECT 'NOTE_' || upper(substr(md5(concat_ws('||', CAST(request_id AS VARCHAR), CAST(claim_id AS VARCHAR), note_type, note)), 1, 12)) AS note_id,
claim_id, note_type, note AS note_content, 'ai_agent' AS author, {instant(f"'{AS_OF}'", 'created_timestamp')}, false AS is_deleted,
CASE WHEN length(note)>100 THEN substr(note,1,100) || '...' ELSE note END AS note_preview FROM requests WHERE note_type<>'rumour')"""


@query("wrt2_add_notes", f"WITH {NOTES} SELECT * FROM notes")
def _(v):
    return plain(audit.add_notes(notes(v), AS_OF)[0])


@query(
    "wrt2_rejected_notes",
    f"""WITH {NOTES} SELECT claim_id, note_type,
'Invalid note_type. Must be one of: general, fraud_indicator, evidence, recommendation, follow_up' AS message
FROM requests WHERE note_type='rumour'""",
)
def _(v):
    return audit.add_notes(notes(v), AS_OF)[1].select("claim_id", "note_type", "message")


def tasks(v):
    priority = F.when(F.col("is_fraud"), "urgent").when(F.col("claim_amount") > 300000, "high").otherwise("medium")
    return v.claims.select(
        F.col("claim_id").alias("request_id"),
        "claim_id",
        F.concat(F.lit("Check: "), "description").alias("task_description"),
        F.concat(F.lit("team "), "claim_type").alias("assigned_to"),
        priority.alias("priority"),
    )


TASKS = f"""{CLAIMS}, tasks AS (SELECT 'TASK_' || upper(substr(md5(concat_ws('||', CAST(claim_id AS VARCHAR), CAST(claim_id AS VARCHAR),
'Check: ' || description)), 1, 12)) AS task_id, claim_id, 'Check: ' || description AS task_description, 'team ' || claim_type AS assigned_to,
CASE WHEN is_fraud THEN 'urgent' WHEN claim_amount>300000 THEN 'high' ELSE 'medium' END AS priority, 'Open' AS status,
{instant(f"'{AS_OF}'", 'created_timestamp')}, '2001-08-08' AS due_date, CAST(NULL AS VARCHAR) AS completed_timestamp,
'Check: ' || description AS task_preview FROM claims)"""


@query("wrt3_assign_tasks", f"WITH {TASKS} SELECT * FROM tasks")
def _(v):
    return plain(audit.assign_tasks(tasks(v), AS_OF)[0])


@query(
    "wrt3_rejected_tasks",
    f"""WITH {TASKS} SELECT claim_id, 'now' AS priority, 'Invalid priority. Must be one of: low, medium, high, urgent' AS message
FROM claims WHERE status='Paid'""",
)
def _(v):
    paid = v.claims.filter("status = 'Paid'").select("claim_id")
    asked = tasks(v).join(paid.withColumn("paid", F.lit(True)), "claim_id", "left")
    wrong = asked.withColumn("priority", F.when(F.col("paid"), "now").otherwise(F.col("priority"))).drop("paid")
    return audit.assign_tasks(wrong, AS_OF)[1].select("claim_id", "priority", "message")
