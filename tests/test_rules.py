import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from builders import claims, column, people, policies
from caseflow.operators import adjudicate, investigate, silver

FEATURES = "claim_id int, rapid_filing int, claim_to_limit_ratio double, has_prior_fraud int, total_claims_count int, days_to_file int"


def test_rule_risk_levels(spark):
    rows = [(1, 0, 0.9, 0, 5, 60), (2, 0, 0.91, 0, 6, 10), (3, 1, 0.5, 1, 6, 0), (4, 1, 0.91, 1, 0, 0),
            (5, 1, 0.91, 1, 6, 0), (6, 0, None, 0, None, None), (7, 0, 1.0, 1, 6, 61)]
    df = investigate.rule_risk(spark.createDataFrame(rows, FEATURES))
    assert column(df, "fraud_risk_score") == {1: 0.0, 2: 0.3, 3: 0.5, 4: 0.6, 5: 0.7, 6: 0.0, 7: 0.65}
    assert column(df, "risk_level") == {1: "Low", 2: "Medium", 3: "Medium", 4: "High", 5: "High", 6: "Low", 7: "High"}
    assert column(df, "risk_factors")[7] == [
        "Claim amount is 100.0% of policy limit", "Claimant has prior fraud history", "Claimant has 6 total claims",
        "Filed 61 days after incident"]
    assert column(df, "risk_factors")[1] == []


def test_percentages_round_the_exact_value(spark):
    # 99.25 and 384.75 are halves; 209.15 and 289.45 lie below and above the double nearest to them.
    ratios = [198500.0 / 200000, 384750.0 / 100000, 209150.0 / 100000, 289450.0 / 100000, 12345650.0 / 1000, 0.90125]
    df = investigate.rule_risk(spark.createDataFrame([(i, 0, r, 0, 0, 0) for i, r in enumerate(ratios)], FEATURES))
    assert column(df, "risk_factors") == {i: [f"Claim amount is {r * 100:.1f}% of policy limit"] for i, r in enumerate(ratios)}


def test_no_score_reaches_the_deny_threshold(spark):
    """Filing within a day and after sixty days exclude each other, so 0.7 is the highest score."""
    rows = [(i, i % 2, 2.0 if i // 2 % 2 else 0.0, i // 4 % 2, 6 if i // 8 % 2 else 0, 0 if i % 2 else 61) for i in range(16)]
    reviewed = adjudicate.review_fraud(investigate.rule_risk(spark.createDataFrame(rows, FEATURES)))
    assert reviewed.agg(F.max("fraud_risk_score")).first()[0] == 0.7
    assert reviewed.filter("fraud_verdict = 'DENY'").isEmpty()


def test_fraud_review_texts(spark):
    rows = [(1, 0.71, ["a", "b", "c", "d"]), (2, 0.7, []), (3, 0.5, []), (4, 0.51, [])]
    df = adjudicate.review_fraud(spark.createDataFrame(rows, "claim_id int, fraud_risk_score double, risk_factors array<string>"))
    assert column(df, "fraud_verdict") == {1: "DENY", 2: "INVESTIGATE", 3: "APPROVE", 4: "INVESTIGATE"}
    assert column(df, "fraud_rationale")[1] == "High fraud risk (score: 0.71). a, b, c"


def test_policy_checks(spark):
    terms = policies(
        spark, {}, dict(policy_id=11, start_date=None), dict(policy_id=12, policy_limit=0.0), dict(policy_id=13, deductible=None),
        dict(policy_id=14, policy_limit=999.99), dict(policy_id=15, deductible=1000.01), dict(policy_id=16, end_date=dt.date(2000, 1, 9)),
        dict(policy_id=17, start_date=dt.date(2000, 1, 10), end_date=dt.date(2000, 1, 10)))
    data = claims(spark, *[dict(claim_id=i, policy_id=i) for i in (10, 11, 12, 13, 14, 15, 16, 17, 99)])
    df = investigate.verify_policy(data, terms)
    statuses = {k: [c.status for c in v] for k, v in column(df, "validations").items()}
    assert statuses == {
        10: ["PASS"] * 3, 11: ["WARN", "PASS", "PASS"], 12: ["PASS", "WARN", "PASS"], 13: ["PASS", "PASS", "WARN"],
        14: ["PASS", "WARN", "PASS"], 15: ["PASS", "PASS", "WARN"], 16: ["FAIL", "PASS", "PASS"], 17: ["PASS"] * 3, 99: []}
    assert column(df, "policy_valid") == {**dict.fromkeys((10, 11, 12, 13, 14, 15, 17), True), 16: False, 99: False}
    messages = {k: [c.message for c in v] for k, v in column(df, "validations").items()}
    assert messages[14][1] == "Claim $1,000.00 exceeds limit $999.99"
    assert messages[15][2] == "Claim $1,000.00 below $1,000.01 deductible"
    assert messages[16][0] == "Incident date 2000-01-10 outside policy period 1999-06-01 to 2000-01-09"
    legal = column(adjudicate.review_legal(df), "legal_verdict")
    assert legal[16] == "DENY" and column(adjudicate.review_legal(df), "legal_rationale")[16].endswith("2000-01-09")
    assert legal[11] == "REVIEW" and legal[99] == "APPROVE"


def test_medical_review(spark):
    # 99285 usually costs 800 to 2000.
    amounts = {1: 3000.0, 2: 3000.01, 3: 400.0, 4: 399.99}
    rows = [dict(claim_id=k, claim_type="Health", procedure_code="99285", claim_amount=a) for k, a in amounts.items()]
    rows += [dict(claim_id=5, claim_type="Workers Comp", procedure_code="00000"), dict(claim_id=6, procedure_code="99285")]
    df = adjudicate.review_medical(investigate.medical_lookup(claims(spark, *rows)))
    assert column(df, "medical_verdict") == {
        1: "APPROVE", 2: "INVESTIGATE", 3: "APPROVE", 4: "REVIEW", 5: "REVIEW", 6: "N/A"}
    assert column(df, "medical_rationale")[2] == "Claim amount $3,000.01 significantly exceeds typical range $800.00-$2,000.00"


def test_financial_review(spark):
    rows = [(1, 90.0, 100.0, 90.0, 90.0), (2, 90.01, 100.0, 90.0, 90.0), (3, 30.0, 100.0, 30.0, 9.99), (4, 30.0, 100.0, 30.0, 10.0),
            (5, 10.0, 100.0, 200.0, 10.0), (6, 10.0, 100.0, 200.01, 10.0), (7, 10.0, None, 10.0, 10.0), (8, 0.0, 0.0, 0.0, 0.0)]
    df = adjudicate.review_financial(
        spark.createDataFrame(rows, "claim_id int, claim_amount double, policy_limit double, total_claimed_amount double, avg_claim_amount double"))
    assert column(df, "financial_verdict") == {
        1: "APPROVE", 2: "INVESTIGATE", 3: "REVIEW", 4: "APPROVE", 5: "APPROVE", 6: "INVESTIGATE", 7: "INVESTIGATE", 8: "APPROVE"}
    assert column(df, "recommended_reserve")[1] == 99.0


def _vote(spark, fraud, legal, financial, medical=None, priority="normal", confidence=0.8):
    """Verdict on one claim; without a medical verdict the claim is not a medical one."""
    kind = "Auto" if medical in (None, "N/A") else "Health"
    row = (1, priority, kind, fraud, legal, financial, medical or "N/A", *[confidence] * 4)
    schema = (
        "claim_id int, priority string, claim_type string, fraud_verdict string, legal_verdict string, financial_verdict string, "
        "medical_verdict string, fraud_confidence double, legal_confidence double, financial_confidence double, medical_confidence double"
    )
    return adjudicate.decide(adjudicate.route(spark.createDataFrame([row], schema), priority)).first()


@pytest.mark.parametrize(
    "verdicts, priority, expected",
    [
        (["DENY", "APPROVE", "APPROVE"], "normal", "DENY"),
        (["APPROVE", "INVESTIGATE", "INVESTIGATE"], "normal", "INVESTIGATE"),
        (["INVESTIGATE", "APPROVE", "APPROVE"], "normal", "APPROVE"),
        (["INVESTIGATE", "APPROVE", "APPROVE"], "high", "INVESTIGATE"),
        (["INVESTIGATE", "APPROVE", "APPROVE", "N/A"], "critical", "INVESTIGATE"),
        (["REVIEW", "INVESTIGATE", "APPROVE"], "normal", "REVIEW"),
        (["APPROVE", "REVIEW", "APPROVE", "REVIEW"], "normal", "APPROVE"),
        (["APPROVE", "REVIEW", "INVESTIGATE", "REVIEW"], "normal", "REVIEW"),
        (["APPROVE", "APPROVE", "INVESTIGATE", "INVESTIGATE"], "low", "INVESTIGATE"),
        (["N/A", "N/A", "N/A", "N/A"], "normal", "APPROVE"),
    ],
)
def test_vote(spark, verdicts, priority, expected):
    row = _vote(spark, *verdicts, priority=priority)
    assert row.final_recommendation == expected
    counted = [v for v in verdicts if v != "N/A"]
    assert row.deny_votes + row.investigate_votes + row.review_votes + row.approve_votes == len(counted)
    assert row.confidence == (0.8 if counted else 0.5)
    assert len(row.next_actions) == 3


def test_vote_names_the_denying_reviewers(spark):
    row = _vote(spark, "DENY", "DENY", "APPROVE")
    assert row.rationale == "Denial recommended by Fraud Detection Agent, Legal Compliance Agent"


def test_urgent_cases_go_to_all_reviewers(spark):
    data = claims(spark, dict(claim_id=1), dict(claim_id=2, claim_type="Health"))
    built = silver.build(data, policies(spark), people(spark))
    normal = adjudicate.decide(adjudicate.reviewed(built))
    urgent = adjudicate.decide(adjudicate.reviewed(built, "critical"))
    assert column(normal, "agent_count") == {1: 3, 2: 4} and column(urgent, "agent_count") == {1: 4, 2: 4}
    listed = urgent.filter("claim_id = 1").select(adjudicate.reviews().alias("reviews")).first().reviews
    assert [r.agent.split()[0] for r in listed] == ["Fraud", "Legal", "Medical", "Financial"]
    assert listed[2].recommendation == "N/A"
    assert adjudicate.reviews_long(adjudicate.reviewed(built)).count() == 7


def test_payment_history_takes_the_latest(spark):
    data = claims(spark, *[dict(claim_id=i, filing_date=dt.date(2000, 1, 1 + i)) for i in range(7)], dict(claim_id=50, claimant_id=5, is_fraud=True))
    rows = {r.claimant_id: r for r in investigate.payment_history(data).collect()}
    assert [c.claim_id for c in rows[100].recent_claims] == [6, 5, 4, 3, 2]
    assert rows[100].risk_pattern == "Medium - Frequent claimant"
    assert rows[5].risk_pattern == "High - Prior fraud detected"
    assert investigate.payment_history(data.limit(0)).isEmpty()


def test_keyword_search_scores(spark):
    data = claims(spark, *[dict(claim_id=i, description="slip" if i else "slip water") for i in range(9)])
    rows = investigate.keyword_search(data, "water slip floor damage", k=7).orderBy("similarity_score").collect()
    assert [r.similarity_score for r in rows] == [0.45, 0.45, 0.53, 0.61, 0.69, 0.77, 0.85]
    assert rows[-1].claim_id == 0


def test_claims_without_type_need_no_medical_review(spark):
    data = claims(spark, dict(claim_id=1, claim_type=None), dict(claim_id=2, claim_type="Health"))
    table = silver.build(data, policies(spark))
    for priority in ("normal", "critical"):
        decided = adjudicate.decide(adjudicate.reviewed(table, priority=priority))
        assert column(decided, "medical_verdict") == {1: "N/A", 2: "REVIEW"}
        assert column(decided, "agent_count") == {1: 3 if priority == "normal" else 4, 2: 4}
        assert column(decided, "review_votes")[1] == column(decided, "review_votes")[2] - 1


def test_an_empty_policy_is_found(spark):
    blank = policies(
        spark, dict(policy_id=10, provider=None, policy_limit=None, deductible=None, premium_annual=None, start_date=None, end_date=None))
    checked = investigate.verify_policy(claims(spark, dict(claim_id=1), dict(claim_id=2, policy_id=99)), blank)
    assert column(checked, "policy_found") == {1: True, 2: False}
    assert column(checked, "period_status") == {1: "WARN", 2: None}


def test_payment_history_of_unknown_claimants(spark):
    rows = [dict(claim_id=i, claimant_id=None if i < 7 else 5, filing_date=dt.date(2000, 1, i)) for i in range(1, 9)]
    history = {r.claimant_id: r for r in investigate.payment_history(claims(spark, *rows)).collect()}
    assert [c.claim_id for c in history[None].recent_claims] == [6, 5, 4, 3, 2] and history[None].total_claims == 6
    assert [c.claim_id for c in history[5].recent_claims] == [8, 7]


def test_the_log_holds_every_analysis(spark):
    table = silver.build(claims(spark, dict(claim_id=1, claim_type="Health", procedure_code="72148")), policies(spark))
    log = adjudicate.investigation_log(adjudicate.decide(adjudicate.reviewed(table)), "2024-01-01").first()
    answers = {a["agent"]: a["analysis"] for a in json.loads(log.investigation_json)["agent_responses"]}
    assert answers[adjudicate.FRAUD]["claimant_history"]["total_claims"] == 1 and "risk_level" in answers[adjudicate.FRAUD]
    assert len(answers[adjudicate.LEGAL]["validations"]) == 3 and answers[adjudicate.LEGAL]["policy_valid"] is True
    assert answers[adjudicate.MEDICAL]["procedure"]["code"] == "72148" and "recommended_reserve" not in answers[adjudicate.MEDICAL]
    assert answers[adjudicate.FINANCIAL]["recommended_reserve"] == 1100.0
