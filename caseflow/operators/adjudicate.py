"""Four rule reviewers and their vote, as columns on every claim (ADJ-*).

Input is the silver table: history totals and policy terms are already on the row, so the
whole adjudication adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.features import cents, flag, money, percent, ratio, rounded
from caseflow.operators import investigate
from caseflow.sources import dims

# Reviewer names as they appear in logs.
FRAUD = "Fraud Detection Agent"
LEGAL = "Legal Compliance Agent"
MEDICAL = "Medical Review Agent"
FINANCIAL = "Financial Analysis Agent"

# Rationale and next actions of each outcome.
DENY_ACTIONS = ["Send denial letter", "Document denial reason", "Close claim"]
INVESTIGATE_RATIONALE = "Multiple agents flagged concerns requiring investigation"
INVESTIGATE_ACTIONS = [
    "Assign to senior adjuster",
    "Request additional documentation",
    "Conduct field investigation if needed",
]
REVIEW_RATIONALE = "Mixed signals from agents - manual review recommended"
REVIEW_ACTIONS = ["Senior adjuster review", "Verify documentation", "Contact claimant for clarification"]
APPROVE_RATIONALE = "Majority of agents recommend approval with no major concerns"
APPROVE_ACTIONS = ["Process payment", "Update claim status", "Notify claimant of approval"]


REVIEWERS = {"fraud": FRAUD, "legal": LEGAL, "medical": MEDICAL, "financial": FINANCIAL}


def _medical() -> Column:
    """Claims that need a medical review; a claim without a type does not."""
    return F.coalesce(F.col("claim_type").isin(dims.MEDICAL_TYPES), F.lit(False))


def _judge(df: DataFrame, kind: str, branches: list[tuple], otherwise: tuple) -> DataFrame:
    """Columns ``kind``_verdict, _confidence and _rationale from the first branch that holds.

    A branch is (condition, verdict, confidence, rationale); ``otherwise`` has no condition.
    """

    def literal(value):
        return value if isinstance(value, Column) else F.lit(value)

    def chosen(part):
        case = F.when(branches[0][0], literal(branches[0][part]))
        for branch in branches[1:]:
            case = case.when(branch[0], literal(branch[part]))
        return case.otherwise(literal(otherwise[part - 1]))

    parts = ("verdict", "confidence", "rationale")
    return df.withColumns({f"{kind}_{name}": chosen(i) for i, name in enumerate(parts, start=1)})


# The rationale texts inside the four reviews are fixed values.


def review_fraud(df: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """ADJ-1: needs INV-2's columns. ``similar`` (claim_id, similar_fraud_count, ...) is reported, not judged."""
    score = F.col("fraud_risk_score")
    shown = F.format_string("%.2f", score)
    reasons = F.array_join(F.slice("risk_factors", 1, 3), ", ")
    judged = _judge(
        df,
        "fraud",
        [
            (score > 0.7, "DENY", 0.9, F.concat(F.lit("High fraud risk (score: "), shown, F.lit("). "), reasons)),
            (
                score > 0.5, "INVESTIGATE", 0.75,
                F.concat(F.lit("Medium fraud risk (score: "), shown, F.lit("). Further investigation recommended.")),
            ),
        ],
        ("APPROVE", 0.85, F.concat(F.lit("Low fraud risk (score: "), shown, F.lit("). Claim appears legitimate."))),
    )
    if similar is None:
        return judged
    return judged.join(similar, "claim_id", "left").fillna({c: 0 for c in similar.columns if c != "claim_id"})


def review_legal(df: DataFrame) -> DataFrame:
    """ADJ-2: needs the policy checks. Without a policy there are no checks, hence an approval."""
    checks = [(F.col(f"{name}_status"), F.col(f"{name}_message")) for name in investigate.CHECKS]

    def with_status(wanted):
        found = [flag(status == wanted) for status, _ in checks]
        return found[0] + found[1] + found[2]

    def first_message(wanted):
        return F.coalesce(*[F.when(status == wanted, message) for status, message in checks])

    counted = df.withColumns({"failed_checks": with_status("FAIL"), "warning_checks": with_status("WARN")})
    return _judge(
        counted,
        "legal",
        [
            (
                F.col("failed_checks") > 0, "DENY", 0.95,
                F.concat(F.lit("Policy validation failed: "), first_message("FAIL")),
            ),
            (
                F.col("warning_checks") > 0, "REVIEW", 0.7,
                F.concat(F.lit("Policy warnings detected: "), first_message("WARN")),
            ),
        ],
        ("APPROVE", 0.9, "All policy validations passed. Claim compliant with policy terms."),
    )


def review_medical(df: DataFrame) -> DataFrame:
    """ADJ-3: needs the code lookup; compares the amount with the usual cost of the procedure."""
    amount, low, high = F.col("claim_amount"), F.col("procedure_cost_min"), F.col("procedure_cost_max")
    return _judge(
        df,
        "medical",
        [
            (
                ~_medical(), "N/A", 1.0,
                "Not a medical claim - no medical review required.",
            ),
            (high.isNull(), "REVIEW", 0.5, "Medical codes not in database - manual review recommended."),
            (
                amount > high * 1.5, "INVESTIGATE", 0.7,
                F.concat(
                    F.lit("Claim amount "), money(amount), F.lit(" significantly exceeds typical range "),
                    money(low), F.lit("-"), money(high),
                ),
            ),
            (
                amount < low * 0.5, "REVIEW", 0.6,
                F.concat(F.lit("Claim amount unusually low for procedure "), F.col("procedure_code")),
            ),
        ],
        ("APPROVE", 0.85, "Medical codes valid and claim amount within expected range."),
    )


def review_financial(df: DataFrame) -> DataFrame:
    """ADJ-4: exposure against the limit and the claimant's history. A missing limit counts as 0."""
    amount = F.col("claim_amount")
    limit = F.coalesce("policy_limit", F.lit(0.0))
    measured = df.withColumns(
        {
            "_exposure": F.when(limit > 0, ratio(amount, limit)).otherwise(0.0),
            "_total": cents(F.coalesce("total_claimed_amount", F.lit(0.0))),
            "_average": cents(F.coalesce("avg_claim_amount", F.lit(0.0))),
        }
    )
    exposure, total, average = F.col("_exposure"), F.col("_total"), F.col("_average")
    judged = _judge(
        measured,
        "financial",
        [
            (
                exposure > 0.9, "INVESTIGATE", 0.8,
                F.concat(
                    F.lit("Claim represents "), percent(exposure), F.lit(" of policy limit - high financial exposure")
                ),
            ),
            (
                (amount > average * 3) & (average > 0), "REVIEW", 0.7,
                F.concat(F.lit("Claim "), money(amount), F.lit(" is 3x claimant's average "), money(average)),
            ),
            (
                total > limit * 2, "INVESTIGATE", 0.75,
                F.concat(F.lit("Claimant's lifetime claims "), money(total), F.lit(" exceed 2x policy limit")),
            ),
        ],
        ("APPROVE", 0.85, "Financial metrics within acceptable parameters."),
    )
    return judged.withColumns(
        {
            "exposure_ratio": rounded(exposure, 4),
            "recommended_reserve": cents(amount * 1.1),
            "claimant_total_claimed": total,
            "claimant_avg_claim": average,
        }
    ).drop("_exposure", "_total", "_average")


def route(df: DataFrame, priority: Column | str = "normal") -> DataFrame:
    """ADJ-5: names of the reviewers to ask, in order; high and critical cases go to all four."""
    urgency = F.lit(priority) if isinstance(priority, str) else priority
    names = {name: F.lit(name) for name in REVIEWERS}
    return df.withColumn("priority", urgency).withColumn("reviewers", _in_order(names))


def _urgent() -> Column:
    return F.coalesce(F.col("priority").isin(dims.URGENT_PRIORITIES), F.lit(False))


def _in_order(by_name: dict[str, Column]) -> Column:
    """One value per consulted reviewer, in the order of consultation."""

    def listed(*names):
        return F.array(*[by_name[n] for n in names])

    return (
        F.when(_urgent(), listed("fraud", "legal", "medical", "financial"))
        .when(_medical(), listed("fraud", "legal", "financial", "medical"))
        .otherwise(listed("fraud", "legal", "financial"))
    )


def reviewed(df: DataFrame, priority: Column | str = "normal", similar: DataFrame | None = None) -> DataFrame:
    """Verdict, confidence and rationale of the four reviewers on every claim."""
    scored = investigate.rule_risk(df).withColumnsRenamed(
        {"recommendation": "risk_recommendation", "confidence": "risk_confidence"}
    )
    coded = investigate.medical_lookup(investigate.policy_checks(scored))
    judged = review_financial(review_medical(review_legal(review_fraud(coded, similar))))
    return route(judged, priority)


def _analyses(columns: list[str]) -> dict[str, dict[str, Column]]:
    """What each reviewer looked at, by reviewer and name."""
    fraud, total = F.col("prior_fraud_count"), F.col("total_claims_count")
    history = F.struct(
        total.alias("total_claims"),
        F.col("claimant_total_claimed").alias("total_claimed"),
        F.col("claimant_avg_claim").alias("average_claim"),
        fraud.alias("fraud_count"),
        investigate.risk_pattern(fraud, total).alias("risk_pattern"),
    )
    parts = {
        kind: F.struct(*[F.col(f"{kind}_{part}").alias(part) for part in names])
        for kind, names in {
            "diagnosis": ("code", "description", "category", "severity", "note"),
            "procedure": ("code", "description", "cost_min", "cost_max", "cost_avg", "note"),
        }.items()
    }
    similar = {c: F.col(c) for c in ("similar_fraud_count", "total_similar_claims") if c in columns}
    return {
        "fraud": {
            "fraud_risk_score": F.col("fraud_risk_score"), "risk_level": F.col("risk_level"),
            "risk_factors": F.col("risk_factors"), **similar, "claimant_history": history,
        },
        "legal": {
            "policy_valid": F.col("policy_valid"), "validations": investigate.validations(),
            "failed_checks": F.col("failed_checks"), "warning_checks": F.col("warning_checks"),
        },
        "medical": {**parts, "claim_amount": F.col("claim_amount")},
        "financial": {
            "claim_amount": F.col("claim_amount"), "policy_limit": F.col("policy_limit"),
            "claim_to_limit_ratio": F.col("exposure_ratio"),
            "claimant_total_claimed": F.col("claimant_total_claimed"),
            "claimant_avg_claim": F.col("claimant_avg_claim"),
            "recommended_reserve": F.col("recommended_reserve"),
        },
    }


def reviews(analyses_of: list[str] | None = None) -> Column:
    """The consulted reviews of a row as an array; with the row's columns, their analyses too.

    All analyses have the same fields, so that they fit one array; those of other reviewers are
    NULL, which JSON leaves out.
    """
    analyses = _analyses(analyses_of) if analyses_of else {}
    fields = {field: column for own in analyses.values() for field, column in own.items()}

    def analysis(name: str) -> list[Column]:
        if not analyses:
            return []
        own = analyses[name]
        values = [(own[f] if f in own else F.when(F.lit(False), c)).alias(f) for f, c in fields.items()]
        return [F.struct(*values).alias("analysis")]

    return _in_order(
        {
            name: F.struct(
                F.lit(agent).alias("agent"),
                F.col(f"{name}_verdict").alias("recommendation"),
                F.col(f"{name}_confidence").alias("confidence"),
                F.col(f"{name}_rationale").alias("rationale"),
                *analysis(name),
            )
            for name, agent in REVIEWERS.items()
        }
    )


def reviews_long(df: DataFrame) -> DataFrame:
    """One row per claim and consulted reviewer."""
    return df.select("claim_id", "priority", F.inline(reviews()))


def decide(df: DataFrame) -> DataFrame:
    """ADJ-6: one verdict per claim from its reviews. Works inside the row, without a shuffle."""
    consulted = _urgent() | _medical()
    votes = {name: F.col(f"{name}_verdict") for name in REVIEWERS}
    votes["medical"] = F.when(consulted, votes["medical"])

    def added(values):
        total = values[0]
        for value in values[1:]:
            total = total + value
        return total

    def votes_for(verdict):
        return added([flag(v == verdict) for v in votes.values()])

    # Added in the order of consultation, which decides the last binary digit. Over an array, because the
    # optimizer takes sums for equal whatever their order.
    shares = {n: F.when(votes[n] != "N/A", F.col(f"{n}_confidence")).otherwise(0.0) for n in REVIEWERS}
    total = F.aggregate(_in_order(shares), F.lit(0.0), lambda sum_, share: sum_ + share)
    asked = added([flag(v != "N/A") for v in votes.values()])
    deny, investigations = F.col("deny_votes"), F.col("investigate_votes")
    verdict = F.col("final_recommendation")
    denied_by = F.concat_ws(", ", *[F.when(votes[n] == "DENY", F.lit(agent)) for n, agent in REVIEWERS.items()])

    def per_outcome(on_deny, on_investigate, on_review, on_approve):
        return (
            F.when(verdict == "DENY", on_deny)
            .when(verdict == "INVESTIGATE", on_investigate)
            .when(verdict == "REVIEW", on_review)
            .otherwise(on_approve)
        )

    def actions(texts):
        return F.array(*map(F.lit, texts))

    return (
        df.withColumns(
            {
                "deny_votes": votes_for("DENY"),
                "investigate_votes": votes_for("INVESTIGATE"),
                "review_votes": votes_for("REVIEW"),
                "approve_votes": votes_for("APPROVE"),
                "agent_count": F.size("reviewers"),
                "confidence": F.round(F.coalesce(F.try_divide(total, asked), F.lit(0.5)), 3),
            }
        )
        .withColumn(
            "final_recommendation",
            F.when(deny > 0, "DENY")
            .when((investigations >= 2) | ((investigations >= 1) & _urgent()), "INVESTIGATE")
            .when(F.col("review_votes") + investigations > F.col("approve_votes"), "REVIEW")
            .otherwise("APPROVE"),
        )
        .withColumns(
            {
                "rationale": per_outcome(
                    F.concat(F.lit("Denial recommended by "), denied_by),
                    F.lit(INVESTIGATE_RATIONALE),
                    F.lit(REVIEW_RATIONALE),
                    F.lit(APPROVE_RATIONALE),
                ),
                "next_actions": per_outcome(
                    actions(DENY_ACTIONS), actions(INVESTIGATE_ACTIONS), actions(REVIEW_ACTIONS), actions(APPROVE_ACTIONS)
                ),
            }
        )
    )


def investigation_log(decisions: DataFrame, as_of) -> DataFrame:
    """ADJ-7: one log row per decided claim, ready for ``store.append``, with every reviewer's analysis."""
    return decisions.withColumn("investigation_timestamp", F.lit(as_of).cast("timestamp")).select(
        "claim_id",
        "investigation_timestamp",
        "priority",
        "final_recommendation",
        "confidence",
        "rationale",
        "agent_count",
        F.array_join(_in_order({name: F.lit(agent) for name, agent in REVIEWERS.items()}), ", ").alias("agents_consulted"),
        F.to_json(
            F.struct(
                "claim_id",
                "investigation_timestamp",
                "priority",
                F.struct(
                    "claimant_id", "policy_id", "claim_type", "claim_amount", "incident_date", "filing_date",
                    "description", "diagnosis_code", "procedure_code", "policy_limit", "status",
                ).alias("claim_data"),
                reviews(decisions.columns).alias("agent_responses"),
                "final_recommendation",
                "confidence",
                "rationale",
                "next_actions",
            )
        ).alias("investigation_json"),
    )
