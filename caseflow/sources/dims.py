"""Code dimensions, vocabularies and log schemas. The dimensions have ten rows
each, so broadcasting them is always safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ICD-10 code, description, category, severity.
ICD10 = [
    ("S06.9", "Head injury, unspecified", "Traumatic injury", "High"),
    ("S83.5", "Sprain of knee", "Soft tissue injury", "Medium"),
    ("M54.5", "Low back pain", "Musculoskeletal", "Low"),
    ("S52.5", "Fracture of lower end of radius", "Fracture", "High"),
    ("T14.9", "Injury, unspecified", "General injury", "Medium"),
    ("S43.4", "Sprain of shoulder joint", "Soft tissue injury", "Medium"),
    ("S93.4", "Sprain of ankle", "Soft tissue injury", "Low"),
    ("M79.3", "Panniculitis, unspecified", "Inflammatory", "Low"),
    ("S72.0", "Fracture of femur", "Fracture", "High"),
    ("S82.5", "Fracture of tibia", "Fracture", "High"),
]

# CPT code, description, typical minimum and maximum cost.
CPT = [
    ("99285", "Emergency department visit, high severity", 800.0, 2000.0),
    ("73610", "Radiologic examination, ankle", 100.0, 300.0),
    ("29881", "Arthroscopy, knee, surgical", 3000.0, 8000.0),
    ("20610", "Arthrocentesis, major joint", 200.0, 500.0),
    ("97110", "Therapeutic exercises", 50.0, 150.0),
    ("72148", "MRI lumbar spine", 800.0, 2500.0),
    ("97140", "Manual therapy techniques", 60.0, 180.0),
    ("29125", "Application of short arm splint", 100.0, 300.0),
    ("27447", "Total knee arthroplasty", 15000.0, 40000.0),
    ("73562", "Radiologic examination, knee", 100.0, 300.0),
]

# State, latitude, longitude of its reference city.
STATE_COORDINATES = [
    ("CA", 34.0522, -118.2437),
    ("TX", 29.7604, -95.3698),
    ("FL", 25.7617, -80.1918),
    ("NY", 40.7128, -74.0060),
    ("IL", 41.8781, -87.6298),
    ("PA", 39.9526, -75.1652),
    ("OH", 39.9612, -82.9988),
    ("GA", 33.7490, -84.3880),
    ("NC", 35.7796, -78.6382),
    ("MI", 42.3314, -83.0458),
]

# Where a claim without a known state is placed.
DEFAULT_STATE = "CA"
DEFAULT_COORDINATES = (34.0522, -118.2437)

# Vocabularies accepted by the audited writes.
CLAIM_STATUSES = ["Pending", "Under Investigation", "Approved", "Denied", "Escalated", "Closed"]
NOTE_TYPES = ["general", "fraud_indicator", "evidence", "recommendation", "follow_up"]
TASK_PRIORITIES = ["low", "medium", "high", "urgent"]

# Claim types that need a medical review, priorities that widen the review.
MEDICAL_TYPES = ["Health", "Workers Comp"]
URGENT_PRIORITIES = ["high", "critical"]

# Log table schemas.
ENRICHMENT_SCHEMA = (
    "claim_id string, enrichment_source string, enrichment_data string, "
    "enrichment_timestamp string, api_status string"
)
FEEDBACK_SCHEMA = (
    "feedback_id string, claim_id string, agent_recommendation string, adjuster_decision string, "
    "adjuster_notes string, rating int, feedback_timestamp timestamp, adjuster_id string, "
    "time_to_decision_hours double, recommendation_correct boolean"
)
EXPERIMENT_SCHEMA = (
    "experiment_id string, experiment_name string, variant_a_config string, variant_b_config string, "
    "allocation_ratio double, description string, start_timestamp timestamp, status string"
)


def _constant(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Rows as an inline table of the plan, without a Python worker."""
    values = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in row) + ")" for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names.split())})")


def icd10(spark: SparkSession) -> DataFrame:
    return _constant(spark, ICD10, "code description category severity")


def cpt(spark: SparkSession) -> DataFrame:
    return _constant(spark, CPT, "code description cost_min cost_max")


def state_coordinates(spark: SparkSession) -> DataFrame:
    return _constant(spark, STATE_COORDINATES, "state latitude longitude")
