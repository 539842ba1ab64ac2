"""Seconds per headline query on local[$BENCH_CPUS], as one JSON line.

Every query is run to completion into Spark's no-op sink, twice; the faster run counts, so that
the start-up of the JVM is left out. Training runs once: the second run would find the model.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caseflow.plans import registry
from caseflow.session import build_session

HEADLINE = """
brz2_record_hash brz3_cdc_diff dq6_completeness dq7_rule_report slv1_enrich slv5_claim_sequence
slv6_claimant_history slv10_weather_flags slv13_feature_table gld1_claims_summary gld2_fraud_alerts
gld3_claimant_profiles gld4_provider_metrics gld5_weekly_series inv2_rule_risk inv3_verify_policy
inv5_payment_history adj6_vote adj7_investigation_log wrt1_status_audit snk5_merge_status evl4_class_report
evl8_assign_variant dsh1_kpis dsh6_factor_rates sim1_cosine_topk sim2_similar_fraud ml2_stratified_split
ml8_curves str3_weekly_windows str5_streaming_upsert j10_all_vectors_by_cells sim4_text_vectors inv6_keyword_search_documents
sim2_similar_fraud_approx slv6_history_point_in_time ml3_train_and_test str4_rolling_monitor gld3_incremental
brz3_cdc_diff_by_digests inv6_keyword_search_indexed sim2_similar_fraud_index
""".split()


ONCE = {"ml3_train_and_test"}


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    seconds = {name: round(min(run(spark, name, folder) for _ in range(1 if name in ONCE else 2)), 3) for name in names}
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
