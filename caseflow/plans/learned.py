"""Vector similarity and the fraud model (SIM, ML)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseflow.operators import evaluate, investigate, model, silver, similarity, vector_index
from caseflow.plans.base import AS_OF, CLAIMS, RISK, instant, num, plain, query
from caseflow.plans.cases import PAIRS
from caseflow.plans.quality_loop import report_sql
from caseflow.session import work_dir


def _vectors(v):
    return v.table("embeddings").select(
        F.col("vec_id").alias("claim_id"), "embedding", (F.col("label") == 0).alias("is_fraud")
    )


def _label_queries(v):
    """The first vector of every label."""
    first = v.table("embeddings").groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q"))
    return first.select(F.col("q.vec_id").alias("query_id"), F.col("q.embedding").alias("embedding"))


def top_sql(k: int) -> str:
    """The k best pairs per query out of ``asked`` times all vectors."""
    return f"""scored AS (SELECT a.vec_id AS query_id, b.vec_id AS claim_id,
round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 10) AS similarity_score
FROM asked a, embeddings b), topk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, claim_id) AS INT) AS position
FROM scored QUALIFY position <= {k})"""


ASKED = "asked AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id)=1)"


@query(
    "sim1_cosine_topk",
    f"WITH {ASKED}, {top_sql(5)} SELECT query_id, claim_id, {num('similarity_score')}, position FROM topk",
)
def _(v):
    return plain(similarity.cosine_topk(_label_queries(v), _vectors(v), 5))


@query("sim2_similar_fraud", f"WITH {PAIRS} SELECT * FROM similar_claims")
def _(v):
    return similarity.similar_fraud(_vectors(v), 5)


@query("sim2_similar_fraud_approx", "SELECT vec_id AS claim_id, true AS plausible FROM embeddings")
def _(v):
    # Neighbours by hashing may differ from the exact ones; every claim still has its own result.
    found = similarity.similar_fraud(_vectors(v), 5, approx={})
    few, frauds = F.col("total_similar_claims"), F.col("similar_fraud_count")
    return found.select("claim_id", (few.between(1, 5) & frauds.between(0, few)).alias("plausible"))


@query("sim2_similar_fraud_index", None)
def _(v):
    # Nine of ten neighbours are the exact ones (tests/test_vector_index.py), so no SQL gives the same rows.
    root = work_dir(v.spark, "sim2")
    vector_index.build(_vectors(v), root, "claims")
    found = vector_index.search(_vectors(v).select(F.col("claim_id").alias("query_id"), "embedding"), root, "claims", 5)
    return similarity.fraud_counts(found, _vectors(v))


@query(
    "sim2_similar_fraud_without_self",
    f"""WITH {PAIRS}, others AS (SELECT * FROM pairs WHERE query_id<>claim_id
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) <= 5) SELECT query_id AS claim_id,
count(*) FILTER (WHERE label=0) AS similar_fraud_count, count(*) AS total_similar_claims FROM others GROUP BY query_id""",
)
def _(v):
    return similarity.similar_fraud(_vectors(v), 5, exclude_self=True)


@query(
    "j10_all_vectors_by_cells",
    f"""WITH asked AS (SELECT * FROM embeddings), {top_sql(3)}
SELECT query_id, claim_id, {num('similarity_score')}, position FROM topk""",
)
def _(v):
    # Limits of nothing force the way that is meant for two large sides.
    queries = _vectors(v).select(F.col("claim_id").alias("query_id"), "embedding")
    limits = similarity.Limits(queries=0, matrix_bytes=0, block=128)
    return plain(similarity.cosine_topk(queries, _vectors(v), 3, limits))


@query(
    "sim3_embedding_table",
    f"""SELECT vec_id, label, 'supplied-64' AS embedding_model, CAST(len(embedding) AS INT) AS embedding_dim,
{instant(f"'{AS_OF}'", 'created_at')} FROM embeddings""",
)
def _(v):
    return plain(similarity.embedding_table(v.table("embeddings"), "supplied-64", AS_OF).drop("embedding"))


@query(
    "sim4_text_vectors",
    f"SELECT doc_id, CAST(384 AS INT) AS embedding_dim, {num('1e0', 'vector_length')} FROM documents",
)
def _(v):
    vectors = similarity.text_vectors(v.table("documents").select("doc_id", "text"), "text")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return plain(
        vectors.select("doc_id", F.size("embedding").alias("embedding_dim"), length.alias("vector_length"))
    )


DETAILS = f"""WITH {CLAIMS}, {ASKED}, {top_sql(5)} SELECT query_id, topk.claim_id, {num('round(similarity_score, 3)', 'similarity_score')},
position, description, {num('claim_amount')}, status, is_fraud AS was_fraud FROM topk JOIN claims ON topk.claim_id=claims.claim_id"""


@query("sim5_topk_details", DETAILS)
def _(v):
    topk = similarity.cosine_topk(_label_queries(v), _vectors(v), 5)
    return plain(similarity.with_details(topk, v.claims))


@query(
    "j8_ids_semi_join",
    f"""WITH {CLAIMS}, {ASKED}, {top_sql(5)} SELECT claim_id, status FROM claims WHERE claim_id IN (SELECT claim_id FROM topk)""",
)
def _(v):
    hits = similarity.cosine_topk(_label_queries(v), _vectors(v), 5).select("claim_id")
    return v.claims.join(hits, "claim_id", "left_semi").select("claim_id", "status")


@query(
    "ml1_class_balance",
    f"""WITH {CLAIMS}, counted AS (SELECT count(*) AS row_count, count(*) FILTER (WHERE is_fraud) AS positive_count,
count(*) FILTER (WHERE NOT is_fraud) AS negative_count FROM claims) SELECT *, {num('positive_count*100e0/row_count', 'positive_rate_pct')},
{num('negative_count/positive_count', 'positive_weight')} FROM counted""",
)
def _(v):
    return plain(model.class_balance(v.claims))


SPLIT = f"""{CLAIMS}, ranked AS (SELECT claim_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(claim_id AS VARCHAR))) AS position,
count(*) OVER (PARTITION BY is_fraud) AS label_size FROM claims), parts AS (
SELECT claim_id, is_fraud, CASE WHEN position<=floor(label_size*0.2e0) THEN 'test' ELSE 'train' END AS split FROM ranked)"""


@query(
    "ml2_stratified_split",
    f"WITH {SPLIT} SELECT * FROM parts",
)
def _(v):
    return model.stratified_split(v.claims.select("claim_id", "is_fraud"), "is_fraud")


class _Fitted:
    """The trained model and the split feature table of one session and data folder.

    Three queries read the same training; asking for another folder releases the last one.
    """

    key: tuple | None = None
    value: tuple | None = None

    @classmethod
    def of(cls, v):
        key = (v.spark.sparkContext.applicationId, v.sf_dir)
        if cls.key != key:
            cls.key, cls.value = None, None
            # The split and the training read the features several times.
            features = model.cut_lineage(v.features)
            parts = model.cut_lineage(model.stratified_split(features, "is_fraud"))
            cls.value = model.train(parts.filter("split = 'train'")), parts
            cls.key = key
        return cls.value


def _test_predictions(v):
    fitted, parts = _Fitted.of(v)
    return model.predict(fitted, parts.filter("split = 'test'"), as_of=AS_OF)


# Trees differ between engines; what must hold of any training can be said in SQL.
METRICS = ", ".join(f"('{m}')" for m in "accuracy precision recall f1_score roc_auc avg_precision".split())


@query("ml3_train_and_test", f"SELECT metric, true AS in_range FROM (VALUES {METRICS}) AS m(metric)")
def _(v):
    predictions = model.cut_lineage(_test_predictions(v))
    metrics = [
        scores.unpivot([], scores.columns, "metric", "value")
        for scores in (model.binary_metrics(predictions), model.ranking_metrics(predictions))
    ]
    return metrics[0].unionByName(metrics[1]).select("metric", F.col("value").between(0, 1).alias("in_range"))


@query(
    "ml4_predictions",
    f"""WITH {SPLIT} SELECT claim_id, CAST(is_fraud AS INT) AS actual_fraud, true AS consistent, 'v1' AS model_version,
{instant(f"'{AS_OF}'", 'prediction_timestamp')} FROM parts WHERE split='test'""",
)
def _(v):
    guess, chance = F.col("predicted_fraud"), F.col("fraud_probability")
    right = F.col("prediction_correct") == (guess == F.col("actual_fraud")).cast("int")
    consistent = chance.between(0, 1) & (guess == (chance > 0.5).cast("int")) & right
    return plain(
        _test_predictions(v).select("claim_id", "actual_fraud", consistent.alias("consistent"), "model_version", "prediction_timestamp")
    )


@query(
    "ml9_feature_importance",
    "SELECT feature, true AS in_range, true AS adds_up FROM (VALUES "
    + ", ".join(f"('{f}')" for f in silver.FEATURES)
    + ") AS f(feature)",
)
def _(v):
    share = F.col("importance")
    listed = model.importances(_Fitted.of(v)[0], v.spark)
    total = F.sum(share).over(Window.partitionBy())  # one row per feature
    return listed.select("feature", share.between(0, 1).alias("in_range"), (F.abs(total - 1) < 1e-9).alias("adds_up"))


# The values themselves, which differ between engines and so have no SQL.


@query("ml3_metric_values", None)
def _(v):
    predictions = model.cut_lineage(_test_predictions(v))
    scores = [model.binary_metrics(predictions), model.ranking_metrics(predictions)]
    listed = [s.unpivot([], s.columns, "metric", "value") for s in scores]
    return listed[0].unionByName(listed[1])


@query("ml4_probabilities", None)
def _(v):
    return _test_predictions(v).select("claim_id", "actual_fraud", "predicted_fraud", "fraud_probability", "prediction_correct")


@query("ml9_importances", None)
def _(v):
    return model.importances(_Fitted.of(v)[0], v.spark).select("feature", "importance")


# The rule score stands in for a probability: it is the same in every engine.
SCORED = f"""{RISK}, scored AS (SELECT claim_id, CAST(is_fraud AS INT) AS actual_fraud, CAST(fraud_risk_score>0.3 AS INT) AS predicted_fraud,
fraud_risk_score AS fraud_probability FROM risk)"""


def _scored(v):
    scored = investigate.rule_risk(v.features)
    return scored.select(
        "claim_id",
        F.col("is_fraud").cast("int").alias("actual_fraud"),
        (F.col("fraud_risk_score") > 0.3).cast("int").alias("predicted_fraud"),
        F.col("fraud_risk_score").alias("fraud_probability"),
    )


OUTCOMES = f"""{SCORED}, o AS (SELECT count(*) AS n, count(*) FILTER (WHERE actual_fraud=1 AND predicted_fraud=1) AS tp,
count(*) FILTER (WHERE actual_fraud=0 AND predicted_fraud=1) AS fp, count(*) FILTER (WHERE actual_fraud=1 AND predicted_fraud=0) AS fn,
count(*) FILTER (WHERE actual_fraud=0 AND predicted_fraud=0) AS tn FROM scored)"""


@query(
    "ml5_binary_metrics",
    f"""WITH {OUTCOMES} SELECT {num('(tp+tn)/n', 'accuracy')}, {num('tp/(tp+fp)', 'precision')}, {num('tp/(tp+fn)', 'recall')},
{num('2*tp/(2*tp+fp+fn)', 'f1_score')} FROM o""",
)
def _(v):
    return plain(model.binary_metrics(_scored(v)))


CURVES = f"""{SCORED}, hist AS (SELECT fraud_probability AS threshold, count(*) FILTER (WHERE actual_fraud=1) AS positives,
count(*) FILTER (WHERE actual_fraud=0) AS negatives FROM scored GROUP BY ALL), points AS (
SELECT threshold, positives, negatives, CAST(sum(positives) OVER down AS BIGINT) AS tp, CAST(sum(negatives) OVER down AS BIGINT) AS fp,
CAST(sum(positives) OVER () AS BIGINT) AS p, CAST(sum(negatives) OVER () AS BIGINT) AS n FROM hist
WINDOW down AS (ORDER BY threshold DESC))"""


@query(
    "ml6_ranking_metrics",
    f"""WITH {CURVES} SELECT {num('sum(negatives*(tp-positives/2))/(any_value(p)*any_value(n))', 'roc_auc')},
{num('sum(positives*(tp/(tp+fp)))/any_value(p)', 'avg_precision')} FROM points""",
)
def _(v):
    return plain(model.ranking_metrics(_scored(v)))


@query(
    "ml7_confusion_matrix",
    f"WITH {SCORED} SELECT actual_fraud, predicted_fraud, count(*) AS row_count FROM scored GROUP BY ALL",
)
def _(v):
    return evaluate.confusion_matrix(_scored(v), "actual_fraud", "predicted_fraud")


@query(
    "ml8_curves",
    f"""WITH {CURVES} SELECT {num('threshold')}, positives, negatives, tp, fp, {num('fp/n', 'fpr')}, {num('tp/p', 'tpr')},
{num('tp/(tp+fp)', 'precision')}, {num('tp/p', 'recall')} FROM points""",
)
def _(v):
    return plain(model.curves(_scored(v)))


@query(
    "ml10_class_report",
    report_sql(f"{SCORED}, truth_table AS (SELECT * FROM scored)", "actual_fraud", "predicted_fraud"),
)
def _(v):
    return plain(evaluate.class_report(_scored(v), "actual_fraud", "predicted_fraud"))


@query(
    "ml10_class_report_labels",
    report_sql("truth_table AS (SELECT * FROM labels)", "toxic", "quality"),
)
def _(v):
    return plain(evaluate.class_report(v.table("labels"), "toxic", "quality"))


@query(
    "ml11_business_impact",
    f"""WITH {OUTCOMES} SELECT n AS total_test_claims, tp+fn AS actual_fraud, tp AS detected_fraud, {num('tp*100e0/(tp+fn)', 'detected_pct')},
fn AS missed_fraud, fp AS false_alarms FROM o""",
)
def _(v):
    return plain(model.impact(_scored(v)))
