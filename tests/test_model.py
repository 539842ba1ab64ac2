import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from caseflow.operators import evaluate, model, similarity
from caseflow.operators.silver import FEATURES


def _toy(spark, n=400):
    random.seed(3)
    rows = [(i, i % 4 == 0, random.random() + (2.0 if i % 4 == 0 else 0.0), None if i % 7 == 0 else random.random()) for i in range(n)]
    return spark.createDataFrame(rows, "claim_id long, is_fraud boolean, a double, b double")


def test_split_is_disjoint_stratified_and_repeatable(spark):
    df = model.stratified_split(_toy(spark), "is_fraud")
    assert df.count() == 400
    counts = {(r.is_fraud, r.split): r["count"] for r in df.groupBy("is_fraud", "split").count().collect()}
    assert counts == {(True, "test"): 20, (True, "train"): 80, (False, "test"): 60, (False, "train"): 240}
    again = model.stratified_split(_toy(spark).repartition(7), "is_fraud")
    assert df.select("claim_id", "split").exceptAll(again.select("claim_id", "split")).isEmpty()


def test_training_separates_a_separable_label(spark):
    parts = model.stratified_split(_toy(spark), "is_fraud")
    fitted = model.train(parts.filter("split = 'train'"), columns=["a", "b"], maxIter=5, maxDepth=3)
    preds = model.predict(fitted, parts.filter("split = 'test'"), columns=["a", "b"], as_of="2024-01-01")
    assert preds.columns == [
        "claim_id", "actual_fraud", "predicted_fraud", "fraud_probability", "prediction_correct", "model_version", "prediction_timestamp"]
    assert preds.count() == 80
    assert model.ranking_metrics(preds).first().roc_auc > 0.9
    assert model.importances(fitted, spark, ["a", "b"]).first().feature == "a"
    assert model.PARAMS["maxIter"] == 200 and model.MODEL_FEATURES == FEATURES and len(FEATURES) == 28


def test_training_uses_few_partitions_and_no_table_of_nodes(spark, monkeypatch):
    seen = []

    class Classifier:
        def __init__(self, **settings):
            self.settings = settings

        def fit(self, data):
            seen.append((self.settings["cacheNodeIds"], data.rdd.getNumPartitions(), data.count()))

    monkeypatch.setattr(model, "GBTClassifier", Classifier)
    cores = spark.sparkContext.defaultParallelism
    many = _toy(spark).repartition(50)
    model.train(many, columns=["a", "b"])
    model.train(many.coalesce(2), columns=["a", "b"])
    monkeypatch.setattr(model, "_PARTITION_ROWS", 10)
    model.train(many, columns=["a", "b"])
    assert seen == [(False, 2 * cores, 400), (False, 2, 400), (False, 40, 400)]


def test_a_table_of_nodes_gives_the_same_trees(spark):
    rows = _toy(spark).coalesce(1)
    trees = [model.train(rows, columns=["a", "b"], maxIter=3, cacheNodeIds=kept).toDebugString for kept in (True, False)]
    assert trees[0].split("\n")[1:] == trees[1].split("\n")[1:] and len(trees[0].split("\n")) > 5


def _preds(spark, scores, labels):
    rows = [(i, int(y), int(s > 0.5), float(s)) for i, (s, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "claim_id int, actual_fraud int, predicted_fraud int, fraud_probability double")


@pytest.mark.parametrize("ties", [False, True])
def test_ranking_metrics_equal_the_definition(spark, ties):
    rng = np.random.default_rng(5)
    scores = rng.random(700) ** 4  # most scores are close to 0
    scores = np.round(scores, 1) if ties else scores
    labels = rng.random(700) < 0.2 + 0.5 * scores
    pos, neg = scores[labels], scores[~labels]
    auc = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
    average, seen = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        chosen = scores >= t
        recall = labels[chosen].sum() / labels.sum()
        average += (recall - seen) * labels[chosen].mean()
        seen = recall
    row = model.ranking_metrics(_preds(spark, scores, labels)).first()
    assert row.roc_auc == pytest.approx(auc) and row.avg_precision == pytest.approx(average)
    points = model.curves(_preds(spark, scores, labels)).orderBy(F.desc("threshold")).collect()
    assert [p.tp + p.fp for p in points] == sorted(p.tp + p.fp for p in points)
    assert (points[-1].fpr, points[-1].tpr) == (1.0, 1.0) and len(points) == len(set(scores))


def test_binary_metrics_and_impact(spark):
    preds = _preds(spark, [0.9, 0.8, 0.7, 0.2, 0.1], [1, 0, 1, 1, 0])
    row = model.binary_metrics(preds).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (0.6, 2 / 3, 2 / 3, 2 / 3)
    impact = model.impact(preds).first()
    assert (impact.detected_fraud, impact.missed_fraud, impact.false_alarms) == (2, 1, 1)
    nothing = model.binary_metrics(_preds(spark, [0.1], [0])).first()
    assert (nothing.precision, nothing.recall, nothing.f1_score) == (0.0, 0.0, 0.0)


def test_class_report_with_labels_on_one_side_only(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "A"), ("C", "A")], "truth string, guess string")
    rows = {r.label: r for r in evaluate.class_report(df, "truth", "guess").collect()}
    assert set(rows) == {"A", "B", "C", "accuracy", "macro avg", "weighted avg"}
    assert (rows["A"].precision, rows["A"].recall, rows["A"].support) == (pytest.approx(1 / 3), 0.5, 2)
    assert (rows["C"].precision, rows["C"].recall, rows["C"].f1_score) == (0.0, 0.0, 0.0)
    assert rows["accuracy"].f1_score == 0.25 and rows["macro avg"].support == 4


def test_feedback_is_normalised(spark):
    raw = spark.createDataFrame(
        [(1, 1, "approve", "APPROVE", 0, None, None), (2, 1, "deny", "review", 9, 1.5, "eva")],
        "feedback_id int, claim_id int, agent_recommendation string, adjuster_decision string, raw_rating int, "
        "time_to_decision_hours double, adjuster_id string",
    ).withColumn("feedback_timestamp", F.lit("2024-01-31 12:00:00").cast("timestamp"))
    rows = {r.feedback_id: r for r in evaluate.normalise_feedback(raw).collect()}
    assert (rows[1].rating, rows[1].adjuster_id, rows[1].recommendation_correct) == (1, "anonymous", True)
    assert (rows[2].rating, rows[2].adjuster_id, rows[2].recommendation_correct) == (5, "eva", False)
    feedback = evaluate.normalise_feedback(raw)
    assert evaluate.quality_summary(feedback, 1, "2024-03-01").first().status == "no_data"
    # The summary starts at midnight, the quality figures at the exact instant.
    assert evaluate.feedback_summary(feedback, 1, "2024-02-01 13:00:00").count() == 2
    assert evaluate.quality_summary(feedback, 1, "2024-02-01 13:00:00").first().total_evaluations == 0


def test_variant_of_unknown_experiment_is_a(spark):
    claims = spark.createDataFrame([("123", "e"), ("123", "none"), ("5", "e")], "claim_id string, experiment_id string")
    experiments = spark.createDataFrame([("e", 0.809)], "experiment_id string, allocation_ratio double")
    # md5('123') is 808 modulo 1000.
    rows = {(r.claim_id, r.experiment_id): r.variant for r in evaluate.assign_variant(claims, experiments).collect()}
    assert rows[("123", "e")] == "B" and rows[("123", "none")] == "A"
    closed = spark.createDataFrame([("e", 0.808)], "experiment_id string, allocation_ratio double")
    assert evaluate.assign_variant(claims, closed).filter("claim_id = '123' and experiment_id = 'e'").first().variant == "A"


def test_text_vectors_are_tf_idf(spark):
    texts = ["a b b c", "a c", None, "", "B x"]
    rows = similarity.text_vectors(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), "text", 64).collect()
    place = HashingTF(numFeatures=64).indexOf
    words = [(t or "").lower().split(" ") for t in texts]
    seen = Counter(i for w in words for i in {place(x) for x in w})
    for row in rows:
        expected = np.zeros(64)
        for word in words[row.id]:
            expected[place(word)] += np.log((len(texts) + 1) / (seen[place(word)] + 1))
        length = np.linalg.norm(expected)
        assert np.allclose(row.embedding, expected / length if length else expected, atol=1e-6)


def test_bands_follow_the_number_of_scores(spark, monkeypatch):
    rng = np.random.default_rng(1)
    preds = _preds(spark, rng.random(500), rng.random(500) < 0.3)
    wanted = model.curves(preds).orderBy("threshold").collect()
    monkeypatch.setattr(model, "_BAND_ROWS", 20)
    assert model.curves(preds).orderBy("threshold").collect() == wanted
