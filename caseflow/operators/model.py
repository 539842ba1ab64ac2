"""Model training, scoring and evaluation (ML-*)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.features import count_where
from caseflow.operators import ranking
from caseflow.operators.silver import FEATURES
from caseflow.session import cut_lineage, shared_dir

# All silver features, and the boosting parameters. The least gain of a split, 0.1, is
# there a sum over the rows of a node; here it is their mean, so 0.1 of 100,000 rows.
MODEL_FEATURES = list(FEATURES)
PARAMS = {
    "maxIter": 200,
    "maxDepth": 6,
    "stepSize": 0.1,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 3,
    "minInfoGain": 1e-6,
    "seed": 42,
}
# A value no feature takes; trees then put missing values on a side of their own.
MISSING = -1.0e9
# Rows of a partition of the training data, where there are more of them than tasks for all cores.
_PARTITION_ROWS = 500_000
# Distinct scores per band of a curve: a band is summed up by one task.
_BAND_ROWS = 100_000


def class_balance(features: DataFrame, label: str = "is_fraud") -> DataFrame:
    """ML-1: label counts, fraud rate and the weight of a positive row."""
    return features.agg(
        F.count(F.lit(1)).alias("row_count"),
        count_where(label).alias("positive_count"),
        count_where(~F.col(label)).alias("negative_count"),
    ).withColumns(
        {
            "positive_rate_pct": F.try_divide("positive_count", "row_count") * 100,
            "positive_weight": F.try_divide("negative_count", "positive_count"),
        }
    )


def stratified_split(df: DataFrame, label: str, test_share: float = 0.2, unique: str = "claim_id") -> DataFrame:
    """ML-2: adds ``split``; within each label the first ``test_share`` by md5(id) is the test part.

    The rank is built from slices of the md5, so a label that holds most rows is not one task.
    """
    ranked = ranking.with_rank(df, [label], None, unique, "_rank", size="_size", slice_hex=4)
    test = F.col("_rank") <= F.floor(F.col("_size") * test_share)
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("_rank", "_size")


def _assembled(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    filled = df.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in columns})
    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_features")
    return assembler.transform(filled).drop(*assembler.getInputCols())


def train(
    train_df: DataFrame, label: str = "is_fraud", columns: Iterable[str] = MODEL_FEATURES, **params
) -> GBTClassificationModel:
    """ML-3: boosted trees with the positive class weighted up to balance.

    Every level of every tree is a job with two tasks per partition, so the partitions are few. Nodes of rows are
    found by walking the tree: at this depth that is faster than a table of them, which needs memory and checkpoints.
    """
    shared_dir(train_df.sparkSession)  # long boosting runs cut their lineage there
    balance = class_balance(train_df, label).first()
    weight = balance["positive_weight"] or 1.0
    partitions = max(2 * train_df.sparkSession.sparkContext.defaultParallelism, -(-balance["row_count"] // _PARTITION_ROWS))
    data = (
        _assembled(train_df, columns)
        .withColumn("_label", F.col(label).cast("double"))
        .withColumn("_weight", F.when(F.col(label), weight).otherwise(1.0))
        .select("_features", "_label", "_weight")
        .coalesce(partitions)
    )
    settings = {"cacheNodeIds": False, "checkpointInterval": 10, **PARAMS, **params}
    classifier = GBTClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", **settings
    )
    return classifier.fit(data)


def predict(
    model, df: DataFrame, label: str = "is_fraud", columns: Iterable[str] = MODEL_FEATURES, version: str = "v1", as_of=None
) -> DataFrame:
    """ML-4: the predictions table."""
    when = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    scored = model.setPredictionCol("_guess").setProbabilityCol("_probability").transform(_assembled(df, columns))
    actual, guess = F.col(label).cast("int"), F.col("_guess").cast("int")
    return scored.select(
        "claim_id",
        actual.alias("actual_fraud"),
        guess.alias("predicted_fraud"),
        vector_to_array("_probability")[1].alias("fraud_probability"),
        (actual == guess).cast("int").alias("prediction_correct"),
        F.lit(version).alias("model_version"),
        when.alias("prediction_timestamp"),
    )


def _outcomes(preds: DataFrame) -> DataFrame:
    actual, guess = F.col("actual_fraud"), F.col("predicted_fraud")
    return preds.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((actual == 1) & (guess == 1)).alias("tp"),
        F.count_if((actual == 0) & (guess == 1)).alias("fp"),
        F.count_if((actual == 1) & (guess == 0)).alias("fn"),
        F.count_if((actual == 0) & (guess == 0)).alias("tn"),
    )


def binary_metrics(preds: DataFrame) -> DataFrame:
    """ML-5: accuracy, precision, recall and F1 from one aggregate; undefined values are 0."""

    def share(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _outcomes(preds).select(
        share(tp + F.col("tn"), F.col("n")).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def impact(preds: DataFrame) -> DataFrame:
    """ML-11: detected, missed and falsely raised cases."""
    return _outcomes(preds).select(
        F.col("n").alias("total_test_claims"),
        (F.col("tp") + F.col("fn")).alias("actual_fraud"),
        F.col("tp").alias("detected_fraud"),
        (F.try_divide("tp", F.col("tp") + F.col("fn")) * 100).alias("detected_pct"),
        F.col("fn").alias("missed_fraud"),
        F.col("fp").alias("false_alarms"),
    )


def curves(preds: DataFrame, score: str = "fraud_probability", label: str = "actual_fraud") -> DataFrame:
    """ML-8: ROC and precision-recall points, one per distinct score, highest score first.

    Running counts are built in two steps: scores are cut into bands of similar size, as many as
    the number of distinct scores asks for, each band is summed up by itself, and the totals of the
    higher bands are added.
    """
    hit = F.col(label) == 1
    histogram = cut_lineage(
        preds.groupBy(F.col(score).alias("threshold")).agg(
            F.count_if(hit).alias("positives"), F.count_if(~hit).alias("negatives")
        )
    )
    bands = max(2, -(-histogram.count() // _BAND_ROWS))
    cuts = histogram.approxQuantile("threshold", [i / bands for i in range(1, bands)], 1 / (4 * bands))
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    banded = Bucketizer(splits=edges, inputCol="threshold", outputCol="_band").transform(histogram)
    totals = banded.groupBy("_band").agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
    above = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(  # one row per band
        "_band",
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p_above"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n_above"),
        F.sum("_p").over(whole).alias("_p_all"),
        F.sum("_n").over(whole).alias("_n_all"),
    )
    inside = Window.partitionBy("_band").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    counted = banded.join(F.broadcast(offsets), "_band").withColumns(
        {
            "tp": F.col("_p_above") + F.sum("positives").over(inside),
            "fp": F.col("_n_above") + F.sum("negatives").over(inside),
        }
    )
    recall = F.try_divide("tp", "_p_all")
    return counted.select(
        "threshold",
        "positives",
        "negatives",
        "tp",
        "fp",
        F.try_divide("fp", "_n_all").alias("fpr"),
        recall.alias("tpr"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        recall.alias("recall"),
    )


def ranking_metrics(preds: DataFrame, score: str = "fraud_probability", label: str = "actual_fraud") -> DataFrame:
    """ML-6: exact ROC-AUC (trapezoids) and average precision, from the curve points."""
    half = F.col("negatives") * (F.col("tp") - F.col("positives") / 2)
    return curves(preds, score, label).agg(
        F.try_divide(F.sum(half), F.sum("positives") * F.sum("negatives")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("positives") * F.col("precision")), F.sum("positives")).alias("avg_precision"),
    )


def importances(model, spark, columns: Iterable[str] = MODEL_FEATURES) -> DataFrame:
    """ML-9: features by importance."""
    rows = list(zip(columns, [float(x) for x in model.featureImportances.toArray()]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
