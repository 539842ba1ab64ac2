"""Every registered query against its SQL on the smallest test tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from caseflow.plans.registry import ORACLES, QUERIES
from caseflow.sources.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"
# The full boosting run takes minutes; test_model.py trains a short one.
LONG = {"ml3_train_and_test", "ml4_predictions", "ml9_feature_importance", "ml3_metric_values", "ml4_probabilities", "ml9_importances"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(FOLDER, table)}.parquet'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(row[c]) for c in columns) for row in df.collect())
    assert got or name in {"dq3_orphans", "dsh2_filtered_listing"}
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    assert got == expected


def test_every_query_has_sql():
    # Recall of the index is tested in test_vector_index.py, a trained model in test_model.py.
    without = {"sim2_similar_fraud_index", "ml3_metric_values", "ml4_probabilities", "ml9_importances"}
    assert set(QUERIES) - set(ORACLES) == without and set(ORACLES) <= set(QUERIES)
