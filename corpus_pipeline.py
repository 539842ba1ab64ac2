"""Documents to packed training sequences, one operator per stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import langid, mixing, packing, queries, secrets, simhash
from caseflow.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A batch of texts is held several times over, in the JVM and in Python, by every core of an executor; Spark's
# default of 10,000 rows of any size takes more than the workers' own tables.
BATCH = "4m"

# Language ID compresses with zstandard and fingerprints hash with XXH64: no SQL for these rows.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; ``lang`` becomes the language found."""
    model = langid.fit(docs.filter(langid.learned_from()))
    found = langid.identify(docs, model).filter("not lang_rejected")
    return found.withColumn("lang", found["lang_pred"]).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that look live are replaced in their texts."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight asks."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.pack(docs, queries.VOCABULARY)


def in_batches(stage: Stage) -> Stage:
    """The stage in a session whose Python tasks get ``BATCH`` bytes and one row at a time, at most."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_batches(language)),
    ("simhash_dedup", in_batches(near_duplicates)),
    ("secret_scan", in_batches(secret_values)),
    ("source_mixing", in_batches(mixed)),
    ("packing", in_batches(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
