"""Bronze ingestion (BRZ-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.features import record_hash
from caseflow.sources import store

METADATA = ("_ingestion_timestamp", "_source_system", "_record_hash")


def with_ingest_meta(df: DataFrame, source: str, as_of=None) -> DataFrame:
    """BRZ-1: ingestion time and source system, only where absent. ``as_of`` defaults to now."""
    when = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    new = {"_ingestion_timestamp": when, "_source_system": F.lit(source)}
    return df.withColumns({name: column for name, column in new.items() if name not in df.columns})


def with_record_hash(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """BRZ-2: md5 of the exact business columns, so that a reload of the same row keeps its hash."""
    if "_record_hash" in df.columns:
        return df
    chosen = cols or [c for c in df.columns if c not in METADATA]
    return df.withColumn("_record_hash", record_hash(chosen))


def cdc_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """BRZ-3: what happened to each key between two snapshots, from the record hashes alone."""
    before = with_record_hash(old).select(key, F.col("_record_hash").alias("old_hash"))
    after = with_record_hash(new).select(key, F.col("_record_hash").alias("new_hash"))
    return _classified(before, after, key)


def _classified(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    old_hash, new_hash = F.col("old_hash"), F.col("new_hash")
    change = (
        F.when(old_hash.isNull(), "insert")
        .when(new_hash.isNull(), "delete")
        .when(old_hash != new_hash, "update")
        .otherwise("unchanged")
    )
    return before.join(after, key, "full_outer").select(key, change.alias("change_type"))


#: Buckets of keys whose digests are kept with a snapshot.
BUCKETS = 1024


def _hashed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    rows = with_record_hash(df).select(F.col(key).alias("key"), "_record_hash")
    return rows.withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets)))


def _digests(rows: DataFrame) -> DataFrame:
    """One row per bucket: number of rows, and 128 bits that do not depend on their order."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("-")), "_record_hash"))

    def half(start):
        return F.bit_xor(F.xxhash64(F.substring(digest, start, 16)))

    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), half(1).alias("left"), half(17).alias("right"))


def keep_snapshot(df: DataFrame, root: str, name: str, key: str, buckets: int = BUCKETS) -> None:
    """Store the record hashes of a load, dealt to buckets of keys, and the digest of each bucket."""
    rows = _hashed(df, key, buckets)
    store.save(rows.repartition("bucket"), root, name, partition_by=("bucket",))
    store.save(_digests(store.load(df.sparkSession, root, name)).coalesce(1), root, f"{name}_digests")


def changed_buckets(new: DataFrame, root: str, name: str, key: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a stored snapshot that differ from ``new``; ``buckets`` of them at most."""
    old = store.load(new.sparkSession, root, f"{name}_digests").withColumnsRenamed({c: f"old_{c}" for c in ("rows", "left", "right")})
    both = old.join(_digests(_hashed(new, key, buckets)), "bucket", "full_outer")
    same = F.lit(True)
    for c in ("rows", "left", "right"):
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return sorted(r["bucket"] for r in both.filter(~same).select("bucket").collect())


def cdc_diff_stored(new: DataFrame, root: str, name: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """BRZ-3 against a stored snapshot. Rows of buckets with equal digests are unchanged without a look at the
    stored ones; only the other buckets are read and joined. Keys are unique in a load, and not NULL."""
    spark = new.sparkSession
    differing = changed_buckets(new, root, name, key, buckets)
    rows = _hashed(new, key, buckets)
    inside = F.col("bucket").isin(differing)
    before = store.load(spark, root, name).filter(inside).select("key", F.col("_record_hash").alias("old_hash"))
    after = rows.filter(inside).select("key", F.col("_record_hash").alias("new_hash"))
    changed = _classified(before, after, "key")
    equal = rows.filter(~inside).select("key", F.lit("unchanged").alias("change_type"))
    return changed.unionByName(equal).withColumnRenamed("key", key)
