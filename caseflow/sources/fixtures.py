"""Claims-shaped views over the supplied test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import silver

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _pick(words: str, index, sep: str = ","):
    return F.split_part(F.lit(words), F.lit(sep), (F.lit(1) + index).cast("int"))


def _times(df: DataFrame, n: int, name: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0. Spark takes the rows of an explode for as few as its input and would
    broadcast millions of them; the size of a cross join it estimates as a product."""
    return df.crossJoin(F.broadcast(df.sparkSession.range(0, n, 1, 1).toDF(name)))


def claimants(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Four claimants per customer."""
    person = _times(customer, 4, "a").withColumn("claimant_id", F.col("c_custkey") * 4 + F.col("a"))
    return person.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "claimant_id",
        F.lit("Customer").alias("first_name"),
        F.expr("substr(c_name, 10)").alias("last_name"),
        F.date_add(F.lit("1950-01-01").cast("date"), (F.col("claimant_id") % 18000).cast("int")).alias("date_of_birth"),
        F.concat(
            F.lit("c"), F.col("claimant_id").cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com")
        ).alias("email"),
        F.col("n_name").alias("address_state"),
    )


def policies(customer: DataFrame) -> DataFrame:
    """Two policies per claimant."""
    ids = _times(customer, 8, "k").select((F.col("c_custkey") * 8 + F.col("k")).alias("policy_id"))
    pid = F.col("policy_id")
    first_day = F.lit("1995-01-01").cast("date")
    return ids.select(
        "policy_id",
        F.floor(pid / 2).cast("bigint").alias("claimant_id"),
        _pick("Auto,Property,Health,Workers Comp,Liability", pid % 5).alias("policy_type"),
        F.concat(F.lit("PROVIDER_"), (pid % 6).cast("string")).alias("provider"),
        (100000 * (1 + pid % 8)).cast("double").alias("policy_limit"),
        F.when(pid % 50 == 0, F.lit(0.0))
        .otherwise(_pick("500,1000,2500,5000", pid % 4).cast("double"))
        .alias("deductible"),
        (1500 * (1 + pid % 8)).cast("double").alias("premium_annual"),
        F.date_add(first_day, ((pid * 37) % 1500).cast("int")).alias("start_date"),
        F.date_add(first_day, ((pid * 37) % 1500 + 1460).cast("int")).alias("end_date"),
        F.lit("Active").alias("status"),
    )


def claims(orders: DataFrame) -> DataFrame:
    """One claim per order; every 97th has a policy that does not exist."""
    key = F.col("o_orderkey")
    claimant = F.col("o_custkey") * 4 + key % 4
    medical = F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED")
    incident = F.col("o_orderdate").cast("date")
    return orders.select(
        key.alias("claim_id"),
        F.when(key % 97 == 0, -key - 1).otherwise(claimant * 2 + F.floor(key / 4).cast("bigint") % 2).alias("policy_id"),
        claimant.alias("claimant_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Auto")
        .when(F.col("o_orderpriority") == "2-HIGH", "Property")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Health")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Workers Comp")
        .otherwise("Liability")
        .alias("claim_type"),
        incident.alias("incident_date"),
        F.date_add(incident, ((key * 13) % 95 - 1).cast("int")).alias("filing_date"),
        F.col("o_totalprice").alias("claim_amount"),
        _pick(
            "Vehicle accident on highway rear-end collision|Slip and fall incident at retail store|"
            "Property damage due to water damage|Medical treatment for Low back pain|"
            "Work-related injury requiring MRI lumbar spine",
            key % 5,
            "|",
        ).alias("description"),
        F.when(medical, _pick("S06.9,S83.5,M54.5,S52.5,T14.9,S43.4,S93.4,M79.3,S72.0,S82.5,Z99.9", key % 11)).alias(
            "diagnosis_code"
        ),
        F.when(medical, _pick("99285,73610,29881,20610,97110,72148,97140,29125,27447,73562,00000", key % 11)).alias(
            "procedure_code"
        ),
        _pick("Submitted,Under Review,Approved,Paid,Closed,Under Investigation,Denied", key % 7).alias("status"),
        (key % 13 == 0).alias("is_fraud"),
    )


def weather(events: DataFrame) -> DataFrame:
    """Enrichment log with two rows per claim, some failed, some of another source."""
    payload = F.to_json(
        F.struct(
            F.get_json_object("props", "$.k").cast("double").alias("wind_speed_mph"),
            (F.col("value") / 200).alias("precipitation_inches"),
            F.col("event_type").alias("conditions_summary"),
        )
    )
    return events.select(
        F.floor(F.col("event_id") / 2).cast("bigint").alias("claim_id"),
        F.when(F.col("event_type") == "signup", "geocoding").otherwise("weather").alias("enrichment_source"),
        payload.alias("enrichment_data"),
        F.col("ts").alias("enrichment_timestamp"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("api_status"),
    )


def feedback(orders: DataFrame) -> DataFrame:
    """Raw reviewer feedback, one row per order."""
    key = F.col("o_orderkey")
    verdicts = "APPROVE,REVIEW,INVESTIGATE,DENY"
    shift = F.when(key % 5 == 0, 1).otherwise(0)
    return orders.select(
        key.alias("feedback_id"),
        key.alias("claim_id"),
        _pick(verdicts, key % 4).alias("agent_recommendation"),
        _pick(verdicts, (key + shift) % 4).alias("adjuster_decision"),
        (key % 7).cast("int").alias("raw_rating"),
        F.col("o_orderdate").cast("timestamp").alias("feedback_timestamp"),
        F.when(key % 11 != 0, (key % 480).cast("double") / 10).alias("time_to_decision_hours"),
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table that is one small file; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, 16) else df


class Views:
    """Lazy frames over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def claimants(self) -> DataFrame:
        return claimants(self.table("customer"), self.table("nation"))

    @cached_property
    def policies(self) -> DataFrame:
        return policies(self.table("customer"))

    @cached_property
    def claims(self) -> DataFrame:
        return claims(spread(self.table("orders"), "o_orderkey"))

    @cached_property
    def weather(self) -> DataFrame:
        return weather(self.table("events"))

    @cached_property
    def feedback(self) -> DataFrame:
        return feedback(self.table("orders"))

    @cached_property
    def enriched(self) -> DataFrame:
        return silver.enrich(self.claims, self.policies, self.claimants)

    @cached_property
    def dated(self) -> DataFrame:
        """Enriched claims with the temporal features: all the gold aggregates need."""
        return silver.temporal_features(self.enriched)

    @cached_property
    def silver(self) -> DataFrame:
        return silver.build(self.claims, self.policies, self.claimants)

    @cached_property
    def cases(self) -> DataFrame:
        """Silver without claimant attributes: all that scoring and adjudication need."""
        return silver.build(self.claims, self.policies)

    @cached_property
    def features(self) -> DataFrame:
        return silver.feature_table(self.cases)
