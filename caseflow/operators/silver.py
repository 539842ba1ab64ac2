"""Enrichment joins and feature engineering (SLV-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.functions.features import count_where, flag, ratio
from caseflow.operators import ranking
from caseflow.sources import dims, store

CLAIM_COLUMNS = (
    "claim_id policy_id claimant_id claim_type incident_date filing_date claim_amount description "
    "diagnosis_code procedure_code status is_fraud"
).split()
POLICY_COLUMNS = "insurance_provider policy_limit deductible premium_annual policy_start_date policy_end_date".split()
PERSON_COLUMNS = "first_name last_name full_name date_of_birth email_domain address_state".split()
METADATA_COLUMNS = ["_ingestion_timestamp", "_source_system"]

# The 28 model features, in table order.
FEATURES = (
    "days_to_file days_since_policy_start days_until_policy_end incident_month incident_day_of_week "
    "is_weekend_incident claim_amount claim_to_limit_ratio claim_to_premium_ratio claim_exceeds_limit "
    "claim_near_limit claim_sequence_num is_first_claim total_claims_count avg_claim_amount max_claim_amount "
    "prior_fraud_count provider_count rapid_filing delayed_filing policy_new_incident policy_expiring_soon "
    "frequent_claimant high_value_claimant has_prior_fraud description_length description_word_count "
    "has_medical_code"
).split()

WEATHER_COLUMNS = {
    "weather_temp_max_f": "float",
    "weather_temp_min_f": "float",
    "weather_precipitation_in": "float",
    "weather_wind_speed_mph": "float",
    "weather_conditions": "string",
    "weather_api_timestamp": "string",
}


def mask_pii(df: DataFrame, strict: bool = False) -> DataFrame:
    """SLV-2: full name and e-mail domain instead of e-mail and phone; ``strict`` drops names and birth date too."""
    masked = df.withColumns(
        {
            "full_name": F.concat("first_name", F.lit(" "), "last_name"),
            "email_domain": F.regexp_extract("email", "@(.+)", 1),
        }
    ).drop("email", "phone")
    return masked.drop("first_name", "last_name", "date_of_birth") if strict else masked


def with_policy(
    claims: DataFrame, policies: DataFrame, extra: dict[str, str] | None = None, marked: bool = False
) -> DataFrame:
    """Claims with their policy terms; claims without a policy are kept.

    ``extra`` asks for more policy columns under a new name each, ``marked`` for ``policy_found``.
    """
    terms = policies.select(
        "policy_id",
        F.col("provider").alias("insurance_provider"),
        "policy_limit",
        "deductible",
        "premium_annual",
        F.col("start_date").alias("policy_start_date"),
        F.col("end_date").alias("policy_end_date"),
        *[F.col(column).alias(name) for column, name in (extra or {}).items()],
        *([F.lit(True).alias("policy_found")] if marked else []),
    )
    metadata = [c for c in METADATA_COLUMNS if c in claims.columns]
    joined = claims.select(*CLAIM_COLUMNS, *metadata).join(terms, "policy_id", "left")
    return joined.withColumn("policy_found", F.coalesce("policy_found", F.lit(False))) if marked else joined


def _people(claimants: DataFrame) -> DataFrame:
    wanted = ["claimant_id", "first_name", "last_name", "date_of_birth", "email", "address_state"]
    return mask_pii(claimants.select(*wanted))


def _arrange(df: DataFrame) -> DataFrame:
    front = [c for c in [*CLAIM_COLUMNS, *POLICY_COLUMNS, *PERSON_COLUMNS] if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


def enrich(claims: DataFrame, policies: DataFrame, claimants: DataFrame) -> DataFrame:
    """SLV-1: claims with policy terms and masked claimant attributes; every claim is kept."""
    return _arrange(with_policy(claims, policies).join(_people(claimants), "claimant_id", "left"))


def temporal_features(df: DataFrame) -> DataFrame:
    """SLV-3."""
    incident, filing = F.col("incident_date"), F.col("filing_date")
    return df.withColumns(
        {
            "days_to_file": F.datediff(filing, incident),
            "days_since_policy_start": F.datediff(incident, "policy_start_date"),
            "days_until_policy_end": F.datediff("policy_end_date", incident),
            "incident_year": F.year(incident),
            "incident_month": F.month(incident),
            "incident_day_of_week": F.dayofweek(incident),
            "filing_year": F.year(filing),
            "filing_month": F.month(filing),
            "is_weekend_incident": flag(F.dayofweek(incident).isin(1, 7)),
        }
    )


def financial_features(df: DataFrame) -> DataFrame:
    """SLV-4."""
    amount, limit = F.col("claim_amount"), F.col("policy_limit")
    to_limit = ratio(amount, limit)
    return df.withColumns(
        {
            "claim_to_limit_ratio": to_limit,
            "claim_to_premium_ratio": ratio(amount, F.col("premium_annual")),
            "claim_exceeds_limit": flag(amount > limit),
            "claim_near_limit": flag(to_limit >= 0.9),
            "amount_category": F.when(amount < 5000, "Low")
            .when(amount < 20000, "Medium")
            .when(amount < 50000, "High")
            .otherwise("Very High"),
        }
    )


# Claims of one claimant from which on they are not handled by one task.
HOT_CLAIMS = 100_000


def hot_claimants(claims: DataFrame, most: int = HOT_CLAIMS) -> DataFrame:
    """Claimants (``_hot_id``, NULL included) with more than ``most`` claims: fewer than one row per
    ``most`` claims, usually none, so they may be broadcast."""
    counted = claims.groupBy("claimant_id").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most)
    return counted.select(F.col("claimant_id").alias("_hot_id"))


def _split(df: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(claims of ordinary claimants, claims of hot ones)."""
    hot = F.broadcast(hot_claimants(df) if hot is None else hot)
    same = F.col("claimant_id").eqNullSafe(F.col("_hot_id"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def _number(df: DataFrame) -> DataFrame:
    ordered = Window.partitionBy("claimant_id").orderBy("filing_date", ranking.tie_break("claim_id"), "claim_id")
    return df.withColumn("claim_sequence_num", F.row_number().over(ordered))


def _number_sliced(df: DataFrame) -> DataFrame:
    return ranking.with_rank(df, ["claimant_id"], "filing_date", "claim_id", "claim_sequence_num")


def _first(df: DataFrame) -> DataFrame:
    return df.withColumn("is_first_claim", flag(F.col("claim_sequence_num") == 1))


def claim_sequence(df: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """SLV-5: position of each claim in its claimant's filing order.

    Ordinary claimants are ranked by one window; the claims of hot ones are ranked in slices.
    """
    ordinary, sliced = _split(df, hot)
    numbered = _number_sliced(sliced).withColumn("claim_sequence_num", F.col("claim_sequence_num").cast("int"))
    return _first(_number(ordinary).unionByName(numbered))


def _totals(over=None) -> dict:
    """Aggregates of a claimant's claims, as such or over a window."""

    def made(column):
        return column if over is None else F.when(F.col("claimant_id").isNotNull(), column.over(over))

    amount = F.col("claim_amount")
    return {
        "total_claims_count": made(F.count(F.lit(1))),
        "total_claimed_amount": made(F.sum(amount)),
        "avg_claim_amount": made(F.avg(amount)),
        "max_claim_amount": made(F.max(amount)),
        "prior_fraud_count": made(count_where(F.col("is_fraud"))),
        "_providers": made(F.collect_set("insurance_provider")),
    }


def _counted(df: DataFrame) -> DataFrame:
    known = F.col("_providers").isNotNull()
    return df.withColumn("provider_count", F.when(known, F.size("_providers").cast("long"))).drop("_providers")


def claimant_totals(df: DataFrame) -> DataFrame:
    """Per-claimant totals over all claims of the claimant, combined before the shuffle."""
    return _counted(df.groupBy("claimant_id").agg(*[c.alias(n) for n, c in _totals().items()]))


def _total(df: DataFrame) -> DataFrame:
    return _counted(df.withColumns(_totals(Window.partitionBy("claimant_id"))))


def _total_sliced(df: DataFrame) -> DataFrame:
    # One row per hot claimant; a NULL claimant finds none.
    return df.join(F.broadcast(claimant_totals(df)), "claimant_id", "left")


def claimant_history(df: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """SLV-6: the claimant's totals on every claim, later claims and the claim itself included.

    Ordinary claimants get them in one window, without a join; hot ones from a broadcast table of
    one row each, so their claims stay where they are. ``hot`` spares counting ``df`` again.
    """
    ordinary, sliced = _split(df, hot)
    return _total(ordinary).unionByName(_total_sliced(sliced))


def history_before(df: DataFrame) -> DataFrame:
    """SLV-6, point in time: the claimant's totals over claims filed on earlier days only.

    What a model may know when a claim is filed: neither its own label nor later ones. Claims are added
    up per claimant and day first, so a claimant of any size is as many rows as days. Without
    claimant or filing date there is no history: NULL. No earlier claim: counts and sum are 0.
    """
    known = df.filter(F.col("claimant_id").isNotNull() & F.col("filing_date").isNotNull())
    who, day = F.col("claimant_id").alias("_who"), F.col("filing_date").alias("_day")
    # A provider counts on the day the claimant first has a claim with it, so running sums count providers.
    first_seen = (
        known.filter(F.col("insurance_provider").isNotNull())
        .groupBy(who, "insurance_provider")
        .agg(F.min("filing_date").alias("_day"))
        .groupBy("_who", "_day")
        .agg(F.count(F.lit(1)).alias("_new"))
    )
    daily = (
        known.groupBy(who, day)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("claim_amount").alias("_sum"),
            F.count("claim_amount").alias("_amounts"),
            F.max("claim_amount").alias("_max"),
            count_where(F.col("is_fraud")).alias("_frauds"),
        )
        .join(first_seen, ["_who", "_day"], "left")
    )
    earlier = Window.partitionBy("_who").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)

    def added(column):
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    before = daily.select(
        "_who",
        "_day",
        added("_n").alias("total_claims_count"),
        added("_sum").cast("double").alias("total_claimed_amount"),
        ratio(F.sum("_sum").over(earlier), F.sum("_amounts").over(earlier)).alias("avg_claim_amount"),
        F.max("_max").over(earlier).alias("max_claim_amount"),
        added("_frauds").alias("prior_fraud_count"),
        added("_new").alias("provider_count"),
    )
    same = (F.col("claimant_id") == F.col("_who")) & (F.col("filing_date") == F.col("_day"))
    return df.join(before, same, "left").drop("_who", "_day")


def risk_flags(df: DataFrame) -> DataFrame:
    """SLV-7: thresholds on earlier features; NULL never raises a flag."""
    return df.withColumns(
        {
            "rapid_filing": flag(F.col("days_to_file") <= 1),
            "delayed_filing": flag(F.col("days_to_file") > 30),
            "policy_new_incident": flag(F.col("days_since_policy_start") < 30),
            "policy_expiring_soon": flag(F.col("days_until_policy_end") < 30),
            "frequent_claimant": flag(F.col("total_claims_count") > 3),
            "high_value_claimant": flag(F.col("total_claimed_amount") > 100000),
            "has_prior_fraud": flag(F.col("prior_fraud_count") > 0),
        }
    )


def text_features(df: DataFrame) -> DataFrame:
    """SLV-8."""
    return df.withColumns(
        {
            "description_length": F.length("description"),
            "description_word_count": F.size(F.split("description", " ")),
            "has_medical_code": flag(F.col("diagnosis_code").isNotNull()),
        }
    )


def parse_weather(log: DataFrame) -> DataFrame:
    """SLV-9: successful weather calls, JSON read into columns, the latest per claim."""

    def number(path: str):
        return F.get_json_object("enrichment_data", path).try_cast("float")

    parsed = log.filter((F.col("enrichment_source") == "weather") & (F.col("api_status") == "success")).select(
        "claim_id",
        number("$.temperature_max_f").alias("weather_temp_max_f"),
        number("$.temperature_min_f").alias("weather_temp_min_f"),
        number("$.precipitation_inches").alias("weather_precipitation_in"),
        number("$.wind_speed_mph").alias("weather_wind_speed_mph"),
        F.get_json_object("enrichment_data", "$.conditions_summary").alias("weather_conditions"),
        F.col("enrichment_timestamp").cast("string").alias("weather_api_timestamp"),
    )
    return ranking.latest_by(parsed, "claim_id", ["weather_api_timestamp", *list(WEATHER_COLUMNS)[:5]])


def with_weather(df: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """SLV-10 and SRC-4: weather columns and flags, typed NULLs and 0 when there is no weather table."""
    if weather is None:
        joined = df.withColumns({c: F.lit(None).cast(t) for c, t in WEATHER_COLUMNS.items()})
    else:
        joined = df.join(weather, "claim_id", "left")
    return joined.withColumns(
        {
            "had_severe_weather": flag(
                (F.col("weather_precipitation_in") > 0.5) | (F.col("weather_wind_speed_mph") > 25)
            ),
            "weather_enriched": flag(F.col("weather_conditions").isNotNull()),
        }
    )


def with_coordinates(df: DataFrame, claimant_state: str, claim_state: str | None = None) -> DataFrame:
    """SLV-12: where to ask for the weather: the claimant's state, else the claim's, else the default."""
    choices = [F.col(c) for c in (claimant_state, claim_state) if c]
    placed = df.withColumn("lookup_state", F.coalesce(*choices, F.lit(dims.DEFAULT_STATE)))
    places = dims.state_coordinates(df.sparkSession).withColumnRenamed("state", "lookup_state")
    latitude, longitude = dims.DEFAULT_COORDINATES
    return placed.join(F.broadcast(places), "lookup_state", "left").fillna(
        {"latitude": latitude, "longitude": longitude}
    )


def build(
    claims: DataFrame,
    policies: DataFrame,
    claimants: DataFrame | None = None,
    weather: DataFrame | None = None,
    point_in_time: bool = False,
    hot: int = HOT_CLAIMS,
) -> DataFrame:
    """The whole silver table; without ``claimants``, the same less their attributes.

    Equal to chaining the single steps, but the claims are read twice only, for the count per
    claimant and for the rows, and move twice: by policy, then by claimant, where sequence, totals
    and attributes share one distribution. Claimants with more than ``hot`` claims go another
    way, which no ordinary data takes. ``point_in_time`` takes the totals of earlier days only.
    """
    ordinary, sliced = _split(claims, hot_claimants(claims, hot))
    whole, parts = _number(with_policy(ordinary, policies, marked=True)), with_policy(sliced, policies, marked=True)
    numbered = _number_sliced(parts).withColumn("claim_sequence_num", F.col("claim_sequence_num").cast("int"))
    if point_in_time:
        joined = history_before(whole.unionByName(numbered))
        if claimants is not None:
            joined = joined.join(_people(claimants), "claimant_id", "left")
    else:
        whole, numbered = _total(whole), _total_sliced(numbered)
        if claimants is not None:
            whole = whole.join(_people(claimants), "claimant_id", "left")
            numbered = numbered.join(_people(claimants), "claimant_id", "left")
        joined = whole.unionByName(numbered)
    return _finished(joined, weather)


def _finished(joined: DataFrame, weather: DataFrame | None) -> DataFrame:
    featured = text_features(risk_flags(financial_features(temporal_features(_first(joined)))))
    return _arrange(with_weather(featured, weather))


# Tables of a stage: claims of ordinary claimants in buckets of these, those of hot ones, and the claimants.
STAGED = ("staged_claims", "staged_hot_claims", "staged_claimants")


def stage(
    claims: DataFrame, policies: DataFrame, claimants: DataFrame, root: str, buckets: int, hot: int = HOT_CLAIMS
) -> None:
    """Store claims with their policy terms, and claimants, in the same buckets of claimants, for ``build_staged``.

    This is the last time that the claims move by claimant. One task reads a bucket, so claims of claimants with more
    than ``hot`` claims lie in a table without buckets. Policies and claims that are stored in the same
    buckets of policies are joined where they are.
    """
    ordinary, sliced = _split(claims, hot_claimants(claims, hot))
    by_claimant = {"bucket_by": ("claimant_id",), "buckets": buckets}
    store.save(with_policy(ordinary, policies, marked=True), root, STAGED[0], **by_claimant)
    store.save(with_policy(sliced, policies, marked=True), root, STAGED[1])
    store.save(_people(claimants), root, STAGED[2], **by_claimant)


def build_staged(spark: SparkSession, root: str, weather: DataFrame | None = None) -> DataFrame:
    """The rows of ``build``, from the tables of ``stage``: sequence, totals and attributes of ordinary claimants
    need no shuffle, since their claims and the claimants lie in the same buckets."""
    claims, hot, people = (store.load(spark, root, name) for name in STAGED)
    numbered = _number_sliced(hot).withColumn("claim_sequence_num", F.col("claim_sequence_num").cast("int"))
    whole = _total(_number(claims)).join(people, "claimant_id", "left")
    sliced = _total_sliced(numbered).join(people, "claimant_id", "left")
    return _finished(whole.unionByName(sliced), weather)


def feature_table(df: DataFrame) -> DataFrame:
    """SLV-13: key, label and the 28 model features."""
    return df.select("claim_id", "is_fraud", *FEATURES)
