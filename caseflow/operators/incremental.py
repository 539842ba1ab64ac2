"""Gold tables kept up to date batch by batch (GLD-1 to GLD-5).

A batch of claims becomes one row of partial sums per group, which is appended to a table of states. Sums,
counts, least and greatest values merge in any order, numbers of different values as pairs of group and value.
Reading a gold table merges the states and finishes the averages and rates; the claims are not read again.
``fold`` replaces the states by their merged rows. A batch names its stream and number, so that one given
again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.features import flag
from caseflow.operators import gold
from caseflow.sources import store


@dataclass(frozen=True)
class Gold:
    """A gold table: its groups, what is kept of them, and how it is finished.

    ``means``, ``least``, ``most`` and ``different`` (numbers of different values) name the result and its column.
    """

    keys: dict[str, Column]
    sums: dict[str, Column]
    finish: Callable[[DataFrame, object], DataFrame]
    means: dict[str, str] = field(default_factory=dict)
    least: dict[str, str] = field(default_factory=dict)
    most: dict[str, str] = field(default_factory=dict)
    different: dict[str, str] = field(default_factory=dict)

    def merged(self) -> dict[str, Column]:
        """How partial columns are merged."""
        added = [*self.sums, *[f"{m}_{part}" for m in self.means for part in ("sum", "n")]]
        return {c: F.sum(c) for c in added} | {c: F.min(c) for c in self.least} | {c: F.max(c) for c in self.most}

    def partial(self, claims: DataFrame) -> DataFrame:
        """One row per group of a batch."""
        values = {c: F.sum(v) for c, v in self.sums.items()}
        for name, column in self.means.items():
            values |= {f"{name}_sum": F.sum(F.col(column).cast("double")), f"{name}_n": F.count(column)}
        values |= {c: F.min(v) for c, v in self.least.items()} | {c: F.max(v) for c, v in self.most.items()}
        return claims.groupBy(*self._keys()).agg(*[v.alias(c) for c, v in values.items()])

    def values(self, claims: DataFrame) -> DataFrame:
        """(group, which, value): the different values of a batch."""
        pairs = F.explode(
            F.array(*[F.struct(F.lit(n).alias("which"), F.col(c).cast("string").alias("value")) for n, c in self.different.items()])
        )
        rows = claims.select(*self._keys(), pairs.alias("pair"))
        return rows.select(*self.keys, "pair.which", "pair.value").filter("value is not null").distinct()

    def _keys(self) -> list[Column]:
        return [v.alias(k) for k, v in self.keys.items()]

    def merge(self, states: DataFrame) -> DataFrame:
        return states.groupBy(*self.keys).agg(*[v.alias(c) for c, v in self.merged().items()])

    def finished(self, states: DataFrame, values: DataFrame | None, as_of=None) -> DataFrame:
        """The gold table of all states."""
        rows = self.merge(states)
        if self.different:
            numbers = values.distinct().groupBy(*self.keys).agg(
                *[F.count_if(F.col("which") == name).alias(name) for name in self.different]
            )
            # Put together by grouping, for which NULL keys are equal; a join would lose them.
            both = rows.unionByName(numbers, allowMissingColumns=True)
            columns = [c for c in both.columns if c not in self.keys]
            rows = both.groupBy(*self.keys).agg(*[F.max(c).alias(c) for c in columns]).fillna(0, list(self.different))
        for name in self.means:
            rows = rows.withColumn(name, F.try_divide(f"{name}_sum", f"{name}_n")).drop(f"{name}_sum", f"{name}_n")
        return self.finish(rows, as_of)


def _one(condition: Column | None = None) -> Column:
    return F.lit(1) if condition is None else flag(condition)


def _of(condition: Column, column: str) -> Column:
    return F.when(condition, F.col(column)).otherwise(0.0)


def claims_summary() -> Gold:
    """GLD-1."""
    return Gold(
        keys={
            **{c: F.col(c) for c in ("claim_type", "insurance_provider", "address_state")},
            "incident_month": F.date_trunc("month", "incident_date").cast("date"),
        },
        sums={
            "total_claims": _one(),
            "total_claimed_amount": F.col("claim_amount"),
            "fraud_count": _one(F.col("is_fraud")),
            "approved_amount": _of(F.col("status") == "Approved", "claim_amount"),
            "denied_count": _one(F.col("status") == "Denied"),
        },
        means={"avg_claim_amount": "claim_amount", "avg_days_to_file": "days_to_file"},
        least={"min_claim_amount": "claim_amount"},
        most={"max_claim_amount": "claim_amount"},
        finish=gold.summary_rates,
    )


def claimant_profiles() -> Gold:
    """GLD-3."""
    return Gold(
        keys={c: F.col(c) for c in ("claimant_id", "full_name", "address_state")},
        sums={"lifetime_claims": _one(), "lifetime_claimed": F.col("claim_amount"), "fraud_claims_count": _one(F.col("is_fraud"))},
        means={"avg_claim_size": "claim_amount", "avg_filing_delay": "days_to_file"},
        least={"first_claim_date": "incident_date"},
        most={"max_claim_size": "claim_amount", "last_claim_date": "incident_date"},
        different={"unique_providers": "insurance_provider", "unique_claim_types": "claim_type"},
        finish=gold.profile_tiers,
    )


def provider_metrics() -> Gold:
    """GLD-4."""
    return Gold(
        keys={"insurance_provider": F.col("insurance_provider"), "quarter": F.date_trunc("quarter", "incident_date").cast("date")},
        sums={
            "total_claims": _one(),
            "total_exposure": F.col("claim_amount"),
            "fraud_losses": _of(F.col("is_fraud"), "claim_amount"),
            "fraud_count": _one(F.col("is_fraud")),
            "approved_count": _one(F.col("status") == "Approved"),
            "denied_count": _one(F.col("status") == "Denied"),
        },
        means={"avg_claim_size": "claim_amount", "avg_processing_time": "days_to_file"},
        different={"unique_claimants": "claimant_id"},
        finish=gold.provider_rates,
    )


def weekly_series() -> Gold:
    """GLD-5: a new batch may change weeks long past and the averages of the three after them."""
    return Gold(
        keys={"incident_week": F.date_trunc("week", "incident_date").cast("date"), "claim_type": F.col("claim_type")},
        sums={
            "claims_count": _one(),
            "total_amount": F.col("claim_amount"),
            "fraud_count": _one(F.col("is_fraud")),
            "approved_count": _one(F.col("status") == "Approved"),
        },
        means={"avg_amount": "claim_amount"},
        finish=gold.weekly_rates,
    )


def _tables(name: str) -> tuple[str, str]:
    return f"{name}_states", f"{name}_values"


def add(claims: DataFrame, root: str, name: str, table: Gold, batch: tuple[str, int]) -> None:
    """Add a batch of new claims to the states of the gold table ``name``. Batches of a stream come in order;
    one that was added already, or in part, is completed and otherwise changes nothing."""
    states, values = _tables(name)
    store.append(table.partial(claims), root, states, batch=batch)
    if table.different:
        store.append(table.values(claims), root, values, batch=batch)


def add_alerts(silver: DataFrame, root: str, name: str, batch: tuple[str, int], as_of=None) -> None:
    """GLD-2: alerts belong to single claims, so those of a batch are added as they are; ``store.load`` reads them."""
    store.append(gold.fraud_alerts(silver, as_of=as_of), root, name, batch=batch)


def current(spark: SparkSession, root: str, name: str, table: Gold, as_of=None) -> DataFrame:
    """The gold table of all batches so far."""
    states, values = _tables(name)
    return table.finished(store.load(spark, root, states), store.load(spark, root, values) if table.different else None, as_of)


def fold(spark: SparkSession, root: str, name: str, table: Gold) -> None:
    """Replace the states by their merged rows. Batches added meanwhile stay beside them."""
    states, values = _tables(name)
    for part, merge in ((states, table.merge), (values, DataFrame.distinct))[: 2 if table.different else 1]:
        base, _ = store.newest(spark, root, part)
        store.save(merge(store.load(spark, root, part)), root, part, base=base)


def refresh_stream(claims: DataFrame, root: str, name: str, table: Gold, checkpoint: str, stream: str) -> None:
    """Add the claims that arrived since the last run; ``stream`` names the feed this checkpoint belongs to."""
    (
        claims.writeStream.foreachBatch(lambda batch, number: add(batch, root, name, table, (stream, number)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
