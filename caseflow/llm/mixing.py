"""Mixing sources to target weights, in DataFrame operations only.

Sizes are aggregated per source, targets follow from weights, and every document is emitted
floor(rate) times plus once more with a probability of the fraction, decided by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import SPACE, free, replace_columns
from caseflow.session import cut_lineage

SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    pieces = F.size(F.split(text, SPACE, -1))
    outside = text.rlike(f"^{SPACE}").cast("int") + text.rlike(f"{SPACE}\\z").cast("int")
    return F.when(F.length(text) > 0, (pieces - outside).cast("long")).otherwise(F.lit(0).cast("long"))


def with_sizes(docs: DataFrame) -> DataFrame:
    return replace_columns(docs, {"size": word_count(F.col("text").cast("string"))})


def targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate), one row per source of ``sized`` (source, size).

    Sources in code point order, NULL last, weigh ``weights`` over and over, and share ``share``
    times all sizes. No target exceeds ``most`` times its source; the excess is shared again by
    weight until none does. One pair of sums over the source table comes to the driver per round.
    The rank is a window over one row per source, not over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut_lineage(
        sized.groupBy("source")
        .agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
        .withColumn("weight", F.get(pattern, place % len(weights)))
    )
    ceiling = most * F.col("source_size")
    total, level, full = None, 0.0, -1
    while True:
        at_most = ceiling <= level * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.count(F.when(at_most, 1)).alias("full"),
            F.coalesce(F.sum(F.when(at_most, ceiling)), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~at_most, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        total = share * (row["total"] or 0)
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (total - row["given"]) / row["open"]
    target = F.least(ceiling, F.lit(float(level)) * F.col("weight"))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    return sources.withColumn("target", target).withColumn("rate", rate).drop("weight")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the key only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def plan(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """``sized`` (doc_id, source, size, anything else) with source_size, target, rate and copies.

    * NULL source: a source of its own. NULL doc_id: all such rows draw the same number.
    * Repeated rows draw the same number, so they are all taken equally often.
    * A source whose documents are all empty has target and copies 0. An empty table stays empty.
    * Columns named like the new ones give way.
    """
    names = ["source_size", "target", "rate"]
    of, *own = free(sized, "_source", *[f"_{n}" for n in names])
    rates = targets(sized, weights, share, most)
    rates = rates.select(F.col("source").alias(of), *[F.col(n).alias(o) for n, o in zip(names, own)])
    joined = sized.join(rates, sized["source"].eqNullSafe(rates[of]), "left")
    rate = F.col(own[-1])
    whole = F.floor(rate)
    copies = whole + (draw(F.col("doc_id"), seed) < rate - whole).cast("long")
    new = {n: F.col(o) for n, o in zip(names, own)} | {"copies": copies}
    return replace_columns(joined, new).drop(of, *own)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """The documents (doc_id, text, source, anything else), each row as often as its plan says.

    NULL and empty texts have size 0 and a copy by the rate of their source like any other; NULL sources are one
    source; repeated rows are taken equally often; an empty table stays empty; other columns keep their
    values, whatever their names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = F.struct(*columns).alias("_row")
    sized = docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"), kept)
    planned = plan(sized, weights, share, most, seed).filter("copies > 0")
    repeated = planned.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return repeated.select("_row.*")
