"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widemetrics.llm.common import free_name, named, partitions, saved

#: Up to so many sources their rates are sent to every task; beyond, they are joined.
BROADCAST_SOURCES = 10_000

#: exp(-rate) stays well above the smallest double up to this; larger rates are
#: drawn as the sum of several independent parts.
PART_RATE = 200.0


def target_rates(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    alpha: float = 0.5,
    by: str = "source",
    text: str = "text",
) -> DataFrame:
    """(source, size, rate): how often each source's documents are to be repeated on average.

    size is the source's UTF-8 bytes of text. The targets are the given
    weights, or size ** alpha (0: all sources alike, 1: as they are). A rate is
    the source's share of the targets over its share of the bytes, so the
    expected volume stays that of the input. A source that is not in weights
    has weight 0 and goes; one without any text has rate 1, as it has no volume
    to steer. Where no source with text has a weight above 0, all such sources
    go. Weights that are negative or no numbers raise ValueError, and so does an
    alpha that takes sizes beyond the range of doubles. A null source is a
    source like any other.
    """
    if not math.isfinite(alpha):
        raise ValueError(f"alpha is no number: {alpha}")
    for name, weight in (weights or {}).items():
        if not (math.isfinite(weight) and weight >= 0):
            raise ValueError(f"the weight of {name} is {weight}")
    sizes = docs.groupBy(F.col(by).alias("source")).agg(
        F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("size")
    )
    if weights is None:
        target = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        target = F.lit(None).cast("double")
        for name, weight in weights.items():
            named = F.col("source").eqNullSafe(F.lit(name))
            target = F.when(named & (F.col("size") > 0), F.lit(float(weight))).otherwise(target)
    # A row for each source; the documents are read once for them.
    parts = saved(sizes.withColumn("target", F.coalesce(target, F.lit(0.0))), "source-sizes")
    total = parts.agg(F.sum("size").alias("size"), F.sum("target").alias("target")).first()
    all_size, all_target = float(total["size"] or 0), float(total["target"] or 0)
    if weights is None and all_size and not 0 < all_target < math.inf:
        raise ValueError(f"alpha {alpha} gives targets beyond what a double holds")
    rate = F.lit(0.0)
    if all_target > 0:
        rate = F.col("target") / F.lit(all_target) * F.lit(all_size) / F.col("size")
    return parts.select(
        "source", "size", F.when(F.col("size") > 0, rate).otherwise(1.0).alias("rate")
    )


def _cumulative(rate: Column) -> Column:
    """The distribution function of a Poisson variable, until it no longer grows."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(
        F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("out")
    )

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(
            p.alias("p"),
            (acc["sum"] + p).alias("sum"),
            F.concat(acc["out"], F.array(acc["sum"] + p)).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["out"])


def _uniform(*seeds: Column) -> Column:
    """52 hashed bits as a number above 0 and below 1."""
    digits = F.substring(F.md5(F.concat_ws("|", *seeds)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def replicate(
    docs: DataFrame,
    rates: DataFrame,
    seed: int = 0,
    by: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """Each document as often as a Poisson number with its source's rate says, shuffled.

    A hash of seed and key gives a uniform number; the count is the Poisson
    distribution function inverted there, so a rerun gives the same counts and
    rows with one key share a count. The result has docs' columns, copy (0 to
    n_copies - 1), n_copies and shuffle_key; names that docs has already get a
    _ behind. Rows are dealt out and sorted by shuffle_key, a hash of the copy:
    read in order of files and rows, they are in random order.

    A null key is hashed as the empty text. Sources are matched null-safe; a
    source without a rate goes. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    copy, copies, order = (free_name(docs, n) for n in ("copy", "n_copies", "shuffle_key"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int")
    drawn = rates.select("source", parts.alias("parts"), (F.col("rate") / parts).alias("part_rate"))
    drawn = drawn.select("source", "parts", _cumulative(F.col("part_rate")).alias("cdf"))
    known = drawn.limit(BROADCAST_SOURCES + 1).collect()
    if len(known) <= BROADCAST_SOURCES:
        drawn = F.broadcast(spark.createDataFrame(known, drawn.schema))

    doc_key = F.coalesce(F.col(f"row.{key}").cast("string"), F.lit(""))
    joined = docs.select(F.struct(*named(docs.columns)).alias("row")).join(
        drawn, F.col(f"row.{by}").eqNullSafe(F.col("source"))
    )

    def one_part(total: Column, i: Column) -> Column:
        u = _uniform(F.lit(str(seed)), doc_key, i.cast("string"))
        return total + F.size(F.filter("cdf", lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), one_part)
    counted = joined.select("row", count.cast("bigint").alias("n")).filter("n > 0")
    exploded = counted.select(
        "row", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i")
    )
    digits = F.substring(
        F.md5(F.concat_ws("|", F.lit(str(seed)), doc_key, F.lit("copy"), F.col("i").cast("string"))),
        1,
        15,
    )
    placed = exploded.withColumn("at", F.conv(digits, 16, 10).cast("bigint"))
    return (
        placed.repartition(partitions(spark), "at")
        .sortWithinPartitions("at")
        .select("row.*", F.col("i").alias(copy), F.col("n").alias(copies), F.col("at").alias(order))
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5,
        seed: int = 0) -> DataFrame:
    """replicate() with the rates that bring docs' sources to their target weights."""
    return replicate(docs, target_rates(docs, weights, alpha), seed)
