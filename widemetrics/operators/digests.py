"""Building and merging t-digests without sorting raw rows.

A digest needs its input in order of value. Sorting all rows of a key in one
task does not hold up when a key owns a third of the data, so values are
first counted in very fine cells (2**-12 of their magnitude wide). That step
is a plain groupBy with map-side combine: what is shuffled and sorted is
bounded by the number of distinct cells, about 4096 for each doubling between
the smallest and the largest value, however many rows there are. A cell keeps
its exact sum and count, so the digest's count, sum, minimum and maximum are
exact; a quantile is off by at most one cell's width beyond the usual error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 100
CELL_BITS = 12


def cell(value: Column, bits: int = CELL_BITS) -> Column:
    """Lower edge of the fine cell that holds a number.

    Scaling by a power of two is exact, so equal edges are bit-equal.
    """
    exponent = F.floor(F.log2(F.abs(F.nullif(value, F.lit(0.0)))))
    scale = F.pow(F.lit(2.0), F.lit(bits) - exponent)
    back = F.pow(F.lit(2.0), exponent - F.lit(bits))
    edge = F.floor(value * scale) * back
    # Zero, and magnitudes whose scale is not a finite double, stand alone.
    return F.when((scale > 0) & (scale < F.lit(float("inf"))) & (back > 0), edge).otherwise(value)


def scale_bucket(rank: Column, count: Column, max_buckets: int = MAX_BUCKETS) -> Column:
    """Number of the centroid that takes what lies at ``rank`` of ``count``.

    The arcsine scale makes centroids narrow at both ends, wide in the middle.
    """
    q = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * (rank / count) - 1))
    return F.floor(F.lit(max_buckets) / F.pi() * (F.asin(q) + F.pi() / 2)).cast("bigint")


def centroid_rows(
    df: DataFrame,
    keys: Sequence[str],
    mean: Column,
    weight: Column,
    low: Column,
    high: Column,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """Rows (keys, kb, mean, weight, total, low, high), one per centroid.

    ``mean`` and ``weight`` describe the input points, ``low`` and ``high`` the
    range each stands for. A key with no points keeps one row with a NULL kb.
    """
    cells = (
        df.select(*keys, mean.alias("__mean"), weight.alias("__w"), low.alias("__lo"), high.alias("__hi"))
        .groupBy(*keys, cell(F.col("__mean")).alias("__cell"))
        .agg(
            F.sum(F.col("__mean") * F.col("__w")).alias("__total"),
            F.coalesce(F.sum("__w"), F.lit(0)).cast("bigint").alias("__w"),
            F.min("__lo").alias("__lo"),
            F.max("__hi").alias("__hi"),
        )
    )
    by_value = Window.partitionBy(*keys).orderBy(F.col("__cell").asc_nulls_first())
    upto = by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    # Both windows and both groupings below use the same hash partitioning.
    placed = cells.withColumn("__upto", F.sum("__w").over(upto)).withColumn(
        "__n", F.sum("__w").over(whole)
    )
    middle = F.col("__upto") - F.col("__w") / 2
    kb = F.when(F.col("__cell").isNotNull(), scale_bucket(middle, F.col("__n"), max_buckets))
    return (
        placed.groupBy(*keys, kb.alias("kb"))
        .agg(
            (F.sum("__total") / F.nullif(F.sum("__w"), F.lit(0))).alias("mean"),
            F.sum("__w").cast("bigint").alias("weight"),
            F.sum("__total").alias("total"),
            F.min("__lo").alias("low"),
            F.max("__hi").alias("high"),
        )
    )


def digest_of(own: Column, bounds: bool = False, max_buckets: int = MAX_BUCKETS) -> Column:
    """One digest from the centroid rows where ``own`` holds; an aggregate."""
    parts = ["mean", "weight", *["low", "high"] * bounds]
    centroid = F.when(own & F.col("kb").isNotNull(), F.struct(*parts))
    weight, total, low, high = (F.when(own, F.col(c)) for c in ("weight", "total", "low", "high"))
    return F.struct(
        F.lit(max_buckets).alias("max_buckets"),
        F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(F.sum(total), F.lit(0.0)).alias("sum"),
        F.min(low).alias("min"),
        F.max(high).alias("max"),
        F.sort_array(F.collect_list(centroid)).alias("centroids"),
    )


def fold(
    rows: DataFrame, keys: Sequence[str], name: str, max_buckets: int = MAX_BUCKETS, bounds: bool = False
) -> DataFrame:
    """One digest per key from centroid rows."""
    return rows.groupBy(*keys).agg(digest_of(F.lit(True), bounds, max_buckets).alias(name))


def has_bounds(df: DataFrame, col: str) -> bool:
    """Whether the centroids of a digest column carry the range of what they stand for."""
    return "low" in df.schema[col].dataType["centroids"].dataType.elementType.names


def points(df: DataFrame, keys: Sequence[str], col: str, invalid: str = "raise") -> DataFrame:
    """Centroid rows of a number column; NULLs are skipped, NaN and infinity raise."""
    value = F.col(col).cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    refuse = F.lit(None).cast("double")
    if invalid == "raise":
        refuse = F.raise_error(F.lit("NaN and infinity have no place in a digest")).cast("double")
    value = F.when(bad, refuse).otherwise(value)
    source = df.withColumn("__v", value)
    v = F.col("__v")
    return centroid_rows(source, keys, v, F.when(v.isNotNull(), F.lit(1)), v, v)


def accumulate(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    name: str = "digest",
    invalid: str = "raise",
    bounds: bool = False,
) -> DataFrame:
    """Numbers to one digest per key.

    With ``bounds`` each centroid keeps the least and the largest number it
    stands for, through merges too. Then digest.rank_bounds and
    digest.quantile_bounds say how far off an estimate can be at most.
    """
    return fold(points(df, keys, col, invalid), keys, name, bounds=bounds)


def ends_of(centroid: Column, at: Column, d: Column, bounds: bool) -> tuple[Column, Column]:
    """The range of the centroid at this place of a digest. Without ranges of their own the first
    centroid has the digest's, which keeps its extremes."""
    if bounds:
        return centroid["low"], centroid["high"]
    return F.when(at == 0, d["min"]), F.when(at == 0, d["max"])


def merge(df: DataFrame, keys: Sequence[str], col: str, name: str = "digest") -> DataFrame:
    """Digests to one digest per key; centroids keep the ranges they have."""
    bounds = has_bounds(df, col)
    exploded = df.select(
        *keys, F.col(col).alias("__d"), F.posexplode_outer(F.col(col)["centroids"]).alias("__pos", "__c")
    )
    at, centroid = F.coalesce(F.col("__pos"), F.lit(0)), F.col("__c")
    low, high = ends_of(centroid, at, F.col("__d"), bounds)
    rows = centroid_rows(exploded, keys, centroid["mean"], centroid["weight"], low, high)
    return fold(rows, keys, name, bounds=bounds)
