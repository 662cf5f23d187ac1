"""Rolling up stored histograms, statistic sets and digests side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from widemetrics.functions import seh, statset
from widemetrics.operators import digests

#: A part of a stored value: which column it is of, what it is merged by, and what it adds.
_PART = (
    "struct<column:int,cell:double,bound:bigint,n:bigint,total:double,low:double,high:double,"
    "set:struct<minimum:double,maximum:double,samplesum:double,samplecount:bigint>>"
)


def mergeable(df: DataFrame) -> dict[str, str]:
    """Which columns of df hold histograms, statistic sets or digests: kind by name."""
    kinds = {}
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, MapType):
            kinds[field.name] = "histogram"
        elif isinstance(kind, StructType) and "samplecount" in kind.names:
            kinds[field.name] = "statistic_set"
        elif isinstance(kind, StructType) and "centroids" in kind.names:
            kinds[field.name] = "digest"
    return kinds


def _part(
    column: int, cell: Column | None = None, bound: Column | None = None, n: Column | None = None,
    total: Column | None = None, low: Column | None = None, high: Column | None = None,
    own: Column | None = None,
) -> Column:
    values = (F.lit(column), cell, bound, n, total, low, high, own)
    return F.struct(*[F.lit(None) if v is None else v for v in values]).cast(_PART)


def _parts(df: DataFrame, column: int, name: str, kind: str) -> Column:
    """The parts of a stored value, as an array."""
    col = F.col(name)
    none = F.array().cast(f"array<{_PART}>")
    if kind == "statistic_set":
        return F.array(_part(column, own=col))
    if kind == "histogram":
        # Whole bounds keep all their digits.
        place = "bound" if _is_whole(df, name) else "cell"
        entries = F.transform(F.map_entries(col), lambda e: _part(column, n=e["value"], **{place: e["key"]}))
        return F.coalesce(entries, none)
    bounds = digests.has_bounds(df, name)

    def centroid(c: Column, at: Column) -> Column:
        low, high = digests.ends_of(c, at, col, bounds)
        mean = c["mean"]
        weight = c["weight"]
        return _part(column, digests.cell(mean), n=weight, total=mean * weight, low=low, high=high)

    return F.coalesce(F.transform(col["centroids"], centroid), none)


def _is_whole(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.keyType.simpleString() == "bigint"


def _centroids(cells: DataFrame, own: Sequence[str], of: Sequence[int]) -> DataFrame:
    """Cells with those of digest columns put together into centroids."""
    by_cell = Window.partitionBy(*own).orderBy("cell")
    upto = F.sum("n").over(by_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("n").over(Window.partitionBy(*own))
    bucket = digests.scale_bucket(upto - F.col("n") / 2, whole).cast("double")
    is_digest = F.col("column").isin(*of)
    placed = cells.select("*", F.when(is_digest, bucket).otherwise(F.col("cell")).alias("kb"))
    # By the same hash of keys and column.
    return placed.groupBy(*own, "kb", "bound").agg(
        F.sum("n").cast("bigint").alias("weight"),
        F.sum("total").alias("total"),
        (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        statset.merge("set").alias("set"),
    )


def merge(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key with all its stored values merged: histograms, statistic sets, digests.

    ``columns`` are those of such a type unless given. Each value is taken apart
    into buckets, fine cells of centroids, or the set itself, under the number
    of its column. All parts are combined per (keys, column, bucket or cell) in
    one partial aggregate, so the input is read once and shuffled once, and a key
    with a third of all rows sends each of its buckets once a task. What follows
    sees those alone. A NULL value adds nothing; a key whose values are all NULL
    has empty ones.
    """
    kinds = mergeable(df)
    names = list(kinds) if columns is None else list(columns)
    if all(kinds[name] == "statistic_set" for name in names):
        # Sets are merged as they are.
        return df.groupBy(*keys).agg(*[statset.merge(name).alias(name) for name in names])
    arrays = [_parts(df, i, name, kinds[name]) for i, name in enumerate(names)]
    each = df.select(*keys, F.inline(F.concat(F.array(_part(-1)), *arrays)))
    own = [*keys, "column"]
    cells = each.groupBy(*own, "cell", "bound").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        statset.merge("set").alias("set"),
    )
    if "digest" in map(kinds.get, names):
        merged = _centroids(cells, own, [i for i, name in enumerate(names) if kinds[name] == "digest"])
    else:
        merged = cells.withColumnsRenamed({"cell": "kb", "n": "weight"})
    results = []
    for i, name in enumerate(names):
        mine = F.col("column") == i
        if kinds[name] == "histogram":
            bound = F.col("bound" if _is_whole(df, name) else "kb")
            pair = F.struct(bound.alias("bucket"), F.col("weight").alias("n"))
            value = seh.from_pairs(F.collect_list(F.when(mine & bound.isNotNull(), pair)))
        elif kinds[name] == "statistic_set":
            value = statset.merge(F.when(mine, F.col("set")))
        else:
            value = digests.digest_of(mine, digests.has_bounds(df, name))
        results.append(value.alias(name))
    return merged.groupBy(*keys).agg(*results)
