"""Dashboard query shapes: recent rows, top-k, histogram panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widemetrics.functions.timefn import time_bucket
from widemetrics.operators import histograms
from widemetrics.schema import CHUNK_SECONDS


def time_range(
    df: DataFrame, lo: Column, hi: Column | None = None, time: str = "time", chunk: str = "chunk"
) -> DataFrame:
    """Rows with ``lo < time``, and ``time <= hi`` where given.

    A frame that still has its chunk column is also pruned by that.
    """
    out = df.where(F.col(time) > lo)
    if hi is not None:
        out = out.where(F.col(time) <= hi)
    if chunk in df.columns:
        seconds = lambda moment: F.unix_seconds(moment.cast("timestamp"))
        out = out.where(F.col(chunk) > seconds(lo) - CHUNK_SECONDS)
        if hi is not None:
            out = out.where(F.col(chunk) <= seconds(hi))
    return out


def latest(df: DataFrame, time: str = "time") -> Column:
    """The newest time in a frame as a literal, to stand for now.

    One row comes to the driver. A literal reaches the scan as a pushed filter,
    which the result of a subquery does not.
    """
    value = df.agg(F.max(time).alias("now")).first()["now"]
    return F.lit(value).cast(df.schema[time].dataType)


def top_k(df: DataFrame, by: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest ``by``; planned as take-ordered, with no full sort."""
    return df.orderBy(F.col(by).desc(), *tiebreak).limit(k)


def in_top_k(
    rows: DataFrame, ranked: DataFrame, key: str, by: str, k: int, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Rows whose key is among those of the k largest ``by`` in ``ranked``."""
    return rows.join(top_k(ranked, by, k, tiebreak).select(key), key, "left_semi")


def hist_panel(
    df: DataFrame,
    width: str,
    col: str,
    keys: Sequence[str] = (),
    time: str = "time",
    merged: bool = False,
    ordered: bool = True,
    **bucket_options: str,
) -> DataFrame:
    """Rows (time, keys.., bucket, count) per time bucket.

    Same as unfolding the histogram of each time bucket, but the histograms
    are never put together: the counts are the result. ``merged`` says that
    ``col`` holds histograms and not numbers; options are those of seh.bucket.
    """
    source = df.withColumn("__time", time_bucket(width, time))
    by = ["__time", *keys]
    counts = (
        histograms.merged_counts(source, by, col)
        if merged
        else histograms.bucket_counts(source, by, col, **bucket_options)
    ).where("__bucket is not null")
    out = counts.select(
        F.col("__time").alias("time"),
        *keys,
        F.col("__bucket").alias("bucket"),
        F.col("__n").alias("count"),
    )
    return out.orderBy("time", *keys, "bucket") if ordered else out


def multi_panel(
    df: DataFrame,
    width: str,
    histogram: Mapping[str, str],
    statistics: Mapping[str, str],
    keys: Sequence[str] = (),
    time: str = "time",
    **bucket_options: str,
) -> DataFrame:
    """Rows (time, keys.., histograms and statistic sets by name) per time bucket, in one pass."""
    source = df.withColumn("__time", time_bucket(width, time))
    out = histograms.accumulate_many(source, ["__time", *keys], histogram, statistics, **bucket_options)
    return out.withColumnRenamed("__time", "time")
