"""Statistic sets: (minimum, maximum, samplesum, samplecount) and their aggregates.

Every aggregate is a composition of built-in ones, so Spark plans it as a
partial and a final HashAggregate. Aggregating no rows gives the identity
(1E308, -1E308, 0, 0), never NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from widemetrics.functions.text import plain_number

# The identity's bounds.
EMPTY_MINIMUM = 1e308
EMPTY_MAXIMUM = -1e308


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _set(minimum: Column, maximum: Column, samplesum: Column, samplecount: Column) -> Column:
    return F.struct(
        F.least(F.lit(EMPTY_MINIMUM), minimum).alias("minimum"),
        F.greatest(F.lit(EMPTY_MAXIMUM), maximum).alias("maximum"),
        F.coalesce(samplesum, F.lit(0.0)).alias("samplesum"),
        F.coalesce(samplecount, F.lit(0)).cast("bigint").alias("samplecount"),
    )


def _average(samplesum: Column, samplecount: Column) -> Column:
    return F.when(samplecount == 0, F.lit(0.0)).otherwise(samplesum / samplecount)


def combine(left: Column | str, right: Column | str) -> Column:
    """Two statistic sets as one."""
    left, right = _col(left), _col(right)
    return _set(
        F.least(left["minimum"], right["minimum"]),
        F.greatest(left["maximum"], right["maximum"]),
        left["samplesum"] + right["samplesum"],
        left["samplecount"] + right["samplecount"],
    )


# Scalars over one set; NULL in, NULL out.


def avg(col: Column | str) -> Column:
    col = _col(col)
    return F.when(col.isNotNull(), _average(col["samplesum"], col["samplecount"]))


def minimum(col: Column | str) -> Column:
    return _col(col)["minimum"]


def maximum(col: Column | str) -> Column:
    return _col(col)["maximum"]


def total(col: Column | str) -> Column:
    return _col(col)["samplesum"]


def count(col: Column | str) -> Column:
    """A double, as the graphs that use it expect."""
    return _col(col)["samplecount"].cast("double")


def to_text(col: Column | str) -> Column:
    """``(min,max,sum,count)``."""
    col = _col(col)
    return F.when(
        col.isNotNull(),
        F.concat(
            F.lit("("),
            F.concat_ws(
                ",",
                plain_number(col["minimum"]),
                plain_number(col["maximum"]),
                plain_number(col["samplesum"]),
                col["samplecount"].cast("string"),
            ),
            F.lit(")"),
        ),
    )


def from_text(text: Column) -> Column:
    """Read ``(min,max,sum,count)`` back; NULL where it does not fit."""
    parts = F.split(F.regexp_extract(text, r"^\s*\((.*)\)\s*$", 1), ",")
    fields = [F.get(parts, F.lit(i)).try_cast("double") for i in range(3)]
    samplecount = F.get(parts, F.lit(3)).try_cast("bigint")
    whole = samplecount.isNotNull() & (F.size(parts) == 4)
    for field in fields:
        whole = whole & field.isNotNull()
    return F.when(
        whole,
        F.struct(
            fields[0].alias("minimum"),
            fields[1].alias("maximum"),
            fields[2].alias("samplesum"),
            samplecount.alias("samplecount"),
        ),
    )


# Aggregates; also usable with .over(window).


def accumulate(col: Column | str) -> Column:
    """Numbers to one statistic set; NULLs are skipped."""
    value = _col(col).cast("double")
    return _set(F.min(value), F.max(value), F.sum(value), F.count(value))


def merge(col: Column | str) -> Column:
    """Statistic sets to one statistic set."""
    col = _col(col)
    return _set(
        F.min(col["minimum"]),
        F.max(col["maximum"]),
        F.sum(col["samplesum"]),
        F.sum(col["samplecount"]),
    )


def merge_over(col: Column | str, window: WindowSpec) -> Column:
    """The sets of each row's frame as one statistic set."""
    col = _col(col)
    return _set(
        F.min(col["minimum"]).over(window),
        F.max(col["maximum"]).over(window),
        F.sum(col["samplesum"]).over(window),
        F.sum(col["samplecount"]).over(window),
    )


def min_agg(col: Column | str) -> Column:
    return F.least(F.lit(EMPTY_MINIMUM), F.min(_col(col)["minimum"]))


def max_agg(col: Column | str) -> Column:
    return F.greatest(F.lit(EMPTY_MAXIMUM), F.max(_col(col)["maximum"]))


def sum_agg(col: Column | str) -> Column:
    return F.coalesce(F.sum(_col(col)["samplesum"]), F.lit(0.0))


def count_agg(col: Column | str) -> Column:
    return F.coalesce(F.sum(_col(col)["samplecount"]), F.lit(0)).cast("double")


def avg_agg(col: Column | str) -> Column:
    """Mean of all samples, 0 where there are none."""
    return _average(sum_agg(col), count_agg(col))
