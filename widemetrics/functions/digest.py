"""t-digest values: text form and quantile estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from widemetrics.functions.text import plain_number


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_text(col: Column | str) -> Column:
    """``(version:1,max_buckets:100,count:..,sum:..,min:..,max:..,centroids:[..])``."""
    col = _col(col)
    centroids = F.array_join(
        F.transform(
            col["centroids"],
            lambda c: F.concat(
                F.lit("(mean:"),
                plain_number(c["mean"]),
                F.lit(",weight:"),
                c["weight"].cast("string"),
                F.lit(")"),
            ),
        ),
        ",",
    )
    return F.concat(
        F.lit("(version:1,max_buckets:"),
        col["max_buckets"].cast("string"),
        F.lit(",count:"),
        col["count"].cast("string"),
        F.lit(",sum:"),
        plain_number(col["sum"]),
        F.lit(",min:"),
        plain_number(col["min"]),
        F.lit(",max:"),
        plain_number(col["max"]),
        F.lit(",centroids:["),
        centroids,
        F.lit("])"),
    )


def quantile(col: Column | str, q: float | Column) -> Column:
    """Estimate the q-quantile by straight lines between centroid middles.

    The line starts at the digest's minimum and ends at its maximum.
    """
    if not isinstance(q, Column) and not 0.0 <= q <= 1.0:
        raise ValueError("q must lie between 0 and 1")
    col = _col(col)
    target = (q if isinstance(q, Column) else F.lit(q)) * col["count"]
    number = "cast(null as double)"
    start = F.struct(
        F.lit(0).cast("bigint").alias("seen"),
        F.lit(0.0).alias("left_rank"),
        col["min"].alias("left_mean"),
        F.expr(number).alias("found"),
    )

    def line(left_rank: Column, left: Column, right_rank: Column, right: Column) -> Column:
        share = F.when(right_rank <= left_rank, F.lit(1.0)).otherwise(
            (target - left_rank) / (right_rank - left_rank)
        )
        return left + (right - left) * share

    def step(acc: Column, c: Column) -> Column:
        middle = acc["seen"] + c["weight"] / 2
        inside = acc["found"].isNull() & (target <= middle)
        found = F.when(inside, line(acc["left_rank"], acc["left_mean"], middle, c["mean"]))
        return F.struct(
            (acc["seen"] + c["weight"]).cast("bigint").alias("seen"),
            middle.alias("left_rank"),
            c["mean"].alias("left_mean"),
            F.coalesce(acc["found"], found).alias("found"),
        )

    def finish(acc: Column) -> Column:
        tail = line(
            acc["left_rank"], acc["left_mean"], acc["seen"].cast("double"), col["max"]
        )
        return F.coalesce(acc["found"], tail)

    estimate = F.aggregate(col["centroids"], start, step, finish)
    return F.when(col["count"] > 0, estimate)


def rank_bounds(col: Column | str, value: Column) -> Column:
    """(lower, upper): how many of the digest's numbers are at most ``value``, for certain and
    perhaps. For digests whose centroids carry their ranges."""
    col = _col(col)

    def weight(which: str) -> Column:
        return F.aggregate(
            col["centroids"],
            F.lit(0).cast("bigint"),
            lambda acc, c: acc + F.when(c[which] <= value, c["weight"]).otherwise(F.lit(0).cast("bigint")),
        )

    return F.struct(weight("high").alias("lower"), weight("low").alias("upper"))


def quantile_bounds(col: Column | str, q: float | Column) -> Column:
    """(low, high): between what numbers the one at rank ceil(q * count) lies, ranks from 1.

    NULL for an empty digest. For digests whose centroids carry their ranges.
    """
    col = _col(col)
    share = q if isinstance(q, Column) else F.lit(q)
    rank = F.greatest(F.lit(1).cast("bigint"), F.ceil(share * col["count"]))
    nothing = F.struct(F.lit(0).cast("bigint").alias("seen"), F.expr("cast(null as double)").alias("found"))

    def walk(which: str, found: Callable[[Column, Column, Column], Column]) -> Column:
        ends = F.array_sort(
            F.transform(col["centroids"], lambda c: F.struct(c[which].alias("end"), c["weight"].alias("weight")))
        )
        return F.aggregate(
            ends,
            nothing,
            lambda acc, c: F.struct(
                (acc["seen"] + c["weight"]).alias("seen"), found(acc, c, acc["seen"] + c["weight"]).alias("found")
            ),
            lambda acc: acc["found"],
        )

    # Fewer than rank numbers can lie below the one, and rank numbers lie at or below the other.
    low = walk("low", lambda acc, c, _: F.when(acc["seen"] < rank, c["end"]).otherwise(acc["found"]))
    high = walk("high", lambda acc, c, upto: F.coalesce(acc["found"], F.when(upto >= rank, c["end"])))
    return F.when(col["count"] > 0, F.struct(low.alias("low"), high.alias("high")))
