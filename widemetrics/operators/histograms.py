"""Building, merging, unfolding and moving sparse histograms.

Counting happens per (keys, bucket) with map-side combine, so a key that
holds a large share of all rows still shuffles only its distinct buckets; the
maps are put together from those counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widemetrics.functions import seh, statset
from widemetrics.functions.timefn import slot_number, slot_start

_N = "__n"
_BUCKET = "__bucket"
_SLOT = "__slot"
_BLOCK = "__block"

#: Slots of a block of running counts; a longer frame is a block itself.
BLOCK_SLOTS = 1024

#: Frames so short are summed slot by slot.
FEW_SLOTS = 3


def bucket_counts(
    df: DataFrame, keys: Sequence[str | Column], col: str, **bucket_options: str
) -> DataFrame:
    """Rows (keys, __bucket, __n) for a number column; NULLs count under a NULL bucket."""
    value = seh.bucket(col, **bucket_options)
    return df.groupBy(*keys, value.alias(_BUCKET)).agg(F.count(F.lit(1)).alias(_N))


def merged_counts(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Rows (keys, __bucket, __n) for a histogram column.

    An empty or NULL histogram leaves one row with a NULL bucket, which keeps
    its keys in the result.
    """
    entries = df.select(*keys, F.explode_outer(col).alias(_BUCKET, _N))
    return entries.groupBy(*keys, _BUCKET).agg(F.sum(_N).cast("bigint").alias(_N))


def fold(counts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One histogram per key from (keys, __bucket, __n) rows; none is NULL."""
    pair = F.when(F.col(_BUCKET).isNotNull(), F.struct(_BUCKET, _N))
    return counts.groupBy(*keys).agg(seh.from_pairs(F.collect_list(pair)).alias(name))


def accumulate(
    df: DataFrame, keys: Sequence[str], col: str, name: str = "histogram", **bucket_options: str
) -> DataFrame:
    """Numbers to one MAP<DOUBLE,BIGINT> histogram per key."""
    return fold(bucket_counts(df, keys, col, **bucket_options), keys, name)


def accumulate_many(
    df: DataFrame,
    keys: Sequence[str],
    histograms: Mapping[str, str],
    statistics: Mapping[str, str],
    **bucket_options: str,
) -> DataFrame:
    """Several histograms and statistic sets per key, by name of result and column, in one pass.

    Each row gives one entry for each column. Entries are combined per (keys,
    column, bucket) before the one shuffle of raw rows; a statistic set is
    merged from the sets of its column's buckets.
    """
    columns = list(dict.fromkeys([*histograms.values(), *statistics.values()]))
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("__column"),
                F.col(c).cast("double").alias("__value"),
                (
                    seh.bucket(c, **bucket_options) if c in histograms.values() else F.lit(None)
                ).cast("double").alias(_BUCKET),
            )
            for i, c in enumerate(columns)
        ]
    )
    each = df.select(*keys, F.inline(entries))
    parts = each.groupBy(*keys, "__column", _BUCKET).agg(
        F.count("__value").alias(_N), statset.accumulate("__value").alias("__set")
    )
    results = []
    for name, c in histograms.items():
        own = (F.col("__column") == columns.index(c)) & F.col(_BUCKET).isNotNull()
        pairs = F.collect_list(F.when(own, F.struct(_BUCKET, _N)))
        results.append(seh.from_pairs(pairs).alias(name))
    for name, c in statistics.items():
        own = F.when(F.col("__column") == columns.index(c), F.col("__set"))
        results.append(statset.merge(own).alias(name))
    return parts.groupBy(*keys).agg(*results)


def merge(df: DataFrame, keys: Sequence[str], col: str, name: str = "histogram") -> DataFrame:
    """Histograms to one histogram per key."""
    return fold(merged_counts(df, keys, col), keys, name)


def buckets(df: DataFrame, col: str, keys: Sequence[str] = (), as_bigint: bool = False) -> DataFrame:
    """One row (keys, bucket, count) per bucket.

    ``as_bigint`` gives whole bounds and raises on a fractional one.
    """
    rows = df.select(*keys, F.explode(col).alias("bucket", "count"))
    if not as_bigint:
        return rows
    bound = F.col("bucket")
    whole = F.when(bound == F.floor(bound), bound.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("bucket is not whole: "), bound.cast("string"))).cast("bigint")
    )
    return rows.withColumn("bucket", whole)


def moving(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    col: str,
    slot_seconds: int,
    frame_slots: int,
    values: bool = False,
    name: str = "histogram",
    slot_name: str = "slot",
    **bucket_options: str,
) -> DataFrame:
    """A histogram over a moving frame: the slot and the ``frame_slots - 1`` before it.

    ``col`` holds histograms, or numbers where ``values`` is set. One row per
    (key, slot) that has input of its own, as a window over slots would give.

    Counts are taken per (key, slot, bucket) first. Each then enters the running
    count of its bucket at its slot and leaves it when the frame has passed by,
    whatever the frame's length. Running counts are kept within blocks of
    slots, so that a key spreads over tasks and a group is bounded by its block:
    a count goes to the block it enters in and, if another, to the one it
    leaves in, which starts from what it brought along. Only buckets whose count
    is not zero come out. In a frame of FEW_SLOTS at most, a count is added to
    each slot it covers, which needs no sort.
    """
    source = df.withColumn(_SLOT, slot_number(time, slot_seconds))
    counts = (
        bucket_counts(source, [*keys, _SLOT], col, **bucket_options)
        if values
        else merged_counts(source, [*keys, _SLOT], col)
    )
    if frame_slots <= FEW_SLOTS:
        return _spread(counts, keys, frame_slots).select(
            *keys, slot_start(_SLOT, slot_seconds).alias(slot_name), F.col("__histogram").alias(name)
        )
    width = max(frame_slots, BLOCK_SLOTS)
    slot, n = F.col(_SLOT), F.col(_N)
    gone = slot + frame_slots
    enters, leaves = slot_block(slot, width), slot_block(gone, width)
    sent = counts.select(
        *keys, _SLOT, _BUCKET, _N, F.explode(F.array_distinct(F.array(enters, leaves))).alias(_BLOCK)
    ).repartition(*keys, _BLOCK)
    block = F.col(_BLOCK)
    nothing = F.lit(0).cast("bigint")
    steps = F.array_compact(
        F.array(
            F.when(enters == block, _step(slot, n, F.lit(True), nothing)),
            F.when(leaves == block, _step(gone, -n, F.lit(False), F.when(enters == block, nothing).otherwise(n))),
        )
    )
    in_block = [*keys, _BLOCK]
    merged = (
        sent.select(*in_block, _BUCKET, F.inline(steps))
        .groupBy(*in_block, "__at", _BUCKET)
        .agg(
            F.sum("__step").alias("__step"),
            F.max("__own").alias("__own"),
            F.sum("__brought").alias("__brought"),
        )
    )
    # Slots with input of their own are numbered within the block; a step takes
    # effect from the first of them at or after it.
    of_slot = Window.partitionBy(*in_block, "__at").orderBy(F.desc("__own"))
    numbered = merged.withColumn(
        "__opens", (F.col("__own") & (F.row_number().over(of_slot) == 1)).cast("bigint")
    )
    of_block = Window.partitionBy(*in_block)
    earlier = of_block.orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    numbered = numbered.select(
        *in_block, "__at", _BUCKET, "__step", "__own", "__brought",
        F.coalesce(F.sum("__opens").over(earlier), nothing).alias("__from"),
        F.sum("__opens").over(of_block).alias("__slots"),
    )
    of_bucket = Window.partitionBy(*in_block, _BUCKET)
    in_order = of_bucket.orderBy("__at")
    brought = F.sum("__brought").over(of_bucket)
    running = numbered.select(
        *in_block, "__at", _BUCKET, "__own", "__from",
        F.coalesce(F.lead("__from").over(in_order), "__slots").alias("__until"),
        (brought + F.sum("__step").over(in_order)).alias(_N),
        F.when(F.row_number().over(in_order) == 1, brought).alias("__before"),
    )
    begin, end, counted = F.col("__from"), F.col("__until"), F.col(_BUCKET).isNotNull()
    spans = F.array_compact(
        F.array(
            F.when(counted & (F.col("__before") != 0) & (begin > 0), _span(nothing, begin, F.col("__before"))),
            F.when(counted & (n != 0) & (end > begin), _span(begin, end, n)).when(
                F.col("__own"), _span(begin, begin + 1, nothing)
            ),
        )
    )
    at = F.when(F.col("__own"), F.struct("__from", "__at"))
    entries = running.select(*in_block, _BUCKET, at.alias("__at"), F.inline(spans)).select(
        *in_block, _BUCKET, _N, "__at", F.explode(F.sequence("__first", F.col("__end") - 1)).alias("__number")
    )
    pair = F.when(F.col(_BUCKET).isNotNull() & (n != 0), F.struct(_BUCKET, _N))
    own_slot = F.when(F.col("__at.__from") == F.col("__number"), F.col("__at.__at"))
    folded = entries.groupBy(*in_block, "__number").agg(
        seh.from_pairs(F.collect_list(pair)).alias(name), F.max(own_slot).alias(_SLOT)
    )
    return folded.select(*keys, slot_start(_SLOT, slot_seconds).alias(slot_name), name)


def _spread(counts: DataFrame, keys: Sequence[str], frame_slots: int) -> DataFrame:
    """Rows (keys, __slot, __histogram) by adding each count to all slots it covers."""
    slot = F.col(_SLOT)
    covered = F.explode(F.sequence(slot, slot + F.lit(frame_slots - 1)))
    spread = counts.select(*keys, slot.alias("__from"), covered.alias(_SLOT), _BUCKET, _N)
    # A slot belongs to the result only if it has input of its own.
    own = F.max(F.col("__from") == slot).alias("__own")
    summed = spread.groupBy(*keys, _SLOT, _BUCKET).agg(F.sum(_N).cast("bigint").alias(_N), own)
    pair = F.when(F.col(_BUCKET).isNotNull() & (F.col(_N) != 0), F.struct(_BUCKET, _N))
    folded = summed.groupBy(*keys, _SLOT).agg(
        seh.from_pairs(F.collect_list(pair)).alias("__histogram"), F.max("__own").alias("__own")
    )
    return folded.where("__own")


def slot_block(slot: Column, width: int) -> Column:
    """Number of the block of ``width`` slots that holds this one."""
    return F.call_function("div", slot - F.pmod(slot, F.lit(width)), F.lit(width))


def _step(at: Column, step: Column, own: Column, brought: Column) -> Column:
    return F.struct(
        at.alias("__at"), step.alias("__step"), own.alias("__own"), brought.alias("__brought")
    )


def _span(first: Column, end: Column, count: Column) -> Column:
    return F.struct(first.alias("__first"), end.alias("__end"), count.alias(_N))
