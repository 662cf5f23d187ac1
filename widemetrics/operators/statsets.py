"""Statistic sets over moving frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widemetrics.functions import statset
from widemetrics.functions.timefn import slot_number, slot_start
from widemetrics.operators.histograms import slot_block

_SLOT = "__slot"

#: Frames so short are summed slot by slot.
FEW_SLOTS = 3


def moving(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    col: str,
    slot_seconds: int,
    frame_slots: int,
    values: bool = False,
    name: str = "statistics",
    slot_name: str = "slot",
) -> DataFrame:
    """The statistic set of a slot and the ``frame_slots - 1`` before it.

    ``col`` holds statistic sets, or numbers where ``values`` is set. Rows are
    merged per (key, slot) first. Time is cut into blocks of ``frame_slots``
    slots: a frame is then the end of one block and the beginning of the next,
    and extremes, which nothing can be taken away from, come from the running
    ones of both. Each set goes to its own block and to the next, however long
    the frame, and a key spreads over tasks by its blocks. In a frame of
    FEW_SLOTS at most, a set goes to each slot it covers, which needs no sort.
    """
    source = df.withColumn(_SLOT, slot_number(time, slot_seconds))
    build = statset.accumulate if values else statset.merge
    slots = source.groupBy(*keys, _SLOT).agg(build(col).alias("__set"))
    slot = F.col(_SLOT)
    if frame_slots <= FEW_SLOTS:
        covered = F.explode(F.sequence(slot, slot + F.lit(frame_slots - 1)))
        spread = slots.select(*keys, slot.alias("__from"), covered.alias(_SLOT), "__set")
        own = F.max(F.col("__from") == slot).alias("__own")
        merged = spread.groupBy(*keys, _SLOT).agg(statset.merge("__set").alias(name), own)
        return merged.where("__own").select(*keys, slot_start(_SLOT, slot_seconds).alias(slot_name), name)
    block = slot_block(slot, frame_slots)
    places = F.array(
        _place(block, slot, F.lit(True)), _place(block + 1, slot + frame_slots, F.lit(False))
    )
    sent = slots.select(*keys, "__set", F.inline(places)).repartition(*keys, "__block")
    of_block = Window.partitionBy(*keys, "__block")
    # Of this block what came up to here; of the one before what lies less than a frame back.
    begun = of_block.orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rest = of_block.orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("__own"), F.col("__set"))
    earlier = F.when(~F.col("__own"), F.col("__set"))
    both = sent.select(
        *keys,
        "__at",
        "__own",
        statset.merge_over(own, begun).alias("__begun"),
        statset.merge_over(earlier, rest).alias("__rest"),
    )
    return both.where("__own").select(
        *keys,
        slot_start("__at", slot_seconds).alias(slot_name),
        statset.combine("__rest", "__begun").alias(name),
    )


def _place(block: Column, at: Column, own: Column) -> Column:
    return F.struct(block.alias("__block"), at.alias("__at"), own.alias("__own"))
