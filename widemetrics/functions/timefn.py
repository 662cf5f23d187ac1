"""Time columns: nanoseconds, buckets, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from widemetrics.schema import CHUNK_SECONDS


def nanos_to_ts(nanos: Column | str) -> Column:
    """Nanoseconds since the epoch to a microsecond TIMESTAMP, rounded half up."""
    nanos = F.col(nanos) if isinstance(nanos, str) else nanos

    def micros(n: Column) -> Column:
        up = F.when(n % F.lit(1000) >= F.lit(500), F.lit(1)).otherwise(F.lit(0))
        return F.call_function("div", n, F.lit(1000)) + up

    # Times before the year 2262 fit a BIGINT and need no decimal arithmetic.
    return F.timestamp_micros(F.coalesce(micros(nanos.try_cast("bigint")), micros(nanos)))


def ts_to_nanos(ts: Column | str) -> Column:
    """The wire form of a TIMESTAMP (or of a TIMESTAMP_NTZ read as session time)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = F.unix_micros(ts.cast("timestamp"))
    return (micros * F.lit(1000)).cast("decimal(20,0)")


def time_bucket(width: str, ts: Column | str) -> Column:
    """Start of the tumbling bucket that holds ``ts``; weeks start on Monday."""
    unit = width.split()[-1].rstrip("s").lower()
    # The epoch is a Thursday, four days ahead of a Monday.
    start = F.window(ts, width, width, "4 days") if unit == "week" else F.window(ts, width)
    return start["start"]


def slot_number(ts: Column | str, seconds: int) -> Column:
    """Index of the fixed-width slot that holds ``ts``, counted from the epoch."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros, width = F.unix_micros(ts.cast("timestamp")), F.lit(seconds * 1_000_000)
    # Whole-number arithmetic; a quotient of doubles could round up to the next slot.
    return F.call_function("div", micros - F.pmod(micros, width), width)


def slot_start(slot: Column | str, seconds: int) -> Column:
    slot = F.col(slot) if isinstance(slot, str) else slot
    return F.timestamp_micros(slot * F.lit(seconds * 1_000_000))


def chunk_of(ts: Column | str, seconds: int = CHUNK_SECONDS) -> Column:
    """Partition value of a row: start of its chunk in epoch seconds.

    A number, because partition folders spell timestamps in the session zone.
    """
    return slot_number(ts, seconds) * F.lit(seconds)
