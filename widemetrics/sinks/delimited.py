"""Wide rows as delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widemetrics.operators.wide import ColumnSpec, own_text, value_text


def rfc3339(nanos: Column | str) -> Column:
    """``2022-01-16T21:13:29Z``, with nine decimals where the second is not whole."""
    nanos = F.col(nanos) if isinstance(nanos, str) else nanos
    second = F.call_function("div", nanos, F.lit(1_000_000_000))
    rest = (nanos % F.lit(1_000_000_000)).cast("bigint")
    utc = F.timestamp_seconds(second)
    # The rendering below is in session time; shift it to UTC first.
    shown = F.date_format(F.to_utc_timestamp(utc, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(rest == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(rest.cast("string"), 9, "0"))
    )
    return F.concat(shown, fraction, F.lit("Z"))


def csv_rows(df: DataFrame, columns: Sequence[ColumnSpec]) -> DataFrame:
    """Datums as text columns (time, dimensions, measurements); missing is NULL."""
    cells = []
    for spec in columns:
        texts = []
        for kind, key in spec.sources:
            value = F.element_at("dimensions" if kind == "dimension" else "measurements", F.lit(key))
            # A column of one type needs the text of that member alone.
            texts.append(own_text(value, kind, spec.type) if spec.uniform else value_text(value, kind))
        cells.append(F.coalesce(*texts).alias(spec.name))
    return df.select(rfc3339("unix_nanos").alias("time"), *cells)


def write_csv(df: DataFrame, columns: Sequence[ColumnSpec], path: str) -> None:
    """Rows without a header; missing and empty are both an empty field."""
    csv_rows(df, columns).write.mode("append").options(
        header=False, quote='"', escape='"', emptyValue="", nullValue=""
    ).csv(path)
