"""Identifier cleaning."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from widemetrics.schema import RESERVED_COLUMNS


def clean_id(col: Column | str) -> Column:
    """Lower-case, then turn each run of non-word characters into one underscore.

    ``(?U)`` makes ``\\w`` cover Unicode letters, so accented names survive.
    """
    return F.regexp_replace(F.lower(col), r"(?U)[^\w]+", "_")


def clean_column(col: Column | str) -> Column:
    """clean_id, with names the storage layout owns moved aside."""
    cleaned = clean_id(col)
    return F.when(cleaned.isin(*RESERVED_COLUMNS), F.concat(cleaned, F.lit("_"))).otherwise(cleaned)


def clean_name(spark: SparkSession, name: str) -> str:
    """What clean_id makes of a name, e.g. to find a metric's table."""
    return spark.range(1).select(clean_id(F.lit(name))).first()[0]
