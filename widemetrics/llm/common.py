"""What the document operators share: sessions, scratch tables, column names, words."""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widemetrics.session import Folder, shared_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows of an Arrow batch: documents are long, so fewer than Spark's 10,000.
BATCH_ROWS = 1000

#: A block of rows ends at so many rows, or bytes of what it holds.
BLOCK_ROWS = 1 << 13
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with the session set up for Arrow batches of documents."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows; a local session's Python workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if spark.sparkContext.master.startswith("local") and _ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{paths}:{_ROOT}" if paths else _ROOT


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the shared scratch folder: it is computed once and outlives executors."""
    return saved_at(df, purpose)[0]


def saved_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """saved(), and the folder, for discard()."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, once all that came of it is saved as well."""
    Folder(spark, path).delete()


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many _ after it as it takes not to clash with a column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(names: Iterable[str]) -> list[Column]:
    """The columns of these names, which may hold points."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def by_place(df: DataFrame) -> DataFrame:
    """df with columns c0, c1 and so on, as Arrow batches cannot be asked for with points in names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64 bits of a row's id and text: equal rows share it, so it needs no row numbers.

    The id goes in as text with a mark, so that a null id differs from any other.
    """
    named = F.concat(F.lit("#"), F.col(id_col).cast("string"))
    return F.xxhash64(F.coalesce(named, F.lit("")), text_of(text_col))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fields(df: DataFrame, *added: tuple[str, str]) -> T.StructType:
    """df's schema and further columns, given as (name, type)."""
    more = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in added))
    return T.StructType([*df.schema.fields, *more.fields])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.binary())


class Blocks:
    """Numbers for blocks of rows of one task."""

    def __init__(self) -> None:
        self._number = TaskContext.get().partitionId() << 33
        self._rows = self._bytes = 0

    def of(self, size: int) -> int:
        if self._rows and (self._rows >= BLOCK_ROWS or self._bytes + size > BLOCK_BYTES):
            self._number += 1
            self._rows = self._bytes = 0
        self._rows += 1
        self._bytes += size
        return self._number
