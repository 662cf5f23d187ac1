"""From maps to one typed column per key: discovery, projection, conflicts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widemetrics.functions import digest, seh, statset
from widemetrics.functions.ident import clean_column, clean_id
from widemetrics.functions.text import parse_boolean, parse_float, plain_number
from widemetrics.functions.timefn import nanos_to_ts
from widemetrics.schema import COLUMN_TYPES, SPARK_TYPES

_DIMENSIONS = [(rank, f) for rank, (kind, f, _) in enumerate(COLUMN_TYPES) if kind == "dimension"]
_MEASUREMENTS = [(rank, f) for rank, (kind, f, _) in enumerate(COLUMN_TYPES) if kind == "measurement"]


@dataclass(frozen=True)
class ColumnSpec:
    """One column of a wide table and the raw keys that feed it."""

    name: str
    kind: str
    type: str
    sources: tuple[tuple[str, str], ...] = field(default=())
    # Every value seen has the column's own type, so none needs to be re-read.
    uniform: bool = False

    @property
    def spark_type(self) -> str:
        return SPARK_TYPES[self.type]


def _rank_of(value: Column, members: Iterable[tuple[int, str]]) -> Column:
    """Type rank of the set member of a oneof; NULL where none is set."""
    chosen = None
    for rank, name in members:
        test = value[name].isNotNull()
        chosen = F.when(test, F.lit(rank)) if chosen is None else chosen.when(test, F.lit(rank))
    return chosen


def observed_keys(df: DataFrame) -> DataFrame:
    """Rows (metric, is_dimension, key, first, uniform): every key with its earliest type.

    ``first`` packs (microsecond, type rank) into one number, so the minimum is
    a hash aggregate with map-side combine; only distinct keys are shuffled.
    ``uniform`` says that the key has one type and no value beyond its range.
    ``first`` is NULL for a key that never has a value, and the key itself for a
    metric's datums without any, so that every metric has a row.
    """
    largest = F.lit("9223372036854775807").cast("decimal(20,0)")
    none = F.array().cast("array<string>")
    keys = F.concat(
        F.coalesce(F.map_keys("dimensions"), none), F.coalesce(F.map_keys("measurements"), none)
    )
    # Values are then taken by position: all of this is generated code, where
    # an array of (key, type) pairs would be built by an interpreted lambda.
    timed = df.select(
        "metric",
        F.unix_micros(nanos_to_ts("unix_nanos")).alias("micros"),
        "dimensions",
        "measurements",
    )
    each = timed.select("*", F.posexplode_outer(keys).alias("pos", "key"))
    split = F.coalesce(F.size("dimensions"), F.lit(0))
    is_dimension = F.col("pos") < split
    dimension = F.get(F.map_values("dimensions"), F.col("pos"))
    measurement = F.get(F.map_values("measurements"), F.col("pos") - split)
    ranked = each.select(
        "metric",
        "micros",
        "key",
        is_dimension.alias("is_dimension"),
        F.when(is_dimension, _rank_of(dimension, _DIMENSIONS))
        .otherwise(_rank_of(measurement, _MEASUREMENTS))
        .alias("rank"),
        F.coalesce(is_dimension & (dimension["Number"] > largest), F.lit(False)).alias("over"),
    )
    rank = F.col("rank")
    uniform = (F.min(rank) == F.max(rank)) & ~F.max("over")
    # Unset values have no rank and aggregates skip them.
    return ranked.groupBy("metric", "is_dimension", "key").agg(
        F.min(F.col("micros") * len(COLUMN_TYPES) + rank).alias("first"),
        uniform.alias("uniform"),
    )


def discover_schema(df: DataFrame) -> DataFrame:
    """Rows (table, column, kind, type, sources, uniform) for every column the datums carry."""
    return discover_tables(df).where(F.col("column").isNotNull())


def discover_tables(df: DataFrame) -> DataFrame:
    """discover_schema, and a row without a column for each table that has datums without values.

    The earliest datum settles a column's type, a dimension ahead of a
    measurement. Keys that clean to the same name share a column; ``sources``
    lists them, dimensions first, then by raw key. Names are cleaned here, on
    the few distinct keys, and not once per datum.
    """
    n = F.lit(len(COLUMN_TYPES))
    kinds = F.array(*[F.lit(kind) for kind, _, _ in COLUMN_TYPES])
    types = F.array(*[F.lit(t) for _, _, t in COLUMN_TYPES])

    def type_of(first: Column) -> Column:
        return F.get(types, F.pmod(first, n).cast("int"))

    source = F.struct(
        F.when(F.col("is_dimension"), F.lit("dimension")).otherwise(F.lit("measurement")).alias("kind"),
        F.col("key").alias("key"),
    )
    one_type = F.size(F.collect_set(type_of(F.col("first")))) == 1
    column = F.when(F.col("first").isNotNull(), clean_column("key"))
    return (
        observed_keys(df)
        .groupBy(clean_id("metric").alias("table"), column.alias("column"))
        .agg(
            F.min("first").alias("first"),
            F.array_sort(F.collect_set(source)).alias("sources"),
            (one_type & F.min("uniform")).alias("uniform"),
        )
        .select(
            "table",
            "column",
            F.get(kinds, F.pmod("first", n).cast("int")).alias("kind"),
            type_of(F.col("first")).alias("type"),
            "sources",
            "uniform",
        )
    )


def collisions(discovered: DataFrame) -> DataFrame:
    """Rows (table, column, keys): columns that several raw keys were cleaned to."""
    shared = discovered.where(F.size("sources") > 1)
    return shared.select("table", "column", F.size("sources").cast("bigint").alias("keys"))


def column_order(columns: Iterable[ColumnSpec]) -> list[ColumnSpec]:
    """Dimensions by name, then measurements by name."""
    return sorted(columns, key=lambda c: (c.kind, c.name))


def collect_schema(rows: DataFrame) -> dict[str, list[ColumnSpec]]:
    """Discovered rows as column lists per table, empty ones too. Only key names reach the driver."""
    tables: dict[str, list[ColumnSpec]] = {}
    for r in rows.toLocalIterator():
        columns = tables.setdefault(r["table"], [])
        if r["column"] is not None:
            sources = tuple((s["kind"], s["key"]) for s in r["sources"])
            columns.append(ColumnSpec(r["column"], r["kind"], r["type"], sources, r["uniform"]))
    return {table: column_order(columns) for table, columns in tables.items()}


def _member_text(value: Column, member: str) -> Column:
    if member in ("F64", "F32"):
        return plain_number(value)
    rich = {"StatisticSet": statset.to_text, "Histogram": seh.to_json, "Tdigest": digest.to_text}
    return rich[member](value) if member in rich else value.cast("string")


def value_text(value: Column, kind: str) -> Column:
    """Text of whatever member of a oneof is set."""
    members = _DIMENSIONS if kind == "dimension" else _MEASUREMENTS
    return F.coalesce(*[_member_text(value[name], name) for _, name in members])


def own_text(value: Column, kind: str, type_name: str) -> Column:
    """Text of the member that a column's type belongs to."""
    for source_kind, member, member_type in COLUMN_TYPES:
        if source_kind == kind and member_type == type_name:
            return _member_text(value[member], member)
    return value_text(value, kind)


def _whole(value: Column, type_name: str) -> Column:
    """A float as an integer, where it is one."""
    return F.when(value == F.floor(value), value.try_cast(type_name))


def _read_as(value: Column, member: str, type_name: str) -> Column | None:
    """A member of a oneof as a column's type, by way of its text where they differ.

    NULL where the text does not fit; None where it never can.
    """
    if member == "String":
        # Rows travel as delimited text, where empty means missing.
        text = F.nullif(value, F.lit(""))
        readers = {
            "string": lambda: text,
            "bigint": lambda: text.try_cast("bigint"),
            "int": lambda: text.try_cast("int"),
            "double": lambda: parse_float(text),
            "float": lambda: parse_float(text).cast("float"),
            "boolean": lambda: parse_boolean(text),
            "statistic_set": lambda: statset.from_text(text),
            "histogram": lambda: seh.from_json(text),
        }
        return readers[type_name]() if type_name in readers else None
    if type_name == "string":
        return _member_text(value, member)
    if member == "Boolean":
        return value if type_name == "boolean" else None
    if member in ("Number", "I64", "I32"):
        if type_name in ("bigint", "int"):
            return value.try_cast(type_name)
        if type_name in ("double", "float"):
            return value.cast(type_name)
        if type_name == "boolean":
            return F.when(value.isin(0, 1), value == 1)
        return None
    if member in ("F64", "F32"):
        if type_name in ("bigint", "int"):
            return _whole(value, type_name)
        if type_name == "double":
            # Through text, so that 42.42 stays 42.42.
            return value.cast("string").cast("double") if member == "F32" else value
        if type_name == "float":
            return value.cast("float")
        if type_name == "boolean":
            return F.when(value.isin(0.0, 1.0), value == 1.0)
        return None
    same = {"StatisticSet": "statistic_set", "Histogram": "histogram", "Tdigest": "tdigest"}
    return value if same[member] == type_name else None


def _typed(value: Column, kind: str, type_name: str) -> tuple[Column, Column]:
    """(value as the column's type, whether it could not be read as that)."""
    members = [f for _, f in (_DIMENSIONS if kind == "dimension" else _MEASUREMENTS)]
    readings = [_read_as(value[f], f, type_name) for f in members]
    usable = [r for r in readings if r is not None]
    null = F.lit(None).cast(SPARK_TYPES[type_name])
    result = F.coalesce(*usable) if usable else null
    given = F.lit(False)
    for name in members:
        member = F.nullif(value[name], F.lit("")) if name == "String" else value[name]
        given = given | member.isNotNull()
    return result, F.coalesce(given & result.isNull(), F.lit(False))


def typed(value: Column, kind: str, type_name: str) -> Column:
    """A oneof as a column's type, NULL where it does not read as that."""
    return _typed(value, kind, type_name)[0]


def dimension_col(name: str, type_name: str = "string", col: str = "dimensions") -> Column:
    """A dimension as a typed column; absent, unset and empty are NULL."""
    return _typed(F.element_at(col, F.lit(name)), "dimension", type_name)[0]


def measurement_col(name: str, type_name: str = "double", col: str = "measurements") -> Column:
    """A measurement as a typed column; absent and unset are NULL."""
    return _typed(F.element_at(col, F.lit(name)), "measurement", type_name)[0]


def _own_member(value: Column, kind: str, type_name: str) -> Column | None:
    for source_kind, member, member_type in COLUMN_TYPES:
        if source_kind == kind and member_type == type_name:
            return _read_as(value[member], member, type_name)
    return None


def _column(spec: ColumnSpec) -> tuple[Column, Column | None]:
    """(value, whether some source of it could not be read; None where that cannot be)."""
    values, conflicts = [], None
    for kind, key in spec.sources:
        source = "dimensions" if kind == "dimension" else "measurements"
        value = F.element_at(source, F.lit(key))
        if spec.uniform:
            values.append(_own_member(value, kind, spec.type))
            continue
        reading, unread = _typed(value, kind, spec.type)
        values.append(reading)
        conflicts = unread if conflicts is None else conflicts | unread
    return F.coalesce(*values), conflicts


def project(df: DataFrame, columns: Sequence[ColumnSpec], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep.., time, columns.., __conflicts).

    ``__conflicts`` names the columns whose value does not read as the column's
    type. A plain projection: no pivot and no shuffle.
    """
    selected, conflicts = [], []
    for spec in columns:
        value, unread = _column(spec)
        selected.append(value.cast(spec.spark_type).alias(spec.name))
        if unread is not None:
            conflicts.append(F.when(unread, F.lit(spec.name)))
    found = F.array_compact(F.array(*conflicts)) if conflicts else F.array().cast("array<string>")
    return df.select(
        *keep, nanos_to_ts("unix_nanos").alias("time"), *selected, found.alias("__conflicts")
    )


def widen(
    df: DataFrame,
    columns: Sequence[ColumnSpec],
    on_conflict: str = "quarantine",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The wide rows of one table: time, dimensions, measurements.

    Rows with a value that does not read as its column's type go: alone with
    ``quarantine`` (see rejects), or with their whole batch with ``drop_batch``.
    ``null`` keeps the row with that value missing.
    """
    rows = project(df, columns, keep)
    clean = F.size("__conflicts") == 0
    if on_conflict == "quarantine":
        rows = rows.where(clean)
    elif on_conflict == "drop_batch":
        if not rows.where(~clean).isEmpty():
            rows = rows.where(F.lit(False))
    elif on_conflict != "null":
        raise ValueError(f"unknown conflict policy: {on_conflict}")
    return rows.drop("__conflicts")


def rejects(df: DataFrame, columns: Sequence[ColumnSpec], keep: Sequence[str] = ()) -> DataFrame:
    """The datums widen leaves out, as they came, with the columns at fault."""
    carried = [*keep, "metric", "unix_nanos", "dimensions", "measurements"]
    rows = project(df, columns, carried)
    return rows.where(F.size("__conflicts") > 0).select(
        *carried, F.col("__conflicts").alias("conflicts")
    )


def widen_each(df: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """The wide rows of all tables, as one frame for each set of columns: (tables, rows with
    the table's name first). Tables with the same columns from the same keys share a frame, so
    the input is read once for each set of columns and not once a table."""
    groups: dict[tuple[ColumnSpec, ...], list[str]] = {}
    for table, columns in collect_schema(discover_tables(df)).items():
        groups.setdefault(tuple(columns), []).append(table)
    named = df.withColumn("table", clean_id("metric"))
    return [
        (tables, widen(named.where(F.col("table").isin(*tables)), columns, keep=["table"]))
        for columns, tables in groups.items()
    ]


def split_metrics(df: DataFrame, tables: Sequence[str]) -> dict[str, DataFrame]:
    """One frame of datums per table name."""
    named = df.withColumn("table", clean_id("metric"))
    return {t: named.where(F.col("table") == t).drop("table") for t in tables}
