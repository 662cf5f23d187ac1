"""Datums from JSON text and from requests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from widemetrics.operators import wide
from widemetrics.operators.wide import ColumnSpec
from widemetrics.schema import DIMENSION_DDL, DIMENSION_MEMBERS, MEASUREMENT_MEMBERS, STATSET_DDL

# As sent: every oneof sits in a "value" wrapper, map keys are strings and
# unsigned numbers need twenty digits.
WIRE_DIMENSION = f"struct<value:{DIMENSION_DDL}>"
WIRE_MEASUREMENT = (
    "struct<value:struct<I64:bigint,I32:int,F64:double,F32:float,"
    "StatisticSet:struct<minimum:double,maximum:double,samplesum:double,samplecount:decimal(20,0)>,"
    "Histogram:struct<buckets:map<string,decimal(20,0)>>,"
    "Tdigest:struct<sum:double,count:decimal(20,0),min:double,max:double,"
    "centroids:array<struct<mean:double,weight:decimal(20,0)>>>>>"
)
WIRE_DATUM = (
    "metric string, unix_nanos decimal(20,0), "
    f"dimensions map<string,{WIRE_DIMENSION}>, "
    f"measurements map<string,{WIRE_MEASUREMENT}>"
)
WIRE_REQUEST = (
    f"shared_dimensions map<string,{WIRE_DIMENSION}>, "
    "metrics array<struct<metric:string,unix_nanos:decimal(20,0),"
    f"dimensions:map<string,{WIRE_DIMENSION}>,measurements:map<string,{WIRE_MEASUREMENT}>>>"
)

_TWO_63 = "9223372036854775808"
_TWO_64 = "18446744073709551616"


def wrap_u64(col: Column) -> Column:
    """An unsigned 64-bit number as the signed one with the same bits."""
    return (
        F.when(col >= F.lit(_TWO_63).cast("decimal(20,0)"), col - F.lit(_TWO_64).cast("decimal(20,0)"))
        .otherwise(col)
        .cast("bigint")
    )


def _dimensions(col: Column) -> Column:
    plain = F.transform_values(col, lambda _, d: d["value"])
    return F.coalesce(plain, F.create_map().cast(f"map<string,{DIMENSION_DDL}>"))


def _measurement(value: Column) -> Column:
    s, h, t = value["StatisticSet"], value["Histogram"], value["Tdigest"]
    statistic_set = F.when(
        s.isNotNull(),
        F.struct(
            s["minimum"].alias("minimum"),
            s["maximum"].alias("maximum"),
            s["samplesum"].alias("samplesum"),
            wrap_u64(s["samplecount"]).alias("samplecount"),
        ).cast(STATSET_DDL),
    )
    histogram = F.when(
        h.isNotNull(),
        F.transform_values(
            F.transform_keys(h["buckets"], lambda k, _: k.cast("bigint")),
            lambda _, n: wrap_u64(n),
        ),
    )
    centroids = F.transform(
        t["centroids"],
        lambda c: F.struct(c["mean"].alias("mean"), wrap_u64(c["weight"]).alias("weight")),
    )
    digest = F.when(
        t.isNotNull(),
        F.struct(
            F.lit(100).alias("max_buckets"),
            wrap_u64(t["count"]).alias("count"),
            t["sum"].alias("sum"),
            t["min"].alias("min"),
            t["max"].alias("max"),
            centroids.alias("centroids"),
        ),
    )
    return F.when(
        value.isNotNull(),
        F.struct(
            value["I64"].alias("I64"),
            value["I32"].alias("I32"),
            value["F64"].alias("F64"),
            value["F32"].alias("F32"),
            statistic_set.alias("StatisticSet"),
            histogram.alias("Histogram"),
            digest.alias("Tdigest"),
        ),
    )


def _datum() -> list[Column]:
    """The canonical columns from wire ones."""
    measurements = F.transform_values("measurements", lambda _, m: _measurement(m["value"]))
    return [
        F.col("metric"),
        F.col("unix_nanos"),
        _dimensions(F.col("dimensions")).alias("dimensions"),
        measurements.alias("measurements"),
    ]


_PARSE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}


def parse_datums(df: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Decode one JSON datum per row.

    The text of a row that is not a datum lands in ``malformed``; its other
    columns are empty. Nothing is dropped.
    """
    wire = F.from_json(col, WIRE_DATUM + ", malformed string", _PARSE_OPTIONS)
    parsed = df.select(*keep, F.col(col).alias("__text"), _decoded(wire))
    return _canonical(parsed, F.col("__text"), keep)


def _canonical(parsed: DataFrame, text: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    unnamed = F.col("metric").isNull() | F.col("unix_nanos").isNull()
    malformed = F.coalesce("malformed", F.when(unnamed, F.coalesce(text, F.lit(""))))
    return parsed.select(*keep, *_datum(), malformed.alias("malformed"))


def _decoded(struct: Column) -> Column:
    """The fields of a decoded struct as columns, by way of a generator.

    A filter on plain fields would be pushed below the projection that decodes
    them, with a copy of the decoding; it does not pass a generator.
    """
    return F.inline(F.array(struct))


def read_datums_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Files of JSON datums, one to a line, or one (or an array of them) to a file."""
    if not multiline:
        return parse_datums(spark.read.text(path))
    reader = spark.read.schema(WIRE_DATUM + ", malformed string").options(**_PARSE_OPTIONS)
    given = F.to_json(F.struct("metric", "unix_nanos", "dimensions", "measurements"))
    return _canonical(reader.json(path, multiLine=True), given)


def split_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(datums, malformed texts) of what parse_datums gave."""
    good = df.where(F.col("malformed").isNull()).drop("malformed")
    return good, df.where(F.col("malformed").isNotNull()).select("malformed")


def overlay(dimensions: Column, shared: Column) -> Column:
    """``dimensions`` with ``shared`` laid over it: shared wins on a clash."""
    own = F.map_filter(dimensions, lambda k, _: ~F.map_contains_key(shared, k))
    return F.when(F.size(shared) > 0, F.map_concat(own, shared)).otherwise(dimensions)


def dimension(**given: Column) -> Column:
    """A dimension with one member set, e.g. ``dimension(String=col)``."""
    return _oneof(DIMENSION_MEMBERS, given)


def measurement(**given: Column) -> Column:
    """A measurement with one member set, e.g. ``measurement(F64=col)``."""
    return _oneof(MEASUREMENT_MEMBERS, given)


def _oneof(members: Mapping[str, str], given: Mapping[str, Column]) -> Column:
    unknown = set(given) - set(members)
    if unknown:
        raise ValueError(f"no such member: {sorted(unknown)}")
    return F.struct(
        *[given.get(name, F.lit(None)).cast(ddl).alias(name) for name, ddl in members.items()]
    )


def dimension_map(values: Mapping[str, str | int | bool]) -> Column:
    """A literal map of dimensions from plain Python values."""
    parts: list[Column] = []
    for name, value in values.items():
        member = {str: "String", int: "Number", bool: "Boolean"}[type(value)]
        parts += [F.lit(name), dimension(**{member: F.lit(value)})]
    return F.create_map(*parts) if parts else F.create_map().cast(f"map<string,{DIMENSION_DDL}>")


def dimensions_from_json(text: str) -> dict[str, str | int | bool]:
    """Plain values from the wire form, ``{"name": {"value": {"String": ".."}}}``."""
    return {name: next(iter(d["value"].values())) for name, d in json.loads(text).items()}


def with_shared_dimensions(df: DataFrame, shared: Column) -> DataFrame:
    """Lay request-level dimensions over each datum's own."""
    return df.withColumn("dimensions", overlay(F.col("dimensions"), shared))


def with_bonus_dimensions(df: DataFrame, values: Mapping[str, str | int | bool]) -> DataFrame:
    """Attach constant dimensions to every datum."""
    return with_shared_dimensions(df, dimension_map(values))


def table_prefix(prefix: str) -> str:
    """The prefix with its separating underscore, unless empty or already there."""
    return prefix if not prefix or prefix.endswith("_") else prefix + "_"


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Put a prefix before every metric name."""
    return df.withColumn("metric", F.concat(F.lit(table_prefix(prefix)), F.col("metric")))


def read_requests(df: DataFrame) -> DataFrame:
    """Datums of a frame of requests in wire form, batch or streaming."""
    each = df.select("shared_dimensions", F.inline("metrics"))
    plain = each.select(_dimensions(F.col("shared_dimensions")).alias("__shared"), *_datum())
    return with_shared_dimensions(plain, F.col("__shared")).drop("__shared")


def parse_requests(df: DataFrame, col: str = "value") -> DataFrame:
    """Datums of a frame that holds one JSON request per row."""
    return read_requests(df.select(_decoded(F.from_json(col, WIRE_REQUEST))))


def parse_request_columns(df: DataFrame, columns: Sequence[ColumnSpec], col: str = "value") -> DataFrame:
    """(metric, unix_nanos, columns..) of the datums in JSON requests, one request per row.

    The maps stay in their wire form and only the values that the columns ask
    for are converted, where parse_requests makes every key's. A value that does
    not read as its column's type is NULL.
    """
    requests = df.select(_decoded(F.from_json(col, WIRE_REQUEST)))
    each = requests.select("shared_dimensions", F.inline("metrics"))

    def value(kind: str, key: str) -> Column:
        if kind == "measurement":
            return _measurement(F.element_at("measurements", F.lit(key))["value"])
        shared = F.element_at("shared_dimensions", F.lit(key))
        given = F.map_contains_key("shared_dimensions", key)
        return F.when(given, shared).otherwise(F.element_at("dimensions", F.lit(key)))["value"]

    found = []
    for spec in columns:
        readings = [wide.typed(value(kind, key), kind, spec.type) for kind, key in spec.sources]
        found.append(F.coalesce(*readings).cast(spec.spark_type).alias(spec.name))
    return each.select("metric", "unix_nanos", *found)
