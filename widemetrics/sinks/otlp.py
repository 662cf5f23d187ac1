"""OTLP-shaped records: one metric per (datum, measurement)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from widemetrics.functions import digest, wire, wirecolumns
from widemetrics.functions.wire import message
from widemetrics.schema import MEASUREMENT_MEMBERS
from widemetrics.sources.datums import wrap_u64

ATTRIBUTES_DDL = (
    "array<struct<key:string,value:struct<string_value:string,int_value:bigint,bool_value:boolean>>>"
)
_POINT = f"attributes:{ATTRIBUTES_DDL},start_time_unix_nano:decimal(20,0),time_unix_nano:decimal(20,0)"
NUMBER_POINT_DDL = f"struct<{_POINT},as_int:bigint,as_double:double>"
SUMMARY_POINT_DDL = (
    f"struct<{_POINT},count:decimal(20,0),sum:double,"
    "quantile_values:array<struct<quantile:double,value:double>>>"
)
HISTOGRAM_POINT_DDL = (
    f"struct<{_POINT},count:decimal(20,0),sum:double,"
    "bucket_counts:array<bigint>,explicit_bounds:array<double>>"
)
METRIC_DDL = (
    "name:string,description:string,unit:string,"
    f"gauge:struct<data_points:array<{NUMBER_POINT_DDL}>>,"
    f"summary:struct<data_points:array<{SUMMARY_POINT_DDL}>>,"
    f"histogram:struct<aggregation_temporality:int,data_points:array<{HISTOGRAM_POINT_DDL}>>"
)
REQUEST_DDL = (
    "resource_metrics array<struct<schema_url:string,instrumentation_library_metrics:array<struct<"
    "instrumentation_library:struct<name:string,version:string>,schema_url:string,"
    f"metrics:array<struct<{METRIC_DDL}>>>>>>"
)

# Fixed values of the projection.
UNIT = "1"
DELTA_TEMPORALITY = 1
LIBRARY_VERSION = "42"
DIGEST_QUANTILES = (0.0, 0.5, 0.9, 0.99, 1.0)

# Bytes of envelopes that are decoded together.
_AT_ONCE = 4 << 20

# Numbers and kinds of the fields in the binary form.
_ANY = message(
    string_value=(1, "string"), bool_value=(2, "bool"), int_value=(3, "int64"), double_value=(4, "double")
)
_TAIL = {"start_time_unix_nano": (2, "fixed64"), "time_unix_nano": (3, "fixed64")}


def _attributes_at(number: int) -> tuple:
    return number, message(key=(1, "string"), value=(2, _ANY)), "repeated"


_NUMBER_POINT = message(**_TAIL, as_double=(4, "double"), as_int=(6, "sfixed64"), attributes=_attributes_at(7))
_SUMMARY_POINT = message(
    **_TAIL, count=(4, "fixed64"), sum=(5, "double"),
    quantile_values=(6, message(quantile=(1, "double"), value=(2, "double")), "repeated"),
    attributes=_attributes_at(7),
)
_HISTOGRAM_POINT = message(
    **_TAIL, count=(4, "fixed64"), sum=(5, "double"), bucket_counts=(6, "fixed64", "repeated"),
    explicit_bounds=(7, "double", "repeated"), attributes=_attributes_at(9),
)
METRIC = message(
    name=(1, "string"), description=(2, "string"), unit=(3, "string"),
    gauge=(5, message(data_points=(1, _NUMBER_POINT, "repeated"))),
    histogram=(
        9, message(data_points=(1, _HISTOGRAM_POINT, "repeated"), aggregation_temporality=(2, "int32"))
    ),
    summary=(11, message(data_points=(1, _SUMMARY_POINT, "repeated"))),
)
_LIBRARY_METRICS = message(
    instrumentation_library=(1, message(name=(1, "string"), version=(2, "string"))),
    metrics=(2, METRIC, "repeated"), schema_url=(3, "string"),
)
_RESOURCE_METRICS = message(
    instrumentation_library_metrics=(2, _LIBRARY_METRICS, "repeated"), schema_url=(3, "string")
)
REQUEST = message(resource_metrics=(1, _RESOURCE_METRICS, "repeated"))

DESCRIPTION = "wide metrics compatibility conversion"
LIBRARY_NAME = "widemetrics"


def attributes(dimensions: Column | str) -> Column:
    """Dimensions as a key-value list in key order; unset ones are left out."""
    entries = F.sort_array(F.map_entries(dimensions))
    given = F.filter(
        entries,
        lambda e: e["value"]["String"].isNotNull()
        | e["value"]["Number"].isNotNull()
        | e["value"]["Boolean"].isNotNull(),
    )
    return F.transform(
        given,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.struct(
                e["value"]["String"].alias("string_value"),
                wrap_u64(e["value"]["Number"]).alias("int_value"),
                e["value"]["Boolean"].alias("bool_value"),
            ).alias("value"),
        ),
    )


def _points(*fields: Column) -> Column:
    common = [
        F.col("attributes"),
        F.lit(0).cast("decimal(20,0)").alias("start_time_unix_nano"),
        F.col("time_unix_nano"),
    ]
    return F.array(F.struct(*common, *fields)).alias("data_points")


def _at_quantile(q: Column, value: Column) -> Column:
    return F.struct(q.alias("quantile"), value.alias("value"))


def unsigned(col: Column) -> Column:
    """The unsigned number a BIGINT stands for."""
    wide = col.cast("decimal(20,0)")
    return F.when(col < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(
        wide
    ).cast("decimal(20,0)")


def _gauge(m: Column) -> Column:
    whole = F.coalesce(m["I64"], m["I32"].cast("bigint"))
    real = F.coalesce(m["F64"], m["F32"].cast("double"))
    points = _points(whole.alias("as_int"), real.alias("as_double"))
    return F.when(whole.isNotNull() | real.isNotNull(), F.struct(points))


def _summary(m: Column) -> Column:
    s, t = m["StatisticSet"], m["Tdigest"]
    of_digest = F.transform(
        F.array(*[F.lit(q) for q in DIGEST_QUANTILES]),
        lambda q: _at_quantile(q, digest.quantile(t, q)),
    )
    of_set = F.array(
        _at_quantile(F.lit(0.0), s["minimum"]), _at_quantile(F.lit(1.0), s["maximum"])
    )
    points = _points(
        unsigned(F.coalesce(s["samplecount"], t["count"])).alias("count"),
        F.coalesce(s["samplesum"], t["sum"]).alias("sum"),
        F.when(s.isNotNull(), of_set).otherwise(of_digest).alias("quantile_values"),
    )
    return F.when(s.isNotNull() | t.isNotNull(), F.struct(points))


def _histogram(m: Column, strict: bool) -> Column:
    h = m["Histogram"]
    entries = F.sort_array(F.map_entries(h))
    counts = F.transform(entries, lambda e: e["value"])
    zero = F.lit(0).cast("decimal(20,0)")
    total = F.aggregate(counts, zero, lambda acc, n: (acc + unsigned(n)).cast("decimal(20,0)"))

    def product(e: Column) -> Column:
        exact = F.try_multiply(e["key"], e["value"]).cast("double")
        return F.coalesce(exact, e["key"].cast("double") * e["value"].cast("double"))

    approximate = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + product(e))
    if strict:
        # One count more than bounds: nothing lies above the last bound.
        counts = F.concat(counts, F.array(F.lit(0).cast("bigint")))
    points = _points(
        total.alias("count"),
        approximate.alias("sum"),
        counts.alias("bucket_counts"),
        F.transform(entries, lambda e: e["key"].cast("double")).alias("explicit_bounds"),
    )
    return F.when(
        h.isNotNull(),
        F.struct(F.lit(DELTA_TEMPORALITY).alias("aggregation_temporality"), points),
    )


def to_otlp(df: DataFrame, strict: bool = True, description: str = DESCRIPTION) -> DataFrame:
    """Datums to metrics: numbers to gauges, sets and digests to summaries, histograms.

    Each metric is named after its datum and measurement. ``strict`` gives
    histograms the extra overflow count the format asks for. No shuffle.
    """
    # Attributes are made before the explode: once a datum, not once a measurement.
    given = df.select(
        "metric",
        F.col("unix_nanos").alias("time_unix_nano"),
        attributes("dimensions").alias("attributes"),
        "measurements",
    )
    each = given.select(
        "metric", "time_unix_nano", "attributes", F.explode("measurements").alias("key", "m")
    )
    m = F.col("m")
    is_set = F.lit(False)
    for member in MEASUREMENT_MEMBERS:
        is_set = is_set | m[member].isNotNull()
    return each.where(is_set).select(
        F.concat_ws("_", "metric", "key").alias("name"),
        F.lit(description).alias("description"),
        F.lit(UNIT).alias("unit"),
        _gauge(m).alias("gauge"),
        _summary(m).alias("summary"),
        _histogram(m, strict).alias("histogram"),
    )


def standard_ddl(ddl: str) -> str:
    """A schema with the names of the standard's JSON: camel case, whole numbers of 64 bits as text."""
    camel = re.sub(r"(\w)_(\w)", lambda m: m.group(1) + m.group(2).upper(), ddl)
    return re.sub(r"decimal\(20,0\)|bigint", "string", camel)


def otlp_request(
    metrics: DataFrame, max_metrics: int = 5000, library: str = LIBRARY_NAME, standard: bool = False
) -> DataFrame:
    """JSON envelopes of at most ``max_metrics`` metrics each: one column, ``request``.

    Every metric is rendered by Spark; a task then only joins the texts of its
    Arrow batches. Nothing is shuffled and no row holds a whole batch of datums.
    ``standard`` gives names in camel case and 64-bit numbers as text, as the
    format's JSON has them.
    """
    opening = (
        '{"resource_metrics":[{"schema_url":"","instrumentation_library_metrics":['
        f'{{"instrumentation_library":{{"name":{json.dumps(library)},"version":"{LIBRARY_VERSION}"}},'
        '"schema_url":"","metrics":['
    )
    if standard:
        for name in ("resource_metrics", "instrumentation_library_metrics", "instrumentation_library", "schema_url"):
            opening = opening.replace(f'"{name}"', f'"{standard_ddl(name)}"')
    closing = "]}]}]}"

    def envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = [*range(0, batch.num_rows, max_metrics), batch.num_rows]
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch.column(0))
            joined = pc.binary_join(lists, ",")
            whole = pc.binary_join_element_wise(opening, joined, closing, "")
            yield pa.RecordBatch.from_arrays([whole], ["request"])

    whole = F.struct("*")
    whole = whole.cast(f"struct<{standard_ddl(METRIC_DDL)}>") if standard else whole
    texts = metrics.select(F.to_json(whole).alias("metric"))
    return texts.mapInArrow(envelopes, "request string")


def request_metrics(requests: DataFrame) -> DataFrame:
    """The metrics inside envelopes (as read by read_otlp), one per row."""
    return (
        requests.select(F.explode("resource_metrics").alias("r"))
        .select(F.explode("r.instrumentation_library_metrics").alias("l"))
        .select(F.inline("l.metrics"))
    )


def parse_requests(requests: DataFrame, standard: bool = False) -> DataFrame:
    """Envelopes in JSON as nested columns; ``standard`` as for otlp_request."""
    if not standard:
        return requests.select(F.inline(F.array(F.from_json("request", REQUEST_DDL))))
    nested = requests.select(F.inline(F.array(F.from_json("request", standard_ddl(REQUEST_DDL)))))
    kind = requests.sparkSession.createDataFrame([], REQUEST_DDL).schema["resource_metrics"].dataType
    return nested.select(F.col("resourceMetrics").cast(kind).alias("resource_metrics"))


_KINDS = ("gauge", "summary", "histogram")
# Fields of the points of some kinds only.
_OWN = {
    "as_int": "bigint", "as_double": "double", "count": "decimal(20,0)", "sum": "double",
    "quantile_values": "array<struct<quantile:double,value:double>>",
    "bucket_counts": "array<bigint>", "explicit_bounds": "array<double>",
}


def _merged(metrics: DataFrame) -> DataFrame:
    """Metrics for the way to Python: points of all kinds in one list, and of each kind how many.

    What rows cost on that way grows with their nested columns, and a list that is null
    costs a look at all rows before it; three kinds, of which a metric has one, cost most.
    """

    def points(kind: str) -> Column:
        own = metrics.select(f"{kind}.data_points").schema[0].dataType.elementType.names

        def one(p: Column) -> Column:
            common = [
                F.coalesce(p["attributes"], F.array().cast(ATTRIBUTES_DDL)).alias("attributes"),
                p["start_time_unix_nano"].alias("start_time_unix_nano"),
                p["time_unix_nano"].alias("time_unix_nano"),
            ]
            for name, ddl in _OWN.items():
                value = p[name] if name in own else F.lit(None).cast(ddl)
                if ddl.startswith("array"):
                    value = F.coalesce(value, F.array().cast(ddl))
                common.append(value.alias(name))
            return F.when(p.isNotNull(), F.struct(*common))

        return F.transform(F.col(kind)["data_points"], one)

    def number(kind: str) -> Column:
        size = F.coalesce(F.size(F.col(kind)["data_points"]), F.lit(0))
        return F.when(F.col(kind).isNotNull(), F.greatest(size, F.lit(0))).alias(kind)

    return metrics.select(
        "name", "description", "unit", *[number(k) for k in _KINDS],
        F.col("histogram")["aggregation_temporality"].alias("aggregation_temporality"),
        F.flatten(F.array_compact(F.array(*[points(k) for k in _KINDS]))).alias("points"),
    )


def _apart(batch: pa.RecordBatch) -> pa.StructArray:
    """Merged metrics as they were."""
    points = batch["points"].flatten()
    counts = [batch[k].fill_null(0).to_numpy(zero_copy_only=False) for k in _KINDS]
    kinds = np.repeat(np.tile(np.arange(len(_KINDS)), batch.num_rows), np.stack(counts, 1).ravel())
    names = ["name", "description", "unit"]
    columns = [batch[n] for n in names]
    for i, kind in enumerate(_KINDS):
        own = points if (kinds == i).all() else points.filter(pa.array(kinds == i))
        lists = pa.LargeListArray.from_arrays(pa.array(wirecolumns.offsets_of(counts[i])), own)
        parts = {"data_points": lists}
        if kind == "histogram":
            parts = {"aggregation_temporality": batch["aggregation_temporality"]} | parts
        columns.append(pa.StructArray.from_arrays(list(parts.values()), list(parts), mask=batch[kind].is_null()))
    return pa.StructArray.from_arrays(columns, [*names, *_KINDS])


def otlp_wire(metrics: DataFrame, max_metrics: int = 5000, library: str = LIBRARY_NAME) -> DataFrame:
    """The same envelopes in the binary form that collectors take: one column, ``request``.

    wire.delimited() puts their lengths ahead where several are to share a file.
    """
    named = wire.encode(
        {"instrumentation_library": {"name": library, "version": LIBRARY_VERSION}}, _LIBRARY_METRICS
    )
    # Metrics of any other shape go as they are, with the fields they have.
    usual = sorted(metrics.dtypes) == sorted(metrics.sparkSession.createDataFrame([], METRIC_DDL).dtypes)

    def within(number: int, body: bytes) -> bytes:
        return wire.varint(number << 3 | 2) + wire.delimited(body)

    def envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _apart(batch) if usual else batch.to_struct_array()
            places, data = wirecolumns.cut_points(wirecolumns.encode_list(rows, METRIC, 2))
            parts = places[[*range(0, len(rows), max_metrics), len(rows)]].tolist()
            whole = [
                within(1, within(2, named + data[i:j].to_pybytes())) for i, j in zip(parts, parts[1:])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary())], ["request"])

    return (_merged(metrics) if usual else metrics).mapInArrow(envelopes, "request binary")


def parse_wire(requests: DataFrame) -> DataFrame:
    """Envelopes in the binary form as nested columns."""
    schema = to_arrow_schema(requests.sparkSession.createDataFrame([], REQUEST_DDL).schema)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in wirecolumns.pieces(batch.column(0), _AT_ONCE):
                rows = wirecolumns.decode_column(some, REQUEST, pa.struct(schema))
                yield pa.RecordBatch.from_arrays(rows.flatten(), schema=schema)

    return requests.select("request").mapInArrow(decoded, REQUEST_DDL)


def write_wire(requests: DataFrame, path: str) -> None:
    """Binary envelopes as Parquet files, in row groups of a few megabytes once compressed.

    A reader holds up to 4,096 rows of a row group at a time, so all of it, as envelopes are
    large. For the same reason sizes are looked at after a few rows instead of a hundred.
    """
    sizes = {"parquet.block.size": 4 << 20, "parquet.page.size": 1 << 20}
    checks = {f"parquet.{of}.size.row.check.min": 4 for of in ("block", "page")}
    requests.write.options(**sizes, **checks).parquet(path)


def write_otlp(requests: DataFrame, path: str) -> None:
    """Envelopes as JSON files, one envelope to a line."""
    requests.write.mode("append").text(path)


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes from JSON files as nested columns."""
    return spark.read.schema(REQUEST_DDL).json(path)
