"""Datums from requests in their binary form, in files or in any binary column."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from widemetrics.functions import wire
from widemetrics.functions.wire import map_of, message, with_maps
from widemetrics.schema import DATUM_DDL

# Numbers and kinds of the fields.
DIMENSION = message(string=(1, "string"), number=(2, "uint64"), boolean=(3, "bool"))
STATISTIC_SET = message(
    minimum=(1, "double"), maximum=(2, "double"), samplesum=(3, "double"), samplecount=(4, "uint64")
)
HISTOGRAM = with_maps(message(), buckets=map_of(1, "int64", "uint64"))
CENTROID = message(mean=(1, "double"), weight=(2, "uint64"))
TDIGEST = message(
    centroids=(1, CENTROID, "repeated"), sum=(2, "double"), count=(3, "uint64"), max=(4, "double"), min=(5, "double")
)
MEASUREMENT = message(
    i64=(1, "int64"), i32=(2, "int32"), f64=(4, "double"), f32=(5, "float"), statistic_set=(6, STATISTIC_SET),
    histogram=(7, HISTOGRAM), tdigest=(8, TDIGEST),
)
DATUM = with_maps(
    message(metric=(1, "string"), unix_nanos=(2, "uint64")),
    dimensions=map_of(3, "string", DIMENSION),
    measurements=map_of(4, "string", MEASUREMENT),
)
REQUEST = with_maps(
    message(metrics=(2, DATUM, "repeated")), shared_dimensions=map_of(1, "string", DIMENSION)
)

#: Datums of an Arrow batch on the way out.
BATCH_ROWS = 4096

#: The digest that the wire form leaves the size of open.
MAX_BUCKETS = 100


def _dimension(value: dict) -> dict:
    number = value.get("number")
    return {
        "String": value.get("string"),
        "Number": None if number is None else Decimal(number),
        "Boolean": value.get("boolean"),
    }


def _set(value: dict | None) -> dict | None:
    if value is None:
        return None
    numbers = {name: value.get(name, 0.0) for name in ("minimum", "maximum", "samplesum")}
    return numbers | {"samplecount": wire.signed(value.get("samplecount", 0))}


def _digest(value: dict | None) -> dict | None:
    if value is None:
        return None
    centroids = [
        {"mean": c.get("mean", 0.0), "weight": wire.signed(c.get("weight", 0))} for c in value["centroids"]
    ]
    return {
        "max_buckets": MAX_BUCKETS, "count": wire.signed(value.get("count", 0)), "sum": value.get("sum", 0.0),
        "min": value.get("min", 0.0), "max": value.get("max", 0.0), "centroids": centroids,
    }


def _measurement(value: dict) -> dict:
    histogram = value.get("histogram")
    return {
        "I64": value.get("i64"),
        "I32": value.get("i32"),
        "F64": value.get("f64"),
        "F32": value.get("f32"),
        "StatisticSet": _set(value.get("statistic_set")),
        "Histogram": histogram and [(k, wire.signed(n)) for k, n in histogram["buckets"].items()],
        "Tdigest": _digest(value.get("tdigest")),
    }


def _datums(data: bytes, keys: frozenset[str] | None) -> Iterator[tuple]:
    """The columns of each datum of a request, with the shared dimensions laid over its own."""
    request = wire.decode(data, REQUEST, keys)
    shared = {k: _dimension(v) for k, v in request["shared_dimensions"].items()}
    for d in request["metrics"]:
        dimensions = {k: _dimension(v) for k, v in d["dimensions"].items()} | shared
        measurements = [(k, _measurement(v)) for k, v in d["measurements"].items()]
        yield d.get("metric", ""), Decimal(d.get("unix_nanos", 0)), [*dimensions.items()], measurements, None


def _decoder(
    schema: pa.Schema, framed: bool, keys: frozenset[str] | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for given in batches:
            for data in given.column(0).to_pylist():
                whole = b"" if data is None else data
                for one, complete in wire.messages(whole) if framed else [(whole, True)]:
                    try:
                        if not complete:
                            raise ValueError("the request ends early")
                        rows += _datums(one, keys)
                    except ValueError:
                        rows.append((None, None, None, None, base64.b64encode(one).decode()))
                    if len(rows) >= BATCH_ROWS:
                        yield batch()
        yield batch()

    return run


def decode_requests(
    df: DataFrame, col: str = "content", framed: bool = True, keys: Sequence[str] | None = None
) -> DataFrame:
    """Datums of a frame with binary requests, batch or streaming; malformed ones are kept.

    A value holds one request, or with ``framed`` any number of them, each with its length
    ahead. Shared dimensions are laid over each datum's own. With ``keys`` only
    those dimensions and measurements are made. The bytes of a request that
    cannot be read land in ``malformed``, in base 64; other requests of the same
    value are not affected, except behind one that ends early.
    """
    ddl = f"{DATUM_DDL}, malformed string"
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)
    chosen = None if keys is None else frozenset(keys)
    return df.select(F.col(col).cast("binary")).mapInArrow(_decoder(schema, framed, chosen), ddl)


def read_request_files(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Datums of landed files of requests with their lengths ahead."""
    return decode_requests(spark.read.format("binaryFile").load(path).select("content"), keys=keys)


def stream_request_files(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame:
    """The same for files as they land."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").load(path)
    return decode_requests(files.select("content"), keys=keys)
