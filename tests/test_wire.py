"""Requests and envelopes in their binary forms, and the standard's JSON."""

import base64
import json
import random
import struct
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from samples import DATUM, datum, frame

from widemetrics.functions import wire, wirecolumns
from widemetrics.operators.wide import ColumnSpec, dimension_col, measurement_col
from widemetrics.session import Folder, shared_dir
from widemetrics.sinks import otlp
from widemetrics.sources import requests
from widemetrics.sources.datums import parse_request_columns, parse_requests

NANOS = 1704067200 * 10**9


def put(number, width, body):
    """A field by hand: what a client of its own would send."""
    def digits(n):
        out = b""
        while n > 127:
            out += bytes([n % 128 + 128])
            n //= 128
        return out + bytes([n])
    tag = digits(number * 8 + width)
    return tag + (digits(body) if width == 0 else digits(len(body)) + body if width == 2 else body)


def entry(number, key, value):
    return put(number, 2, put(1, 2, key.encode()) + put(2, 2, value))


def sample_request():
    """Bytes and JSON of one request with every kind of value."""
    double = lambda x: struct.pack("<d", x)
    bucket = lambda k, n: put(1, 2, put(1, 0, k % 2**64) + put(2, 0, n))
    measurements = [
        ("a", put(1, 0, (-5) % 2**64)), ("b", put(2, 0, (-7) % 2**64)), ("c", put(4, 1, double(1.5))),
        ("d", put(5, 5, struct.pack("<f", 0.25))),
        ("e", put(6, 2, put(1, 1, double(1.0)) + put(2, 1, double(2.0)) + put(3, 1, double(3.0)) + put(4, 0, 2))),
        ("f", put(7, 2, bucket(10, 5) + bucket(-20, 1))),
        ("g", put(8, 2, put(1, 2, put(1, 1, double(4.0)) + put(2, 0, 3)) + put(2, 1, double(12.0)) + put(3, 0, 3)
                  + put(4, 1, double(5.0)) + put(5, 1, double(3.5)))),
        ("unset", b""),
    ]
    own = [("host", put(1, 2, "hé".encode())), ("n", put(2, 0, 2**64 - 1)), ("ok", put(3, 0, 0)), ("az", put(1, 2, b"own"))]
    d = put(1, 2, b"m") + put(2, 0, NANOS) + b"".join(entry(3, k, v) for k, v in own)
    d += b"".join(entry(4, k, v) for k, v in measurements) + put(99, 2, b"unknown") + put(98, 0, 7)
    data = put(2, 2, d) + entry(1, "az", put(1, 2, b"z1")) + put(2, 2, put(1, 2, b"bare"))
    wide = {
        "a": {"I64": -5}, "b": {"I32": -7}, "c": {"F64": 1.5}, "d": {"F32": 0.25},
        "e": {"StatisticSet": {"minimum": 1.0, "maximum": 2.0, "samplesum": 3.0, "samplecount": 2}},
        "f": {"Histogram": {"buckets": {"10": 5, "-20": 1}}},
        "g": {"Tdigest": {"sum": 12.0, "count": 3, "min": 3.5, "max": 5.0, "centroids": [{"mean": 4.0, "weight": 3}]}},
    }
    dims = {"host": {"String": "hé"}, "n": {"Number": 2**64 - 1}, "ok": {"Boolean": False}, "az": {"String": "own"}}
    one = json.loads(datum("m", NANOS, dims, wide))
    one["measurements"]["unset"] = {"value": {}}
    text = {"shared_dimensions": {"az": {"value": {"String": "z1"}}},
            "metrics": [one, {"metric": "bare", "unix_nanos": 0, "dimensions": {}, "measurements": {}}]}
    return data, json.dumps(text)


def rows_of(df):
    """Rows as plain values, maps as sorted lists."""
    def plain(x):
        if isinstance(x, dict):
            return sorted((k, plain(v)) for k, v in x.items())
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x
    return sorted((plain(list(r)) for r in df.collect()), key=repr)


def test_bytes_give_the_rows_of_the_json(spark):
    data, text = sample_request()
    got = requests.decode_requests(spark.createDataFrame([(bytearray(data),)], "content binary"), framed=False)
    want = parse_requests(spark.createDataFrame([(text,)], "value string"))
    assert rows_of(got.drop("malformed")) == rows_of(want)
    assert got.where("malformed is null").count() == 2


def test_chosen_columns_equal_those_of_whole_datums(spark):
    _, text = sample_request()
    df = spark.createDataFrame([(text,), ("{",), ('{"shared_dimensions":{},"metrics":[]}',)], "value string")
    kinds = {
        "az": ("dimension", "string"), "n": ("dimension", "bigint"), "ok": ("dimension", "boolean"),
        "absent": ("dimension", "string"), "a": ("measurement", "bigint"), "d": ("measurement", "double"),
        "e": ("measurement", "statistic_set"), "f": ("measurement", "histogram"), "g": ("measurement", "tdigest"),
        "unset": ("measurement", "double"),
    }
    specs = [ColumnSpec(k, kind, t, ((kind, k),)) for k, (kind, t) in kinds.items()]
    got = parse_request_columns(df, specs)
    col = {"dimension": dimension_col, "measurement": measurement_col}
    want = parse_requests(df).select(
        "metric", "unix_nanos", *[col[kind](k, t).alias(k) for k, (kind, t) in kinds.items()]
    )
    assert rows_of(got) == rows_of(want) and got.columns == want.columns


def test_own_encoder_equals_the_hand_made_bytes():
    data, _ = sample_request()
    values = wire.decode(data, requests.REQUEST)
    assert wire.decode(wire.encode(values, requests.REQUEST), requests.REQUEST) == values


def test_files_batch_and_stream_with_chosen_keys(spark, tmp_path):
    data, _ = sample_request()
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"f{i}").write_bytes(wire.delimited(data) * (i + 1))
    got = requests.read_request_files(spark, str(inbox), keys=["az", "c"])
    assert got.count() == 12 and got.where("malformed is not null").count() == 0
    row = got.where("metric = 'm'").first()
    assert set(row["dimensions"]) == {"az"} and row["dimensions"]["az"]["String"] == "z1"
    assert set(row["measurements"]) == {"c"}
    folder = shared_dir(spark, "wire-stream")
    run = requests.stream_request_files(spark, str(inbox)).writeStream.format("parquet").option("path", f"{folder}/o")
    run.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination(60)
    stored = spark.read.parquet(f"{folder}/o")
    assert rows_of(stored) == rows_of(requests.read_request_files(spark, str(inbox)))


def test_broken_requests_keep_their_bytes_and_spare_the_others(spark):
    data, _ = sample_request()
    broken = put(2, 2, put(1, 2, b"\xff\xfe"))
    values = [wire.delimited(data) + wire.delimited(broken) + wire.delimited(data), wire.delimited(data)[:-3], b"", None, b"\x80"]
    df = spark.createDataFrame([(None if v is None else bytearray(v),) for v in values], "content binary")
    got = requests.decode_requests(df).collect()
    assert sum(r["malformed"] is None for r in got) == 4
    bad = [base64.b64decode(r["malformed"]) for r in got if r["malformed"] is not None]
    assert broken in bad and len(bad) == 3


def test_any_bytes_are_read_or_refused():
    rng = random.Random(6)
    data, _ = sample_request()
    for _ in range(3000):
        changed = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            changed[rng.randrange(len(changed))] = rng.randrange(256)
        try:
            wire.decode(bytes(changed[: rng.randint(0, len(changed))]), requests.REQUEST)
        except ValueError:
            pass


def test_envelopes_in_binary_and_standard_json_hold_the_metrics(spark):
    texts = [DATUM, *[datum("m", i, {"k": {"Boolean": True}}, {"v": {"I64": i - 2**62}}) for i in range(9)]]
    metrics = otlp.to_otlp(frame(spark, *texts)).coalesce(2).cache()
    want = rows_of(metrics)
    sent = otlp.otlp_wire(metrics, max_metrics=4)
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString().split("InMemory")[0]
    got = otlp.request_metrics(otlp.parse_wire(sent))
    # A list that was empty is there as such; absent numbers are null again.
    assert rows_of(got) == want
    sizes = otlp.parse_wire(sent).select(F.size(F.col("resource_metrics")[0]["instrumentation_library_metrics"][0]["metrics"]))
    assert max(r[0] for r in sizes.collect()) <= 4
    standard = otlp.otlp_request(metrics, 4, standard=True)
    assert rows_of(otlp.request_metrics(otlp.parse_requests(standard, standard=True))) == want
    one = json.loads(standard.first()[0])
    found = one["resourceMetrics"][0]["instrumentationLibraryMetrics"][0]["metrics"]
    points = [m["gauge"]["dataPoints"][0] for m in found if "gauge" in m]
    assert all(isinstance(p["timeUnixNano"], str) and "_" not in "".join(p) for p in points)
    assert any(isinstance(p.get("asInt"), str) for p in points)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 2**32, 2**63, 2**64 - 1])
def test_varints(n):
    assert wire.read_varint(wire.varint(n) + b"x", 0) == (n, len(wire.varint(n)))


def some_value(rng, kind, size):
    if isinstance(kind, wire.Message):
        return some_values(rng, kind, size)
    return {
        "string": lambda: "".join(rng.choices("aé𝄞 \0", k=rng.choice([0, 1, 5, 200]))),
        "bool": lambda: rng.random() < 0.5,
        "double": lambda: rng.choice([0.0, -0.0, 1e-310, -1.5, float("inf"), 1e308]),
        "fixed64": lambda: rng.choice([0, 1, 2**63, 2**64 - 1]),
        "sfixed64": lambda: rng.choice([0, -1, 2**63 - 1, -(2**63)]),
        "int32": lambda: rng.choice([0, 1, 127, 128, -1, 2**31 - 1, -(2**31)]),
        "int64": lambda: rng.choice([0, -1, 300, 2**63 - 1, -(2**63)]),
    }[kind]()


def some_values(rng, of, size=3):
    out = {}
    for f in of.fields.values():
        if f.repeated:
            out[f.name] = [some_value(rng, f.kind, size) for _ in range(rng.choice([0, 0, 1, size]))]
        else:
            out[f.name] = some_value(rng, f.kind, size) if rng.random() < 0.6 else None
    return out


def arrow_type(of):
    plain = {"string": pa.string(), "bool": pa.bool_(), "double": pa.float64(), "fixed64": pa.decimal128(20, 0),
             "sfixed64": pa.int64(), "int32": pa.int32(), "int64": pa.int64()}

    def one(f):
        kind = arrow_type(f.kind) if isinstance(f.kind, wire.Message) else plain[f.kind]
        return pa.list_(kind) if f.repeated else kind

    return pa.struct([(f.name, one(f)) for f in of.fields.values()])


@pytest.mark.parametrize("seed,n,size", [(1, 300, 3), (2, 5, 90), (3, 1, 1), (4, 0, 1), (5, 64, 40)])
def test_columns_are_encoded_and_decoded_as_single_messages_are(seed, n, size):
    rng = random.Random(seed)
    kind = arrow_type(otlp.METRIC)
    rows = [some_values(rng, otlp.METRIC, size) for _ in range(n)]
    column = pa.array([None, *rows, {}, None], kind)
    bytes_of = wirecolumns.encode_column(column, otlp.METRIC).to_pylist()
    assert bytes_of == [None if r is None else wire.encode(r, otlp.METRIC) for r in column.to_pylist()]
    # Slices begin and end within the buffers of the whole.
    for part in (column.slice(1, n), column.slice(n // 2, 2)):
        want = [None if r is None else wire.encode(r, otlp.METRIC) for r in part.to_pylist()]
        assert wirecolumns.encode_column(part, otlp.METRIC).to_pylist() == want
    sent = pa.array([b for b in bytes_of if b is not None], pa.binary())
    want = pa.array([wire.decode(b, otlp.METRIC) for b in sent.to_pylist()], kind)
    assert wirecolumns.decode_column(sent, otlp.METRIC, kind).equals(want)
    assert wirecolumns.decode_column(sent.slice(1), otlp.METRIC, kind).equals(want.slice(1))
    cut = list(wirecolumns.pieces(sent, 200))
    assert pa.chunked_array(cut, pa.binary()).combine_chunks().equals(sent) if cut else not len(sent)


def test_columns_of_any_bytes_are_what_single_messages_are():
    """Each message by itself, and among so many that they are read field by field."""
    rng = random.Random(7)
    kind = arrow_type(otlp.METRIC)
    good = [wire.encode(some_values(rng, otlp.METRIC), otlp.METRIC) for _ in range(60)]
    # Fields sent again, unknown ones, and lists of numbers that are not packed, or partly.
    doubled = b"".join(good[:5]) + put(99, 2, b"unknown") + put(98, 0, 2**63) + put(97, 5, b"1234")
    one = struct.pack("<d", 2.5)
    loose = put(9, 2, put(1, 2, put(7, 1, one) + put(7, 2, one + one) + put(6, 1, b"8" * 8) + put(7, 1, one)))
    refused = 0
    for _ in range(1500):
        changed = bytearray(rng.choice([*good, doubled, loose]))
        for _ in range(rng.randint(0, 3)):
            if changed:
                changed[rng.randrange(len(changed))] = rng.choice([0x80, 0xFF, rng.randrange(256)])
        changed = bytes(changed[: rng.choice([len(changed), rng.randint(0, len(changed))])])
        try:
            want = pa.array([wire.decode(changed, otlp.METRIC)], kind)
        except (ValueError, OverflowError):
            want, refused = None, refused + 1
        for many in ([changed], [*good, changed, *good]):
            sent = pa.array(many, pa.binary())
            if want is None:
                with pytest.raises(ValueError):
                    wirecolumns.decode_column(sent, otlp.METRIC, kind)
            else:
                at = many.index(changed)
                got = wirecolumns.decode_column(sent, otlp.METRIC, kind).slice(at, 1)
                assert repr(got.to_pylist()) == repr(want.to_pylist())
    assert 100 < refused < 1400


def test_columns_take_less_than_half_the_time_of_single_messages():
    rng = random.Random(8)
    some = [some_values(rng, otlp.METRIC) for _ in range(100)]
    rows = pa.array(some * 40, arrow_type(otlp.METRIC))

    def single():
        sent = pa.array([wire.encode(r, otlp.METRIC) for r in rows.to_pylist()])
        return pa.array([wire.decode(b, otlp.METRIC) for b in sent.to_pylist()], rows.type)

    def columns():
        return wirecolumns.decode_column(wirecolumns.encode_column(rows, otlp.METRIC), otlp.METRIC, rows.type)

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    assert columns().slice(0, 100).to_pylist() == single().slice(0, 100).to_pylist()
    assert min(seconds(columns) for _ in range(3)) < min(seconds(single) for _ in range(2)) / 2


def test_metrics_go_to_python_with_the_points_of_all_kinds_in_one_list(spark):
    sent = otlp.otlp_wire(otlp.to_otlp(frame(spark, DATUM)))
    handed = sent._jdf.queryExecution().analyzed().children().head().schema().treeString()
    assert handed.count("attributes: array") == 1


def test_metrics_of_other_shapes_are_sent_with_the_fields_they_have(spark):
    metrics = otlp.to_otlp(frame(spark, DATUM))
    some = metrics.select("gauge", "name", F.lit(3).alias("other")).where("gauge is not null")
    got = otlp.request_metrics(otlp.parse_wire(otlp.otlp_wire(some)))
    assert rows_of(got.select("gauge", "name")) == rows_of(some.select("gauge", "name"))
    assert got.where("unit is not null or summary is not null").count() == 0
    empty = metrics.withColumn("gauge", F.col("gauge").withField("data_points", F.filter("gauge.data_points", lambda _: F.lit(False))))
    back = otlp.request_metrics(otlp.parse_wire(otlp.otlp_wire(empty)))
    assert rows_of(back) == rows_of(empty) and empty.where("size(gauge.data_points) = 0").count()


def test_written_envelopes_lie_in_row_groups_that_a_task_can_hold(spark):
    rng = random.Random(9)
    rows = [(bytearray(rng.randbytes(1 << 20)),) for _ in range(24)]
    folder = shared_dir(spark, "wire-groups")
    otlp.write_wire(spark.createDataFrame(rows, "request binary").coalesce(1), folder)
    (name,) = Folder(spark, folder).glob("*.parquet")
    file = pq.ParquetFile(name.removeprefix("file:"))
    sizes = [file.metadata.row_group(i).total_byte_size for i in range(file.num_row_groups)]
    assert len(sizes) >= 3 and max(sizes) < 10 << 20
    assert rows_of(spark.read.parquet(folder)) == rows_of(spark.createDataFrame(rows, "request binary"))
