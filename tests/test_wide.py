"""Schema discovery, projection and conflicts."""

import pytest
from pyspark.sql import functions as F
from samples import DATUM, DIMENSIONS, MEASUREMENTS, MOMENT, datum, frame

from widemetrics.operators import wide
from widemetrics.operators.wide import ColumnSpec, dimension_col, measurement_col
from widemetrics.sinks import delimited


def schema_of(df):
    return wide.collect_schema(wide.discover_schema(df))


def test_sample_widens_in_column_order(spark):
    df = frame(spark, DATUM)
    rows = wide.widen(df, schema_of(df)["depot"])
    assert rows.columns == [
        "time", "cooled", "depot", "pallets",
        "forklifts", "load", "parcels", "sizes", "trip", "wait", "weight"]
    assert dict(rows.dtypes)["forklifts"] == "int" and dict(rows.dtypes)["load"] == "float"
    row = rows.first()
    assert row["sizes"] == {10: 5, 20: 1, 45: 2} and row["pallets"] == 9 and row["cooled"] is False


def test_earliest_value_fixes_the_type(spark):
    df = frame(
        spark,
        datum("m", 2000, meas={"v": {"F64": 1.5}}),
        datum("m", 1000, meas={"v": {"I64": 3}}),
        datum("m", 3000, meas={"v": {"F64": 4.0}}),
    )
    columns = schema_of(df)["m"]
    assert [(c.name, c.type, c.uniform) for c in columns] == [("v", "bigint", False)]
    kept = [r["v"] for r in wide.widen(df, columns).orderBy("time").collect()]
    assert kept == [3, 4]
    bad = wide.rejects(df, columns).collect()
    assert [(r["conflicts"], int(r["unix_nanos"])) for r in bad] == [(["v"], 2000)]
    assert wide.widen(df, columns, "drop_batch").count() == 0
    assert wide.widen(df, columns, "null").count() == 3
    with pytest.raises(ValueError):
        wide.widen(df, columns, "nonsense")


def test_a_dimension_goes_before_a_measurement(spark):
    df = frame(spark, datum("m", 1, {"x": {"String": "a"}}, {"x": {"I64": 1}}))
    (column,) = schema_of(df)["m"]
    assert (column.kind, column.type) == ("dimension", "string")
    assert wide.widen(df, [column]).first()["x"] == "a"


def test_names_that_clean_alike_share_a_column(spark):
    df = frame(
        spark,
        datum("My Metric", 1, {"Host-Name": {"String": "b"}, "host.name": {"String": "a"}, "time": {"String": "t"}}),
        datum("my-metric", 2, {"host.name": {"String": "c"}}),
    )
    schema = schema_of(df)
    assert list(schema) == ["my_metric"]
    assert [(c.name, len(c.sources)) for c in schema["my_metric"]] == [("host_name", 2), ("time_", 1)]
    rows = wide.widen(df, schema["my_metric"]).orderBy("time").collect()
    assert [(r["host_name"], r["time_"]) for r in rows] == [("b", "t"), ("c", None)]


def test_unset_values_make_no_column(spark):
    df = frame(spark, '{"metric":"m","unix_nanos":1,"dimensions":{"a":{}},"measurements":{"b":{"value":{"I32":1}}}}')
    assert [c.name for c in schema_of(df)["m"]] == ["b"]


def test_missing_empty_and_overflowing_values(spark):
    df = frame(
        spark,
        datum("m", 1, {"s": {"String": ""}, "n": {"Number": 2**64 - 1}}),
        datum("m", 2, {"s": {"String": "x"}, "n": {"Number": 7}}),
        datum("m", 3),
    )
    columns = schema_of(df)["m"]
    assert [(c.name, c.uniform) for c in columns] == [("n", False), ("s", True)]
    rows = wide.widen(df, columns).orderBy("time").collect()
    assert [(r["n"], r["s"]) for r in rows] == [(7, "x"), (None, None)]
    assert [r["conflicts"] for r in wide.rejects(df, columns).collect()] == [["n"]]
    assert [r[0] for r in df.select(dimension_col("s")).collect()] == [None, "x", None]


@pytest.mark.parametrize(
    "value, type_name, want",
    [
        ({"String": "12"}, "bigint", 12),
        ({"String": "12.5"}, "bigint", None),
        ({"String": "1e3"}, "double", 1000.0),
        ({"String": "yes"}, "boolean", True),
        ({"String": "(1,2,3,4)"}, "statistic_set", (1.0, 2.0, 3.0, 4)),
        ({"String": '{"1":2}'}, "histogram", {1: 2}),
        ({"String": "x"}, "tdigest", None),
        ({"Number": 5}, "string", "5"),
        ({"Number": 1}, "boolean", True),
        ({"Number": 2}, "boolean", None),
        ({"Number": 5}, "double", 5.0),
        ({"Boolean": True}, "string", "true"),
        ({"Boolean": True}, "bigint", None),
    ],
)
def test_dimensions_read_as_another_type(spark, value, type_name, want):
    got = frame(spark, datum("m", 1, {"x": value})).select(dimension_col("x", type_name).alias("r")).first()["r"]
    assert (tuple(got) if type_name == "statistic_set" and got else got) == want


@pytest.mark.parametrize(
    "value, type_name, want",
    [
        ({"F64": 3.0}, "int", 3),
        ({"F64": 3.5}, "bigint", None),
        ({"F32": 6.1}, "double", 6.1),
        ({"I64": 2**40}, "int", None),
        ({"I32": 5}, "bigint", 5),
        ({"F64": 1e7}, "string", "10000000"),
        ({"Histogram": {"buckets": {"30": 8, "10": 5}}}, "string", '{"10":5,"30":8}'),
        ({"StatisticSet": {"minimum": 0.5, "maximum": 7, "samplesum": 30, "samplecount": 12}}, "string", "(0.5,7,30,12)"),
        ({"Histogram": {"buckets": {"3": 4}}}, "double", None),
    ],
)
def test_measurements_read_as_another_type(spark, value, type_name, want):
    df = frame(spark, datum("m", 1, None, {"x": value}))
    assert df.select(measurement_col("x", type_name)).first()[0] == want


def test_discovery_is_a_hash_aggregate(spark):
    df = frame(spark, DATUM)
    text = wide.observed_keys(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "partial_min" in text


def test_tables_without_values_are_found(spark):
    df = frame(spark, datum("a", 1), datum("b", 1, None, {"x": {"I64": 1}}), datum("c", 1, {"unset": {}}))
    found = wide.collect_schema(wide.discover_tables(df))
    assert {t: [c.name for c in columns] for t, columns in found.items()} == {"a": [], "b": ["x"], "c": []}
    assert wide.discover_schema(df).count() == 1


def test_each_set_of_columns_is_one_frame(spark):
    df = frame(spark, *[datum(m, 1, None, {k: {"I64": 1}}) for m, k in (("a", "x"), ("b", "x"), ("c", "y"))])
    parts = wide.widen_each(df)
    assert sorted(tables for tables, _ in parts) == [["a", "b"], ["c"]]
    assert sorted(r["table"] for _, rows in parts for r in rows.collect()) == ["a", "b", "c"]


def test_a_wide_table_of_many_columns_plans(spark):
    keys = [f"d{i}" for i in range(150)]
    df = frame(spark, datum("m", 1, {k: {"String": k} for k in keys}))
    mixed = [ColumnSpec(k, "dimension", "string", (("dimension", k),)) for k in keys]
    assert wide.widen(df, mixed).first()["d7"] == "d7"


def test_csv(spark, tmp_path):
    dims = {**DIMENSIONS, "depot": {"String": 'a "q", b'}}
    df = frame(spark, datum("Depot", MOMENT, dims, MEASUREMENTS), datum("Depot", MOMENT + 123456789))
    columns = schema_of(df)["depot"]
    delimited.write_csv(df.coalesce(1), columns, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    first, second = part.read_text().splitlines()
    assert first == (
        '2023-11-14T22:13:20Z,false,"a ""q"", b",9,3,0.25,70000,"{""10"":5,""20"":1,""45"":2}",'
        '"(version:1,max_buckets:100,count:20,sum:64.5,min:2,max:9.5,centroids:[(mean:2.5,weight:17),(mean:7.33,weight:3)])",'
        '"(0.5,7,30,12)",812.5')
    assert second == "2023-11-14T22:13:20.123456789Z" + "," * 10


def test_split_metrics(spark):
    df = frame(spark, datum("A b", 1), datum("a-b", 2), datum("c", 3))
    parts = wide.split_metrics(df, ["a_b", "c"])
    assert {t: p.agg(F.count("*")).first()[0] for t, p in parts.items()} == {"a_b": 2, "c": 1}
