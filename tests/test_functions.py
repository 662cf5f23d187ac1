"""Column expressions on hand-worked rows."""

import math

import pytest
from pyspark.sql import functions as F

from widemetrics.functions import digest, seh, statset
from widemetrics.functions.ident import clean_column, clean_id, clean_name
from widemetrics.functions.text import parse_boolean, parse_float, plain_number
from widemetrics.functions.timefn import chunk_of, nanos_to_ts, time_bucket


def values(spark, items, ddl, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {ddl}")
    rows = df.coalesce(1).select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Héllo--World", "héllo_world"),
        ("a.b/c d", "a_b_c_d"),
        ("ÀB__c!!", "àb__c_"),
        ("already_clean", "already_clean"),
        ("日本 語", "日本_語"),
        ("Ⓐ-x", "ⓐ_x"),
    ],
)
def test_clean_id_of_a_column_and_of_a_name(spark, raw, want):
    assert values(spark, [raw], "string", clean_id) == [want]
    assert clean_name(spark, raw) == want


def test_reserved_columns_move_aside(spark):
    assert values(spark, ["Time", "chunk", "other"], "string", clean_column) == [
        "time_",
        "chunk_",
        "other",
    ]


def test_nanos_round_to_microseconds(spark):
    got = values(spark, [1499, 1500, 0], "bigint",
                 lambda c: F.unix_micros(nanos_to_ts(c.cast("decimal(20,0)"))))
    assert got == [1, 2, 0]


def test_weeks_start_on_monday(spark):
    week = lambda c: time_bucket("1 week", c.cast("timestamp_ntz")).cast("string")
    assert values(spark, ["2024-01-03 10:00:00", "2024-01-08 00:00:00"], "string", week) == [
        "2024-01-01 00:00:00",
        "2024-01-08 00:00:00",
    ]


def test_chunks_before_the_epoch(spark):
    got = values(spark, ["1969-12-31 23:00:00", "1970-01-01 05:00:00"], "string",
                 lambda c: chunk_of(c.cast("timestamp")))
    assert got == [-14400, 14400]


def test_plain_number(spark):
    numbers = [0.0, 1.0, 1.5, 1e7, 1.5e-5, -2.5e10, 1.25e15, 123456789.25, None]
    assert values(spark, numbers, "double", plain_number) == [
        "0", "1", "1.5", "10000000", "0.000015", "-25000000000", "1250000000000000",
        "123456789.25", None,
    ]
    assert values(spark, [math.nan, math.inf, -math.inf], "double", plain_number) == [
        "NaN", "inf", "-inf",
    ]
    assert values(spark, [1e308], "double", plain_number) == ["1" + "0" * 308]


def test_parse_float_takes_no_suffix(spark):
    got = values(spark, ["1e3", "1.0d", "+Inf", ".5", "5.", "oops", ""], "string", parse_float)
    assert got == [1000.0, None, math.inf, 0.5, 5.0, None, None]


def test_parse_boolean(spark):
    got = values(spark, ["on", "OFF", "t", "0", "maybe"], "string", parse_boolean)
    assert got == [True, False, True, False, None]


# Statistic sets


def agg(df, *exprs):
    return df.agg(*exprs).first()


def test_aggregating_nothing_gives_the_identity(spark):
    none = spark.createDataFrame([(None,), (None,)], "v double")
    row = agg(none, statset.accumulate("v").alias("s"))["s"]
    assert tuple(row) == (1e308, -1e308, 0.0, 0)
    sets = none.select(F.lit(None).cast("struct<minimum:double,maximum:double,samplesum:double,samplecount:bigint>").alias("s"))
    row = agg(sets, statset.merge("s").alias("m"), statset.avg_agg("s").alias("a"),
              statset.min_agg("s").alias("lo"), statset.max_agg("s").alias("hi"),
              statset.sum_agg("s").alias("t"), statset.count_agg("s").alias("n"))
    assert tuple(row["m"]) == (1e308, -1e308, 0.0, 0)
    assert (row["a"], row["lo"], row["hi"], row["t"], row["n"]) == (0.0, 1e308, -1e308, 0.0, 0.0)
    assert isinstance(row["n"], float)


def test_nan_and_infinity(spark):
    row = agg(spark.createDataFrame([(math.nan,), (1.0,)], "v double"), statset.accumulate("v").alias("s"))["s"]
    assert row["minimum"] == 1.0 and math.isnan(row["maximum"]) and row["samplecount"] == 2
    row = agg(spark.createDataFrame([(math.inf,)], "v double"), statset.accumulate("v").alias("s"))["s"]
    assert row["minimum"] == 1e308 and row["maximum"] == math.inf


def test_merge_of_parts_is_the_whole(spark, events):
    whole = events.groupBy("event_type").agg(statset.accumulate("value").alias("s"))
    parts = events.groupBy("event_type", F.col("user_id") % 7).agg(statset.accumulate("value").alias("p"))
    merged = parts.groupBy("event_type").agg(statset.merge("p").alias("s"))
    a = {r[0]: r[1] for r in whole.collect()}
    for name, s in merged.collect():
        assert (s["minimum"], s["maximum"], s["samplecount"]) == (
            a[name]["minimum"], a[name]["maximum"], a[name]["samplecount"])
        assert s["samplesum"] == pytest.approx(a[name]["samplesum"])


def test_set_text_both_ways(spark):
    df = spark.sql("select named_struct('minimum',1D,'maximum',2.5D,'samplesum',8D,'samplecount',6L) s")
    text = statset.to_text("s")
    assert df.select(text).first()[0] == "(1,2.5,8,6)"
    assert tuple(df.select(statset.from_text(text).alias("b")).first()["b"]) == (1.0, 2.5, 8.0, 6)
    bad = values(spark, ["(1,2,3)", "(1,2,x,4)", "no", "(1,2,3,4,5)"], "string", statset.from_text)
    assert bad == [None] * 4


def test_average_of_an_empty_set_is_zero(spark):
    df = spark.sql("select named_struct('minimum',1D,'maximum',2D,'samplesum',8D,'samplecount',n) s from values (0L),(4L) t(n)")
    assert [r[0] for r in df.select(statset.avg("s")).collect()] == [0.0, 2.0]


# Histograms


def test_bucket_bounds(spark):
    pairs = [(0.0, 0.0), (1.0, 1.0), (1.2, 1.5), (9.9, 10.0), (10.0, 10.0), (11.0, 15.0), (15.0, 15.0),
             (99.0, 100.0), (100.0, 100.0), (0.05, 0.05), (12345.0, 15000.0), (1e300, 1e300),
             (5e-324, 5e-324), (None, None)]
    got = values(spark, [p[0] for p in pairs], "double", seh.bucket)
    assert got == [p[1] for p in pairs]


def test_numbers_without_a_bucket(spark):
    for bad in (-1.0, math.nan, math.inf):
        with pytest.raises(Exception, match="has no bucket|have no bucket"):
            values(spark, [bad], "double", seh.bucket)
    mirrored = lambda c: seh.bucket(c, negative="mirror", invalid="skip")
    assert values(spark, [-1.2, -0.0, math.nan, math.inf, 1.2], "double", mirrored) == [
        -1.5, 0.0, None, None, 1.5]


def test_combine_then_subtract(spark):
    df = spark.sql("select map(1L,2L,3L,4L) a, map(3L,1L,5L,6L) b")
    both = seh.combine("a", "b")
    row = df.select(both.alias("c"), seh.subtract(both, "b").alias("d"), seh.count("a").alias("n")).first()
    assert row["c"] == {1: 2, 3: 5, 5: 6} and row["d"] == {1: 2, 3: 4} and row["n"] == 6


def test_histogram_json_both_ways(spark):
    df = spark.sql("select map(5L,6L,1L,2L,3L,4L) h")
    text = seh.to_json("h")
    assert df.select(text).first()[0] == '{"1":2,"3":4,"5":6}'
    assert df.select(seh.from_json(text)).first()[0] == {1: 2, 3: 4, 5: 6}
    assert values(spark, ['{"a":1}', '{"1":"x"}', "[]"], "string", seh.from_json) == [None] * 3
    assert spark.sql("select map(0.05D,1L,10000000D,2L) h").select(seh.to_json("h", "double")).first()[0] == (
        '{"0.05":1,"10000000":2}')


# Digests


def test_digest_text(spark):
    df = spark.sql(
        "select named_struct('max_buckets',100,'count',42L,'sum',42.3D,'min',1D,'max',1.3D,'centroids',"
        "array(named_struct('mean',1D,'weight',41L),named_struct('mean',1.3D,'weight',1L))) d")
    assert df.select(digest.to_text("d")).first()[0] == (
        "(version:1,max_buckets:100,count:42,sum:42.3,min:1,max:1.3,"
        "centroids:[(mean:1,weight:41),(mean:1.3,weight:1)])")
    low, high = df.select(digest.quantile("d", 0.0), digest.quantile("d", 1.0)).first()
    assert (low, high) == (1.0, pytest.approx(1.3))


def test_digest_quantile_out_of_range(spark):
    with pytest.raises(ValueError):
        digest.quantile("d", 1.5)
