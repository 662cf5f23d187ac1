"""Operators: histograms, digests, moving frames, skewed keys."""

import bisect
import math
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from widemetrics.functions import digest
from widemetrics.operators import digests, histograms, statsets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_empty_group_keeps_an_empty_histogram(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "g string, v double")
    got = {r["g"]: r["histogram"] for r in histograms.accumulate(df, ["g"], "v").collect()}
    assert got == {"a": {1.0: 2}, "b": {}}
    assert histograms.accumulate(df.where("false"), [], "v").collect()[0]["histogram"] == {}


def test_merge_keeps_empty_groups(spark):
    df = spark.sql("select * from values ('a', map(1L,2L)), ('a', map(1L,3L,5L,1L)), ('b', map()), ('b', null) t(g,h)")
    got = {r["g"]: r["histogram"] for r in histograms.merge(df, ["g"], "h").collect()}
    assert got == {"a": {1: 5, 5: 1}, "b": {}}


def test_merge_of_parts_is_the_whole(spark, events):
    parted = events.withColumn("p", F.col("user_id") % 5)
    parts = histograms.accumulate(parted, ["event_type", "p"], "value", "h")
    merged = {r[0]: r[1] for r in histograms.merge(parts, ["event_type"], "h", "h").collect()}
    whole = {r[0]: r[1] for r in histograms.accumulate(events, ["event_type"], "value", "h").collect()}
    assert merged == whole


def test_whole_buckets_only(spark):
    df = spark.sql("select map(1.0D, 2L) h union all select map(1.5D, 1L)")
    assert sorted(r["bucket"] for r in histograms.buckets(df, "h").collect()) == [1.0, 1.5]
    with pytest.raises(Exception, match="not whole"):
        histograms.buckets(df, "h", as_bigint=True).collect()


def brute_frames(rows, slots):
    """{(key, slot): Counter} over slots with rows of their own."""
    own = {(k, s) for k, s, _ in rows}
    return {
        (k, s): Counter(v for k2, s2, v in rows if k2 == k and s - slots < s2 <= s) for k, s in own
    }


def test_moving_histogram_against_brute_force(spark):
    start = datetime(2024, 1, 1)
    rows = [("ab"[i % 2], (i * 7) % 40, float(1 + i % 4)) for i in range(60)]
    df = spark.createDataFrame([(k, start + timedelta(hours=s), v) for k, s, v in rows], "k string, t timestamp, v double")
    got = histograms.moving(df, ["k"], "t", "v", 3600, 3, values=True, name="h").collect()
    base = int(datetime(2024, 1, 1).timestamp())
    want = brute_frames(rows, 3)
    assert len(got) == len(want)
    for r in got:
        hours = int((r["slot"] - start).total_seconds() // 3600)
        assert r["h"] == dict(want[r["k"], hours]), base


def test_moving_frame_keeps_a_slot_whose_histogram_is_empty(spark):
    df = spark.sql(
        "select * from values ('a', timestamp'2024-01-01 00:00:00', map(1L,2L)),"
        " ('a', timestamp'2024-01-01 01:00:00', map()) t(k,t,h)")
    got = {r["slot"].hour: r["histogram"] for r in histograms.moving(df, ["k"], "t", "h", 3600, 2).collect()}
    assert got == {0: {1: 2}, 1: {1: 2}}


def test_moving_sets_against_brute_force(spark):
    start = datetime(2024, 1, 1)
    rows = [("ab"[i % 2], (i * 7) % 40, float(1 + i % 4)) for i in range(60)]
    df = spark.createDataFrame([(k, start + timedelta(hours=s), v) for k, s, v in rows], "k string, t timestamp, v double")
    got = statsets.moving(df, ["k"], "t", "v", 3600, 4, values=True, name="s").collect()
    want = brute_frames(rows, 4)
    assert len(got) == len(want)
    for r in got:
        values = list(want[r["k"], int((r["slot"] - start).total_seconds() // 3600)].elements())
        assert tuple(r["s"]) == (min(values), max(values), pytest.approx(sum(values)), len(values))


def test_aggregates_are_partial_and_hashed(spark, events):
    text = plan(histograms.accumulate(events, ["event_type"], "value"))
    assert "SortAggregate" not in text and "partial_count" in text
    text = plan(statsets.moving(events, ["event_type"], "ts", "value", 3600, 3, values=True))
    assert "Window" not in text and "SortAggregate" not in text


# Digests


def rank(sorted_values, x):
    return (bisect.bisect_left(sorted_values, x) + bisect.bisect_right(sorted_values, x)) / 2 / len(sorted_values)


def test_digest_rank_error(spark):
    df = spark.range(200_000).select((F.exp(F.randn(3) * 2)).alias("v")).cache()
    d = digests.accumulate(df, [], "v", "d")
    exact = sorted(r[0] for r in df.collect())
    marks = [0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999]
    row = d.select("d", *[digest.quantile("d", q).alias(f"q{i}") for i, q in enumerate(marks)]).first()
    assert len(row["d"]["centroids"]) <= 100
    assert row["d"]["count"] == 200_000
    assert (row["d"]["min"], row["d"]["max"]) == (exact[0], exact[-1])
    assert row["d"]["sum"] == pytest.approx(sum(exact))
    for i, q in enumerate(marks):
        assert abs(rank(exact, row[f"q{i}"]) - q) < 0.02 * math.sqrt(q * (1 - q)) + 2e-4


def test_digest_of_merged_parts(spark):
    df = spark.range(50_000).select((F.col("id") % 9).alias("p"), (F.rand(5) * 100 - 50).alias("v")).cache()
    parts = digests.accumulate(df, ["p"], "v", "d")
    row = digests.merge(parts, [], "d", "d").select("d", digest.quantile("d", 0.5).alias("m")).first()
    exact = sorted(r["v"] for r in df.collect())
    assert row["d"]["count"] == 50_000 and row["d"]["min"] == exact[0] and row["d"]["max"] == exact[-1]
    assert abs(rank(exact, row["m"]) - 0.5) < 0.01


def test_digest_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double")
    got = {r["g"]: r for r in digests.accumulate(df, ["g"], "v", "d").withColumn("q", digest.quantile("d", 0.5)).collect()}
    assert got["a"]["d"]["count"] == 0 and got["a"]["d"]["centroids"] == [] and got["a"]["q"] is None
    assert got["b"]["q"] == 2.0
    merged = digests.merge(digests.accumulate(df, ["g"], "v", "d"), ["g"], "d", "d")
    assert {r["g"]: r["d"]["count"] for r in merged.collect()} == {"a": 0, "b": 1}


def test_digest_refuses_nan(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,)], "v double")
    with pytest.raises(Exception, match="no place"):
        digests.accumulate(df, [], "v").collect()
    assert digests.accumulate(df, [], "v", "d", invalid="skip").first()["d"]["count"] == 1


def test_digest_cells_bound_what_is_sorted(spark):
    """A key with all the rows shuffles its distinct cells, not its rows."""
    df = spark.range(300_000).select(F.lit("hot").alias("g"), (1 + F.rand(1)).alias("v"))
    cells = df.groupBy("g", digests.cell(F.col("v"))).count()
    assert cells.count() <= 4096 + 1
    assert cells.agg(F.sum("count")).first()[0] == 300_000


def test_cells_hold_their_values(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, -0.0, 1.0, 1.0001, -3.7, 1e-310, 1e308, 5e-324, 4096.5)], "v double")
    for v, c in df.select("v", digests.cell(F.col("v"))).collect():
        assert c <= v and abs(v - c) <= abs(v) * 2.0**-11
