"""Dashboard query shapes."""

import pytest
from pyspark.sql import functions as F

from widemetrics.functions import digest, statset
from widemetrics.functions.sqlnames import register_functions
from widemetrics.operators import digests, histograms
from widemetrics.plans import panels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_does_not_sort_everything(spark, events):
    assert "TakeOrderedAndProject" in plan(panels.top_k(events, "value", 5, ["event_id"]))


def test_semi_join_sorts_no_rows_and_hints_nothing(spark, events):
    joined = panels.in_top_k(events, events, "user_id", "value", 5, ["event_id"])
    assert "LeftSemi" in plan(joined) and "TakeOrderedAndProject" in plan(joined)
    assert "strategy=broadcast" not in joined._jdf.queryExecution().logical().toString()
    large = panels.in_top_k(events, events, "user_id", "value", events.count(), ["event_id"])
    assert large.count() == events.count()


def test_many_histograms_and_sets_in_one_pass(spark, events):
    df = events.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    found = panels.multi_panel(
        df, "4 hours", {"a": "value", "b": "k"}, {"s": "value", "t": "k"}, ["event_type"], "ts")
    text = plan(found)
    assert text.count("FileScan") == 1
    key = lambda r: (r["time"], r["event_type"])
    got = {key(r): r for r in found.collect()}
    for name, c in (("a", "value"), ("b", "k")):
        timed = df.withColumn("time", F.window("ts", "4 hours").start)
        want = histograms.accumulate(timed, ["time", "event_type"], c, "h")
        assert {k: r[name] for k, r in got.items()} == {key(r): r["h"] for r in want.collect()}
        sets = timed.groupBy("time", "event_type").agg(statset.accumulate(c).alias("s")).collect()
        for r in sets:
            mine = got[key(r)]["s" if c == "value" else "t"]
            assert (mine["minimum"], mine["maximum"], mine["samplecount"]) == (r["s"]["minimum"], r["s"]["maximum"], r["s"]["samplecount"])
            assert abs(mine["samplesum"] - r["s"]["samplesum"]) < 1e-6


def test_bucket_options_reach_panels_and_frames(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, -2.0, float("nan")])], "s long, v double")
    df = rows.withColumn("time", F.timestamp_seconds("s"))
    panel = panels.hist_panel(df, "1 hour", "v", negative="mirror", invalid="skip")
    assert [(r["bucket"], r["count"]) for r in panel.collect()] == [(-2.0, 1), (1.0, 1)]
    moved = histograms.moving(df, [], "time", "v", 3600, 2, values=True, negative="mirror", invalid="skip")
    assert moved.first()["histogram"] == {-2.0: 1, 1.0: 1}


def test_sql_functions(spark):
    names = register_functions(spark)
    assert "buckets" in names and "seh_bucket" in names
    got = spark.sql(
        "select seh_bucket(1.2D) a, seh_bucket(0D) b, seh_bucket(12345D) c, "
        "statistic_set_avg(statistic_set(null, null, null, 0L)) d, "
        "histogram_combine(map(1D, 2L), map(1D, 3L, 2D, 1L)) e, histogram_count(map(1D, 2L, 3D, 4L)) f, "
        "histogram_subtract(map(1D, 2L, 3D, 4L), map(1D, 2L)) g").first()
    assert tuple(got) == (1.5, 0.0, 15000.0, 0.0, {1.0: 5, 2.0: 1}, 6, {3.0: 4})
    rows = spark.sql("select b.* from (select map(1D, 2L) as h) t, lateral buckets(h) b").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2)]
    with pytest.raises(Exception, match="no bucket"):
        spark.sql("select seh_bucket(-1D)").collect()


def test_time_range_reaches_the_scan(spark, events):
    lo = panels.latest(events, "ts") - F.expr("interval 1 day")
    text = plan(panels.time_range(events.select("ts", "value"), lo, time="ts"))
    assert "GreaterThan(ts" in text and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


def test_panel_of_merged_histograms_is_the_same(spark, events):
    direct = panels.hist_panel(events, "4 hours", "value", ["event_type"], time="ts")
    hourly = histograms.accumulate(
        events.withColumn("hour", F.window("ts", "1 hour").start), ["event_type", "hour"], "value", "h")
    merged = panels.hist_panel(hourly, "4 hours", "h", ["event_type"], time="hour", merged=True)
    assert direct.collect() == merged.collect()


def test_panel_aggregates_before_it_shuffles(spark, events):
    text = plan(panels.hist_panel(events, "4 hours", "value", ["event_type"], time="ts"))
    assert "partial_count" in text and "SortAggregate" not in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text


def test_digests_and_histograms_in_sql(spark):
    register_functions(spark)
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in range(1, 40 if g == "a" else 3)], "g string, v double")
    found = digests.accumulate(df, ["g"], "v", "d").join(histograms.accumulate(df, ["g"], "v", "h"), "g")
    found.createOrReplaceTempView("found")
    for q in (0.0, 0.3, 0.5, 0.99, 1.0):
        for r in spark.sql(f"select g, d, digest_quantile(d, {q}D) as q, digest_count(d) as n from found").collect():
            want = found.where(F.col("g") == r["g"]).select(digest.quantile("d", q)).first()[0]
            assert (r["q"], r["n"]) == (want, r["d"]["count"])
    texts = {r[0]: r[1] for r in spark.sql("select g, histogram_json(h) from found").collect()}
    assert texts["b"] == '{"1":1,"2":1}'
    assert spark.sql("select histogram_json(map(1.5D, 2L, 20D, 1L))").first()[0] == '{"1.5":2,"20":1}'
