"""OTLP records and the chunked store."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from samples import DATUM, MOMENT, datum, frame

from widemetrics.operators import wide
from widemetrics.plans import panels
from widemetrics.session import shared_dir
from widemetrics.sinks import otlp
from widemetrics.sinks.store import MetricStore, daily_copy, write_metrics
from widemetrics.sources.datums import parse_datums

DAY = 86400 * 10**9
HOUR = 3600 * 10**9
START = 1704067200 * 10**9  # 2024-01-01


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_sample_as_otlp(spark):
    got = by_name(otlp.to_otlp(frame(spark, DATUM)))
    assert sorted(got) == sorted(
        "Depot_" + n for n in ("forklifts", "parcels", "load", "weight", "wait", "sizes", "trip"))
    point = got["Depot_forklifts"]["gauge"]["data_points"][0]
    assert point["as_int"] == 3 and point["as_double"] is None and point["time_unix_nano"] == MOMENT
    assert got["Depot_load"]["gauge"]["data_points"][0]["as_double"] == 0.25
    assert [(a["key"], *a["value"]) for a in point["attributes"]] == [
        ("cooled", None, None, False), ("depot", "north", None, None), ("pallets", None, 9, None)]
    summary = got["Depot_wait"]["summary"]["data_points"][0]
    assert (summary["count"], summary["sum"]) == (12, 30.0)
    assert [tuple(q) for q in summary["quantile_values"]] == [(0.0, 0.5), (1.0, 7.0)]
    histogram = got["Depot_sizes"]["histogram"]
    assert histogram["aggregation_temporality"] == 1
    point = histogram["data_points"][0]
    # 10 * 5 + 20 * 1 + 45 * 2
    assert (point["count"], point["sum"]) == (8, 160.0)
    assert point["explicit_bounds"] == [10.0, 20.0, 45.0] and point["bucket_counts"] == [5, 1, 2, 0]
    digest = got["Depot_trip"]["summary"]["data_points"][0]
    assert [q["quantile"] for q in digest["quantile_values"]] == [0.0, 0.5, 0.9, 0.99, 1.0]
    assert {r["unit"] for r in got.values()} == {"1"}


def test_metrics_have_the_envelope_schema(spark):
    metrics = otlp.to_otlp(frame(spark, DATUM))
    declared = spark.createDataFrame([], otlp.METRIC_DDL)
    assert metrics.schema.simpleString() == declared.schema.simpleString()


def test_loose_histograms_have_as_many_counts_as_bounds(spark):
    point = by_name(otlp.to_otlp(frame(spark, DATUM), strict=False))["Depot_sizes"]["histogram"]["data_points"][0]
    assert point["bucket_counts"] == [5, 1, 2]


def test_large_numbers_and_unset_values(spark):
    text = '{"metric":"m","unix_nanos":1,"dimensions":{"big":{"value":{"Number":18446744073709551615}},"unset":{}},"measurements":{"x":{"value":{"I64":1}},"none":{}}}'
    (row,) = otlp.to_otlp(frame(spark, text)).collect()
    (attribute,) = row["gauge"]["data_points"][0]["attributes"]
    assert (attribute["key"], attribute["value"]["int_value"]) == ("big", -1)
    huge = datum("m", 1, None, {"h": {"Histogram": {"buckets": {"9223372036854775807": 2}}},
                               "s": {"StatisticSet": {"minimum": 0, "maximum": 1, "samplesum": 1, "samplecount": 2**64 - 1}}})
    got = by_name(otlp.to_otlp(frame(spark, huge)))
    assert got["m_h"]["histogram"]["data_points"][0]["sum"] == pytest.approx(2 * 9.223372036854775807e18)
    assert got["m_s"]["summary"]["data_points"][0]["count"] == 2**64 - 1


def test_envelopes_hold_every_metric_in_pieces(spark, tmp_path):
    metrics = otlp.to_otlp(frame(spark, *[datum("m", i, None, {"v": {"I64": i}}) for i in range(25)]).coalesce(2))
    requests = otlp.otlp_request(metrics, max_metrics=4)
    parsed = otlp.parse_requests(requests)
    sizes = [len(r["resource_metrics"][0]["instrumentation_library_metrics"][0]["metrics"]) for r in parsed.collect()]
    assert max(sizes) <= 4 and sum(sizes) == 25
    values = otlp.request_metrics(parsed).select(F.explode("gauge.data_points").alias("p")).select("p.as_int")
    assert sorted(r[0] for r in values.collect()) == list(range(25))
    otlp.write_otlp(requests, str(tmp_path / "o"))
    lines = [json.loads(x) for p in (tmp_path / "o").glob("part-*") for x in p.read_text().splitlines()]
    library = lines[0]["resource_metrics"][0]["instrumentation_library_metrics"][0]["instrumentation_library"]
    assert library["version"] == "42"


def test_otlp_needs_no_shuffle(spark):
    requests = otlp.otlp_request(otlp.to_otlp(frame(spark, DATUM)))
    assert "Exchange" not in requests._jdf.queryExecution().executedPlan().toString()


# The store


def store(spark):
    return MetricStore(spark, shared_dir(spark, "store"))


def hourly(spark, hours, metric="m", **extra):
    return frame(spark, *[
        datum(metric, START + h * HOUR, {"host": {"String": f"h{h % 3}"}}, {"v": {"I64": h}, **extra}) for h in hours])


def values(df, name="v"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is None, x))


def test_write_and_read_back(spark):
    s = store(spark)
    first = s.write(hourly(spark, range(10)))
    assert s.write(hourly(spark, range(10, 12))) != first
    assert values(s.read("M")) == list(range(12))
    lo = datetime(2024, 1, 1, 2)
    assert values(s.read("m", lo, lo + timedelta(hours=4))) == [3, 4, 5, 6]
    assert s.read("m").columns == ["time", "host", "v"]
    with pytest.raises(KeyError):
        s.read("missing")


def test_time_bounds_prune_chunks(spark):
    s = store(spark)
    s.write(hourly(spark, range(48)))
    rows = s.read("m", datetime(2024, 1, 2))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(time" in plan
    # Only the chunks in question are listed at all.
    chunks = {p.split("chunk=")[1].split("/")[0] for p in rows.inputFiles()}
    assert len(chunks) == 6 and min(map(int, chunks)) == START // 10**9 + 24 * 3600


def test_time_range_on_a_frame_with_its_chunks(spark):
    s = store(spark)
    s.write(hourly(spark, range(72)))
    rows = s.read("m", layout=True)
    lo = F.lit("2024-01-02 05:00:00").cast("timestamp")
    hi = F.lit("2024-01-02 08:00:00").cast("timestamp")
    found = panels.time_range(rows, lo, hi)
    assert values(found) == [30, 31, 32]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "chunk" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_columns_heal_and_types_stay(spark):
    s = store(spark)
    s.write(hourly(spark, [0]))
    s.write(hourly(spark, [1], extra={"F64": 1.5}))
    s.write(frame(spark, datum("m", START + 2 * HOUR, {"host": {"Number": 5}}, {"v": {"F64": 7.0}})))
    s.write(frame(spark, datum("m", START + 3 * HOUR, None, {"v": {"F64": 7.5}})))
    assert [(c.name, c.type) for c in s.schemas()["m"]] == [("host", "string"), ("extra", "double"), ("v", "bigint")]
    rows = s.read("m").orderBy("time").collect()
    assert [(r["host"], r["extra"], r["v"]) for r in rows] == [("h0", None, 0), ("h1", 1.5, 1), ("5", None, 7)]
    (bad,) = s.rejects().collect()
    assert bad["conflicts"] == ["v"] and bad["measurements"]["v"]["F64"] == 7.5


def test_healing_twice_changes_nothing(spark):
    s = store(spark)
    found = wide.collect_schema(wide.discover_schema(hourly(spark, [0])))
    assert s.heal(found) == s.heal(found)
    assert len(s._registry()) == 3


def test_drop_batch(spark):
    s = store(spark)
    s.write(hourly(spark, [0]))
    mixed = hourly(spark, [1]).unionByName(frame(spark, datum("m", START, None, {"v": {"F64": 0.5}})))
    other = hourly(spark, [2], metric="other")
    s.write(mixed.unionByName(other), on_conflict="drop_batch")
    assert values(s.read("m")) == [0] and values(s.read("other")) == [2]
    assert sorted((r["reason"], r["conflicts"]) for r in s.rejects().collect()) == [("companion", []), ("conflict", ["v"])]
    with pytest.raises(ValueError):
        s.write(other, on_conflict="null")


def test_a_batch_written_again_replaces_itself(spark):
    s = store(spark)
    for _ in range(2):
        s.write(hourly(spark, range(5)), writer="w", batch=3)
    assert values(s.read("m")) == list(range(5))
    s.write(hourly(spark, range(2)), writer="v", batch=3)
    assert values(s.read("m")) == [0, 0, 1, 1, 2, 3, 4]


def test_datums_without_values_are_rows(spark):
    s = store(spark)
    s.write(frame(spark, datum("new", START), datum("m", START, None, {"v": {"I64": 1}})))
    s.write(frame(spark, datum("m", START + HOUR), datum("m", START, {"unset": {}})))
    assert s.read("new").count() == 1 and s.read("new").columns == ["time"]
    assert values(s.read("m")) == [1, None, None]
    assert s.rejects().count() == 0


def test_every_stray_datum_is_among_the_rejects(spark):
    s = store(spark)
    texts = ["{", datum("", START), datum("m", START, None, {"v": {"I64": 1}}),
             '{"metric":"m","dimensions":{},"measurements":{}}', '{"unix_nanos":1}', None]
    rows = parse_datums(spark.createDataFrame([(t,) for t in texts], "value string"))
    s.write(rows)
    untimed = rows.where("metric = 'm' and unix_nanos is not null").select(
        "metric", F.lit(None).cast("decimal(20,0)").alias("unix_nanos"), "dimensions", "measurements")
    s.write(untimed)
    assert values(s.read("m")) == [1]
    reasons = sorted((r["reason"], r["malformed"] is None) for r in s.rejects().collect())
    assert reasons == [("malformed", False)] * 4 + [("unnamed", True), ("untimed", True)]


def test_rejects_of_batches_add_up(spark):
    s = store(spark)
    s.write(hourly(spark, [0]))
    for _ in range(2):
        s.write(frame(spark, datum("m", START, None, {"v": {"F64": 0.5}})))
    assert s.rejects().count() == 2 and values(s.read("m")) == [0]


def test_a_table_of_2000_columns_and_its_neighbour(spark):
    s = store(spark)
    many = datum("many", START, None, {f"c{i}": {"I64": i} for i in range(2000)})
    s.write(frame(spark, many, datum("m", START, None, {"v": {"I64": 1}})))
    assert len(s.read("many").columns) == 2001 and values(s.read("m")) == [1]
    assert s.read("many").first()["c1999"] == 1999


def test_daily_copy_keeps_every_row_in_order(spark):
    s, folder = store(spark), shared_dir(spark, "days")
    s.write(hourly(spark, range(60)))
    daily_copy(s.read("m"), folder)
    rows = spark.read.parquet(folder)
    assert values(rows) == list(range(60)) and rows.select("day").distinct().count() == 3


def test_metrics_with_their_own_columns(spark):
    s = store(spark)
    a, b = hourly(spark, [0, 1]), frame(spark, datum("B-b", START, {"z": {"Boolean": True}}))
    same = hourly(spark, [4], metric="a2")
    s.write(a.unionByName(b).unionByName(same))
    assert values(s.read("m")) == [0, 1] and values(s.read("a2")) == [4]
    assert s.read("B-b").first()["z"] is True


def test_retention_goes_by_chunk_end(spark):
    s = store(spark)
    s.write(hourly(spark, range(0, 72)))
    now = datetime(2024, 1, 4, tzinfo=timezone.utc)
    # 24 h back: days one and two go, day three stays.
    gone = s.apply_retention(now, 24 * 3600)
    assert len(gone) == 12
    assert values(s.read("m")) == list(range(48, 72))
    assert s.apply_retention(now, 24 * 3600) == []


def test_write_metrics(spark):
    root = shared_dir(spark, "root")
    write_metrics(hourly(spark, [1]), root)
    assert values(MetricStore(spark, root).read("m")) == [1]


def test_other_session_zone(spark):
    root = shared_dir(spark, "zone")
    MetricStore(spark, root).write(hourly(spark, [1, 30]))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        lo = datetime(2024, 1, 2, tzinfo=timezone.utc)
        assert values(MetricStore(spark, root).read("m", lo)) == [30]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
