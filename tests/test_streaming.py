"""Streams: stream equals batch, restarts, replayed batches, fan-out."""

import pytest
from pyspark.sql import functions as F
from samples import datum, frame

from widemetrics.functions import statset
from widemetrics.operators import histograms
from widemetrics.session import Folder, shared_dir
from widemetrics.sinks import otlp
from widemetrics.sinks.store import MetricStore
from widemetrics.sources.datums import parse_datums, parse_requests
from widemetrics.streaming import pipelines

START = 1704067200 * 10**9


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    return folder


def drop(inbox, name, *texts):
    (inbox / name).write_text("\n".join(texts) + "\n")


def stream(spark, inbox):
    return parse_datums(spark.readStream.text(str(inbox))).where("malformed is null").drop("malformed")


def one(i, **extra):
    return datum("m", START + i * 10**9, {"host": {"String": "a"}}, {"v": {"I64": i}, **extra})


def read(spark, root):
    return sorted(r["v"] for r in MetricStore(spark, root).read("m").collect())


def test_stream_restarts_where_it_stopped_and_heals(spark, inbox):
    folder = shared_dir(spark, "s")
    drop(inbox, "a", one(1), one(2))
    pipelines.stream_wide(stream(spark, inbox), f"{folder}/t", f"{folder}/c", None).awaitTermination(60)
    assert read(spark, f"{folder}/t") == [1, 2]
    drop(inbox, "b", one(3, more={"F64": 0.5}), "not json")
    pipelines.stream_wide(stream(spark, inbox), f"{folder}/t", f"{folder}/c", None).awaitTermination(60)
    assert read(spark, f"{folder}/t") == [1, 2, 3]
    assert MetricStore(spark, f"{folder}/t").read("m").columns == ["time", "host", "more", "v"]


def test_a_replayed_batch_is_not_doubled(spark, inbox):
    folder = shared_dir(spark, "s")
    drop(inbox, "a", one(1), one(2))
    pipelines.stream_wide(stream(spark, inbox), f"{folder}/t", f"{folder}/c", None).awaitTermination(60)
    # The batch was written, but its commit was lost.
    for commit in Folder(spark, f"{folder}/c/commits").glob("*"):
        Folder(spark, commit).delete()
    pipelines.stream_wide(stream(spark, inbox), f"{folder}/t", f"{folder}/c", None).awaitTermination(60)
    assert read(spark, f"{folder}/t") == [1, 2]


def test_another_checkpoint_and_other_writers_add(spark, inbox):
    folder = shared_dir(spark, "s")
    drop(inbox, "a", one(1), one(2))
    for checkpoint in ("c1", "c2"):
        run = pipelines.stream_wide(stream(spark, inbox), f"{folder}/t", f"{folder}/{checkpoint}", None)
        run.awaitTermination(60)
    MetricStore(spark, f"{folder}/t").write(frame(spark, one(7)))
    assert read(spark, f"{folder}/t") == [1, 1, 2, 2, 7]


def test_malformed_rows_of_a_stream_are_kept(spark, inbox):
    folder = shared_dir(spark, "s")
    drop(inbox, "a", one(1), "not json")
    whole = parse_datums(spark.readStream.text(str(inbox)))
    pipelines.stream_wide(whole, f"{folder}/t", f"{folder}/c", None).awaitTermination(60)
    store = MetricStore(spark, f"{folder}/t")
    assert read(spark, f"{folder}/t") == [1]
    assert [(r["reason"], r["malformed"]) for r in store.rejects().collect()] == [("malformed", "not json")]


def test_rollup_parts_of_batches_out_of_order_equal_batch(spark, inbox):
    folder = shared_dir(spark, "s")
    stamps = [f'{{"t":"2024-01-01T{h:02d}:{m:02d}:00Z","g":"a","v":{h + m / 10}}}' for h in range(8) for m in (0, 7, 59)]
    for i in (3, 0, 2, 1):
        drop(inbox, f"{'abcd'[(i * 3) % 4]}.json", *stamps[i * 6 : i * 6 + 6])
    rows = spark.readStream.schema("t timestamp, g string, v double").option("maxFilesPerTrigger", 1).json(str(inbox))

    def sets(batch):
        return pipelines.statistics_of(batch, "t", "3 hours", ["g"], "v", "s")

    for _ in range(2):
        run = pipelines.stream_rollup(rows, sets, f"{folder}/out", f"{folder}/c", None)
        run.awaitTermination(60)
    got = pipelines.merged_statistics(spark.read.parquet(f"{folder}/out"), ["g"], "s")
    batch = spark.read.schema("t timestamp, g string, v double").json(str(inbox))
    key = lambda r: r["time"]
    assert len(Folder(spark, f"{folder}/out").glob("writer=*/batch=*")) == 4
    for a, b in zip(sorted(got.collect(), key=key), sorted(sets(batch).collect(), key=key), strict=True):
        assert (a["time"], a["s"]["samplecount"], a["s"]["minimum"], a["s"]["maximum"]) == (
            b["time"], b["s"]["samplecount"], b["s"]["minimum"], b["s"]["maximum"])


def test_both_consumers_see_every_datum(spark, inbox):
    folder = shared_dir(spark, "s")
    drop(inbox, "a", *[one(i) for i in range(7)])
    for run in pipelines.fan_out(stream(spark, inbox), f"{folder}/t", f"{folder}/o", f"{folder}/c", None):
        run.awaitTermination(60)
    assert read(spark, f"{folder}/t") == list(range(7))
    requests = otlp.read_otlp(spark, f"{folder}/o")
    points = otlp.request_metrics(requests).select(F.explode("gauge.data_points").alias("p")).select("p.as_int")
    assert sorted(r[0] for r in points.collect()) == list(range(7))


def test_stream_of_requests(spark, inbox):
    folder = shared_dir(spark, "s")
    shared = '{"shared_dimensions":{"az":{"value":{"String":"z1"}}},"metrics":[%s,%s]}'
    drop(inbox, "a", shared % (one(1), one(2)))
    datums = parse_requests(spark.readStream.text(str(inbox)))
    pipelines.stream_wide(datums, f"{folder}/t", f"{folder}/c", None).awaitTermination(60)
    rows = MetricStore(spark, f"{folder}/t").read("m").collect()
    assert sorted((r["az"], r["v"]) for r in rows) == [("z1", 1), ("z1", 2)]


def test_paced_trigger(spark, inbox):
    folder = shared_dir(spark, "s")
    drop(inbox, "a", one(1))
    run = pipelines.stream_wide(stream(spark, inbox), f"{folder}/t", f"{folder}/c", "1 second")
    try:
        run.processAllAvailable()
        drop(inbox, "b", one(2))
        run.processAllAvailable()
    finally:
        run.stop()
    assert read(spark, f"{folder}/t") == [1, 2]


def numbers(spark, inbox):
    rows = spark.readStream.schema("t timestamp, g string, v double").json(str(inbox))
    return rows


def run_to_end(rows, mode, name, checkpoint):
    writer = rows.writeStream.format("memory").queryName(name).outputMode(mode)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(60)
    return rows.sparkSession.table(name)


def test_rollups_equal_batch(spark, inbox):
    lines = [
        f'{{"t":"2024-01-01T{h:02d}:{m:02d}:00Z","g":"{"ab"[m % 2]}","v":{h + m / 10}}}'
        for h in range(6) for m in range(0, 60, 7)
    ]
    drop(inbox, "a.json", *lines)
    batch = spark.read.schema("t timestamp, g string, v double").json(str(inbox))
    folder = shared_dir(spark, "r")
    hour = F.window("t", "1 hour").start.alias("time")

    sets = pipelines.rollup_statistics(numbers(spark, inbox), "t", "1 hour", "10 minutes", ["g"], "v", "s")
    got = run_to_end(sets, "update", "roll_sets", f"{folder}/a").collect()
    want = batch.groupBy(hour, "g").agg(statset.accumulate("v").alias("s")).collect()
    key = lambda r: (r["time"], r["g"])
    assert sorted(got, key=key) == sorted(want, key=key)

    maps = pipelines.rollup_histograms(numbers(spark, inbox), "t", "1 hour", "10 minutes", ["g"], "v", "h")
    got = {key(r): r["h"] for r in run_to_end(maps, "append", "roll_maps", f"{folder}/b").collect()}
    want = histograms.accumulate(batch.withColumn("time", hour), ["time", "g"], "v", "h").collect()
    # The last hour is still open: its end lies beyond the watermark.
    assert got == {key(r): r["h"] for r in want if r["time"].hour < 5}
