"""Datum streams into wide tables, OTLP records and rollups."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from widemetrics.functions import statset
from widemetrics.functions.timefn import chunk_of, time_bucket
from widemetrics.operators import histograms, rollups
from widemetrics.schema import CHUNK_SECONDS
from widemetrics.session import Folder
from widemetrics.sinks.otlp import otlp_request, to_otlp
from widemetrics.sinks.store import MetricStore

# Seconds a batch is collected for.
WIDE_TRIGGER = "5 seconds"
OTLP_TRIGGER = "6 seconds"


def _start(writer: DataStreamWriter, trigger: str | None) -> StreamingQuery:
    """Run at a fixed pace, or through all that is there where trigger is None."""
    if trigger is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=trigger).start()


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own id, which Spark keeps in its checkpoint."""
    text = spark.read.text(f"{checkpoint}/metadata").first()[0]
    return json.loads(text)["id"]


def stream_wide(
    datums: DataFrame,
    root: str,
    checkpoint: str,
    trigger: str | None = WIDE_TRIGGER,
    on_conflict: str = "quarantine",
) -> StreamingQuery:
    """Each micro-batch heals the schema, then goes to its tables.

    Batches are the checkpoint's own: one that is replayed after a failure
    overwrites its own folders, and another checkpoint's add to the tables.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = MetricStore(spark, root)
        # Decoded once for both passes.
        batch.persist()
        try:
            store.write(batch, writer_of(spark, checkpoint), batch_id, on_conflict)
        finally:
            batch.unpersist()

    writer = datums.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return _start(writer, trigger)


def stream_otlp(
    datums: DataFrame,
    path: str,
    checkpoint: str,
    trigger: str | None = OTLP_TRIGGER,
    max_metrics: int = 5000,
) -> StreamingQuery:
    """Each micro-batch becomes envelopes in JSON files."""
    requests = otlp_request(to_otlp(datums), max_metrics)
    writer = (
        requests.writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return _start(writer, trigger)


def fan_out(
    datums: DataFrame, root: str, otlp_path: str, checkpoint: str, trigger: str | None = WIDE_TRIGGER
) -> list[StreamingQuery]:
    """Both consumers on one source; each keeps its own progress."""
    otlp_trigger = None if trigger is None else OTLP_TRIGGER
    return [
        stream_wide(datums, root, f"{checkpoint}/wide", trigger),
        stream_otlp(datums, otlp_path, f"{checkpoint}/otlp", otlp_trigger),
    ]


def stream_rollup(
    stream: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    trigger: str | None = WIDE_TRIGGER,
    keys: Sequence[str] | None = None,
    folder_seconds: int = CHUNK_SECONDS,
) -> StreamingQuery:
    """Rollups kept current however late rows come.

    ``build`` makes mergeable values of a batch, such as statistic sets or
    histograms by window and key. No window has to be closed, no row is too
    late, no state is kept, and a batch that is replayed changes nothing.

    With ``keys``, the columns besides ``time`` that name a value, each
    micro-batch merges its values into the windows it touches (add_to_windows),
    so that read_rollup opens files by the span of time and not by the number of
    batches. Without, each batch leaves its own part, to be merged by the reader
    (merged_statistics, merged_histograms).
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        writer = writer_of(batch.sparkSession, checkpoint)
        if keys is None:
            build(batch).write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch_id}")
        else:
            add_to_windows(build(batch), keys, f"{path}/writer={writer}", batch_id, folder_seconds)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return _start(writer, trigger)


def _versions(spark: SparkSession, folder: str, spans: str = "*") -> dict[int, list[tuple[int, str]]]:
    """(batch, path) of each folder of time, oldest first."""
    found: dict[int, list[tuple[int, str]]] = {}
    for path in Folder(spark, folder).glob(f"span={spans}/upto=*"):
        span, upto = (part.split("=")[1] for part in path.rstrip("/").split("/")[-2:])
        found.setdefault(int(span), []).append((int(upto), path))
    return {span: sorted(v) for span, v in found.items()}


def add_to_windows(
    values: DataFrame, keys: Sequence[str], folder: str, batch: int, folder_seconds: int = CHUNK_SECONDS
) -> None:
    """Merge a batch's values into those of their windows, once.

    Windows lie in folders of time. Those that the batch touches are merged with
    it into new versions of these folders, named after the batch; a mark then
    makes them count. A batch that comes again finds its mark and does nothing,
    or, without the mark, starts again from the versions before it. The
    version before the newest stays for readers that have listed it; older ones
    go. Batches of a folder come one at a time, in order, as a stream's do.
    """
    spark = values.sparkSession
    marks = Folder(spark, f"{folder}/_done")
    # Marks are plain files; of those only the last is kept.
    done = marks.names()
    if done and int(done[-1]) >= batch:
        return
    built = values.withColumn("span", chunk_of("time", folder_seconds)).persist()
    try:
        # One number for each folder of time that the batch reaches.
        spans = sorted(r["span"] for r in built.select("span").distinct().toLocalIterator())
        if spans:
            wanted = "{" + ",".join(map(str, spans)) + "}"
            before = {
                span: [v for v in versions if v[0] < batch]
                for span, versions in _versions(spark, folder, wanted).items()
            }
            held = [versions[-1][1] for versions in before.values() if versions]
            parts = built
            if held:
                schema = StructType([*built.drop("span").schema.fields, StructField("span", LongType())])
                old = spark.read.schema(schema).option("basePath", folder).parquet(*held)
                parts = built.unionByName(old.select(*built.columns))
            merged = rollups.merge(parts, ["span", "time", *keys])
            (
                merged.withColumn("upto", F.lit(batch).cast("bigint"))
                .hint("rebalance", "span")
                .sortWithinPartitions("span", "upto", "time")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("span", "upto")
                .parquet(folder)
            )
        marks.claim(f"{batch:012d}", "")
        if spans:
            for versions in before.values():
                for _, path in versions[:-1]:
                    Folder(spark, path).delete()
        for name in done:
            Folder(spark, f"{folder}/_done/{name}").delete()
    finally:
        built.unpersist()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The values of stream_rollup with keys, of all writers; one row per window and key if one
    stream has written them. Opens the newest version of each folder of time, and no other."""
    paths = []
    for writer in Folder(spark, path).glob("writer=*"):
        done = Folder(spark, f"{writer}/_done").names()
        for versions in _versions(spark, writer).values():
            counting = [p for upto, p in versions if done and upto <= int(done[-1])]
            paths += counting[-1:]
    if not paths:
        raise FileNotFoundError(f"no rollup at {path}")
    return spark.read.option("basePath", path).parquet(*paths).drop("writer", "span", "upto")


def statistics_of(
    rows: DataFrame, time: str, width: str, keys: Sequence[str], col: str, name: str = "statistics"
) -> DataFrame:
    """Statistic sets by window of time and keys."""
    grouped = rows.groupBy(time_bucket(width, time).alias("time"), *keys)
    return grouped.agg(statset.accumulate(col).alias(name))


def merged_statistics(parts: DataFrame, keys: Sequence[str], name: str = "statistics") -> DataFrame:
    return parts.groupBy("time", *keys).agg(statset.merge(name).alias(name))


def histograms_of(
    rows: DataFrame,
    time: str,
    width: str,
    keys: Sequence[str],
    col: str,
    name: str = "histogram",
    **options: str,
) -> DataFrame:
    """Histograms by window of time and keys; options as for histograms.accumulate."""
    timed = rows.withColumn("__time", time_bucket(width, time))
    return histograms.accumulate(timed, ["__time", *keys], col, name, **options).withColumnRenamed(
        "__time", "time"
    )


def merged_histograms(parts: DataFrame, keys: Sequence[str], name: str = "histogram") -> DataFrame:
    return histograms.merge(parts, ["time", *keys], name, name)


def rollup_statistics(
    stream: DataFrame,
    time: str,
    width: str,
    delay: str,
    keys: Sequence[str],
    col: str,
    name: str = "statistics",
) -> DataFrame:
    """Tumbling statistic sets as one streaming query; write with update or append mode.

    The delay bounds the state: rows later than that are left out. Where late
    rows must count, use stream_rollup.
    """
    marked = stream.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", delay)
    grouped = marked.groupBy(F.window("__time", width).alias("w"), *keys)
    return grouped.agg(statset.accumulate(col).alias(name)).select(
        F.col("w.start").alias("time"), *keys, name
    )


def rollup_histograms(
    stream: DataFrame,
    time: str,
    width: str,
    delay: str,
    keys: Sequence[str],
    col: str,
    name: str = "histogram",
    **options: str,
) -> DataFrame:
    """Tumbling histograms as one streaming query; write with append mode.

    Counts per bucket are the first aggregation, the histograms a second one
    that sees only those counts. A window comes out once the watermark has
    passed its end; rows later than the delay are left out (see stream_rollup).
    """
    marked = stream.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", delay)
    window = F.window("__time", width).alias("w")
    counts = histograms.bucket_counts(marked, [window, *keys], col, **options)
    folded = histograms.fold(counts, ["w", *keys], name)
    return folded.select(F.col("w.start").alias("time"), *keys, name)
