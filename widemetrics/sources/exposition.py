"""Text exposition scrapes to datums.

A scrape is one row that holds the whole body, because the meaning of a line
hangs on the TYPE line above it. The body is cut at its TYPE lines with one
regular expression, and each piece is decoded on its own: no window over the
lines and no shuffle, whatever the number of scrapes or of lines from one
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from widemetrics.functions.bind import let
from widemetrics.functions.text import parse_float
from widemetrics.sources.datums import dimension, measurement, table_prefix

# Family kinds; each sample of a scalar family is one datum.
SCALAR_KINDS = ("gauge", "counter", "untyped", "summary")

_TYPE_LINE = r"^# TYPE (\w+) (\w+)(?:\n|$)"
# Possessive throughout: a line is read once, without going back.
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_LABEL = rf'\b(\w++)="({_INSIDE})"'
_BRACES = rf'\{{(?:[^"}}]++|"{_INSIDE}")*+\}}'
_SAMPLE_VALUE = rf"^\w++(?:{_BRACES})? *+([^ ]*+)"
I64_MAX = 9223372036854775807

_SERIES_DDL = "array<struct<labels:array<struct<key:string,value:string>>,bound:bigint,cum:decimal(20,0)>>"


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """Landed bodies, one file each: (scrape_id, scraped_at, body)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("scrape_id"),
        F.col("_metadata.file_modification_time").alias("scraped_at"),
        F.col("value").alias("body"),
    )


def families(df: DataFrame, keep: tuple[str, ...] = ("scrape_id", "scraped_at")) -> DataFrame:
    """Rows (keep.., family, kind, lines): the lines below each TYPE line."""
    body = F.regexp_replace("body", "\r\n", "\n")
    piece = F.col("piece")
    lines = F.split(piece, "\n")
    return (
        df.select(*keep, F.explode(F.split(body, r"(?m)(?=^# TYPE \w+ \w+$)")).alias("piece"))
        .where(piece.rlike(_TYPE_LINE))
        .select(
            *keep,
            F.regexp_extract(piece, _TYPE_LINE, 1).alias("family"),
            F.regexp_extract(piece, _TYPE_LINE, 2).alias("kind"),
            F.slice(lines, 2, F.size(lines)).alias("lines"),
        )
    )


def _names(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_LABEL), F.lit(1))


def _texts(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_LABEL), F.lit(2))


def label_map(names: Column, texts: Column) -> Column:
    """Labels of a sample; escapes stay as written, the last of equal names wins."""
    pairs = F.arrays_zip(names.alias("k"), texts.alias("v"))
    last = F.filter(
        pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"])
    )
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    return F.when(repeated, F.map_from_entries(last)).otherwise(F.map_from_arrays(names, texts))


def _bound(le: Column) -> Column:
    """Whole upper bound of an ``le`` label; infinity is the largest BIGINT."""

    def whole(value: Column) -> Column:
        return (
            F.when(F.isnan(value), F.lit(None))
            .when(value >= F.lit(float(I64_MAX)), F.lit(I64_MAX))
            .otherwise(F.ceil(value))
            .cast("bigint")
        )

    return let(parse_float(le), whole)


def samples(
    pieces: DataFrame,
    bad_value: float | None = None,
    keep: tuple[str, ...] = ("scrape_id", "scraped_at"),
) -> DataFrame:
    """Rows (keep.., family, labels, value, histogram, bad_line).

    Gauge-like families give one row per sample with ``value`` set. Such a
    family ends at the first line that is not one of its samples. A number that
    does not parse becomes ``bad_value``, with the line in ``bad_line``.

    Histogram families give one row per series with ``histogram`` set:
    cumulative counts become plain ones under whole bounds, and bounds that
    round up to the same whole one keep the largest cumulative count. All lines
    of a series sit in one row's array, so they are sorted and cut up in place.
    """
    kinds = (*SCALAR_KINDS, "histogram")
    rows = pieces.where(F.col("kind").isin(*kinds)).select(
        *keep, "family", _scalar_run().alias("run"), F.sort_array(_bucket_entries()).alias("e")
    )
    # Sorted by (labels, bound, cum): the last of equal (labels, bound) stays.
    e = F.col("e")

    def is_last(x: Column, i: Column) -> Column:
        after = F.get(e, i + 1)
        return after.isNull() | (after["labels"] != x["labels"]) | (after["bound"] != x["bound"])

    def is_first(i: Column) -> Column:
        return (i == 0) | (F.get(e, i - 1)["labels"] != F.get(e, i)["labels"])

    rows = rows.withColumn("e", F.filter(e, is_last))
    places = F.when(F.size(e) > 0, F.sequence(F.lit(0), F.size(e) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    rows = rows.withColumn("starts", F.filter(places, is_first))
    starts = F.col("starts")
    series = F.transform(
        starts, lambda s, j: F.slice(e, s + 1, F.coalesce(F.get(starts, j + 1), F.size(e)) - s)
    )
    no_line = F.lit(None).cast("string").alias("line")
    no_series = F.lit(None).cast(_SERIES_DDL).alias("d")
    each = F.concat(
        F.transform("run", lambda line: F.struct(line.alias("line"), no_series)),
        F.transform(series, lambda d: F.struct(no_line, d.alias("d"))),
    )
    # What follows works on single lines, in generated code.
    out = rows.select(*keep, "family", F.explode(each).alias("x")).select(*keep, "family", "x.*")
    line, d = F.col("line"), F.col("d")
    out = out.select(
        *keep,
        "family",
        "line",
        "d",
        _names(line).alias("names"),
        _texts(line).alias("texts"),
        parse_float(F.regexp_extract(line, _SAMPLE_VALUE, 1)).alias("number"),
    )
    is_bad = line.isNotNull() & F.col("number").isNull()
    of_series = F.map_from_entries(F.get(d, F.lit(0))["labels"])
    return out.select(
        *keep,
        "family",
        F.when(line.isNotNull(), label_map(F.col("names"), F.col("texts")))
        .otherwise(of_series)
        .alias("labels"),
        F.when(is_bad, F.lit(bad_value).cast("double")).otherwise(F.col("number")).alias("value"),
        F.when(d.isNotNull(), _plain_histogram(d)).alias("histogram"),
        F.when(is_bad, line).alias("bad_line"),
    )


def _scalar_run() -> Column:
    """The lines of a gauge-like family up to the first that is not its sample."""
    own = F.transform("lines", lambda x: F.regexp_extract(x, r"^(\w*)", 1) == F.col("family"))
    run = let(
        F.array_position(own, F.lit(False)),
        lambda end: F.when(end == 0, F.col("lines")).otherwise(
            F.slice("lines", F.lit(1), (end - 1).cast("int"))
        ),
    )
    return F.when(F.col("kind").isin(*SCALAR_KINDS), run).otherwise(F.array().cast("array<string>"))


def _bucket_entries() -> Column:
    """(labels but le, whole bound, cumulative count) of a histogram family's lines."""
    bucket_line = F.concat(F.col("family"), F.lit("_bucket{"))
    wanted = F.col("kind") == "histogram"
    lines = F.filter("lines", lambda x: wanted & x.startswith(bucket_line))

    def entry(line: Column) -> Column:
        count = F.regexp_extract(line, _SAMPLE_VALUE, 1).try_cast("decimal(20,0)")
        return let(
            let(
                F.struct(_names(line).alias("names"), _texts(line).alias("texts")),
                lambda x: label_map(x["names"], x["texts"]),
            ),
            lambda labels: F.struct(
                F.sort_array(F.map_entries(F.map_filter(labels, lambda k, _: k != "le"))).alias(
                    "labels"
                ),
                _bound(F.element_at(labels, F.lit("le"))).alias("bound"),
                count.alias("cum"),
            ),
        )

    return F.filter(
        F.transform(lines, entry), lambda e: e["bound"].isNotNull() & e["cum"].isNotNull()
    )


def _plain_histogram(d: Column) -> Column:
    def plain(x: Column, i: Column) -> Column:
        below = F.coalesce(F.get(d, i - 1)["cum"], F.lit(0).cast("decimal(20,0)"))
        return F.struct(x["bound"].alias("bound"), (x["cum"] - below).try_cast("bigint").alias("n"))

    return F.map_from_entries(F.transform(d, plain))


def decode_prometheus(df: DataFrame, prefix: str = "", bad_value: float | None = None) -> DataFrame:
    """Scrapes (scrape_id, scraped_at, body) to datums with one ``value`` each.

    Samples' own timestamps are ignored for the time of the scrape. The frame
    also has ``malformed``: the line, where its number did not parse.
    """
    nanos = (F.unix_micros(F.col("scraped_at").cast("timestamp")) * 1000).cast("decimal(20,0)")
    value = F.when(
        F.col("histogram").isNotNull(), measurement(Histogram=F.col("histogram"))
    ).otherwise(measurement(F64=F.col("value")))
    return samples(families(df), bad_value).select(
        F.concat(F.lit(table_prefix(prefix)), F.col("family")).alias("metric"),
        nanos.alias("unix_nanos"),
        F.transform_values("labels", lambda _, v: dimension(String=v)).alias("dimensions"),
        F.create_map(F.lit("value"), value).alias("measurements"),
        F.col("bad_line").alias("malformed"),
    )
