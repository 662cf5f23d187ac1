"""Every operator as a query over the given tables, with its SQL counterpart.

Histograms and nested records come out as flat rows, so that a plain SQL
engine can state the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from widemetrics.functions import digest, seh, statset, wire
from widemetrics.functions.ident import clean_id
from widemetrics.functions.sqlnames import register_functions
from widemetrics.functions.timefn import nanos_to_ts, time_bucket
from widemetrics.operators import digests, histograms, rollups, statsets, wide
from widemetrics.operators.wide import ColumnSpec, dimension_col, measurement_col
from widemetrics.plans import panels
from widemetrics.session import shared_dir
from widemetrics.sinks import delimited, otlp
from widemetrics.sinks.store import MetricStore, daily_copy
from widemetrics.sources import datums, exposition, requests
from widemetrics.sources.datums import dimension as dim
from widemetrics.sources.datums import measurement as mea
from widemetrics.streaming import pipelines

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# Tables as datums


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The tables hold zoneless times; UTC makes them instants.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # A pattern serves for one file as well as for a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def as_map(**entries: Column) -> Column:
    parts: list[Column] = []
    for name, value in entries.items():
        parts += [F.lit(name), value]
    return F.create_map(*parts)


def nanos(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) * 1000


def ntz(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")


def k_of_props() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def as_datums(
    df: DataFrame, metric: Column, ts: str, dimensions: Column, measurements: Column, *keep: str
) -> DataFrame:
    """Rows as datums; the generator keeps filters from copying the maps' construction."""
    datum = F.struct(
        metric.alias("metric"),
        nanos(ts).cast("decimal(20,0)").alias("unix_nanos"),
        dimensions.alias("dimensions"),
        measurements.alias("measurements"),
    )
    return df.select(*keep, F.inline(F.array(datum)))


def event_datums(events: DataFrame) -> DataFrame:
    """metric = event_type; dimensions user_id, event_type; measurements value, k."""
    return as_datums(
        events,
        F.col("event_type"),
        "ts",
        as_map(user_id=dim(Number=F.col("user_id")), event_type=dim(String=F.col("event_type"))),
        as_map(value=mea(F64=F.col("value")), k=mea(I64=k_of_props())),
    )


def event_log(events: DataFrame) -> DataFrame:
    """All events as one metric."""
    return event_datums(events).withColumn("metric", F.lit("Event-Log"))


def order_datums(orders: DataFrame) -> DataFrame:
    return as_datums(
        orders,
        F.lit("Orders-Placed"),
        "o_orderdate",
        as_map(customer=dim(Number=F.col("o_custkey")), status=dim(String=F.col("o_orderstatus"))),
        as_map(total=mea(F64=F.col("o_totalprice"))),
    )


def wire_json(df: DataFrame, *keep: str) -> DataFrame:
    """Datums as the JSON a client sends."""
    wrap = lambda m: F.transform_values(m, lambda _, v: F.struct(v.alias("value")))
    body = F.struct(
        "metric",
        "unix_nanos",
        wrap(F.col("dimensions")).alias("dimensions"),
        wrap(F.col("measurements")).alias("measurements"),
    )
    return df.select(*keep, F.to_json(body).alias("value"))


SQL_K = r"cast(regexp_extract(props, '(\d+)', 1) as bigint)"


def sql_bucket(v: str) -> str:
    decade = f"pow(10, floor(log10({v})))"
    return f"case when {v} = 0 then 0 else ceil({v}/{decade}*2)/2*{decade} end"


# Sources


@query(
    "json_datums",
    f"""select event_type as metric, epoch_us(ts) * 1000 as unix_nanos, user_id, event_type,
               value, {SQL_K} as k from events""",
)
def json_datums(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = wire_json(event_datums(table(spark, sf_dir, "events")))
    good, _ = datums.split_malformed(datums.parse_datums(text))
    return good.select(
        "metric",
        F.col("unix_nanos").cast("bigint").alias("unix_nanos"),
        dimension_col("user_id", "bigint").alias("user_id"),
        dimension_col("event_type", "string").alias("event_type"),
        measurement_col("value", "double").alias("value"),
        measurement_col("k", "bigint").alias("k"),
    )


@query(
    "request_explode",
    f"""select 'event_value' as metric, epoch_us(ts) * 1000 as unix_nanos, event_type as source,
               user_id, value as reading from events
        union all
        select 'event_k', epoch_us(ts) * 1000, event_type, user_id, cast({SQL_K} as double) from events""",
)
def request_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")

    def metric(name: str, member: str, value: Column) -> Column:
        user = F.struct(F.struct(F.col("user_id").alias("Number")).alias("value"))
        reading = F.struct(F.struct(value.alias(member)).alias("value"))
        return F.struct(
            F.lit(name).alias("metric"),
            nanos("ts").alias("unix_nanos"),
            as_map(user_id=user).alias("dimensions"),
            as_map(reading=reading).alias("measurements"),
        )

    source = F.struct(F.struct(F.col("event_type").alias("String")).alias("value"))
    sent = F.array(
        F.to_json(metric("event_value", "F64", F.col("value"))),
        F.to_json(metric("event_k", "I64", k_of_props())),
    )
    request = F.concat(
        F.lit('{"shared_dimensions":'),
        F.to_json(as_map(source=source)),
        F.lit(',"metrics":['),
        F.array_join(sent, ","),
        F.lit("]}"),
    )
    columns = [
        ColumnSpec("source", "dimension", "string", (("dimension", "source"),)),
        ColumnSpec("user_id", "dimension", "bigint", (("dimension", "user_id"),)),
        ColumnSpec("reading", "measurement", "double", (("measurement", "reading"),)),
    ]
    rows = datums.parse_request_columns(events.select(request.alias("value")), columns)
    return rows.withColumn("unix_nanos", F.col("unix_nanos").cast("bigint"))


@query(
    "request_wire",
    f"""select 'event_value' as metric, epoch_us(ts) * 1000 as unix_nanos, event_type as source,
               user_id, value as reading from events
        union all
        select 'event_k', epoch_us(ts) * 1000, event_type, user_id, cast({SQL_K} as double) from events""",
)
def request_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests above in their binary form, decoded; of their keys only those asked for."""
    events = table(spark, sf_dir, "events")
    given = events.select(
        "event_type", "user_id", "value", k_of_props().alias("k"), nanos("ts").cast("bigint").alias("nanos")
    )

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                metrics = [
                    {
                        "metric": name,
                        "unix_nanos": r["nanos"],
                        "dimensions": {"user_id": {"number": r["user_id"]}, "unused": {"string": "x"}},
                        "measurements": {"reading": {member: value}},
                    }
                    for name, member, value in (("event_value", "f64", r["value"]), ("event_k", "i64", r["k"]))
                ]
                shared = {"source": {"string": r["event_type"]}}
                request = {"shared_dimensions": shared, "metrics": metrics}
                out.append(wire.delimited(wire.encode(request, requests.REQUEST)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["content"])

    folder = shared_dir(spark, "request-wire")
    given.mapInArrow(sent, "content binary").write.parquet(folder)
    keys = ["source", "user_id", "reading"]
    rows = requests.decode_requests(spark.read.parquet(folder), keys=keys).where("malformed is null")
    return rows.select(
        "metric",
        F.col("unix_nanos").cast("bigint").alias("unix_nanos"),
        dimension_col("source").alias("source"),
        dimension_col("user_id", "bigint").alias("user_id"),
        measurement_col("reading", "double").alias("reading"),
    )


@query(
    "shared_dims",
    """select event_type as metric, user_id, upper(event_type) as event_type,
              'host-' || cast(user_id % 7 as varchar) as host from events""",
)
def shared_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    shared = as_map(
        event_type=dim(String=F.upper("metric")),
        host=dim(
            String=F.concat(F.lit("host-"), (dimension_col("user_id", "bigint") % 7).cast("string"))
        ),
    )
    rows = datums.with_shared_dimensions(event_datums(events), shared)
    return rows.select(
        "metric",
        dimension_col("user_id", "bigint").alias("user_id"),
        dimension_col("event_type").alias("event_type"),
        dimension_col("host").alias("host"),
    )


@query(
    "prefix_bonus",
    """select 'node_' || event_type as metric, user_id, 'a' as host, cast(7 as bigint) as rack,
              true as live, value from events""",
)
def prefix_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datums.with_prefix(event_datums(table(spark, sf_dir, "events")), "node")
    rows = datums.with_bonus_dimensions(rows, {"host": "a", "rack": 7, "live": True})
    return rows.select(
        "metric",
        dimension_col("user_id", "bigint").alias("user_id"),
        dimension_col("host").alias("host"),
        dimension_col("rack", "bigint").alias("rack"),
        dimension_col("live", "boolean").alias("live"),
        measurement_col("value").alias("value"),
    )


# Upper bounds of the scraped histogram.
SCRAPE_BOUNDS = (0.5, 1.0, 5.0, 10.0, 25.0, 50.0, 100.0)


def scrapes(events: DataFrame) -> DataFrame:
    """One scrape per hour and event type; its size does not grow with the rows."""
    at_most = [F.sum((F.col("value") <= b).cast("bigint")).alias(f"c{i}") for i, b in enumerate(SCRAPE_BOUNDS)]
    stats = events.groupBy(time_bucket("1 hour", "ts").alias("hour"), "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("value").alias("hi"),
        F.min("value").alias("lo"),
        *at_most,
    )
    label = F.concat(F.lit('event_type="'), F.col("event_type"), F.lit('"'))

    def line(family: str, labels: Column, value: Column) -> Column:
        return F.concat(F.lit(family + "{"), labels, F.lit("} "), value.cast("string"))

    def with_le(bound: str) -> Column:
        return F.concat(label, F.lit(f',le="{bound}"'))

    lines = [
        F.lit("# HELP events_total events so far"),
        F.lit("# TYPE events_total counter"),
        line("events_total", label, F.col("n")),
        F.lit("# TYPE event_value_max gauge"),
        line("event_value_max", F.concat(label, F.lit(',note="a,}b",')), F.col("hi")),
        F.lit("# TYPE event_value_min untyped"),
        F.concat(line("event_value_min", label, F.col("lo")), F.lit(" 1700000000000")),
        F.lit("# TYPE event_value summary"),
        line("event_value", F.concat(label, F.lit(',quantile="1"')), F.col("hi")),
        line("event_value_sum", label, F.col("n")),
        F.lit("# TYPE event_odd stateset"),
        line("event_odd", label, F.col("n")),
        F.lit("# TYPE event_size histogram"),
        *[line("event_size_bucket", with_le(str(b)), F.col(f"c{i}")) for i, b in enumerate(SCRAPE_BOUNDS)],
        line("event_size_bucket", with_le("+Inf"), F.col("n")),
        line("event_size_count", label, F.col("n")),
    ]
    return stats.select(
        F.concat_ws("/", F.col("hour").cast("string"), "event_type").alias("scrape_id"),
        F.col("hour").alias("scraped_at"),
        F.concat_ws("\n", *lines).alias("body"),
    )


@query(
    "prom_samples",
    """with s as (select time_bucket(interval '1 hour', ts) as t, event_type, count(*) as n,
                         max(value) as hi, min(value) as lo from events group by 1, 2)
       select 'node_events_total' as metric, t as time, event_type, null as note, cast(n as double) as value from s
       union all select 'node_event_value_max', t, event_type, 'a,}b', hi from s
       union all select 'node_event_value_min', t, event_type, null, lo from s
       union all select 'node_event_value', t, event_type, null, hi from s""",
)
def prom_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exposition.decode_prometheus(scrapes(table(spark, sf_dir, "events")), "node")
    value = measurement_col("value", "double")
    return rows.where(value.isNotNull()).select(
        "metric",
        ntz(nanos_to_ts("unix_nanos")).alias("time"),
        dimension_col("event_type").alias("event_type"),
        dimension_col("note").alias("note"),
        value.alias("value"),
    )


@query(
    "prom_histograms",
    """with s as (select time_bucket(interval '1 hour', ts) as t, event_type, count(*) as n,
              sum(case when value <= 1 then 1 else 0 end) as c1, sum(case when value <= 5 then 1 else 0 end) as c5,
              sum(case when value <= 10 then 1 else 0 end) as c10, sum(case when value <= 25 then 1 else 0 end) as c25,
              sum(case when value <= 50 then 1 else 0 end) as c50, sum(case when value <= 100 then 1 else 0 end) as c100
              from events group by 1, 2),
       r as (select t, event_type, 1 as bucket, c1 as c from s union all select t, event_type, 5, c5 - c1 from s
             union all select t, event_type, 10, c10 - c5 from s union all select t, event_type, 25, c25 - c10 from s
             union all select t, event_type, 50, c50 - c25 from s union all select t, event_type, 100, c100 - c50 from s
             union all select t, event_type, 9223372036854775807, n - c100 from s)
       select t as time, event_type, cast(bucket as bigint) as bucket, cast(c as bigint) as count from r""",
)
def prom_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exposition.decode_prometheus(scrapes(table(spark, sf_dir, "events")))
    found = rows.select(
        ntz(nanos_to_ts("unix_nanos")).alias("time"),
        dimension_col("event_type").alias("event_type"),
        measurement_col("value", "histogram").alias("h"),
    )
    return histograms.buckets(found.where("h is not null"), "h", ["time", "event_type"])


# Projections


@query(
    "clean_id",
    r"""select p_partkey, regexp_replace(lower(p_name || '--' || p_brand || ' / ' || p_type), '[^\w]+', '_', 'g') as id
        from part""",
)
def clean_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("--"), "p_brand", F.lit(" / "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", clean_id(raw).alias("id"))


@query(
    "nanos_to_ts",
    """select event_id, make_timestamp((epoch_us(ts) * 1000 + event_id % 1000 + 500) // 1000) as time
       from events""",
)
def nanos_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = (nanos("ts") + F.col("event_id") % 1000).cast("decimal(20,0)")
    return table(spark, sf_dir, "events").select("event_id", ntz(nanos_to_ts(wire)).alias("time"))


@query(
    "dimension_types",
    f"""select event_id, nullif(case when {SQL_K} % 5 = 0 then '' else event_type end, '') as label,
               user_id as number, cast(user_id as varchar) as number_text, value > 50 as flag,
               case when value > 50 then 'true' else 'false' end as flag_text, cast(null as varchar) as absent
        from events""",
)
def dimension_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    label = F.when(k_of_props() % 5 == 0, F.lit("")).otherwise(F.col("event_type"))
    rows = events.select(
        "event_id",
        as_map(
            label=dim(String=label),
            number=dim(Number=F.col("user_id")),
            flag=dim(Boolean=F.col("value") > 50),
            unset=dim(),
        ).alias("dimensions"),
    )
    return rows.select(
        "event_id",
        dimension_col("label").alias("label"),
        dimension_col("number", "bigint").alias("number"),
        dimension_col("number", "string").alias("number_text"),
        dimension_col("flag", "boolean").alias("flag"),
        dimension_col("flag", "string").alias("flag_text"),
        F.coalesce(dimension_col("unset"), dimension_col("missing")).alias("absent"),
    )


@query(
    "measurement_types",
    f"""select event_id, {SQL_K} as a_long, cast({SQL_K} as integer) as an_int, value as a_double,
               cast(value as float) as a_float, value as low, value * 2 as high, cast(2 as bigint) as n,
               {SQL_K} as bound, cast(3 as bigint) as bound_count, value as digest_min, cast(1 as bigint) as digest_weight
        from events""",
)
def measurement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = k_of_props(), F.col("value")
    one = F.lit(1).cast("bigint")
    events = table(spark, sf_dir, "events")
    rows = events.select(
        "event_id",
        as_map(
            a_long=mea(I64=k),
            an_int=mea(I32=k.cast("int")),
            a_double=mea(F64=v),
            a_float=mea(F32=v.cast("float")),
            a_set=mea(StatisticSet=F.struct(v, v * 2, v * 3, F.lit(2).cast("bigint"))),
            a_histogram=mea(Histogram=F.create_map(k, F.lit(3).cast("bigint"))),
            a_digest=mea(Tdigest=F.struct(F.lit(100), one, v, v, v, F.array(F.struct(v, one)))),
        ).alias("measurements"),
    )
    a_set = measurement_col("a_set", "statistic_set")
    a_histogram = measurement_col("a_histogram", "histogram")
    a_digest = measurement_col("a_digest", "tdigest")
    return rows.select(
        "event_id",
        measurement_col("a_long", "bigint").alias("a_long"),
        measurement_col("an_int", "int").alias("an_int"),
        measurement_col("a_double", "double").alias("a_double"),
        measurement_col("a_float", "float").alias("a_float"),
        a_set["minimum"].alias("low"),
        a_set["maximum"].alias("high"),
        a_set["samplecount"].alias("n"),
        F.get(F.map_keys(a_histogram), F.lit(0)).alias("bound"),
        F.get(F.map_values(a_histogram), F.lit(0)).alias("bound_count"),
        a_digest["min"].alias("digest_min"),
        F.get(a_digest["centroids"], F.lit(0))["weight"].alias("digest_weight"),
    )


def shifting_datums(events: DataFrame) -> DataFrame:
    """Datums whose measurement changes type, with keys that need cleaning."""
    odd = F.col("event_id") % 2 == 1
    reading = F.when(odd, mea(I64=k_of_props())).otherwise(mea(F64=F.col("value")))
    dimensions = {
        "User-Id": dim(Number=F.col("user_id")),
        "time": dim(String=F.col("event_type")),
        "unset": dim(),
    }
    measurements = {
        "reading": reading,
        "Reading": mea(F32=F.col("value").cast("float")),
        "k": mea(I32=k_of_props().cast("int")),
    }
    metric = F.concat(F.lit("Svc."), F.col("event_type"))
    return as_datums(events, metric, "ts", as_map(**dimensions), as_map(**measurements))


@query(
    "schema_discovery",
    """with f as (select event_type, arg_min(event_id, ts) as event_id from events group by 1),
       t as (select 'svc_' || event_type as "table", event_id from f)
       select "table", 'user_id' as "column", 'dimension' as kind, 'bigint' as type, 'dimension:User-Id' as sources from t
       union all select "table", 'time_', 'dimension', 'string', 'dimension:time' from t
       union all select "table", 'k', 'measurement', 'int', 'measurement:k' from t
       union all select "table", 'reading', 'measurement', case when event_id % 2 = 1 then 'bigint' else 'double' end,
                        'measurement:Reading,measurement:reading' from t""",
)
def schema_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wide.discover_schema(shifting_datums(table(spark, sf_dir, "events")))
    sources = F.transform("sources", lambda s: F.concat(s["kind"], F.lit(":"), s["key"]))
    return found.select("table", "column", "kind", "type", F.array_join(sources, ",").alias("sources"))


@query(
    "key_collisions",
    """select distinct 'svc_' || event_type as "table", 'reading' as "column", cast(2 as bigint) as keys from events""",
)
def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.collisions(wide.discover_schema(shifting_datums(table(spark, sf_dir, "events"))))


@query(
    "statset_scalars",
    """select event_type, user_id, round(avg(value), 6) as average, min(value) as low, max(value) as high,
              round(sum(value), 4) as total, cast(count(*) as double) as n from events group by 1, 2""",
)
def statset_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "events").groupBy("event_type", "user_id")
    sets = sets.agg(statset.accumulate("value").alias("s"))
    return sets.select(
        "event_type",
        "user_id",
        F.round(statset.avg("s"), 6).alias("average"),
        statset.minimum("s").alias("low"),
        statset.maximum("s").alias("high"),
        F.round(statset.total("s"), 4).alias("total"),
        statset.count("s").alias("n"),
    )


@query(
    "statset_text",
    """select l_partkey, '(' || cast(cast(min(l_quantity) as bigint) as varchar) || ',' ||
              cast(cast(max(l_quantity) as bigint) as varchar) || ',' ||
              cast(cast(sum(l_quantity) as bigint) as varchar) || ',' || cast(count(*) as varchar) || ')' as s
       from lineitem group by 1""",
)
def statset_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy("l_partkey")
    sets = sets.agg(statset.accumulate("l_quantity").alias("s"))
    return sets.select("l_partkey", statset.to_text("s").alias("s"))


@query("seh_bucket", f"select event_id, {sql_bucket('value')} as bucket from events")
def seh_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", seh.bucket("value").alias("bucket"))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, low, high, total): histograms of events with k below 50, of the others, of all."""
    events = table(spark, sf_dir, "events").withColumn("k", k_of_props())
    events = events.select(
        "user_id",
        "value",
        F.when(F.col("k") < 50, F.col("value")).alias("below"),
        F.when(F.col("k") >= 50, F.col("value")).alias("above"),
    )
    return histograms.accumulate_many(
        events, ["user_id"], {"low": "below", "high": "above", "total": "value"}, {}
    )


@query(
    "hist_combine",
    f"select user_id, {sql_bucket('value')} as bucket, count(*) as count from events group by 1, 2",
)
def hist_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = halves(spark, sf_dir).select("user_id", seh.combine("low", "high").alias("h"))
    return histograms.buckets(both, "h", ["user_id"])


@query(
    "hist_subtract",
    f"""select user_id, {sql_bucket('value')} as bucket, count(*) as count from events
        where {SQL_K} >= 50 group by 1, 2""",
)
def hist_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = halves(spark, sf_dir).select("user_id", seh.subtract("total", "low").alias("h"))
    return histograms.buckets(rest, "h", ["user_id"])


@query(
    "hist_buckets",
    f"select l_suppkey, cast({sql_bucket('l_quantity')} as bigint) as bucket, count(*) as count from lineitem group by 1, 2",
)
def hist_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histograms.accumulate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "h")
    return histograms.buckets(found, "h", ["l_suppkey"], as_bigint=True)


@query(
    "hist_json",
    f"""with c as (select l_suppkey, cast({sql_bucket('l_quantity')} as bigint) as b, count(*) as n from lineitem group by 1, 2)
        select l_suppkey, '{{' || string_agg('"' || cast(b as varchar) || '":' || cast(n as varchar), ',' order by b) || '}}' as h
        from c group by 1""",
)
def hist_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histograms.accumulate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "h")
    return found.select("l_suppkey", seh.to_json("h", "double").alias("h"))


@query(
    "tdigest_text",
    r"""with e as (select event_id, regexp_replace(cast(value as varchar), '\.0$', '') as v from events)
        select event_id, '(version:1,max_buckets:100,count:1,sum:' || v || ',min:' || v || ',max:' || v ||
               ',centroids:[(mean:' || v || ',weight:1)])' as d from e""",
)
def tdigest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, one = F.col("value"), F.lit(1).cast("bigint")
    d = F.struct(
        F.lit(100).alias("max_buckets"),
        one.alias("count"),
        v.alias("sum"),
        v.alias("min"),
        v.alias("max"),
        F.array(F.struct(v.alias("mean"), one.alias("weight"))).alias("centroids"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", d.alias("d"))
    return rows.select("event_id", digest.to_text("d").alias("d"))


@query(
    "time_range",
    "select event_id, ts, value from events where ts > (select max(ts) from events) - interval 3 day",
)
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    lo = panels.latest(events, "ts") - F.expr("interval 3 days")
    return panels.time_range(events, lo, time="ts")


# Aggregations


LINE_KEYS = ["l_returnflag", "l_linestatus"]


@query(
    "statset_accumulate",
    """select l_returnflag, l_linestatus, min(l_extendedprice) as low, max(l_extendedprice) as high,
              round(sum(l_extendedprice), 2) as total, count(l_extendedprice) as n from lineitem group by 1, 2""",
)
def statset_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sets = lines.groupBy(*LINE_KEYS).agg(statset.accumulate("l_extendedprice").alias("s"))
    return sets.select(
        *LINE_KEYS,
        F.col("s.minimum").alias("low"),
        F.col("s.maximum").alias("high"),
        F.round("s.samplesum", 2).alias("total"),
        F.col("s.samplecount").alias("n"),
    )


def daily_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistic sets of event values per (event_type, day), to merge further."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", time_bucket("1 day", "ts").alias("day")).agg(
        statset.accumulate("value").alias("s")
    )


@query(
    "statset_merge",
    """select event_type, min(value) as low, max(value) as high, round(sum(value), 4) as total, count(*) as n
       from events group by 1""",
)
def statset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = daily_sets(spark, sf_dir).groupBy("event_type").agg(statset.merge("s").alias("s"))
    return merged.select(
        "event_type",
        F.col("s.minimum").alias("low"),
        F.col("s.maximum").alias("high"),
        F.round("s.samplesum", 4).alias("total"),
        F.col("s.samplecount").alias("n"),
    )


def _merged_by_type(spark: SparkSession, sf_dir: str, agg: Column) -> DataFrame:
    return daily_sets(spark, sf_dir).groupBy("event_type").agg(agg.alias("result"))


@query("statset_min", "select event_type, min(value) as result from events group by 1")
def statset_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_by_type(spark, sf_dir, statset.min_agg("s"))


@query("statset_max", "select event_type, max(value) as result from events group by 1")
def statset_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_by_type(spark, sf_dir, statset.max_agg("s"))


@query("statset_sum", "select event_type, round(sum(value), 4) as result from events group by 1")
def statset_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_by_type(spark, sf_dir, F.round(statset.sum_agg("s"), 4))


@query("statset_count", "select event_type, cast(count(*) as double) as result from events group by 1")
def statset_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_by_type(spark, sf_dir, statset.count_agg("s"))


@query("statset_avg", "select event_type, round(avg(value), 6) as result from events group by 1")
def statset_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_by_type(spark, sf_dir, F.round(statset.avg_agg("s"), 6))


@query(
    "seh_accumulate",
    f"""select l_returnflag, l_linestatus, {sql_bucket('l_extendedprice')} as bucket, count(*) as count
        from lineitem group by 1, 2, 3""",
)
def seh_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    found = histograms.accumulate(lines, LINE_KEYS, "l_extendedprice", "h")
    return histograms.buckets(found, "h", LINE_KEYS)


@query(
    "seh_merge",
    f"select event_type, {sql_bucket('value')} as bucket, count(*) as count from events group by 1, 2",
)
def seh_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", time_bucket("1 day", "ts"))
    daily = histograms.accumulate(events, ["event_type", "day"], "value", "h")
    return histograms.buckets(histograms.merge(daily, ["event_type"], "h", "h"), "h", ["event_type"])


# Cells 2**-12 of a value's magnitude wide, then centroids on the arcsine scale.
SQL_CENTROIDS = """
    with c as (select event_type as g,
                      case when value = 0 then 0 else floor(value * pow(2, 12 - floor(log2(abs(value))))) *
                           pow(2, floor(log2(abs(value))) - 12) end as cell,
                      count(*) as w, sum(value) as total from events group by 1, 2),
         r as (select g, w, total, sum(w) over (partition by g order by cell rows unbounded preceding) as upto,
                      sum(w) over (partition by g) as n from c),
         k as (select g, w, total, cast(floor(100 / pi() * (asin(least(1.0::double, greatest(-1.0::double,
                      2 * ((upto - w / 2) / n) - 1))) + pi() / 2)) as bigint) as kb from r),
         d as (select g, kb, sum(total) / sum(w) as mean, cast(sum(w) as bigint) as weight from k group by 1, 2)
"""


@query(
    "tdigest_accumulate",
    f"{SQL_CENTROIDS} select g as event_type, round(mean, 6) as mean, weight from d",
)
def tdigest_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digests.accumulate(table(spark, sf_dir, "events"), ["event_type"], "value", "d")
    return found.select("event_type", F.inline("d.centroids")).withColumn("mean", F.round("mean", 6))


def _sql_quantile(q: float, name: str) -> str:
    """Line between the centroid middles on both sides of the rank."""
    return f"""(select min_by(case when p.target <= p.middle then
                     p.left_mean + (p.mean - p.left_mean) *
                     (case when p.middle <= p.left_rank then 1 else (p.target - p.left_rank) / (p.middle - p.left_rank) end)
                     end, p.middle)
               from (select m.*, {q} * m.n as target from m where m.g = t.g) p where p.target <= p.middle) as {name}"""


@query(
    "tdigest_quantile",
    f"""{SQL_CENTROIDS},
        a as (select g, mean, weight, sum(weight) over (partition by g order by mean rows unbounded preceding) as upto,
                     sum(weight) over (partition by g) as n from d),
        b as (select g, mean, n, upto - weight / 2 as middle from a),
        e as (select event_type as g, min(value) as lo, max(value) as hi from events group by 1),
        f as (select b.g, mean, n, middle from b union all select b.g, any_value(hi), any_value(n), any_value(n) from b join e on b.g = e.g group by 1),
        m as (select f.g, mean, n, middle, coalesce(lag(mean) over (partition by f.g order by middle), lo) as left_mean,
                     coalesce(lag(middle) over (partition by f.g order by middle), 0) as left_rank
              from f join e on f.g = e.g),
        t as (select distinct g from d),
        z as (select g, {_sql_quantile(0.5, 'p50')}, {_sql_quantile(0.9, 'p90')}, {_sql_quantile(0.99, 'p99')} from t)
        select g as event_type, round(p50, 6) as p50, round(p90, 6) as p90, round(p99, 6) as p99 from z""",
)
def tdigest_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digests.accumulate(table(spark, sf_dir, "events"), ["event_type"], "value", "d")
    return found.select(
        "event_type",
        F.round(digest.quantile("d", 0.5), 6).alias("p50"),
        F.round(digest.quantile("d", 0.9), 6).alias("p90"),
        F.round(digest.quantile("d", 0.99), 6).alias("p99"),
    )


MARKS = [0.5, 0.9, 0.99]

# Centroids of each day as above, with the range of what they stand for, and those of all days.
SQL_MERGED = """
    with v as (select event_type as g, time_bucket(interval '1 day', ts) as day, value as m, 1 as w, value as lo,
                      value as hi from events),
         c1 as (select g, day, case when m = 0 then 0 else floor(m * pow(2, 12 - floor(log2(abs(m))))) *
                       pow(2, floor(log2(abs(m))) - 12) end as cell, sum(w) as w, sum(m * w) as total, min(lo) as lo,
                       max(hi) as hi from v group by 1, 2, 3),
         r1 as (select *, sum(w) over (partition by g, day order by cell rows unbounded preceding) as upto,
                       sum(w) over (partition by g, day) as n from c1),
         d1 as (select g, day, cast(floor(100 / pi() * (asin(least(1.0::double, greatest(-1.0::double,
                       2 * ((upto - w / 2) / n) - 1))) + pi() / 2)) as bigint) as kb, sum(total) / sum(w) as m,
                       sum(w) as w, min(lo) as lo, max(hi) as hi from r1 group by 1, 2, 3),
         c2 as (select g, case when m = 0 then 0 else floor(m * pow(2, 12 - floor(log2(abs(m))))) *
                       pow(2, floor(log2(abs(m))) - 12) end as cell, sum(w) as w, sum(m * w) as total, min(lo) as lo,
                       max(hi) as hi from d1 group by 1, 2),
         r2 as (select *, sum(w) over (partition by g order by cell rows unbounded preceding) as upto,
                       sum(w) over (partition by g) as n from c2),
         d2 as (select g, cast(floor(100 / pi() * (asin(least(1.0::double, greatest(-1.0::double,
                       2 * ((upto - w / 2) / n) - 1))) + pi() / 2)) as bigint) as kb, cast(sum(w) as bigint) as w,
                       min(lo) as lo, max(hi) as hi from r2 group by 1, 2)
"""


@query(
    "tdigest_merge",
    f"""{SQL_MERGED},
        e as (select event_type as g, value, row_number() over (partition by event_type order by value) as rank,
                     count(*) over (partition by event_type) as n from events),
        t as (select g, n, share, value as exact, greatest(1, ceil(share * n)) as wanted
              from e, (values (0.5::double), (0.9), (0.99)) s(share) where rank = greatest(1, ceil(share * n))),
        l as (select t.g, t.share, max(x.lo) as low from t join
                (select a.g, a.lo, coalesce(sum(b.w), 0) as under from d2 a left join d2 b on a.g = b.g and b.lo < a.lo
                 group by all) x on x.g = t.g and x.under < t.wanted group by 1, 2),
        h as (select t.g, t.share, min(x.hi) as high from t join
                (select a.g, a.hi, sum(b.w) as upto from d2 a join d2 b on a.g = b.g and b.hi <= a.hi group by all) x
                 on x.g = t.g and x.upto >= t.wanted group by 1, 2)
        select t.g as event_type, share, n, case when exact between low and high then low end as low,
               case when exact between low and high then high end as high,
               cast((select sum(w) from d2 where d2.g = t.g and d2.hi <= exact) as bigint) as lower_rank,
               cast((select sum(w) from d2 where d2.g = t.g and d2.lo <= exact) as bigint) as upper_rank
        from t join l using (g, share) join h using (g, share)""",
)
def tdigest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily digests merged: between what values the exact quantiles lie, and between what ranks."""
    events = table(spark, sf_dir, "events")
    daily = events.withColumn("day", time_bucket("1 day", "ts"))
    daily = digests.accumulate(daily, ["event_type", "day"], "value", "d", bounds=True)
    merged = digests.merge(daily, ["event_type"], "d", "d")
    share = F.explode(F.array(*map(F.lit, MARKS))).alias("share")
    bounded = merged.select("event_type", "d", share).select(
        "event_type", "d", "share", digest.quantile_bounds("d", F.col("share")).alias("at")
    )
    # The exact values, to ask the digest for their ranks.
    of_type = Window.partitionBy("event_type")
    ranked = events.select(
        "event_type",
        F.col("value").alias("exact"),
        F.row_number().over(of_type.orderBy("value")).alias("rank"),
        F.count("*").over(of_type).alias("n"),
    )
    exact = ranked.select("*", share).where(F.col("rank") == F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n"))))
    ranks = digest.rank_bounds("d", F.col("exact"))
    return bounded.join(exact, ["event_type", "share"]).select(
        "event_type", "share", "n", "at.low", "at.high",
        ranks["lower"].alias("lower_rank"), ranks["upper"].alias("upper_rank"),
    )


@query(
    "rollup_stored",
    f"""with b as (select event_type, time_bucket(interval '1 day', ts) as day, {sql_bucket('value')} as bucket,
                          count(*) as count from events group by 1, 2, 3),
             s as (select event_type, time_bucket(interval '1 day', ts) as day, min(value) as low, max(value) as high,
                          round(sum(value), 4) as total, count(*) as n from events group by 1, 2)
        select b.*, low, high, total, n, low as digest_low, high as digest_high, total as digest_total, n as digest_n
        from b join s using (event_type, day)""",
)
def rollup_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored histogram, statistic set and digest of each hour and key, rolled up by day in one
    scan and one shuffle of them."""
    events = table(spark, sf_dir, "events").withColumn("hour", time_bucket("1 hour", "ts"))
    keys = ["event_type", "hour"]
    hourly = histograms.accumulate_many(events, keys, {"h": "value"}, {"s": "value"}).join(
        digests.accumulate(events, keys, "value", "d", bounds=True), keys
    )
    folder = shared_dir(spark, "rollup-stored")
    hourly.write.parquet(folder)
    stored = spark.read.parquet(folder).withColumn("day", time_bucket("1 day", "hour"))
    found = rollups.merge(stored, ["event_type", "day"])
    return found.select(
        "event_type", ntz("day").alias("day"), F.explode("h").alias("bucket", "count"), "s", "d"
    ).select(
        "event_type", "day", "bucket", "count",
        F.col("s.minimum").alias("low"), F.col("s.maximum").alias("high"),
        F.round("s.samplesum", 4).alias("total"), F.col("s.samplecount").alias("n"),
        F.col("d.min").alias("digest_low"), F.col("d.max").alias("digest_high"),
        F.round("d.sum", 4).alias("digest_total"), F.col("d.count").alias("digest_n"),
    )


# Moving frames

SLOT_SECONDS = 4 * 3600
FRAME_SLOTS = 3

SQL_SLOTS = """s as (select event_type, time_bucket(interval '4 hours', ts) as slot, value from events),
               own as (select distinct event_type, slot from s)"""
SQL_FRAME = """own join s on s.event_type = own.event_type
               and s.slot <= own.slot and s.slot > own.slot - interval 12 hours"""


@query(
    "seh_moving",
    f"""with {SQL_SLOTS} select own.event_type, own.slot, {sql_bucket('value')} as bucket, count(*) as count
        from {SQL_FRAME} group by 1, 2, 3""",
)
def seh_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hourly = histograms.accumulate(
        events.withColumn("hour", time_bucket("1 hour", "ts")), ["event_type", "hour"], "value", "h"
    )
    found = histograms.moving(hourly, ["event_type"], "hour", "h", SLOT_SECONDS, FRAME_SLOTS, name="h")
    return histograms.buckets(
        found.withColumn("slot", ntz("slot")), "h", ["event_type", "slot"]
    )


@query(
    "statset_moving",
    f"""with {SQL_SLOTS} select own.event_type, own.slot, min(value) as low, max(value) as high,
        round(sum(value), 4) as total, count(*) as n from {SQL_FRAME} group by 1, 2""",
)
def statset_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = statsets.moving(
        events, ["event_type"], "ts", "value", SLOT_SECONDS, FRAME_SLOTS, values=True, name="s"
    )
    return found.select(
        "event_type",
        ntz("slot").alias("slot"),
        F.col("s.minimum").alias("low"),
        F.col("s.maximum").alias("high"),
        F.round("s.samplesum", 4).alias("total"),
        F.col("s.samplecount").alias("n"),
    )


LONG_SECONDS, LONG_SLOTS = 1800, 200

SQL_LONG = """s as (select event_type, time_bucket(interval '30 minutes', ts) as slot, value from events),
              own as (select distinct event_type, slot from s)"""
SQL_LONG_FRAME = """own join s on s.event_type = own.event_type
                    and s.slot <= own.slot and s.slot > own.slot - interval 100 hours"""


@query(
    "seh_moving_long",
    f"""with {SQL_LONG} select own.event_type, own.slot, {sql_bucket('value')} as bucket, count(*) as count
        from {SQL_LONG_FRAME} group by 1, 2, 3""",
)
def seh_moving_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 200 slots."""
    found = histograms.moving(
        table(spark, sf_dir, "events"), ["event_type"], "ts", "value", LONG_SECONDS, LONG_SLOTS, values=True, name="h"
    )
    return histograms.buckets(found.withColumn("slot", ntz("slot")), "h", ["event_type", "slot"])


@query(
    "statset_moving_long",
    f"""with {SQL_LONG} select own.event_type, own.slot, min(value) as low, max(value) as high,
        round(sum(value), 4) as total, count(*) as n from {SQL_LONG_FRAME} group by 1, 2""",
)
def statset_moving_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 200 slots."""
    events = table(spark, sf_dir, "events")
    found = statsets.moving(
        events, ["event_type"], "ts", "value", LONG_SECONDS, LONG_SLOTS, values=True, name="s"
    )
    return found.select(
        "event_type",
        ntz("slot").alias("slot"),
        F.col("s.minimum").alias("low"),
        F.col("s.maximum").alias("high"),
        F.round("s.samplesum", 4).alias("total"),
        F.col("s.samplecount").alias("n"),
    )


# Dashboard queries


@query(
    "time_bucket",
    """select time_bucket(interval '7 days', ts) as week, time_bucket(interval '15 minutes', ts) as quarter,
              count(*) as n from events group by 1, 2""",
)
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two buckets of one frame: each is its own projection.
    events = table(spark, sf_dir, "events").select(time_bucket("1 week", "ts").alias("week"), "ts")
    events = events.select("week", time_bucket("15 minutes", "ts").alias("quarter"))
    return events.groupBy("week", "quarter").agg(F.count(F.lit(1)).alias("n"))


@query(
    "top_k",
    "select event_id, user_id, value from events order by value desc, event_id limit 10",
)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return panels.top_k(events, "value", 10, ["event_id"])


@query(
    "topk_semi_join",
    """with recent as (select * from events where ts > (select max(ts) from events) - interval 3 day),
            top as (select user_id from recent order by value desc, event_id limit 10)
       select ts, user_id, value from recent where user_id in (select user_id from top) order by ts""",
)
def topk_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    lo = panels.latest(events, "ts") - F.expr("interval 3 days")
    recent = panels.time_range(events, lo, time="ts")
    rows = panels.in_top_k(recent, recent, "user_id", "value", 10, ["event_id"])
    return rows.select("ts", "user_id", "value").orderBy("ts")


@query(
    "hist_panel",
    f"""select time_bucket(interval '4 hours', ts) as time, event_type, {sql_bucket('value')} as bucket,
               count(*) as count from events group by 1, 2, 3""",
)
def hist_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return panels.hist_panel(events, "4 hours", "value", ["event_type"], time="ts")


# Reshaping, tables and sinks

EVENT_COLUMNS = [
    ColumnSpec("event_type", "dimension", "string", (("dimension", "event_type"),), True),
    ColumnSpec("user_id", "dimension", "bigint", (("dimension", "user_id"),)),
    ColumnSpec("k", "measurement", "bigint", (("measurement", "k"),), True),
    ColumnSpec("value", "measurement", "double", (("measurement", "value"),), True),
]


def read_events(store: MetricStore, lo=None, hi=None) -> DataFrame:
    rows = store.read("Event-Log", lo, hi)
    return rows.select(ntz("time").alias("time"), "event_type", "user_id", "k", "value")


def both_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_datums(table(spark, sf_dir, "events"))
    return events.unionByName(order_datums(table(spark, sf_dir, "orders")))


SQL_EVENT_ROWS = f"select ts as time, event_type, user_id, {SQL_K} as k, value from events"


@query(
    "route_by_metric",
    """select event_type as "table", ts as time, user_id as who, value as reading from events
       union all select 'orders_placed', o_orderdate, o_custkey, o_totalprice from orders""",
)
def route_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for tables, rows in wide.widen_each(both_metrics(spark, sf_dir)):
        who, reading = ("customer", "total") if "orders_placed" in tables else ("user_id", "value")
        rows_out = rows.select(
            "table", ntz("time").alias("time"), F.col(who).alias("who"), F.col(reading).alias("reading")
        )
        out = rows_out if out is None else out.unionByName(rows_out)
    return out


@query("widen", f"select ts as time, event_type, user_id, {SQL_K} as k, value from events")
def widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide.widen(event_datums(table(spark, sf_dir, "events")), EVENT_COLUMNS)
    return rows.withColumn("time", ntz("time"))


@query(
    "schema_heal",
    f"""with t as (select 'event_log' as "table", ts as time, user_id, value, {SQL_K} as k from events)
       select "table", time, 1 as batch, user_id, value, cast(null as bigint) as k from t
       union all select "table", time, 2, user_id, 1.0::double, k from t""",
)
def schema_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table first; then a column more, missing before, and a changed type that does not take."""
    store = MetricStore(spark, shared_dir(spark, "schema-heal"))
    rows = event_log(table(spark, sf_dir, "events"))
    batch = [
        F.map_concat("dimensions", as_map(batch=dim(Number=F.lit(n)))).alias("dimensions") for n in (1, 2)
    ]
    first = rows.select(
        "metric", "unix_nanos", batch[0],
        F.map_filter("measurements", lambda key, _: key != "k").alias("measurements"),
    )
    k = F.element_at("measurements", F.lit("k"))["I64"]
    changed = rows.select(
        "metric", "unix_nanos", batch[1],
        as_map(value=mea(I64=F.lit(1).cast("bigint")), k=mea(I64=k)).alias("measurements"),
    )
    for part in (first, changed):
        store.write(part)
    out = None
    for name in sorted(store.schemas()):
        read = store.read(name).select(
            F.lit(name).alias("table"), ntz("time").alias("time"),
            F.col("batch_").cast("int").alias("batch"), "user_id", "value", "k",
        )
        out = read if out is None else out.unionByName(read)
    return out


@query(
    "type_conflict_rejects",
    f"""select event_type as metric, epoch_us(ts) * 1000 as unix_nanos, 'code' as conflict,
               'x' || cast(user_id as varchar) as text, cast(null as bigint) as code, cast(null as double) as value
        from events where {SQL_K} % 10 = 3
        union all select event_type, epoch_us(ts) * 1000, null, null, user_id, value
        from events where {SQL_K} % 10 <> 3""",
)
def type_conflict_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    code = F.when(
        k_of_props() % 10 == 3, dim(String=F.concat(F.lit("x"), F.col("user_id").cast("string")))
    ).otherwise(dim(Number=F.col("user_id")))
    rows = as_datums(
        events, F.col("event_type"), "ts", as_map(code=code), as_map(value=mea(F64=F.col("value")))
    )
    columns = [
        ColumnSpec("code", "dimension", "bigint", (("dimension", "code"),)),
        ColumnSpec("value", "measurement", "double", (("measurement", "value"),)),
    ]
    nanos_out = F.col("unix_nanos").cast("bigint").alias("unix_nanos")
    rejected = wide.rejects(rows, columns).select(
        "metric",
        nanos_out,
        F.explode("conflicts").alias("conflict"),
        dimension_col("code").alias("text"),
        F.lit(None).cast("bigint").alias("code"),
        F.lit(None).cast("double").alias("value"),
    )
    none = F.lit(None).cast("string")
    kept = wide.widen(rows, columns, keep=["metric", "unix_nanos"]).select(
        "metric", nanos_out, none.alias("conflict"), none.alias("text"), "code", "value"
    )
    return rejected.unionByName(kept)


@query(
    "chunked_write",
    f"""with r as ({SQL_EVENT_ROWS})
        select 'all' as part, * from r
        union all select 'range', * from r where time > (select min(ts) from events) + interval 5 day
            and time <= (select min(ts) from events) + interval 20 day
        union all select 'failures', time, event_type, user_id, null, 1.0::double from r where event_type = 'error'""",
)
def chunked_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics loaded together; both read back whole, and one for a range of time."""
    events = table(spark, sf_dir, "events")
    other = event_datums(events.where("event_type = 'error'")).select(
        F.lit("Failures").alias("metric"),
        "unix_nanos",
        "dimensions",
        as_map(failed=mea(I32=F.lit(1))).alias("measurements"),
    )
    store = MetricStore(spark, shared_dir(spark, "chunked-write"))
    store.write(event_log(events).unionByName(other))
    first = events.agg(F.min("ts").cast("timestamp").alias("t"))
    lo, hi = first.select(
        F.unix_micros(F.col("t") + F.expr("interval 5 days")),
        F.unix_micros(F.col("t") + F.expr("interval 20 days")),
    ).first()
    failures = store.read("Failures").select(
        ntz("time").alias("time"), "event_type", "user_id", F.lit(None).cast("bigint").alias("k"),
        F.col("failed").cast("double").alias("value"),
    )
    parts = {"all": read_events(store), "range": read_events(store, moment(lo), moment(hi)), "failures": failures}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("part"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "store_accounts_for_all",
    f"""with e as (select *, {SQL_K} as k from events)
        select event_type as "table", case when k % 10 = 3 and event_id % 5 > 1 then 'conflict' else 'stored' end as outcome,
               count(*) as n from e where event_id % 5 > 0 group by all
        union all select '', case event_id % 3 when 0 then 'malformed' when 1 then 'unnamed' else 'untimed' end, count(*)
               from e where event_id % 5 = 0 group by all""",
)
def store_accounts_for_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datums without keys, names, times or readable text, and with other types, among plain
    ones: each is in a table or among the rejects."""
    events = table(spark, sf_dir, "events")
    fault = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 3)
    bare = F.col("event_id") % 5 == 1
    code = F.when(
        k_of_props() % 10 == 3, dim(String=F.concat(F.lit("x"), F.col("user_id").cast("string")))
    ).otherwise(dim(Number=F.col("user_id")))
    # The first datum of all settles the column's type.
    early = F.lit(0).cast("decimal(20,0)")
    rows = events.select(
        F.when(F.coalesce(fault, F.lit(9)) == 1, "").otherwise(F.col("event_type")).alias("metric"),
        F.when(F.coalesce(fault, F.lit(9)) != 2, nanos("ts").cast("decimal(20,0)")).alias("unix_nanos"),
        F.when(~bare, as_map(code=code)).alias("dimensions"),
        F.when(~bare, as_map(value=mea(F64=F.col("value")))).alias("measurements"),
        F.when(fault == 0, "{").alias("malformed"),
    )
    folder = shared_dir(spark, "accounts")
    store = MetricStore(spark, folder)
    kinds = events.select("event_type").distinct()
    settled = kinds.select(
        F.col("event_type").alias("metric"), early.alias("unix_nanos"),
        as_map(code=dim(Number=F.lit(1).cast("decimal(20,0)"))).alias("dimensions"),
        F.lit(None).cast(rows.schema["measurements"].dataType).alias("measurements"),
    )
    store.write(settled)
    store.write(rows)
    out = store.rejects().select(
        F.when(F.col("reason") == "conflict", F.col("table")).otherwise("").alias("table"),
        F.col("reason").alias("outcome"),
    )
    for name in sorted(store.schemas()):
        stored = store.read(name).where(F.unix_micros("time") > 0)
        out = out.unionByName(stored.select(F.lit(name).alias("table"), F.lit("stored").alias("outcome")))
    return out.groupBy("table", "outcome").agg(F.count("*").alias("n"))


def moment(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


@query(
    "csv_rows",
    rf"""select strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(cast((epoch_us(ts) % 1000000) * 1000 as varchar), 9, '0') || 'Z' as time,
                event_type, cast(user_id as varchar) as user_id, cast({SQL_K} as varchar) as k,
                regexp_replace(cast(value as varchar), '\.0$', '') as value from events""",
)
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_datums(table(spark, sf_dir, "events"))
    folder = shared_dir(spark, "csv-rows")
    delimited.write_csv(rows, EVENT_COLUMNS, folder)
    names = ["time", *[c.name for c in EVENT_COLUMNS]]
    return spark.read.schema(", ".join(f"{n} string" for n in names)).csv(folder, quote='"', escape='"')


SQL_GAUGES = f"""select event_type || '_value' as name, epoch_us(ts) * 1000 as time_unix_nano, '1' as unit,
                        cast(null as bigint) as as_int, value as as_double from events
                 union all select event_type || '_k', epoch_us(ts) * 1000, '1', {SQL_K}, null from events"""


def gauge_points(metrics: DataFrame) -> DataFrame:
    points = metrics.select("name", "unit", F.explode("gauge.data_points").alias("p"))
    return points.select(
        "name",
        "unit",
        F.col("p.time_unix_nano").cast("bigint").alias("time_unix_nano"),
        "p.as_int",
        "p.as_double",
    )


@query("otlp_gauge", SQL_GAUGES)
def otlp_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauge_points(otlp.to_otlp(event_datums(table(spark, sf_dir, "events"))))


@query(
    "otlp_attributes",
    """select 'value' as kind, user_id as n, ts as time, 'user_id' as key, cast(null as varchar) as string_value, user_id as int_value from events
       union all select 'value', user_id, ts, 'event_type', event_type, null from events""",
)
def otlp_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_datums(table(spark, sf_dir, "events")).select(
        F.lit("value").alias("kind"),
        dimension_col("user_id", "bigint").alias("n"),
        ntz(nanos_to_ts("unix_nanos")).alias("time"),
        F.explode(otlp.attributes("dimensions")).alias("a"),
    )
    return rows.select("kind", "n", "time", "a.key", "a.value.string_value", "a.value.int_value")


@query(
    "otlp_summary",
    """with d as (select event_type, time_bucket(interval '1 day', ts) as day, min(value) as lo, max(value) as hi,
                         round(sum(value), 4) as total, count(*) as n from events group by 1, 2)
       select event_type || '_daily' as name, day as time, 0::double as quantile, lo as value, total, n from d
       union all select event_type || '_daily', day, 1::double, hi, total, n from d""",
)
def otlp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_sets(spark, sf_dir).select(
        F.col("event_type").alias("metric"),
        nanos("day").cast("decimal(20,0)").alias("unix_nanos"),
        as_map(event_type=dim(String=F.col("event_type"))).alias("dimensions"),
        as_map(daily=mea(StatisticSet=F.col("s"))).alias("measurements"),
    )
    points = otlp.to_otlp(rows).select("name", F.explode("summary.data_points").alias("p"))
    return points.select(
        "name",
        ntz(nanos_to_ts("p.time_unix_nano")).alias("time"),
        F.round("p.sum", 4).alias("total"),
        F.col("p.count").cast("bigint").alias("n"),
        F.inline("p.quantile_values"),
    )


@query(
    "otlp_histogram",
    f"""with c as (select event_type, time_bucket(interval '1 day', ts) as day, cast(ceil({sql_bucket('cast(' + SQL_K + ' as double)')}) as bigint) as b,
                   count(*) as n from events group by 1, 2, 3),
            t as (select event_type, day, cast(sum(n) as bigint) as n, cast(sum(b * n) as double) as total, count(*) as bounds
                  from c group by 1, 2),
            r as (select event_type, day, cast(b as double) as bound, n,
                         row_number() over (partition by event_type, day order by b) as i from c
                  union all select event_type, day, null, 0, bounds + 1 from t)
        select r.event_type || '_sizes' as name, r.day as time, t.n, t.total as approximate_sum, cast(i - 1 as int) as place,
               bound, r.n as bucket_count from r join t on r.event_type = t.event_type and r.day = t.day""",
)
def otlp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_type", time_bucket("1 day", "ts").alias("day"), k_of_props().alias("k")
    )
    daily = histograms.accumulate(events, ["event_type", "day"], "k", "h")
    whole = F.transform_keys("h", lambda bound, _: bound.cast("bigint"))
    rows = daily.select(
        F.col("event_type").alias("metric"),
        nanos("day").cast("decimal(20,0)").alias("unix_nanos"),
        as_map(event_type=dim(String=F.col("event_type"))).alias("dimensions"),
        as_map(sizes=mea(Histogram=whole)).alias("measurements"),
    )
    points = otlp.to_otlp(rows).select("name", F.explode("histogram.data_points").alias("p"))
    each = points.select("name", "p", F.posexplode("p.bucket_counts").alias("place", "bucket_count"))
    return each.select(
        "name",
        ntz(nanos_to_ts("p.time_unix_nano")).alias("time"),
        F.col("p.count").cast("bigint").alias("n"),
        F.col("p.sum").alias("approximate_sum"),
        "place",
        F.get("p.explicit_bounds", F.col("place")).alias("bound"),
        F.col("bucket_count").cast("bigint").alias("bucket_count"),
    )


@query("otlp_request", SQL_GAUGES)
def otlp_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = otlp.to_otlp(event_datums(table(spark, sf_dir, "events")))
    requests = otlp.parse_requests(otlp.otlp_request(metrics, 1000))
    return gauge_points(otlp.request_metrics(requests))


@query(
    "retention",
    f"""select * from ({SQL_EVENT_ROWS}) where time_bucket(interval '4 hours', time) + interval 4 hours >
        (select max(ts) from events) - interval 7 day""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    store = MetricStore(spark, shared_dir(spark, "retention"))
    store.write(event_log(events))
    now = events.agg(F.unix_micros(F.max("ts").cast("timestamp"))).first()[0]
    store.apply_retention(moment(now), 7 * 24 * 3600)
    return read_events(store)


@query("compaction", SQL_EVENT_ROWS)
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a table copied into a folder a day, newest first."""
    folder = shared_dir(spark, "compaction")
    store = MetricStore(spark, f"{folder}/store")
    store.write(event_log(table(spark, sf_dir, "events")))
    daily_copy(store.read("Event-Log"), f"{folder}/days")
    rows = spark.read.parquet(f"{folder}/days")
    return rows.select(ntz("time").alias("time"), "event_type", "user_id", "k", "value")


# Streaming


@query("stream_wide", SQL_EVENT_ROWS)
def stream_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "stream-wide")
    stream = event_log(events_stream(spark, sf_dir))
    run = pipelines.stream_wide(stream, f"{folder}/tables", f"{folder}/progress", trigger=None)
    run.awaitTermination()
    return read_events(MetricStore(spark, f"{folder}/tables"))


@query("otlp_wire", SQL_GAUGES)
def otlp_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes in the binary form, written and decoded."""
    folder = shared_dir(spark, "otlp-wire")
    metrics = otlp.to_otlp(event_datums(table(spark, sf_dir, "events")))
    otlp.write_wire(otlp.otlp_wire(metrics), folder)
    return gauge_points(otlp.request_metrics(otlp.parse_wire(spark.read.parquet(folder))))


@query("stream_otlp", SQL_GAUGES)
def stream_otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "stream-otlp")
    stream = event_datums(events_stream(spark, sf_dir))
    run = pipelines.stream_otlp(stream, f"{folder}/out", f"{folder}/progress", trigger=None)
    run.awaitTermination()
    return gauge_points(otlp.request_metrics(otlp.read_otlp(spark, f"{folder}/out")))


def quarters(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The events as a stream of four micro-batches, each a span of time, in no order of time."""
    events = table(spark, sf_dir, "events")
    events.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return reader.option("latestFirst", "true").parquet(f"{folder}/in")


@query(
    "stream_rollup",
    """select time_bucket(interval '4 hours', ts) as time, event_type, min(value) as low, max(value) as high,
              round(sum(value), 4) as total, count(*) as n from events group by 1, 2""",
)
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "stream-rollup")

    def sets(batch: DataFrame) -> DataFrame:
        return pipelines.statistics_of(batch, "ts", "4 hours", ["event_type"], "value", "s")

    run = pipelines.stream_rollup(
        quarters(spark, sf_dir, folder), sets, f"{folder}/out", f"{folder}/progress", None, ["event_type"], 7 * 86400
    )
    run.awaitTermination()
    found = pipelines.read_rollup(spark, f"{folder}/out")
    return found.select(
        ntz("time").alias("time"),
        "event_type",
        F.col("s.minimum").alias("low"),
        F.col("s.maximum").alias("high"),
        F.round("s.samplesum", 4).alias("total"),
        F.col("s.samplecount").alias("n"),
    )


@query(
    "stream_rollup_histogram",
    f"""select time_bucket(interval '4 hours', ts) as time, event_type, {sql_bucket('value')} as bucket,
               count(*) as count from events group by 1, 2, 3""",
)
def stream_rollup_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "stream-histogram")

    def maps(batch: DataFrame) -> DataFrame:
        return pipelines.histograms_of(batch, "ts", "4 hours", ["event_type"], "value", "h")

    run = pipelines.stream_rollup(
        quarters(spark, sf_dir, folder), maps, f"{folder}/out", f"{folder}/progress", None, ["event_type"], 7 * 86400
    )
    run.awaitTermination()
    found = pipelines.read_rollup(spark, f"{folder}/out")
    return histograms.buckets(found.withColumn("time", ntz("time")), "h", ["time", "event_type"])


@query(
    "fan_out",
    f"""select 'table' as sink, 'event_log' as name, ts as time, event_type, user_id, {SQL_K} as k, value from events
        union all select 'otlp', 'Event-Log_value', ts, event_type, user_id, null, value from events
        union all select 'otlp', 'Event-Log_k', ts, event_type, user_id, {SQL_K}, null from events""",
)
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream into tables and into envelopes: every column of the one, every gauge of the other."""
    folder = shared_dir(spark, "fan-out")
    stream = event_log(events_stream(spark, sf_dir))
    for run in pipelines.fan_out(stream, f"{folder}/tables", f"{folder}/otlp", f"{folder}/progress", None):
        run.awaitTermination()
    metrics = otlp.request_metrics(otlp.read_otlp(spark, f"{folder}/otlp"))
    points = metrics.select("name", F.explode("gauge.data_points").alias("p"))

    def attribute(name: str, member: str) -> Column:
        return F.get(F.filter("p.attributes", lambda a: a["key"] == name), 0)["value"][member].alias(name)

    out = points.select(
        F.lit("otlp").alias("sink"), "name", ntz(nanos_to_ts("p.time_unix_nano")).alias("time"),
        attribute("event_type", "string_value"), attribute("user_id", "int_value"),
        F.col("p.as_int").alias("k"), F.col("p.as_double").alias("value"),
    )
    store = MetricStore(spark, f"{folder}/tables")
    for name in sorted(store.schemas()):
        rows = store.read(name).select(
            F.lit("table").alias("sink"), F.lit(name).alias("name"), ntz("time").alias("time"),
            "event_type", "user_id", "k", "value",
        )
        out = out.unionByName(rows)
    return out


# Panels in one pass, and as SQL


@query(
    "multi_panel",
    f"""with e as (select time_bucket(interval '4 hours', ts) as time, event_type, value, cast({SQL_K} as double) as k from events),
            s as (select time, event_type, min(value) as low, max(k) as most, count(*) as n from e group by 1, 2),
            b as (select time, event_type, 'value' as measure, {sql_bucket('value')} as bucket, count(*) as count from e group by all
                  union all select time, event_type, 'k', {sql_bucket('k')}, count(*) from e group by all)
       select b.*, low, most, n from b join s using (time, event_type)""",
)
def multi_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", k_of_props().cast("double"))
    found = panels.multi_panel(
        events, "4 hours", {"value_h": "value", "k_h": "k"}, {"value_s": "value", "k_s": "k"}, ["event_type"], "ts"
    )
    maps = F.map_from_arrays(F.array(F.lit("value"), F.lit("k")), F.array("value_h", "k_h"))
    each = found.select(
        ntz("time").alias("time"), "event_type", F.explode(maps).alias("measure", "h"),
        F.col("value_s.minimum").alias("low"), F.col("k_s.maximum").alias("most"),
        F.col("value_s.samplecount").alias("n"),
    )
    return histograms.buckets(each, "h", ["time", "event_type", "measure", "low", "most", "n"])


@query(
    "sql_hist_panel",
    f"""select time_bucket(interval '4 hours', ts) as time, {sql_bucket('value')} as bucket, count(*) as count
        from events group by 1, 2""",
)
def sql_hist_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram panel in SQL alone, by the functions a session can register."""
    register_functions(spark)
    events = table(spark, sf_dir, "events")
    return spark.sql(
        """
        with counts as (
          select window(ts, '4 hours').start as time, seh_bucket(value) as bound, count(*) as n
          from {events} group by 1, 2
        ), panel as (
          select time, map_from_entries(collect_list(struct(bound, n))) as h from counts group by time
        )
        select cast(time as timestamp_ntz) as time, b.bucket, b.count from panel, lateral buckets(h) b
        """,
        events=events,
    )


@query(
    "sql_statistic_sets",
    """select event_type, min(value) as low, max(value) as high, round(sum(value), 4) as total,
              count(*)::double as n, round(avg(value), 6) as mean from events group by 1""",
)
def sql_statistic_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    return spark.sql(
        """
        with sets as (
          select event_type, statistic_set(min(value), max(value), sum(value), count(value)) as s
          from {events} group by event_type
        )
        select event_type, statistic_set_min(s) as low, statistic_set_max(s) as high,
          round(statistic_set_sum(s), 4) as total, statistic_set_count(s) as n,
          round(statistic_set_avg(s), 6) as mean
        from sets
        """,
        events=table(spark, sf_dir, "events"),
    )


@query(
    "sql_topk_semi_join",
    """select event_id, user_id, value from events where user_id in
         (select user_id from (select user_id, max(value) as top from events group by 1 order by top desc, user_id limit 10))""",
)
def sql_topk_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """
        select event_id, user_id, value from {events} where user_id in (
          select user_id from (
            select user_id, max(value) as top from {events} group by 1 order by top desc, user_id limit 10))
        """,
        events=table(spark, sf_dir, "events"),
    )
