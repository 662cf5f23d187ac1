"""The value functions as SQL functions of a session, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from widemetrics.schema import STATSET_DDL, TDIGEST_DDL

_MAP = "map<double,bigint>"

_DECADE = "nullif(pow(10D, floor(log10(v))), 0D)"

_SEH_BUCKET = f"""
case when v is null then null
  when v < 0 or isnan(v) or v = double('infinity')
    then cast(raise_error('no bucket for this number') as double)
  when v = 0 then 0D
  else coalesce(ceil(v / {_DECADE} * 2) / 2 * {_DECADE}, v) end
"""

_MIDDLE = "a.seen + c.weight / 2D"

# Straight lines between the middles of centroids, from the least number to the largest.
_QUANTILE = f"""
case when d.count > 0 then aggregate(d.centroids,
  named_struct('seen', 0L, 'left_rank', 0D, 'left_mean', d.min, 'found', cast(null as double)),
  (a, c) -> named_struct('seen', a.seen + c.weight, 'left_rank', {_MIDDLE}, 'left_mean', c.mean,
    'found', coalesce(a.found, case when q * d.count <= {_MIDDLE} then a.left_mean + (c.mean - a.left_mean) *
      case when {_MIDDLE} <= a.left_rank then 1D
        else (q * d.count - a.left_rank) / ({_MIDDLE} - a.left_rank) end end)),
  a -> coalesce(a.found, a.left_mean + (d.max - a.left_mean) *
    case when a.seen <= a.left_rank then 1D else (q * d.count - a.left_rank) / (a.seen - a.left_rank) end))
end
"""

# Bounds in order; those above nine are whole.
_JSON = """
concat('{', array_join(transform(array_sort(map_entries(h)), e -> concat('"', case when e.key = floor(e.key)
  and abs(e.key) < 1E18D then cast(cast(e.key as bigint) as string) else cast(e.key as string) end, '":',
  cast(e.value as string))), ','), '}')
"""

#: name, parameters, result and body; the sets' functions return 0 for an empty average.
SCALARS = [
    ("statistic_set_min", f"s {STATSET_DDL}", "double", "s.minimum"),
    ("statistic_set_max", f"s {STATSET_DDL}", "double", "s.maximum"),
    ("statistic_set_sum", f"s {STATSET_DDL}", "double", "s.samplesum"),
    ("statistic_set_count", f"s {STATSET_DDL}", "double", "cast(s.samplecount as double)"),
    (
        "statistic_set_avg",
        f"s {STATSET_DDL}",
        "double",
        "case when s.samplecount = 0 then 0D else s.samplesum / s.samplecount end",
    ),
    (
        "histogram_combine",
        f"l {_MAP}, r {_MAP}",
        _MAP,
        "map_zip_with(l, r, (k, x, y) -> coalesce(x, 0L) + coalesce(y, 0L))",
    ),
    (
        "histogram_subtract",
        f"l {_MAP}, r {_MAP}",
        _MAP,
        "map_filter(map_zip_with(l, r, (k, x, y) -> coalesce(x, 0L) - coalesce(y, 0L)), (k, n) -> n <> 0)",
    ),
    ("histogram_count", f"h {_MAP}", "bigint", "aggregate(map_values(h), 0L, (a, n) -> a + n)"),
    ("histogram_json", f"h {_MAP}", "string", _JSON),
    ("digest_quantile", f"d {TDIGEST_DDL}, q double", "double", _QUANTILE),
    ("digest_count", f"d {TDIGEST_DDL}", "bigint", "d.count"),
]

TABLES = [
    ("buckets", f"h {_MAP}", "bucket double, count bigint", "select * from explode(h) as t(bucket, count)"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions for statistic sets and histograms; gives their names.

    statistic_set_min, _max, _sum, _count and _avg take a statistic set;
    histogram_combine, histogram_subtract, histogram_count and histogram_json
    histograms; digest_quantile and digest_count digests without ranges.
    seh_bucket takes a number, and buckets, a table function, a histogram.
    A statistic set of numbers is statistic_set(min(v), max(v), sum(v),
    count(v)), and of sets the same with sums of sums and counts: aggregates
    stay SQL's own, so they combine before a shuffle. They are plain
    expressions: nothing runs in Python.
    """
    for name, parameters, result, body in SCALARS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    spark.sql(
        "create or replace temporary function statistic_set(low double, high double, total double, n bigint) "
        f"returns {STATSET_DDL} return named_struct('minimum', coalesce(low, 1E308D), 'maximum', "
        "coalesce(high, -1E308D), 'samplesum', coalesce(total, 0D), 'samplecount', coalesce(n, 0L))"
    )
    spark.sql(f"create or replace temporary function seh_bucket(v double) returns double return {_SEH_BUCKET}")
    for name, parameters, result, body in TABLES:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns table({result}) return {body}")
    return [s[0] for s in SCALARS] + ["statistic_set", "seh_bucket"] + [t[0] for t in TABLES]

