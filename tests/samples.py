"""A datum with every member of the wire form, and a scrape; names and numbers are our own."""

import json

# 2023-11-14T22:13:20Z, in nanoseconds.
MOMENT = 1_700_000_000 * 10**9

# The names of members and their fields on the wire.
DIMENSIONS = {
    "depot": {"String": "north"},
    "pallets": {"Number": 9},
    "cooled": {"Boolean": False},
}
MEASUREMENTS = {
    "forklifts": {"I32": 3},
    "parcels": {"I64": 70_000},
    "load": {"F32": 0.25},
    "weight": {"F64": 812.5},
    "wait": {"StatisticSet": {"minimum": 0.5, "maximum": 7, "samplesum": 30, "samplecount": 12}},
    "sizes": {"Histogram": {"buckets": {"10": 5, "20": 1, "45": 2}}},
    "trip": {
        "Tdigest": {
            "sum": 64.5, "count": 20, "min": 2, "max": 9.5,
            "centroids": [{"mean": 2.5, "weight": 17}, {"mean": 7.33, "weight": 3}],
        }
    },
}

#: Cumulative counts 4, 4, 10, 25 and 31 in all.
HISTOGRAM_SCRAPE = """# TYPE truck_stop_minutes histogram
truck_stop_minutes_bucket{le="1"} 4
truck_stop_minutes_bucket{le="2.5"} 4
truck_stop_minutes_bucket{le="5"} 10
truck_stop_minutes_bucket{le="15"} 25
truck_stop_minutes_bucket{le="+Inf"} 31
truck_stop_minutes_sum 297.5
truck_stop_minutes_count 31
"""


def datum(metric="m", nanos=0, dims=None, meas=None):
    """Wire form of one datum as JSON text."""
    return json.dumps(
        {
            "metric": metric,
            "unix_nanos": nanos,
            "dimensions": {k: {"value": v} for k, v in (dims or {}).items()},
            "measurements": {k: {"value": v} for k, v in (meas or {}).items()},
        }
    )


def frame(spark, *texts):
    """Datums from JSON texts."""
    from widemetrics.sources.datums import parse_datums, split_malformed

    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    return split_malformed(parse_datums(rows))[0]


DATUM = datum("Depot", MOMENT, DIMENSIONS, MEASUREMENTS)
