"""Decoding datums, requests and scrapes."""

import json
import math
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from samples import DATUM, HISTOGRAM_SCRAPE, MOMENT, datum, frame

from widemetrics.operators.wide import dimension_col, measurement_col
from widemetrics.sources import datums, exposition


def test_sample_datum(spark):
    row = frame(spark, DATUM).first()
    assert (row["metric"], row["unix_nanos"]) == ("Depot", Decimal(MOMENT))
    d = row["dimensions"]
    assert (d["depot"]["String"], d["pallets"]["Number"], d["cooled"]["Boolean"]) == ("north", 9, False)
    m = row["measurements"]
    assert m["forklifts"]["I32"] == 3 and m["parcels"]["I64"] == 70_000
    assert m["load"]["F32"] == 0.25 and m["weight"]["F64"] == 812.5
    assert tuple(m["wait"]["StatisticSet"]) == (0.5, 7.0, 30.0, 12)
    assert m["sizes"]["Histogram"] == {10: 5, 20: 1, 45: 2}
    assert m["trip"]["Tdigest"]["max_buckets"] == 100
    assert [tuple(c) for c in m["trip"]["Tdigest"]["centroids"]] == [(2.5, 17), (7.33, 3)]


def test_what_is_no_datum_is_kept_as_text(spark):
    texts = [DATUM, "nope", '{"metric":"m"}', "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    good, bad = datums.split_malformed(datums.parse_datums(rows))
    assert good.count() == 1
    assert sorted(r[0] for r in bad.collect()) == ["", "", "nope", '{"metric":"m"}']


def test_datum_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(DATUM + "\n" + datum("x", 1) + "\n")
    good, _ = datums.split_malformed(datums.read_datums_json(spark, str(tmp_path)))
    assert sorted(r["metric"] for r in good.collect()) == ["Depot", "x"]


def test_datum_files_over_several_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(json.loads(DATUM), indent=2))
    (tmp_path / "b.json").write_text("[" + datum("x", 1) + ",\n" + datum("y", 2) + "]")
    (tmp_path / "c.json").write_text('{"metric":"z"}')
    good, bad = datums.split_malformed(datums.read_datums_json(spark, str(tmp_path), multiline=True))
    assert sorted(r["metric"] for r in good.collect()) == ["Depot", "x", "y"]
    assert [r[0] for r in bad.collect()] == ['{"metric":"z"}']


def test_decoding_happens_once(spark):
    rows = spark.createDataFrame([(DATUM,)], "value string")
    good, _ = datums.split_malformed(datums.parse_datums(rows))
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
    requests = datums.parse_requests(rows)._jdf.queryExecution().executedPlan().toString()
    assert requests.count("from_json") == 1


def test_unsigned_counts_wrap(spark):
    text = datum(meas={"s": {"StatisticSet": {"minimum": 0, "maximum": 0, "samplesum": 0, "samplecount": 2**64 - 1}}})
    assert frame(spark, text).first()["measurements"]["s"]["StatisticSet"]["samplecount"] == -1


def test_shared_dimensions_win(spark):
    request = {
        "shared_dimensions": {"host": {"value": {"String": "shared"}}, "az": {"value": {"Number": 3}}},
        "metrics": [json.loads(datum("m", 5, {"host": {"String": "own"}, "x": {"Boolean": True}})),
                    json.loads(datum("n", 6))],
    }
    plain = {"metrics": [json.loads(datum("p", 7, {"host": {"String": "own"}}))]}
    texts = [(json.dumps(r),) for r in (request, plain, {"metrics": []})]
    rows = datums.parse_requests(spark.createDataFrame(texts, "value string"))
    got = {
        r["metric"]: (r["h"], r["a"], r["x"])
        for r in rows.select("metric", dimension_col("host").alias("h"), dimension_col("az", "bigint").alias("a"),
                             dimension_col("x", "boolean").alias("x")).collect()
    }
    assert got == {"m": ("shared", 3, True), "n": ("shared", 3, None), "p": ("own", None, None)}


def test_prefix(spark):
    assert [datums.table_prefix(p) for p in ("", "node", "node_")] == ["", "node_", "node_"]
    assert datums.with_prefix(frame(spark, datum("m")), "node").first()["metric"] == "node_m"


def test_bonus_dimensions(spark):
    values = datums.dimensions_from_json('{"host": {"value": {"String": "a"}}, "live": {"value": {"Boolean": true}}}')
    row = datums.with_bonus_dimensions(frame(spark, datum("m", 1, {"host": {"String": "b"}})), values).first()
    assert row["dimensions"]["host"]["String"] == "a" and row["dimensions"]["live"]["Boolean"] is True


# Scrapes


def scrape(spark, *bodies):
    rows = [(i, datetime(2024, 1, 1, i), b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "scrape_id int, scraped_at timestamp, body string")


def decoded(spark, body, **options):
    rows = exposition.decode_prometheus(scrape(spark, body), **options).collect()
    out = []
    for r in rows:
        labels = {k: v["String"] for k, v in r["dimensions"].items()}
        value = r["measurements"]["value"]
        out.append((r["metric"], labels, value["F64"] if value["Histogram"] is None else value["Histogram"]))
    return out


def test_histogram_sample(spark):
    assert decoded(spark, HISTOGRAM_SCRAPE) == [
        ("truck_stop_minutes", {}, {1: 4, 3: 0, 5: 6, 15: 15, 9223372036854775807: 6})
    ]


def test_kinds(spark):
    body = "\n".join(
        line
        for kind in ("gauge", "counter", "untyped", "summary", "stateset")
        for line in (f"# TYPE a_{kind} {kind}", f"a_{kind} 1")
    )
    assert [m for m, _, _ in decoded(spark, body, prefix="p")] == [
        "p_a_gauge", "p_a_counter", "p_a_untyped", "p_a_summary"]


def test_labels(spark):
    body = '# TYPE a gauge\na{x="1",y="q,}\\"z",} 2 1700000000\na{} 3\na{d="1",d="2"} 4\n'
    assert decoded(spark, body) == [
        ("a", {"x": "1", "y": 'q,}\\"z'}, 2.0), ("a", {}, 3.0), ("a", {"d": "2"}, 4.0)]


def test_numbers(spark):
    body = "# TYPE a gauge\na NaN\na +Inf\na 1e3\na oops\na -2.5\n"
    values = [v for _, _, v in decoded(spark, body)]
    assert math.isnan(values[0]) and values[1:] == [math.inf, 1000.0, None, -2.5]
    assert [v for _, _, v in decoded(spark, body, bad_value=-1.0)][3] == -1.0
    rows = exposition.decode_prometheus(scrape(spark, body))
    assert [r["malformed"] for r in rows.where("malformed is not null").collect()] == ["a oops"]


def test_a_family_ends_at_a_foreign_line(spark):
    body = "orphan 1\n# TYPE a gauge\na 1\nb 2\na 3\n# HELP c x\n# TYPE c counter\nc 4\nc_more 5\n# TYPE s summary\ns 1\ns_sum 2\ns_count 3\n"
    assert [(m, v) for m, _, v in decoded(spark, body)] == [("a", 1.0), ("c", 4.0), ("s", 1.0)]


def test_windows_line_ends(spark):
    assert decoded(spark, "# TYPE a gauge\r\na 1\r\n") == [("a", {}, 1.0)]


def test_histogram_series_interleave_and_a_family_follows(spark):
    body = """# TYPE h histogram
h_bucket{code="1",le="2.5"} 3
h_bucket{code="2",le="+Inf"} 7
h_bucket{le="5",code="1"} 7
h_sum{code="1"} 9
h_bucket{code="1",le="4.5"} 6
h_bucket{code="3",le="bad"} 6
# TYPE g gauge
g 1
"""
    got = {(m, l.get("code")): v for m, l, v in decoded(spark, body)}
    assert got == {
        ("h", "1"): {3: 3, 5: 4}, ("h", "2"): {9223372036854775807: 7}, ("g", None): 1.0}


def test_scrape_time_and_files(spark, tmp_path):
    rows = exposition.decode_prometheus(scrape(spark, "", "# TYPE a gauge\na 1 99\n")).collect()
    assert [int(r["unix_nanos"]) for r in rows] == [1704070800 * 10**9]
    (tmp_path / "one.txt").write_text(HISTOGRAM_SCRAPE)
    read = exposition.read_scrapes(spark, str(tmp_path))
    assert exposition.decode_prometheus(read).count() == 1


def test_decoding_needs_no_shuffle(spark):
    rows = exposition.decode_prometheus(scrape(spark, HISTOGRAM_SCRAPE))
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Window" not in text and "Python" not in text


def test_many_lines_in_one_family(spark):
    body = "# TYPE a gauge\n" + "\n".join(f'a{{i="{i}"}} {i}' for i in range(5000))
    rows = exposition.decode_prometheus(scrape(spark, body))
    total = rows.agg(F.count("*"), F.sum(measurement_col("value"))).first()
    assert tuple(total) == (5000, sum(range(5000)))


@pytest.mark.parametrize("text", ["", "no metrics here", "# TYPE a gauge"])
def test_empty_scrapes(spark, text):
    assert decoded(spark, text) == []
