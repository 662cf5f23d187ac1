"""How often queries read their input, and what they shuffle."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from widemetrics import queries as registered
from widemetrics.operators import wide


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hist_combine", "hist_subtract", "multi_panel", "sql_hist_panel"])
def test_one_scan_without_a_join(spark, name):
    text = plan(registered.queries()[name](spark, SF))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_scans_do_not_grow_with_the_tables(spark, events):
    many = registered.event_datums(events).withColumn(
        "metric", F.concat("metric", F.lit("_"), (F.element_at("dimensions", F.lit("user_id"))["Number"] % 40).cast("string")))
    parts = wide.widen_each(many)
    assert len(parts) == 1 and len(parts[0][0]) > 40
    assert plan(parts[0][1]).count("FileScan") == 1


def test_digests_are_checked_without_joining_raw_rows(spark):
    text = plan(registered.tdigest_merge(spark, SF))
    # Below the join there is an aggregate on either side, not a scan.
    join = text[text.index("Join"):]
    assert join.index("HashAggregate") < join.index("FileScan")


def test_a_uniform_column_is_rendered_from_its_own_member(spark, events):
    from widemetrics.sinks import delimited

    text = plan(delimited.csv_rows(registered.event_datums(events), registered.EVENT_COLUMNS))
    # The digest's text form is not among what is worked out.
    assert "max_buckets:" not in text
