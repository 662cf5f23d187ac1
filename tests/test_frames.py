"""Moving frames of any length, rollups of stored values, digests that know their error."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import brute_frames

from widemetrics.functions import digest, statset
from widemetrics.operators import digests, histograms, rollups, statsets

START = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def slotted(spark, rows):
    timed = [(k, START + timedelta(hours=s), v) for k, s, v in rows]
    return spark.createDataFrame(timed, "k string, t timestamp, v double").repartition(3)


def hours(moment):
    return int((moment - START).total_seconds() // 3600)


@pytest.mark.parametrize("frame", [1, 3, 4, 1000, 5000])
def test_frames_of_any_length_against_brute_force(spark, frame):
    """Dense and sparse keys, gaps longer than the frame, slots before 1970, one key over blocks."""
    rng = random.Random(frame)
    rows = [("hot", rng.randint(-3000, 3000), float(rng.randint(0, 9))) for _ in range(700)]
    rows += [("rare", s, 3.0) for s in (0, 1, 2000, 2001, 9000)] + [(None, 5, 1.0), (None, 5, 1.0)]
    rows += [("old", s - 600_000, 2.0) for s in (0, frame - 1, frame, frame + 1)]
    df = slotted(spark, rows)
    want = brute_frames(rows, frame)
    got = histograms.moving(df, ["k"], "t", "v", 3600, frame, values=True, name="h").collect()
    assert len(got) == len(want)
    for r in got:
        # Digits are their own buckets.
        assert r["h"] == dict(want[r["k"], hours(r["slot"])])
    sets = statsets.moving(df, ["k"], "t", "v", 3600, frame, values=True, name="s").collect()
    assert len(sets) == len(want)
    for r in sets:
        values = list(want[r["k"], hours(r["slot"])].elements())
        assert tuple(r["s"]) == (min(values), max(values), sum(values), len(values))


def test_a_count_is_shuffled_twice_at_most_whatever_the_frame(spark, tmp_path):
    """A count meets one shuffle on the way to its slot's total and then goes to two blocks at
    most; the blocks of one key lie in several tasks."""
    rows = [("hot", s, float(s % 5)) for s in range(10_000)]
    slotted(spark, rows).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for build in (histograms.moving, statsets.moving):
            for frame in (10, 1000):
                found = build(df, ["k"], "t", "v", 3600, frame, values=True)
                assert plan(found).count("Exchange hashpartitioning") == 2
                assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 2
                assert sent_rows(spark, found) <= 2 * len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sent_rows(spark, found):
    """Rows that the second shuffle of a plan writes, by its own metric."""
    found.write.mode("overwrite").format("noop").save()
    execution = found._jdf.queryExecution()
    execution.toRdd().count()
    sizes = []

    def walk(node):
        name = str(node.nodeName())
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
            return
        if "QueryStage" in name:
            walk(node.plan())
            return
        if name == "Exchange":
            sizes.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(execution.executedPlan())
    return sizes[0]


def test_histograms_with_counts_of_nothing_keep_their_slots(spark):
    df = spark.sql(
        "select * from values ('a', timestamp'2024-01-01 00:00:00', map(1L,2L)),"
        " ('a', timestamp'2024-01-01 03:00:00', map(1L,0L)), ('a', timestamp'2024-01-01 04:00:00', null),"
        " ('a', timestamp'2024-01-01 01:00:00', map(5L,1L)) t(k,t,h)")
    got = {r["slot"].hour: r["histogram"] for r in histograms.moving(df, ["k"], "t", "h", 3600, 2).collect()}
    assert got == {0: {1: 2}, 1: {1: 2, 5: 1}, 3: {}, 4: {}}
    everything = histograms.moving(df, [], "t", "h", 3600, 100).collect()
    assert {r["slot"].hour: r["histogram"] for r in everything}[4] == {1: 2, 5: 1}


# Rollups of stored values


def stored(spark, rows):
    df = spark.createDataFrame(rows, "g string, p int, v double")
    keys = ["g", "p"]
    return (
        df.groupBy(*keys).agg(statset.accumulate("v").alias("s"))
        .join(histograms.accumulate(df, keys, "v", "h"), keys)
        .join(digests.accumulate(df, keys, "v", "d", bounds=True), keys)
        .join(digests.accumulate(df, keys, "v", "plain"), keys)
    )


def test_stored_values_merge_as_they_do_alone(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 9), round(rng.random() * 100, 2)) for _ in range(3000)]
    rows += [("none", 1, None), ("zero", 1, 0.0)]
    parts = stored(spark, rows).cache()
    whole = parts.withColumn("big", F.expr("map(9223372036854775807L, 1L, 9223372036854775806L, 2L)"))
    got = {r["g"]: r for r in rollups.merge(whole, ["g"]).collect()}
    for name, alone in (
        ("h", histograms.merge(parts, ["g"], "h", "x")),
        ("s", parts.groupBy("g").agg(statset.merge("s").alias("x"))),
        ("d", digests.merge(parts, ["g"], "d", "x")),
        ("plain", digests.merge(parts, ["g"], "plain", "x")),
    ):
        for r in alone.collect():
            mine = got[r["g"]][name]
            if name == "h":
                assert mine == r["x"]
            elif name == "s":
                assert mine[:2] == r["x"][:2] and mine[3] == r["x"][3] and mine[2] == pytest.approx(r["x"][2])
            else:
                assert (mine["count"], mine["min"], mine["max"]) == (r["x"]["count"], r["x"]["min"], r["x"]["max"])
                assert [c["weight"] for c in mine["centroids"]] == [c["weight"] for c in r["x"]["centroids"]]
    assert got["a"]["big"] == {9223372036854775807: 10, 9223372036854775806: 20}
    assert got["none"]["h"] == {} and got["none"]["d"]["count"] == 0 and tuple(got["none"]["s"])[3] == 0


def test_stored_values_are_scanned_and_shuffled_once(spark, tmp_path):
    stored(spark, [("a", 1, 2.0), ("b", 2, 3.0)]).write.parquet(str(tmp_path / "s"))
    text = plan(rollups.merge(spark.read.parquet(str(tmp_path / "s")), ["g"]))
    assert text.count("FileScan") == 1 and "partial_sum" in text
    # The last two exchanges carry merged cells and centroids.
    assert text.count("Exchange hashpartitioning") <= 3


def test_null_values_add_nothing(spark):
    parts = stored(spark, [("a", 1, 2.0)])
    none = parts.select("g", *[F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in ("s", "h", "d")])
    both = parts.select("g", "s", "h", "d").unionByName(none).unionByName(none.withColumn("g", F.lit("n")))
    got = {r["g"]: r for r in rollups.merge(both, ["g"]).collect()}
    assert got["a"]["h"] == {2.0: 1} and got["a"]["d"]["count"] == 1 and got["n"]["h"] == {}
    assert rollups.merge(both.limit(0), ["g"]).count() == 0


# Digests that know their error


@pytest.mark.parametrize("seed", [1, 2])
def test_brackets_hold_the_exact_quantile_and_rank(spark, seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.gauss(0, 5), lambda: float(rng.randint(0, 3)), lambda: rng.expovariate(1), lambda: 7.0]
    rows = [(str(i % 4), rng.randint(0, 20), kinds[i % 4]()) for i in range(8000)]
    df = spark.createDataFrame(rows, "g string, p int, v double")
    merged = digests.merge(digests.accumulate(df, ["g", "p"], "v", "d", bounds=True), ["g"], "d", "d").cache()
    marks = [0.0, 0.001, 0.1, 0.5, 0.77, 0.99, 1.0]
    for r in merged.select("g", *[digest.quantile_bounds("d", q).alias(str(q)) for q in marks]).collect():
        own = sorted(v for g, _, v in rows if g == r["g"])
        for q in marks:
            exact = own[max(1, -int(-q * len(own) // 1)) - 1]
            assert r[str(q)]["low"] <= exact <= r[str(q)]["high"]
        at = [own[0], own[len(own) // 3], own[-1], 0.5]
        bounds = merged.where(F.col("g") == r["g"]).select(
            *[digest.rank_bounds("d", F.lit(x)).alias(f"r{i}") for i, x in enumerate(at)]
        ).first()
        for i, x in enumerate(at):
            lower, upper = bounds[f"r{i}"]
            assert lower <= sum(v <= x for v in own) <= upper
            assert upper - lower <= 0.06 * len(own) or len(set(own)) < 5
    assert Counter(c["weight"] for c in merged.first()["d"]["centroids"])


def test_bounds_of_an_empty_digest_are_null(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    d = digests.accumulate(df, ["g"], "v", "d", bounds=True)
    row = d.select(digest.quantile_bounds("d", 0.5).alias("q"), digest.rank_bounds("d", F.lit(1.0)).alias("r")).first()
    assert row["q"] is None and tuple(row["r"]) == (0, 0)
