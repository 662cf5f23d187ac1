"""Several writers on one store, batches read once, rollups folded by window, replays."""

import threading
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from samples import datum, frame

from widemetrics.operators import wide
from widemetrics.schema import DATUM_DDL
from widemetrics.session import Folder, shared_dir
from widemetrics.sinks.store import MetricStore
from widemetrics.sources.datums import parse_datums
from widemetrics.streaming import pipelines

START = 1704067200 * 10**9
HOUR = 3600 * 10**9


def together(*work):
    """Run at the same time, after one another has reached the start."""
    barrier, faults = threading.Barrier(len(work)), []

    def run(one):
        try:
            barrier.wait()
            one()
        except Exception as fault:  # noqa: BLE001
            faults.append(fault)

    threads = [threading.Thread(target=run, args=(w,)) for w in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert faults == []


def test_one_of_several_claims_succeeds(spark):
    folder = Folder(spark, shared_dir(spark, "claims"))
    for i in range(20):
        won = []
        together(*[lambda n=n: won.append((n, folder.claim(f"{i}", str(n)))) for n in range(4)])
        (winner,) = [n for n, ok in won if ok]
        assert folder.read(f"{i}") == str(winner)
    assert sorted(folder.names(), key=int) == [str(i) for i in range(20)]


def test_writers_agree_on_a_columns_type(spark):
    """Two at a time find one column, each with its own type: 50 times one type counts for both."""
    store = MetricStore(spark, shared_dir(spark, "race"))

    def column(name, kind):
        return {name: [wide.ColumnSpec("v", "measurement", kind, (("measurement", "v"),), True)]}

    for i in range(50):
        got = {}
        together(*[lambda k=k: got.update({k: store.heal(column(f"t{i}", k))}) for k in ("double", "bigint")])
        types = {healed[f"t{i}"][0].type for healed in got.values()}
        assert types == {store.schemas()[f"t{i}"][0].type}
        (kind,) = types
        # The other has to read its values as that type.
        assert {k: healed[f"t{i}"][0].uniform for k, healed in got.items()} == {
            k: k == kind for k in ("double", "bigint")
        }
    versions = [r["version"] for r in store._registry() if r["column"] is None]
    assert versions == sorted(versions)


def test_rows_of_writers_with_two_types_are_stored_or_rejected(spark):
    store = MetricStore(spark, shared_dir(spark, "race"))
    rounds = 4
    for i in range(rounds):
        whole = frame(spark, *[datum(f"m{i}", START + n, None, {"v": {"I64": n}}) for n in range(4)])
        halves = frame(spark, *[datum(f"m{i}", START + n, None, {"v": {"F64": n + 0.5}}) for n in range(4)])
        together(lambda: store.write(whole), lambda: store.write(halves))
        stored = store.read(f"m{i}").count()
        rejected = store.rejects().where(F.col("table") == f"m{i}").count()
        assert (stored, rejected) in ((8, 0), (4, 4))


def counted(spark, df):
    """df behind a step that counts the rows it has decoded."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def several_tables():
    texts = [datum(f"t{i % 3}", START + i * HOUR, None, {f"c{i % 3}": {"I64": i}}) for i in range(12)]
    texts += [datum("t0", START + HOUR, None, {"c0": {"F64": 0.5}}), "{", datum("", START)]
    return texts


def test_a_batch_is_decoded_twice_whatever_is_in_it(spark):
    """Once for the keys, once for rows and rejects: one table or several, with strays and conflicts."""
    texts = spark.createDataFrame([(t,) for t in several_tables()], "value string")
    for tables in (["t0"], ["t0", "t1", "t2"]):
        parsed = parse_datums(texts)
        mine = parsed.where(F.col("metric").isin(*tables, "") | F.col("malformed").isNotNull())
        rows, seen = counted(spark, mine)
        n = mine.count()
        store = MetricStore(spark, shared_dir(spark, "once"))
        store.write(rows)
        assert seen.value == 2 * n
        stored = sum(store.read(t).count() for t in tables)
        assert stored + store.rejects().count() == n
        assert sorted(r["reason"] for r in store.rejects().collect()) == ["conflict", "malformed", "unnamed"]


def test_a_stream_decodes_its_batches_once(spark, tmp_path):
    folder = shared_dir(spark, "once")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("\n".join(several_tables()) + "\n")
    rows, seen = counted(spark, parse_datums(spark.readStream.text(str(tmp_path / "in"))))
    pipelines.stream_wide(rows, f"{folder}/t", f"{folder}/c", None).awaitTermination(60)
    assert seen.value == 15
    assert MetricStore(spark, f"{folder}/t").rejects().count() == 3


def test_a_replayed_batch_leaves_nothing_of_its_first_attempt(spark):
    store = MetricStore(spark, shared_dir(spark, "again"))
    store.write(frame(spark, datum("m", START, None, {"v": {"I64": 1}}), datum("m", START + 9 * HOUR, None, {"v": {"I64": 2}})), "w", 1)
    store.write(frame(spark, datum("m", START, None, {"v": {"I64": 1}})), "w", 1)
    assert [r["v"] for r in store.read("m").collect()] == [1]
    store.write(frame(spark, datum("m", START, None, {"v": {"I64": 3}})), "w", 2)
    assert sorted(r["v"] for r in store.read("m").collect()) == [1, 3]


def test_latest_opens_the_newest_chunk_alone(spark):
    store = MetricStore(spark, shared_dir(spark, "latest"))
    store.write(frame(spark, *[datum("m", START + h * HOUR, None, {"v": {"I64": h}}) for h in range(0, 60, 3)]))
    assert store.latest("m") == datetime(2024, 1, 3, 9)
    # The files of earlier chunks are not even readable.
    chunks = sorted(store._chunks("m"), key=lambda c: c[2])
    for path, _, _ in chunks[:-1]:
        for name in Folder(spark, path).glob("writer=*/batch=*/*.parquet"):
            with open(name.removeprefix("file:"), "wb") as out:
                out.write(b"broken")
    assert store.latest("M") == datetime(2024, 1, 3, 9)
    empty = MetricStore(spark, shared_dir(spark, "latest"))
    empty.write(spark.createDataFrame([], DATUM_DDL))
    assert empty.schemas() == {}


# Rollups folded by window


def batch_of(spark, rows):
    base = datetime(2024, 1, 1)
    timed = [(base + timedelta(minutes=m), g, v) for m, g, v in rows]
    df = spark.createDataFrame(timed, "t timestamp, g string, v double")
    sets = pipelines.statistics_of(df, "t", "10 minutes", ["g"], "v", "s")
    maps = pipelines.histograms_of(df, "t", "10 minutes", ["g"], "v", "h")
    return sets.join(maps, ["time", "g"])


def found(spark, folder):
    return {(r["time"], r["g"]): (tuple(r["s"]), r["h"]) for r in pipelines.read_rollup(spark, folder).collect()}


def whole(spark, batches):
    rows = [r for b in batches for r in b]
    return {(r["time"], r["g"]): (tuple(r["s"]), r["h"]) for r in batch_of(spark, rows).collect()}


def test_windows_are_folded_and_replays_change_nothing(spark):
    folder = shared_dir(spark, "fold")
    own = f"{folder}/writer=w"
    batches = [[((b * 17 + i * 3) % 180, "ab"[i % 2], float(1 + i)) for i in range(6)] for b in range(10)]
    # Late rows of the first window come last of all.
    batches.append([(1, "a", 100.0), (1, "late", 7.0)])
    for b, rows in enumerate(batches):
        pipelines.add_to_windows(batch_of(spark, rows), ["g"], own, b, 3600)
        if b in (0, 4):
            # Again after all was done, then again as if the mark had been lost.
            pipelines.add_to_windows(batch_of(spark, rows), ["g"], own, b, 3600)
            Folder(spark, f"{own}/_done/{b:012d}").delete()
            if b:
                Folder(spark, f"{own}/_done").claim(f"{b - 1:012d}", "")
            pipelines.add_to_windows(batch_of(spark, rows), ["g"], own, b, 3600)
        assert found(spark, folder) == whole(spark, batches[: b + 1])
    paths = pipelines.read_rollup(spark, folder).inputFiles()
    # Three hours: as many folders, whatever the number of batches; two versions of each at most.
    assert len({p.split("span=")[1].split("/")[0] for p in paths}) == 3
    assert len({p.rsplit("/", 1)[0] for p in paths}) == 3
    assert len(Folder(spark, own).glob("span=*/upto=*")) <= 6
    assert len(Folder(spark, f"{own}/_done").names()) == 1


def test_an_empty_batch_and_one_that_never_finished(spark):
    folder = shared_dir(spark, "fold")
    own = f"{folder}/writer=w"
    rows = [(1, "a", 2.0), (70, "b", 3.0)]
    pipelines.add_to_windows(batch_of(spark, rows), ["g"], own, 0, 3600)
    pipelines.add_to_windows(batch_of(spark, rows).limit(0), ["g"], own, 1, 3600)
    assert found(spark, folder) == whole(spark, [rows])
    # What a batch wrote before it stopped does not count until its mark is there.
    pipelines.add_to_windows(batch_of(spark, [(1, "a", 9.0)]), ["g"], own, 2, 3600)
    Folder(spark, f"{own}/_done/{2:012d}").delete()
    Folder(spark, f"{own}/_done").claim(f"{1:012d}", "")
    assert found(spark, folder) == whole(spark, [rows])
    pipelines.add_to_windows(batch_of(spark, [(1, "a", 9.0)]), ["g"], own, 2, 3600)
    assert found(spark, folder) == whole(spark, [rows, [(1, "a", 9.0)]])
