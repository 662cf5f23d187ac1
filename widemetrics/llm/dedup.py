"""Exact duplicates by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widemetrics.llm import golomb
from widemetrics.llm.common import free_name, partitions, row_key, saved

#: Rows whose fingerprints one message table holds: a power of two.
BLOCK_BITS = 18

#: Tasks that the copies of one text are spread over before they are counted in one.
SALTS = 16

#: Fingerprints an owner is to hold, about.
OWNER_ROWS = 1 << 19


def normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, uid, row_key, fp, sha) of each row; uid numbers the rows of this table for good."""
    read = docs.select(
        F.col(key).alias("id"),
        F.monotonically_increasing_id().alias("uid"),
        row_key(key, text).alias("row_key"),
        F.col(text).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([fingerprint(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                ],
                names=["id", "uid", "row_key", "fp", "sha"],
            )

    schema = read.drop("text").withColumns({"fp": F.lit(0).cast("bigint"), "sha": F.lit(b"")}).schema
    return saved(read.mapInArrow(run, schema), "dedup-fingerprints")


def _unsigned(values: pa.ChunkedArray) -> np.ndarray:
    return values.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _by_owner(fps: np.ndarray, owner_bits: int) -> list[tuple[int, np.ndarray]]:
    """The sorted distinct fingerprints, cut where the owner, their first bits, changes."""
    if not owner_bits:
        return [(0, fps)]
    owners = (fps >> np.uint64(64 - owner_bits)).astype(np.int64)
    begins = np.flatnonzero(np.diff(owners, prepend=-1))
    return [(int(owners[b]), part) for b, part in zip(begins, np.split(fps, begins[1:]))]


def suspects(marked: DataFrame) -> DataFrame:
    """marked with suspect: whether the fingerprint occurs on another row too.

    Blocks of rows send each owner of a range of fingerprints theirs, sorted,
    distinct and Golomb-coded; the owner tells each block by a bitmap which of
    them another block has sent as well. So a fingerprint goes over the wire at
    most once a block, however many rows share it, and what comes back is one
    bit. A block knows by itself which occur in it more than once.
    """
    spark = marked.sparkSession
    n = marked.count()
    owner_bits = (max(partitions(spark), n // OWNER_ROWS) - 1).bit_length()
    blocks = marked.withColumn("block", F.shiftright("uid", BLOCK_BITS))

    def send(rows: pa.Table) -> pa.Table:
        fps = np.unique(_unsigned(rows.column("fp")))
        block = rows.column("block")[0].as_py()
        sent = [(o, len(part), *golomb.encoded(part)) for o, part in _by_owner(fps, owner_bits)]
        return pa.table(
            {
                "owner": pa.array([s[0] for s in sent], pa.int64()),
                "block": pa.array([block] * len(sent), pa.int64()),
                "n": pa.array([s[1] for s in sent], pa.int64()),
                "k": pa.array([s[2] for s in sent], pa.int64()),
                "code": pa.array([s[3] for s in sent], pa.binary()),
            }
        )

    def answer(messages: pa.Table) -> pa.Table:
        lists = [
            golomb.decoded(*m)
            for m in zip(*(messages.column(c).to_pylist() for c in ("n", "k", "code")))
        ]
        seen, times = np.unique(np.concatenate(lists), return_counts=True)
        twice = times > 1
        bitmaps = [np.packbits(twice[np.searchsorted(seen, fps)]).tobytes() for fps in lists]
        return pa.table(
            {
                "owner": messages.column("owner"),
                "block": messages.column("block"),
                "bitmap": pa.array(bitmaps, pa.binary()),
            }
        )

    def flag(rows: pa.Table, answers: pa.Table) -> pa.Table:
        all_fps = _unsigned(rows.column("fp"))
        fps, times = np.unique(all_fps, return_counts=True)
        told = dict(zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist()))
        elsewhere = [
            np.unpackbits(np.frombuffer(told[o], np.uint8))[: len(part)]
            for o, part in _by_owner(fps, owner_bits)
        ]
        bad = (times > 1) | np.concatenate(elsewhere).astype(bool)
        flags = pa.array(bad[np.searchsorted(fps, all_fps)], pa.bool_())
        return rows.drop_columns(["block"]).append_column("suspect", flags)

    messages = blocks.select("block", "fp").groupBy("block").applyInArrow(
        send, "owner bigint, block bigint, n bigint, k bigint, code binary"
    )
    answers = messages.groupBy("owner").applyInArrow(
        answer, "owner bigint, block bigint, bitmap binary"
    )
    schema = marked.withColumn("suspect", F.lit(True)).schema
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(flag, schema)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, row_key, sha (of the normalised text), keep_id,
    group_size and kept.

    Texts are equal when they agree byte by byte once A-Z are lower-cased; null
    counts as empty. Of each group the row with the largest id is kept; of
    several with that id just one, and a null id is below any other. Where all
    ids are null, keep_id is null and one row is kept.

    Rows whose fingerprint is theirs alone are done. The texts of the others
    are read once more and grouped by their bytes. Equal texts of a batch are
    counted together before the shuffle and go to one of SALTS tasks, so that a
    text that a third of all rows share is sent once a batch, to many tasks, and
    from those once each.
    """
    marked = _marked(docs, key, text)
    flagged = saved(suspects(marked), "dedup-suspects")
    shared = saved(flagged.filter("suspect").select("fp").distinct(), "dedup-shared")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId()
        for batch in batches:
            texts = Counter(normal(t) for t in batch.column(0).to_pylist())
            salt += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([fingerprint(t) for t in texts], pa.int64()),
                    pa.array([salt % SALTS] * len(texts), pa.int32()),
                    pa.array(texts.keys(), pa.binary()),
                    pa.array(texts.values(), pa.int64()),
                ],
                names=["fp", "salt", "bytes", "n"],
            )

    again = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(
        bytes_of, "fp bigint, salt int, bytes binary, n bigint"
    )
    salted = shared.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    # Copies are counted by their bytes; the sum of the bytes' hash names the group further on.
    verified = (
        again.join(salted.hint("merge"), ["fp", "salt"], "left_semi")
        .groupBy("fp", "bytes")
        .agg(F.sum("n").alias("group_size"))
        .select("fp", F.unhex(F.sha2("bytes", 256)).alias("sha"), "group_size")
    )
    keepers = flagged.filter("suspect").groupBy("fp", "sha").agg(
        F.max(F.struct("id", "uid")).alias("keep")
    )
    groups = saved(verified.join(keepers, ["fp", "sha"]), "dedup-groups")
    found = flagged.filter("suspect").join(groups, ["fp", "sha"], "left")
    return (
        flagged.filter("not suspect")
        .select(
            "id", "row_key", "sha", F.col("id").alias("keep_id"),
            F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        )
        .unionByName(
            found.select(
                "id", "row_key", "sha", F.col("keep.id").alias("keep_id"), "group_size",
                (F.col("uid") == F.col("keep.uid")).alias("kept"),
            )
        )
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_groups() keeps, with docs' columns.

    Rows that agree in id and text are one document to it; of them one stays,
    whichever, where other columns differ.
    """
    groups = saved(exact_groups(docs, key, text).select("row_key", "kept"), "dedup-kept")
    # Rows that share id and text share a row_key: several, of which one may be kept.
    keys = groups.groupBy("row_key").agg(
        F.max("kept").alias("kept"), F.count("*").alias("times")
    )
    mark = free_name(docs, "row_key")
    odd = saved(keys.filter("not kept or times > 1"), "dedup-odd").withColumnRenamed("row_key", mark)
    named = docs.withColumn(mark, row_key(key, text))
    rest = named.join(odd.hint("merge"), mark, "left_anti").drop(mark)
    repeated = odd.filter("kept").select(mark)
    if repeated.isEmpty():
        return rest
    once = named.join(repeated.hint("merge"), mark, "left_semi").dropDuplicates([mark])
    return rest.unionByName(once.drop(mark))
