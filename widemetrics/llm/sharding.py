"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widemetrics.llm.common import fields, free_name, named, partitions, saved, text_of

#: Bytes of records a bucket should hold, a small part of a task's memory.
BUCKET_BYTES = 16 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is largest.

    Only key, seed and the number of shards count, and a further shard wins
    keys from the others without moving any between them.
    """
    named = F.coalesce(key.cast("string"), F.lit(""))
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(named, s, F.lit(seed)).alias("score"), s.alias("shard")),
    )
    return F.array_max(scores)["shard"]


def shuffled_shards(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Every row in a shard and at a place there, as after a shuffle of all rows.

    Pass one scatters rows by hash: the key decides the shard, and a seeded
    hash of the row the bucket within it; buckets are made for about
    bucket_bytes of records. Pass two shuffles each bucket in memory by Fisher
    and Yates, seeded by the bucket, from a defined order of its rows, so that
    a task run again places them alike. Slots count on through a shard's
    buckets without gaps.

    Adds size (UTF-8 bytes of the text, 0 for null, plus 16), shard, slot and
    grown_shard, the shard with one more of them; a clashing name gets a _
    behind. Null keys are hashed as empty and share a shard. Rows that agree in
    key and text are interchangeable.
    """
    size, shard, slot, grown = (
        free_name(docs, n) for n in ("size", "shard", "slot", "grown_shard")
    )
    placed = docs.select(
        F.struct(*named(docs.columns)).alias("row"),
        (F.octet_length(text_of(text)) + 16).cast("bigint").alias("size"),
        shard_of(F.col(key), shards, seed).alias("shard"),
        shard_of(F.col(key), shards + 1, seed).alias("grown"),
        # Of the row's content alone: the counts and the scatter below must agree on it.
        F.xxhash64(
            F.coalesce(F.col(key).cast("string"), F.lit("")), text_of(text), F.lit(seed + 1)
        ).alias("lot"),
    )
    # One row for each shard comes to the driver: how many bytes it holds.
    held = {
        r["shard"]: r["bytes"]
        for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    }
    per_shard = [max(1, -(-held.get(s, 0) // bucket_bytes)) for s in range(shards)]
    buckets = F.element_at(F.array(*[F.lit(n) for n in per_shard]), F.col("shard") + 1)
    placed = placed.withColumn("bucket", F.pmod(F.col("lot"), buckets).cast("int"))

    # Where each bucket's slots begin: as many rows as there are buckets, which stay in a table.
    earlier = Window.partitionBy("shard").orderBy("bucket")
    begins = saved(
        placed.groupBy("shard", "bucket")
        .count()
        .select("shard", "bucket", (F.sum("count").over(earlier) - F.col("count")).alias("begin")),
        "shard-begins",
    )

    names = docs.columns
    schema = fields(
        docs, (size, "bigint"), (shard, "int"), (slot, "bigint"), (grown, "int")
    )

    def fisher_yates(group: pa.Table) -> pa.Table:
        s, b = group.column("shard")[0].as_py(), group.column("bucket")[0].as_py()
        group = group.sort_by([("lot", "ascending")])
        seeded = hashlib.blake2b(f"{seed}|{s}|{b}".encode(), digest_size=16).digest()
        order = np.random.Generator(np.random.PCG64(int.from_bytes(seeded, "little"))).permutation(
            group.num_rows
        )
        group = group.take(pa.array(order))
        rows = pa.concat_tables([group]).combine_chunks().column("row").combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        begin = group.column("begin")[0].as_py() if group.num_rows else 0
        slots = pa.array(np.arange(group.num_rows, dtype=np.int64) + begin)
        return pa.table(
            [*rows.flatten(), group.column("size"), group.column("shard"), slots,
             group.column("grown")],
            names=[*names, size, shard, slot, grown],
        )

    # As many tasks as there are buckets of bytes, whatever the session's number of partitions.
    n = max(partitions(docs.sparkSession), sum(per_shard))
    spread = placed.repartition(n, "shard", "bucket")
    known = begins.repartition(n, "shard", "bucket").hint("merge")
    return spread.join(known, ["shard", "bucket"]).groupBy("shard", "bucket").applyInArrow(fisher_yates, schema)


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder of Parquet files for each shard, rows in order of their slots in each file."""
    sharded.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
