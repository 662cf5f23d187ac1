"""How the sources of a language differ in their terms, ranked by cells of counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widemetrics.llm.common import saved

#: Terms are runs of letters A-Z, a-z and characters beyond ASCII: all other bytes end one.
_ENDS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_BLANKED = bytes.maketrans(_ENDS, b" " * len(_ENDS))

#: Bytes of a text that are cut into terms at a time.
SLICE = 1 << 20

#: Distinct terms a task counts before it passes them on.
HELD = 1 << 17

#: Rows of counts that one task compares all sources over, and sources of a tile.
SHARD_ROWS = 1 << 17
TILE = 128

#: Terms whose shares lie in memory for all sources of two tiles at once.
CHUNK_TERMS = 1 << 12

#: Added to every count, and what a share of one is.
SMOOTHING, SCALE = 5, 1_000_000_000


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text with A-Z lower-cased, slice by slice."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANKED)
    at = 0
    while len(data) - at > SLICE:
        cut = data.find(b" ", at + SLICE)
        if cut < 0:
            break
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, documents) in held.items():
            n = len(times)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array(list(times), pa.binary()).cast(pa.string()),
                    pa.array(times.values(), pa.int64()),
                    pa.array([documents[t] for t in times], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            times, documents = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for found in terms(text):
                times.update(found)
                own.update(found)
            documents.update(own)
        if sum(len(t) for t, _ in held.values()) > HELD:
            yield from passed_on()
    yield from passed_on()


def share(count: Column, size: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (size + 5 * kept)), exactly; NULL where nothing is kept."""
    top = (count.cast("decimal(19,0)") + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)")
    bottom = size.cast("decimal(19,0)") + kept.cast("decimal(18,0)") * SMOOTHING
    whole = F.call_function("div", top, F.nullif(bottom, F.lit(0).cast("decimal(25,0)")))
    return F.lit(1).cast("bigint") + whole


def shares(counts: np.ndarray, sizes: np.ndarray, kept: int) -> np.ndarray:
    """share() over arrays, by long division; all 0 where nothing is kept."""
    if not kept:
        return np.zeros(len(counts), np.int64)
    bottom, left = sizes + SMOOTHING * kept, counts + SMOOTHING
    if len(bottom) and bottom.max() >= 1 << 59:
        bottom, left = bottom.astype(object), left.astype(object)
    whole, left = left // bottom, left % bottom
    for _ in range(len(str(SCALE)) - 1):
        left = left * 10
        whole, left = whole * 10 + left // bottom, left % bottom
    return (whole + 1).astype(np.int64)


def _pair_sums(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms that occur here, for all pairs of a tile and another."""
    i, j = key[2].as_py(), key[3].as_py()
    sources = groups.column("source").to_pylist()
    place = {s: k for k, s in enumerate(sources)}
    sizes = groups.column("size").to_numpy().astype(np.int64)
    tile = groups.column("tile").to_numpy()
    kept = groups.column("kept")[0].as_py() if sources else 0
    none = shares(np.zeros(len(sources), np.int64), sizes, kept)

    encoded = rows.column("term").combine_chunks().dictionary_encode()
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    term = encoded.indices.to_numpy()
    own = np.array([place[s] for s in rows.column("source").to_pylist()], np.int64)
    p = shares(rows.column("n").to_numpy().astype(np.int64), sizes[own], kept)
    order = np.argsort(term, kind="stable")
    term, own, p = term[order], own[order], p[order]
    seen = len(encoded.dictionary)
    sums = np.zeros((len(sources), len(sources)), np.int64)
    for begin in range(0, seen, CHUNK_TERMS):
        end = min(begin + CHUNK_TERMS, seen)
        a, b = np.searchsorted(term, [begin, end])
        table = np.tile(none, (end - begin, 1))
        table[term[a:b] - begin, own[a:b]] = p[a:b]
        for s in range(len(sources)):
            sums[s] += np.abs(table - table[:, s : s + 1]).sum(axis=0)
    left, right = np.meshgrid(np.arange(len(sources)), np.arange(len(sources)), indexing="ij")
    asked = (left != right) & (
        ((tile[left] == i) & (tile[right] == j)) | ((tile[left] == j) & (tile[right] == i))
    )
    s, t = left[asked], right[asked]
    names = pa.array(sources, pa.string())
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(s), pa.string()),
            "source": names.take(pa.array(s)),
            "item": names.take(pa.array(t)),
            "part_sum": pa.array(sums[s, t], pa.int64()),
            "seen": pa.array(np.full(len(s), seen), pa.int64()),
            "apart": pa.array(np.abs(none[s] - none[t]), pa.int64()),
            "kept": pa.array(np.full(len(s), kept), pa.int64()),
        }
    )


def _tile_pairs(tiles: int) -> Column:
    """All pairs of tiles that a row's own is one of."""
    own = F.col("tile")
    return F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(tiles - 1)),
            lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")),
        )
    )


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, in both orders."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    tiles = -(-most // TILE)
    shards = -(-counts.count() // SHARD_ROWS) or 1
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int").alias("tile")
    pair = _tile_pairs(tiles).alias("pair")
    rows = counts.select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"), "term", "source", "n", tile
    ).select("lang", "shard", pair, "term", "source", "n")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1))).alias("shard")
    owners = groups.select("lang", "source", "size", "kept", tile, every).select(
        "lang", "shard", pair, "source", "size", "kept", "tile"
    )
    keys = ["lang", "shard", F.col("pair.i").alias("i"), F.col("pair.j").alias("j")]
    sums = rows.groupBy(*keys).cogroup(owners.groupBy(*keys)).applyInArrow(
        _pair_sums,
        "lang string, source string, item string, part_sum bigint, seen bigint, apart bigint, kept bigint",
    )
    # Terms that neither source has all add the same: what a count of none is apart.
    unseen = F.max("kept") - F.sum("seen")
    return sums.groupBy("lang", "source", "item").agg(
        (F.sum("part_sum") + unseen * F.max("apart")).alias("value")
    )


def _leading_terms(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value) of the terms that stand out most, the first `top` a group."""
    own = ["lang", "source"]
    cell = [*own, "n", "total"]
    p = share(F.col("n"), F.col("size"), F.col("kept"))
    q = share(F.col("total"), F.col("lang_size"), F.col("kept"))
    cells = (
        counts.groupBy(*cell)
        .agg(F.count("*").alias("times"))
        .join(groups, own)
        .select(*cell, "times", (p - q).alias("value"))
        .filter("value > 0")
    )
    # Every cell holds a term, so the first `top` values suffice, and of those the ones that
    # fewer than `top` terms come before.
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("value")))
    values = cells.groupBy(*own, "value").agg(F.sum("times").alias("times")).withColumn("at", rank)
    running = Window.partitionBy(*own).orderBy("at")
    before = F.sum("times").over(running) - F.col("times")
    values = values.filter(F.col("at") <= top).withColumn("before", before)
    chosen = cells.join(values.filter(F.col("before") < top).select(*own, "value"), [*own, "value"])
    # Of a cell, however many terms it holds, only the first `top` can count.
    first = F.row_number().over(Window.partitionBy(*cell).orderBy("term"))
    few = counts.withColumn("at", first).filter(F.col("at") <= top).drop("at")
    return few.join(chosen.select(*cell, "value"), cell).select(
        *own, F.col("term").alias("item"), "value"
    )


def divergence(
    docs: DataFrame,
    least: int = 30,
    top: int = 50,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """How each source of a language differs from the others and in which terms it stands out.

    Rows (lang, source, part, item, value, rank). A language keeps the terms
    that at least `least` of its documents hold. A term's share in a group is
    1 + floor(10**9 * (count + 5) / (N + 5 * V)), N being the group's count of
    kept terms and V their number; the language's own share is made alike.
    `pair`: item is another source of the language, value the sum of the
    differences of both shares over all kept terms. `term`: item is a term that
    occurs in the group with a larger share than in the language, value the
    difference; the first `top` of them. Both by falling value, equal ones in
    the order of the item's bytes.

    Null texts, languages and sources count as empty ones. A group without
    terms, or a language that keeps none, still has its pairs; without kept
    terms their value is 0. Equal rows count each; an empty table gives no row.
    Other columns are not read.

    Terms of a group are ranked by cells: those with the same count in the
    group and in the language share a value, so values are worked out once a
    cell and ranked with the number of its terms; only the cells that reach the
    first ranks are expanded. For pairs, terms are spread over tasks, each of
    which adds up all pairs of sources of two tiles over its own terms, of those
    that a source has; the others add the same each.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    read = docs.select(*named, F.col(text).cast("string").alias("text"))
    counted = read.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    counts = saved(
        counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "divergence-counts",
    )
    kept = saved(
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
        .filter(F.col("docs") >= least)
        .drop("docs"),
        "divergence-kept",
    )
    own = saved(counts.drop("docs").join(kept, ["lang", "term"]), "divergence-own")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = {"size": 0, "kept": 0, "lang_size": 0}
    groups = saved(
        read.select("lang", "source").distinct()
        .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(zero),
        "divergence-groups",
    )

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by_value)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = _pairs(own, groups).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    leading = _leading_terms(own, groups, top).withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.select(*columns).unionByName(leading.withColumn("part", F.lit("term")).select(*columns))
