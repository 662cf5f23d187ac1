"""Removal of passages that an earlier document has, by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widemetrics.llm import exchange, words
from widemetrics.llm.common import Blocks, named, partitions, row_key, saved

#: The second, independent hash of a window.
_CHECK = 0x5851F42D4C957F2D

_CANDIDATE, _REPEATED = 0, 1


def levels(length: int) -> list[int]:
    """The window lengths: from about a quarter of length on, each at most twice the one before."""
    out = [length]
    while len(out) < 3 and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _utf8(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _batches(values: list[bytes], most: int = words.CHUNK) -> Iterator[slice]:
    begin, held = 0, 0
    for i, v in enumerate(values):
        held += len(v)
        if held >= most or i + 1 == len(values):
            yield slice(begin, i + 1)
            begin, held = i + 1, 0


class _Windows:
    """All windows of `length` words within some texts, each with the sub-window that stands
    for it at a shorter length: of those inside it, the one with the least hash."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.hashes, self.offsets = words.hashed(texts)
        self.starts, self.text = words.starts_within(self.offsets, length)

    def stand_ins(self, short: int) -> np.ndarray:
        """For each window the hash of its sub-window of `short` words."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        sub = words.windows(self.hashes, short)
        return sub[words.least_in(sub, self.length - short + 1)[self.starts]]

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits of each window and 32 more."""
        if not len(self.starts):
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        more = words.windows(self.hashes, self.length, _CHECK)[self.starts]
        return words.windows(self.hashes, self.length)[self.starts], (more >> np.uint64(32)).astype(np.uint32)


def _sets(values: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct values of each of n texts."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[new], t[new]
    return np.split(v, np.searchsorted(t, np.arange(1, n)))


def _matrix(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u8") for b in column.to_pylist()]


def _distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of a block's rows, and whether several rows hold each."""
    found, times = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
    return found, times > 1


def repeated_words(
    docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of docs: key, row_key (a hash of key and text), n_words, removed,
    n_removed and kept_sha256.

    removed are the spans of words, from start up to but not end, that go.

    Words are runs of anything but blanks (space and 0x09-0x0D), unchanged. A
    window is `length` consecutive words of one document; each word goes that
    lies in a window whose words also start somewhere in a document with a
    smaller key. All windows are judged on the input. kept_sha256 is that of the
    kept words joined by one space. Null texts have no words; texts shorter than
    a window lose none. A row with a null key neither loses words nor makes
    others lose any; rows that share a key count as one document. Keys are
    whole numbers.

    Level by level a window can repeat only if the shorter ones inside it do,
    so at a quarter of the length one sub-window of each window is looked up,
    the one with the least hash, which is the same wherever the window occurs.
    Where it occurs in no other row, the window is done. The others go on to
    half the length and then to the full one, where every remaining window is
    compared by 96 bits. Lookups go between blocks of rows and owners of hash
    ranges; a passage that very many documents share is one entry a block.
    Texts are shuffled once to the rows with candidates, and those rows twice.
    """
    spark = docs.sparkSession
    short, half, full = levels(length) if length > 3 else [length] * 3
    n_partitions = partitions(spark)
    id_type = dict(docs.dtypes)[key]

    read = docs.select(
        F.col(key).alias("id"), row_key(key, text).alias("row_key"), F.col(text).cast("string").alias("text")
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for batch in batches:
            data = _utf8(batch.column("text").to_pylist())
            for part in _batches(data):
                own = data[part]
                w = _Windows(own, full)
                sets = _sets(w.stand_ins(short), w.text, len(own))
                split = [t.split() for t in own]
                at = pa.array(range(part.start, part.stop))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(at),
                        batch.column("row_key").take(at),
                        pa.array([blocks.of(s.nbytes) for s in sets], pa.int64()),
                        pa.array([len(s) for s in split], pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(s)).hexdigest() for s in split]),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["id", "row_key", "block", "n_words", "sha", "hashes"],
                )

    rows = saved(
        read.mapInArrow(
            first,
            f"id {id_type}, row_key bigint, block bigint, n_words bigint, sha string, hashes binary",
        ),
        "repeats-rows",
    )

    # A quarter of the length: which rows have a sub-window that another row has too.
    total = rows.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    bits = exchange.owner_bits(total // 8, n_partitions)
    asking = rows.filter("id is not null and octet_length(hashes) > 0").select("row_key", "block", "hashes")

    def ask(group: pa.Table) -> pa.Table:
        found, _ = _distinct(_matrix(group.column("hashes")))
        return exchange.messages(group.column("block")[0].as_py(), found, bits)

    def keep_shared(group: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _matrix(group.column("hashes"))
        found, several = _distinct(sets)
        shared = found[several | exchange.bits_of(found, answers, bits)]
        left = [s[np.isin(s, shared, assume_unique=True)] for s in sets]
        return pa.table(
            {
                "row_key": group.column("row_key"),
                "hashes": pa.array([x.tobytes() for x in left], pa.binary()),
            }
        )

    answers = (
        asking.groupBy("block").applyInArrow(ask, exchange.MESSAGE)
        .groupBy("owner").applyInArrow(exchange.occurs_elsewhere, exchange.ANSWER)
    )
    candidates = saved(
        asking.groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(keep_shared, "row_key bigint, hashes binary")
        .filter("octet_length(hashes) > 0"),
        "repeats-candidates",
    )

    # Half the length, in the windows that are left of the rows that are left.
    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for batch in batches:
            data = _utf8(batch.column("text").to_pylist())
            known = _matrix(batch.column("hashes"))
            for part in _batches(data):
                own = data[part]
                w = _Windows(own, full)
                alive = _held(w.stand_ins(short), w.text, known[part])
                sets = _sets(w.stand_ins(half)[alive], w.text[alive], len(own))
                at = pa.array(range(part.start, part.stop))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(at),
                        batch.column("row_key").take(at),
                        pa.array([blocks.of(len(t) + s.nbytes) for t, s in zip(own, sets)], pa.int64()),
                        batch.column("text").take(at),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["id", "row_key", "block", "text", "hashes"],
                )

    joined = read.join(candidates.dropDuplicates(["row_key"]).hint("merge"), "row_key")
    # Rows equal in key and text fare alike: one of them is worked on.
    joined = joined.dropDuplicates(["row_key"]).select("id", "row_key", "text", "hashes")
    held = saved(
        joined.mapInArrow(
            second, f"id {id_type}, row_key bigint, block bigint, text string, hashes binary"
        ),
        "repeats-texts",
    )
    total_half = held.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    bits_half = exchange.owner_bits(total_half // 8, n_partitions)

    def ask_half(group: pa.Table) -> pa.Table:
        found, _ = _distinct(_matrix(group.column("hashes")))
        return exchange.messages(group.column("block")[0].as_py(), found, bits_half)

    answers_half = saved(
        held.select("block", "hashes").groupBy("block").applyInArrow(ask_half, exchange.MESSAGE)
        .groupBy("owner").applyInArrow(exchange.occurs_elsewhere, exchange.ANSWER),
        "repeats-answers",
    )

    # The full length: the least key that each window left in a block has there, and elsewhere.
    bits_full = exchange.owner_bits(4 * total_half // 8, n_partitions)

    def remaining(group: pa.Table, told: pa.Table) -> tuple:
        """The block's candidate windows: their hashes, checks, row, start and offsets of rows."""
        sets = _matrix(group.column("hashes"))
        found, several = _distinct(sets)
        shared = found[several | exchange.bits_of(found, told, bits_half, _CANDIDATE)]
        data = _utf8(group.column("text").to_pylist())
        hashes, checks, row, start = [], [], [], []
        for part in _batches(data):
            w = _Windows(data[part], full)
            alive = np.flatnonzero(np.isin(w.stand_ins(half), shared))
            h, c = w.full()
            hashes.append(h[alive])
            checks.append(c[alive])
            row.append(w.text[alive] + part.start)
            start.append(w.starts[alive] - w.offsets[w.text[alive]])
        return data, *(np.concatenate(x or [np.empty(0, np.int64)]) for x in (hashes, checks, row, start))

    def least_ids(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple:
        """Distinct windows in order of hash, with the least id, and which one each window is."""
        order = np.lexsort((ids, checks, hashes))
        h, c = hashes[order], checks[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        return h[new], c[new], ids[order][new], which

    def ask_full(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return exchange.messages(0, np.empty(0, np.uint64), bits_full)
        _, hashes, checks, row, _ = remaining(group, told)
        ids = group.column("id").to_numpy()[row] if len(row) else np.empty(0, np.int64)
        h, c, least, _ = least_ids(hashes, checks, ids)
        # Two windows of one hash but different checks must not share a place in the code.
        one = np.ones(len(h), bool)
        one[1:] = h[1:] != h[:-1]
        return exchange.messages(
            group.column("block")[0].as_py(), h[one], bits_full, _REPEATED, c[one], least[one]
        )

    by_block = held.groupBy("block")
    answers_full = (
        by_block.cogroup(answers_half.groupBy("block")).applyInArrow(ask_full, exchange.MESSAGE)
        .groupBy("owner").applyInArrow(exchange.smaller_elsewhere, exchange.ANSWER)
    )

    def remove(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], f.type) for f in _REMOVED], schema=_REMOVED)
        data, hashes, checks, row, start = remaining(group, told)
        ids = group.column("id").to_numpy()[row] if len(row) else np.empty(0, np.int64)
        h, c, least, which = least_ids(hashes, checks, ids)
        one = np.ones(len(h), bool)
        one[1:] = h[1:] != h[:-1]
        smaller = np.zeros(len(h), bool)
        smaller[one] = exchange.bits_of(h[one], told, bits_full, _REPEATED)
        gone = (least[which] < ids) | smaller[which]
        begins, row = start[gone], row[gone]
        out = []
        for i in np.unique(row):
            split = data[i].split()
            edge = np.zeros(len(split) + 1, np.int64)
            own = begins[np.searchsorted(row, i) : np.searchsorted(row, i, "right")]
            np.add.at(edge, own, 1)
            np.add.at(edge, own + full, -1)
            stay = np.cumsum(edge[:-1]) == 0
            left = b" ".join(x for x, s in zip(split, stay) if s)
            turns = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]])))
            spans = [{"start": int(x), "end": int(y)} for x, y in turns.reshape(-1, 2)]
            digest = hashlib.sha256(left).hexdigest()
            out.append((group.column("row_key")[int(i)].as_py(), spans, int((~stay).sum()), digest))
        columns = list(zip(*out)) or [[]] * len(_REMOVED)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _REMOVED)], schema=_REMOVED)

    told = answers_half.unionByName(answers_full)
    removed = saved(
        by_block.cogroup(told.groupBy("block")).applyInArrow(
            remove, f"row_key bigint, spans {SPANS}, n_removed bigint, kept_sha string"
        ),
        "repeats-removed",
    )
    none = F.array().cast(SPANS)
    return rows.select("id", "row_key", "n_words", "sha").join(removed, "row_key", "left").select(
        F.col("id").alias(key),
        "row_key",
        "n_words",
        F.coalesce("spans", none).alias("removed"),
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
    )


def kept_text(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the words that repeated_words() names taken out of the text.

    Texts that lose words become the others joined by one space; all else stays
    as it is. The texts are joined to the spans by a hash of key and text.
    """
    names = docs.columns
    spans = found.filter("n_removed > 0").select("row_key", "removed").dropDuplicates(["row_key"])
    joined = docs.select(F.struct(*named(names)).alias("row"), row_key(key, text).alias("row_key")).join(
        spans, "row_key", "left"
    )
    split = F.filter(F.split(F.col(f"row.{text}"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    stays = F.filter(
        split,
        lambda w, i: ~F.exists("removed", lambda s: (s["start"] <= i) & (i < s["end"])),
    )
    new = F.when(F.col("removed").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(stays, " "))
    return joined.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in names])


SPANS = "array<struct<start: int, end: int>>"

_REMOVED = pa.schema(
    [
        ("row_key", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("n_removed", pa.int64()),
        ("kept_sha", pa.string()),
    ]
)


def _held(values: np.ndarray, text: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of the values lie in the sorted set of their text."""
    out = np.zeros(len(values), bool)
    bounds = np.searchsorted(text, np.arange(len(sets) + 1))
    for i, own in enumerate(sets):
        part = slice(bounds[i], bounds[i + 1])
        out[part] = np.isin(values[part], own)
    return out
