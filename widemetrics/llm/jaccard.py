"""Near duplicates: a Jaccard join of word n-gram sets in prefix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widemetrics.llm import exchange, golomb, trie, words
from widemetrics.llm.common import Blocks, discard, free_name, partitions, row_key, saved, saved_at
from widemetrics.llm.components import components
from widemetrics.llm.dedup import normal

#: N-grams of a block of documents, and documents in it, at most.
BLOCK_MEMBERS = 1 << 20
BLOCK_DOCS = (1 << 16) - 1

#: Sets, and members of them, that one task puts into a tree, about; larger families are
#: cut into blocks, and each pair of blocks is joined.
TREE_SETS = 512
TREE_MEMBERS = 1 << 20


def _sets_of(texts: list[str | None], n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sets of some texts at a time, and where these begin."""
    batch: list[bytes] = []
    held, first = 0, 0
    for i, t in enumerate(texts):
        batch.append(normal(t))
        held += len(batch[-1])
        if held >= words.CHUNK or i + 1 == len(texts):
            yield first, words.shingle_sets(batch, n)
            batch, held, first = [], 0, i + 1


def _union(schema: pa.Schema, count: int, **columns) -> pa.RecordBatch:
    """Rows with the given columns, all others null."""
    out = [columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(out, schema=schema)


class _Shortened:
    """A block's n-grams cut to fewer bits, with the document that alone has each in the block."""

    #: Stands for more than one document.
    MANY = BLOCK_DOCS

    def __init__(self, hash_bits: int, owner_bits: int):
        self._shift, self._owner_shift = np.uint64(64 - hash_bits), hash_bits - owner_bits
        self.clear()

    def clear(self) -> None:
        self._held: list[np.ndarray] = []
        self.members = 0

    def add(self, place: int, members: np.ndarray) -> None:
        self._held.append((members >> self._shift) << np.uint64(16) | np.uint64(place))
        self.members += len(members)

    def messages(self, block: int) -> Iterator[tuple]:
        """(owner, block, n, k, code, places) with distinct cut n-grams and their documents."""
        if not self.members:
            return
        both = np.sort(np.concatenate(self._held))
        values = both >> np.uint64(16)
        first = np.ones(len(values), bool)
        first[1:] = values[1:] != values[:-1]
        begins = np.flatnonzero(first)
        places = (both[begins] & np.uint64(0xFFFF)).astype("<u2")
        places[np.diff(np.append(begins, len(values))) > 1] = self.MANY
        values = values[begins]
        owners = (values >> np.uint64(self._owner_shift)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        for begin, end in zip(cuts, np.append(cuts[1:], len(values))):
            k, code = golomb.encoded(values[begin:end])
            yield int(owners[begin]), block, int(end - begin), k, code, places[begin:end].tobytes()


def _alone(received: pa.Table) -> pa.Table:
    """For each block the documents of n-grams that no other document has, one by one."""
    sent = exchange.lists(received)
    values = np.concatenate(sent)
    places = np.frombuffer(b"".join(received.column("places").to_pylist()), "<u2")
    source = np.repeat(np.arange(len(sent)), [len(x) for x in sent])
    order = np.argsort(values, kind="stable")
    v = values[order]
    single = np.ones(len(v), bool)
    single[1:] &= v[1:] != v[:-1]
    single[:-1] &= v[:-1] != v[1:]
    own = order[single]
    own = own[places[own] != _Shortened.MANY]
    parts = np.split(
        places[own[np.argsort(source[own], kind="stable")]],
        np.cumsum(np.bincount(source[own], minlength=len(sent)))[:-1],
    )
    listed = pa.array([_steps(np.sort(part)) for part in parts], pa.binary())
    return pa.table({"block": received.column("block"), "places": listed})


def _steps(places: np.ndarray) -> bytes:
    """Ascending numbers, repeated ones too, as steps of a byte; 255 goes on to the next byte."""
    steps = np.diff(places.astype(np.int64), prepend=0)
    ends = np.cumsum(steps // 255 + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = steps % 255
    return out.tobytes()


def _counted(codes: list[bytes], many: int) -> np.ndarray:
    """How often each number up to many was in the lists that _steps() coded."""
    out = np.zeros(many, np.int64)
    for code in codes:
        steps = np.frombuffer(code, np.uint8)
        out += np.bincount(np.cumsum(steps, dtype=np.int64)[steps != 255], minlength=many)
    return out


def near_duplicates(
    docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of docs: key, row_key, n_shingles, component_id and n_links.

    A document's set holds the distinct runs of n words (anything but blanks,
    A-Z lower-cased) of its whole text, or all its words as one if there are
    fewer. Two rows are linked when 100 |intersection| >= percent |union|.
    component_id is the least key that can be reached by links, itself
    included; n_links counts a row's links. A row without words, or with a null
    text, has n_shingles 0 and no links. Null keys are passed over as least
    key; a component of null keys alone has a null id. Equal rows are linked
    like any others.

    First blocks of documents send the owners of ranges of hashes their n-grams,
    cut to some forty bits; the owners count how many of each document's are its
    own alone. A document with more of those than the similarity leaves room for
    has no partner. The texts of the others are read once more. Their n-grams
    are counted exactly, and all sets ordered alike, from rare to frequent: two
    sets alike enough share one of their first (100 - percent) % members.
    Documents that do belong to a family. Each family's sets, equal ones once,
    are stored in a prefix tree and all searched at once; families of more than
    TREE_SETS are cut into blocks by hash and joined block by block. No link is
    lost on the way. Hashes of n-grams have 64 bits, those of sets 128.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[key]
    n_partitions = partitions(spark)
    read = docs.select(
        F.col(key).alias("id"), row_key(key, text).alias("row_key"), F.col(text).cast("string").alias("text")
    )
    # At most one n-gram for every second byte; in prose one for about six.
    volume = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = exchange.owner_bits(volume // 6, n_partitions)
    hash_bits = min(48, max(bits + 1, (volume // 6).bit_length() + 13))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and the messages of blocks of them."""
        block = TaskContext.get().partitionId() << 33
        cut, known, schema = _Shortened(hash_bits, bits), {}, None

        def send() -> Iterator[pa.RecordBatch]:
            sent = list(cut.messages(block))
            if sent:
                columns = dict(zip(("owner", "block", "m", "k", "code", "places"), zip(*sent)))
                arrays = {c: pa.array(v, schema.field(c).type) for c, v in columns.items()}
                yield _union(schema, len(sent), **arrays)
            cut.clear()
            known.clear()

        for batch in batches:
            schema = schema or pa.schema([("id", batch.column("id").type), *_DESCRIBED])
            for first, sets in _sets_of(batch.column("text").to_pylist(), n):
                digests, at, where = [], [], []
                for own in sets:
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                    if digest and digest not in known:
                        if known and (
                            cut.members + len(own) > BLOCK_MEMBERS or len(known) >= BLOCK_DOCS
                        ):
                            yield from send()
                            block += 1
                        known[digest] = len(known)
                        cut.add(known[digest], own)
                    digests.append(digest)
                    where.append(block)
                    at.append(known[digest] if digest else None)
                part = slice(first, first + len(sets))
                yield _union(
                    schema,
                    len(sets),
                    id=batch.column("id")[part],
                    row_key=batch.column("row_key")[part],
                    n=pa.array([len(s) for s in sets], pa.int64()),
                    set_key=pa.array(digests, pa.binary()),
                    block=pa.array(where, pa.int64()),
                    place=pa.array(at, pa.int64()),
                )
        yield from send()

    described, folder = saved_at(
        read.mapInArrow(
            describe,
            f"id {id_type}, row_key bigint, n bigint, set_key binary, block bigint, place bigint, "
            "owner bigint, m bigint, k bigint, code binary, places binary",
        ),
        "jaccard-described",
    )
    sent = described.filter("owner is not null")
    counts = (
        sent.select("owner", "block", F.col("m").alias("n"), "k", "code", "places")
        .groupBy("owner")
        .applyInArrow(_alone, "block bigint, places binary")
    )

    def partners_possible(rows: pa.Table, told: pa.Table) -> pa.Table:
        size, place = rows.column("n").to_numpy(), rows.column("place").fill_null(0).to_numpy()
        alone = _counted(told.column("places").to_pylist(), int(place.max(initial=0)) + 1)
        own = np.where(size > 0, alone[place], 0)
        possible = (size > 0) & (100 * (size - own) >= percent * size)
        return rows.drop_columns(["block", "place"]).append_column("possible", pa.array(possible))

    asked = described.filter("owner is null").select("id", "row_key", "n", "set_key", "block", "place")
    rows = saved(
        asked.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
            partners_possible,
            f"id {id_type}, row_key bigint, n bigint, set_key binary, possible boolean",
        ),
        "jaccard-rows",
    )
    discard(spark, folder)
    classes = saved(
        rows.filter("n > 0").groupBy("set_key", "n")
        .agg(
            F.min("id").alias("least"), F.count("*").alias("copies"),
            F.min("row_key").alias("row_key"), F.max("possible").alias("possible"),
        )
        .withColumn("class", F.monotonically_increasing_id()),
        "jaccard-classes",
    )

    # The sets of those that may have partners.
    def sets_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for batch in batches:
            for first, sets in _sets_of(batch.column("text").to_pylist(), n):
                part = slice(first, first + len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("class")[part],
                        pa.array([blocks.of(s.nbytes) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["class", "block", "members"],
                )

    texts = read.select("row_key", "text").join(
        classes.filter("possible").select("row_key", "class").hint("merge"), "row_key"
    )
    # Rows equal in key and text have one row_key.
    texts = texts.dropDuplicates(["class", "row_key"]).select("class", "text")
    held = saved(texts.mapInArrow(sets_again, "class bigint, block bigint, members binary"), "jaccard-sets")
    total = held.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    own_bits = exchange.owner_bits(total // 8, n_partitions)

    def members_of(group: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(m, "<u8") for m in group.column("members").to_pylist()]

    def count(group: pa.Table) -> pa.Table:
        found, times = np.unique(np.concatenate(members_of(group)), return_counts=True)
        return exchange.messages(group.column("block")[0].as_py(), found, own_bits, 0, times)

    def first_members(group: pa.Table, told: pa.Table) -> pa.Table:
        """What a block sends for its sets' rarest members, as far as others have them too."""
        if not group.num_rows:
            return exchange.messages(0, np.empty(0, np.uint64), own_bits)
        sets, ids = members_of(group), group.column("class").to_numpy()
        found = np.unique(np.concatenate(sets))
        held_by = exchange.numbers_of(found, told, own_bits)
        hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for own, who in zip(sets, ids):
            times = held_by[np.searchsorted(found, own)]
            many = len(own) - -(-percent * len(own) // 100) + 1
            rare = np.lexsort((own, times))[:many]
            rare = rare[times[rare] > 1]
            hashes.append(own[rare])
            owners.append(np.full(len(rare), who, np.int64))
        pairs, distinct, least = exchange.tied(np.concatenate(hashes), np.concatenate(owners))
        block = group.column("block")[0].as_py()
        out = exchange.messages(block, distinct, own_bits, 0, None, least)
        # Ties within the block go along as messages of one id to another, owned by nobody.
        own_ties = {
            "owner": pa.array([-1] * bool(len(pairs)), pa.int64()),
            "block": pa.array([block] * bool(len(pairs)), pa.int64()),
            "level": pa.array([1] * bool(len(pairs)), pa.int32()),
            "n": pa.array([len(pairs)] * bool(len(pairs)), pa.int64()),
            "k": pa.array([0] * bool(len(pairs)), pa.int64()),
            "code": pa.array([pairs.column("a").to_numpy().tobytes()] * bool(len(pairs)), pa.binary()),
            "checks": pa.array([b""] * bool(len(pairs)), pa.binary()),
            "ids": pa.array([pairs.column("b").to_numpy().tobytes()] * bool(len(pairs)), pa.binary()),
        }
        return pa.concat_tables([out, pa.table(own_ties, schema=out.schema)])

    def families_of(received: pa.Table) -> pa.Table:
        if received.column("owner")[0].as_py() >= 0:
            return exchange.ties(received)
        a, b = (np.frombuffer(b"".join(received.column(c).to_pylist()), "<i8") for c in ("code", "ids"))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    by_block = held.groupBy("block")
    counted = (
        by_block.applyInArrow(count, exchange.MESSAGE)
        .groupBy("owner").applyInArrow(exchange.totals, exchange.ANSWER)
    )
    meet = by_block.cogroup(counted.groupBy("block")).applyInArrow(first_members, exchange.MESSAGE)
    # Ties within blocks are spread, not owned together.
    meet = meet.withColumn(
        "turn", F.when(F.col("owner") < 0, F.pmod("block", F.lit(n_partitions))).otherwise(0)
    )
    pairs = saved(
        meet.groupBy("owner", "turn").applyInArrow(families_of, "a bigint, b bigint").distinct(),
        "jaccard-ties",
    )
    families = components(pairs).select(F.col("node").alias("class"), F.col("root").alias("family"))
    members = saved(
        classes.select("class", "copies", "n").join(families, "class"), "jaccard-members"
    )
    sizes = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / TREE_SETS), F.ceil(F.sum("n") / TREE_MEMBERS)).cast("int").alias("blocks")
    )
    placed = members.join(sizes, "family").select(
        "class", "copies", "family", "blocks", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("part")
    )
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j")),
    )
    paired = (
        held.select("class", "members").join(placed.hint("merge"), "class")
        .withColumn("pair", F.explode(pair))
        .select("family", "pair.i", "pair.j", "part", "class", "copies", "members")
    )

    def join(group: pa.Table) -> pa.Table:
        found, part = members_of(group), group.column("part").to_numpy()
        ids, copies = group.column("class").to_numpy(), group.column("copies").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left = np.flatnonzero(part == i)
        right = left if i == j else np.flatnonzero(part == j)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in trie.links(
            [found[x] for x in left], None if i == j else [found[x] for x in right], percent
        ):
            a, b = int(left[x]), int(right[y])
            links[a] += copies[b]
            links[b] += copies[a]
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        linked = np.flatnonzero(links)
        return pa.table(
            {
                "class": pa.array(ids[linked], pa.int64()),
                "other": pa.array(ids[[top(int(x)) for x in linked]], pa.int64()),
                "links": pa.array(links[linked], pa.int64()),
            }
        )

    linked = saved(
        paired.groupBy("family", "i", "j").applyInArrow(join, "class bigint, other bigint, links bigint"),
        "jaccard-links",
    )
    joined = components(linked.select(F.col("class").alias("a"), F.col("other").alias("b")))
    number = linked.groupBy("class").agg(F.sum("links").alias("links"))
    reached = classes.join(joined.withColumnRenamed("node", "class"), "class", "left").join(
        number, "class", "left"
    )
    reached = reached.withColumn("root", F.coalesce("root", "class"))
    leasts = reached.groupBy("root").agg(F.min("least").alias("component"))
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    by_set = reached.join(leasts, "root").select("set_key", "component", links)
    return rows.join(by_set, "set_key", "left").select(
        F.col("id").alias(key),
        "row_key",
        F.col("n").alias("n_shingles"),
        # A set of words has a component, if only a null one; a row without any is alone.
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are their component's least key, with docs' columns.

    Of rows that share that key one stays, the one with the least hash of key
    and text; a component without any key keeps one row that way too.
    """
    found = saved(near_duplicates(docs, n, percent, key, text), "jaccard-found")
    alone = F.col("n_links") == 0
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("row_key")))
    kept = found.filter(~alone).groupBy("component_id").agg(best.alias("best")).select("best.row_key")
    # Rows without links stay as they are; of the others, those that are not kept go.
    mark = free_name(docs, "row_key")
    odd = saved(
        found.filter(~alone).groupBy("row_key").agg(F.count("*").alias("times"))
        .join(kept.withColumn("stays", F.lit(True)), "row_key", "left"),
        "jaccard-odd",
    )
    odd = odd.filter("stays is null or times > 1").withColumnRenamed("row_key", mark)
    marked = docs.withColumn(mark, row_key(key, text))
    rest = marked.join(odd.hint("merge"), mark, "left_anti").drop(mark)
    repeated = odd.filter("stays").select(mark)
    if repeated.isEmpty():
        return rest
    once = marked.join(repeated.hint("merge"), mark, "left_semi").dropDuplicates([mark])
    return rest.unionByName(once.drop(mark))


_DESCRIBED = [
    ("row_key", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("block", pa.int64()),
    ("place", pa.int64()), ("owner", pa.int64()), ("m", pa.int64()), ("k", pa.int64()),
    ("code", pa.binary()), ("places", pa.binary()),
]
