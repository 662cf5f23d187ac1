"""Collocations from streams of phrase counts in prefix and suffix order."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from widemetrics.llm import exchange
from widemetrics.llm.common import partitions, saved
from widemetrics.llm.words import mixed

#: Bytes that end a piece of text.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECES = bytes.maketrans(_ENDS, b"\n" * len(_ENDS))

#: Words are runs of bytes other than these within a piece.
_WORD = re.compile(rb"[^\x20\x09]+")
_BLANK = re.compile(rb"[\x20\x09]")

#: Words of a block, of which the task's phrases are counted together.
BLOCK_WORDS = 1 << 20

#: Hashes of pairs an owner is to hold, about. A block has a message for each owner.
OWNED_PAIRS = 1 << 20

#: Phrases of a batch that leaves Python.
BATCH_PHRASES = 1 << 16

#: Bytes of a piece that are cut into words at a time.
SLICE = 1 << 20

#: Counted phrases that one task walks through.
STREAM_ROWS = 1 << 17

#: The code of the end of a piece, and its mark among words: a byte that no text in UTF-8 has.
_END = 0
_MARK = b"\xff"


class _Coded:
    """Words of one language as numbers in order, pieces apart."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_MARK] = _END
        self.codes: list[int] = []
        self.context: list[int] = []
        self.n = 0

    def add_whole(self, data: bytes) -> int:
        """All pieces of a text; gives the number of words."""
        data = data.rstrip(b"\n").replace(b"\n\n", b"\n")
        words = data.replace(b"\n", b" " + _MARK + b" ").split()
        n = len(words) - data.count(b"\n")
        if n:
            self.codes.extend(map(self.numbers.__getitem__, words))
            self.codes.append(_END)
            self.n += n
        return n

    def add(self, words: list[bytes], context: list[bytes]) -> None:
        """A run of words; those of context follow, but no phrase that begins there counts."""
        self.codes.extend(map(self.numbers.__getitem__, words))
        self.n += len(words)
        if context:
            begin = len(self.codes)
            self.codes.extend(map(self.numbers.__getitem__, context))
            self.context.extend(range(begin, len(self.codes)))
        self.codes.append(_END)


def _lowered(text: str | None) -> bytes:
    """A text with A-Z lower-cased and a line for each piece."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PIECES)


def runs(text: str | None, context: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The words of each piece of a text with A-Z lower-cased; a very long piece in several runs,
    each with the words that follow it."""
    return _runs(_lowered(text), context)


def _runs(data: bytes, context: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        while end - at > SLICE:
            cut = _BLANK.search(data, at + SLICE, end)
            if not cut:
                break
            after = [m.group() for m in islice(_WORD.finditer(data, cut.start(), end), context)]
            yield data[at : cut.start()].split(), after
            at = cut.start()
        words = data[at:end].split()
        if words:
            yield words, []
        at = end + 1


def _blocks(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to blocks (block, lang, words, codes, context, n) of numbered words, all but the
    first with a value for each language in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[str, _Coded] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            nonlocal number
            number += 1
            filled = {lang: own for lang, own in held.items() if len(own.numbers) > 1}
            if filled:
                rows = [
                    (lang, b"\n".join(own.numbers), np.array(own.codes, "<i4").tobytes(),
                     np.array(own.context, "<i4").tobytes(), own.n)
                    for lang, own in filled.items()
                ]
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), *(pa.array([c], pa.list_(t)) for c, t in zip(zip(*rows), kinds))],
                    names=["block", "lang", "words", "codes", "context", "n"],
                )
            held.clear()

        words = 0
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = _lowered(text)
                if len(data) <= SLICE:
                    if lang not in held:
                        held[lang] = _Coded()
                    words += held[lang].add_whole(data)
                    if words >= BLOCK_WORDS:
                        yield from passed_on()
                        words = 0
                    continue
                for run_words, after in _runs(data, longest - 1):
                    if lang not in held:
                        held[lang] = _Coded()
                    held[lang].add(run_words, after)
                    words += len(run_words)
                    if words >= BLOCK_WORDS:
                        yield from passed_on()
                        words = 0
        yield from passed_on()

    return run


class _Grams:
    """The words of a block, of all its languages, by numbers."""

    def __init__(self, group: pa.Table | pa.RecordBatch):
        self.block = group.column("block")[0].as_py()
        self.langs = group.column("lang")[0].as_py()
        self.words = [b""]
        sizes, codes, context, length = [1], [], [], 0
        for words, own, after in zip(*(group.column(c)[0].as_py() for c in ("words", "codes", "context"))):
            found, own = words.split(b"\n"), np.frombuffer(own, "<i4")
            codes.append(np.where(own == _END, _END, own + np.int32(len(self.words) - 1)))
            context.append(np.frombuffer(after, "<i4") + length)
            length += len(own)
            self.words += found[1:]
            sizes.append(len(found) - 1)
        self.codes = np.concatenate(codes)
        self.begins = self.codes != _END
        self.begins[np.concatenate(context)] = False
        #: The language of each word; that of the end of a piece does not matter.
        self.lang = np.repeat(np.maximum(np.arange(len(sizes)) - 1, 0), sizes)

    def levels(self, longest: int, answers: pa.Table | None, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 2 the places of phrases, and 64 bits of the language and the words
        of each: those that answers say are frequent or, without answers for the length, all whose
        first and last words but one are places of the length before."""
        step = np.uint64(0x9E3779B97F4A7C15)
        seeds = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.langs]
        of = map(seeds.__getitem__, self.lang.tolist())
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words, of), np.uint64, len(self.words))
        later = mixed(each)
        going = self.codes != _END
        at = np.flatnonzero(going[:-1])
        values = each[self.codes[at]]
        for length in range(2, longest + 1):
            keep = going[at] & going[at + 1]
            at = at[keep]
            values = mixed(values[keep] * step + later[self.codes[at + length - 1]])
            told = answers and answers.filter(pc.equal(answers.column("level"), length))
            if told:
                own, first = _numbered(values)
                frequent = exchange.heard(values[first], told, bits)[own]
                at, values = at[frequent], values[frequent]
            yield length, at, values
            going[:] = False
            going[at] = True

    def asked(self, level: int, answers: pa.Table | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of phrases of so many words, sorted, and how many of each begin here."""
        for _, at, values in self.levels(level, answers, bits):
            pass
        found, times = np.unique(values, return_counts=True)
        np.subtract.at(times, np.searchsorted(found, values[~self.begins[at]]), 1)
        return found, times


def _ask(bits: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks ask for their pairs of words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams = _Grams(batch.slice(i, 1))
                yield from exchange.counted(grams.block, *grams.asked(2, None, bits), bits, least).to_batches()

    return ask


def _ask_longer(bits: int, least: int, level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Blocks ask for their phrases of so many words whose shorter ones are frequent."""

    def ask(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return exchange.counted(0, np.empty(0, np.uint64), np.empty(0, np.int64), bits, least)
        grams = _Grams(group)
        return exchange.counted(grams.block, *grams.asked(level, answers, bits), bits, least)

    return ask


def _often(least: int, level: int) -> Callable[[pa.Table], pa.Table]:
    def answer(received: pa.Table) -> pa.Table:
        return exchange.often(received, least, level)

    return answer


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its number among the distinct ones in order, and a place of each of those."""
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=keys[order[:1]]) != 0
    new[:1] = True
    numbers = np.empty(len(keys), np.int64)
    numbers[order] = np.cumsum(new) - 1
    return numbers, order[new]


def _count(bits: int, longest: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's phrases and how often they begin there: all words, those longer phrases that are
    frequent, and the longest ones as far as both shorter by a word are."""

    def count(group: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
        if not group.num_rows:
            return schema.empty_table()
        grams = _Grams(group)
        codes = grams.codes
        words, langs = pa.array(grams.words, pa.binary()).cast(pa.string()), pa.array(grams.langs, pa.string())
        batches: list[pa.RecordBatch] = []

        def counted(code: np.ndarray, text: pa.Array, times: np.ndarray) -> None:
            """Phrases by their first words' codes."""
            lang = langs.take(pa.array(grams.lang[code]))
            table = pa.table([lang, text, pa.array(times, pa.int64())], schema=schema)
            batches.extend(table.to_batches(max_chunksize=BATCH_PHRASES))

        times = np.bincount(codes[grams.begins], minlength=len(grams.words))
        code = np.flatnonzero(times)
        counted(code, words.take(pa.array(code)), times[code])
        # level by level, by the words: the number of the phrase that begins at each place
        numbers = codes.astype(np.int64)
        for length, at, _ in grams.levels(longest, answers, bits):
            own, first = _numbered(numbers[at] * len(grams.words) + codes[at + length - 1])
            numbers[at] = own
            times = np.bincount(own[grams.begins[at]], minlength=len(first))
            place = at[first[times > 0]]
            text = words.take(pa.array(codes[place]))
            for k in range(1, length):
                text = pc.binary_join_element_wise(text, words.take(pa.array(codes[place + k])), " ")
            counted(codes[place], text, times[times > 0])
        return pa.Table.from_batches(batches, schema)

    return count


@contextmanager
def _batches_of(spark: SparkSession, most: str) -> Iterator[None]:
    """Arrow batches end at so many bytes meanwhile: a task's blocks go to Python one by one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def phrase_counts(docs: DataFrame, least: int, longest: int, lang: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of the phrases of up to `longest` words that occur at least `least` times
    in their language, and (lang, n) of all languages with words.

    Blocks first learn from the owners of hash ranges which pairs of words are
    frequent in all blocks together, and of the phrases made of such pairs which
    are frequent, up to one word less than the longest. Only those are counted,
    and longest ones whose shorter parts are among them, as no other can be
    frequent; those counts are exact, by the words themselves.
    """
    spark = docs.sparkSession
    read = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.col(text).cast("string").alias("text"),
    )
    blocks = saved(
        read.mapInArrow(
            _blocks(longest),
            "block bigint, lang array<string>, words array<binary>, codes array<binary>, "
            "context array<binary>, n array<bigint>",
        ),
        "phrase-blocks",
    )
    sizes = blocks.select(F.explode(F.arrays_zip("lang", "n")).alias("own")).groupBy("own.lang").agg(
        F.sum("own.n").alias("n")
    )
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = exchange.owner_bits(total // 2, partitions(spark), OWNED_PAIRS)
    coded = blocks.select("block", "lang", "words", "codes", "context")
    asking = coded.mapInArrow(_ask(bits, least), exchange.COUNTED)
    # saved, as blocks that ask do not go through a shuffle until then
    with _batches_of(spark, "4m"):
        answers = saved(asking.groupBy("owner").applyInArrow(_often(least, 2), exchange.ANSWER), "phrase-answers")
    by_block = coded.groupBy("block")
    for level in range(3, longest):
        asking = by_block.cogroup(answers.groupBy("block")).applyInArrow(
            _ask_longer(bits, least, level), exchange.COUNTED
        )
        told = asking.groupBy("owner").applyInArrow(_often(least, level), exchange.ANSWER)
        answers = answers.unionByName(told)
    found = by_block.cogroup(answers.groupBy("block")).applyInArrow(
        _count(bits, longest), "lang string, phrase string, n bigint"
    )
    counts = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return saved(counts, "phrase-counts"), sizes


_WALKED = (
    "lang string, words array<string>, f bigint, heads array<bigint>, extended bigint, stream int"
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In order, each phrase after its beginnings and before the next that does not begin with it.

    Gives each phrase the counts of its beginnings and the largest count of
    those one word longer. Where this part of the stream begins within the
    phrases of an earlier one, the beginnings not seen here have f null.
    """
    stream = TaskContext.get().partitionId()
    path: list[list] = []
    now = None
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(path) > depth:
            word, f, best = path.pop()
            out.append((now, [*(p[0] for p in path), word], f, [p[1] for p in path], best, stream))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32()]
        names = ["lang", "words", "f", "heads", "extended", "stream"]
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        for lang, words, f in zip(*(c.to_pylist() for c in batch.columns)):
            same = 0
            if lang == now:
                while same < min(len(path), len(words) - 1) and path[same][0] == words[same]:
                    same += 1
            close(same)
            now = lang
            for word in words[len(path) : -1]:
                path.append([word, None, 0])
            if path:
                path[-1][2] = max(path[-1][2], f)
            path.append([words[-1], f, 0])
        yield batch_of(out)
        out.clear()
    close(0)
    yield batch_of(out)


def in_lockstep(counts: DataFrame, backwards: bool = False) -> DataFrame:
    """(lang, phrase, f, heads, extended) of counted phrases, of which every beginning must be one.

    heads are the counts of the phrase's first word, first two words and so on,
    extended the largest count of a phrase that goes on by one word; 0 if none
    does. With `backwards` the same from the phrase's end: last word, last two
    words, one more word ahead.

    The stream lies sorted over all tasks, cut by range, so that phrases that
    begin with one common word spread over as many as they fill. What a part
    lacks of the phrases it begins in, three rows at most for four words, is
    handed on afterwards.
    """
    words = F.split("phrase", " ", -1)
    stream = counts.select("lang", (F.reverse(words) if backwards else words).alias("words"), "f")
    parts = max(partitions(counts.sparkSession), -(-counts.count() // STREAM_ROWS))
    ordered = stream.repartitionByRange(parts, "lang", "words").sortWithinPartitions("lang", "words")
    walked = saved(ordered.mapInArrow(_walk, _WALKED), "phrase-streams")
    seen = walked.filter("f is not null")
    lost = walked.filter("f is null").select("lang", "words", "extended", "stream")
    told = (
        lost.join(seen.select("lang", "words", "f"), ["lang", "words"])
        .groupBy("stream")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.size("words"), "f"))).alias("told"))
    )
    later = lost.groupBy("lang", "words").agg(F.max("extended").alias("later"))
    heads = F.transform("heads", lambda h, i: F.coalesce(h, F.element_at("told", i + 1)))
    phrase = F.array_join(F.reverse("words") if backwards else F.col("words"), " ")
    return (
        seen.join(told, "stream", "left")
        .join(later, ["lang", "words"], "left")
        .select(
            "lang", phrase.alias("phrase"), "f", heads.alias("heads"),
            F.greatest("extended", "later").alias("extended"),
        )
    )


def collocations(
    docs: DataFrame,
    least: int = 30,
    longest: int = 4,
    covered_percent: int = 80,
    scale: int = 2_000_000,
    top: int | None = None,
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of 2 to `longest` words that stand together,
    and rank where only the first `top` of each language are asked for.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and
    those into words at spaces and tabs. a is how often the phrase occurs in
    pieces of its language, `least` times or more. Cut after its first words, l
    and r are the counts of both parts and the score is floor(scale * a /
    (l + r)); the cut with the least counts, the first of equal ones. n is the
    number of words in the language. A phrase within a longer one that occurs
    at least covered_percent as often is left out; as the counts of longer
    phrases fall, one word more on either side decides that. Ranks go by score,
    then a, both falling, then the phrase's bytes.

    A null lang is `und`, a null or blank text has no words, equal rows count
    each, and an empty table gives no row. Other columns are not read.

    Phrases are kept as two sorted streams, one in the order of their words from
    the front and one from the back. In the first, a phrase's beginnings come
    just before it and its extensions to the right just after; in the second,
    its ends and the extensions to the left. So a walk along each gives all
    counts, and both meet in a merge join.
    """
    counts, sizes = phrase_counts(docs, least, longest, lang, text)
    front = in_lockstep(counts)
    back = in_lockstep(counts, backwards=True).select(
        "lang", "phrase", F.col("heads").alias("tails"), F.col("extended").alias("ahead")
    )
    whole = "decimal(20,0)"

    def cut(k):
        l, r = F.get("heads", k - 1), F.get("tails", F.size("heads") - k)
        score = F.call_function(
            "div", F.col("f").cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)"), l.cast(whole) + r.cast(whole)
        )
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    longer = F.greatest("extended", "ahead").cast(whole) * 100
    lowest = F.array_min(F.transform(F.sequence(F.lit(1), F.size("heads")), cut))
    both = front.filter(F.size("heads") > 0).hint("merge").join(back, ["lang", "phrase"])
    kept = both.filter(longer < F.col("f").cast(whole) * covered_percent).withColumn("cut", lowest)
    kept = kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    columns = ["lang", "phrase", "a", "l", "r", "n", "score"]
    if top is not None:
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        kept = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        columns.append("rank")
    return kept.join(sizes, "lang").select(*columns)
