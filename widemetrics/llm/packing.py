"""Packing examples into sequences by vector bin packing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widemetrics.llm.common import fields, free_name, named
from widemetrics.llm.tokens import encoder

#: Tokens waiting for a place in a task before bins are filled from them.
POOL_TOKENS = 1 << 18

#: Rows tokenized at once, and pieces held back until they make a batch.
ENCODED_ROWS = 1000
FLUSHED_PIECES = 2000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at once; tokens is to be a power of two."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass
class Piece:
    """Ids of one example from start on; loss marks those that bear loss (None: all)."""

    example: int
    start: int
    ids: np.ndarray
    loss: np.ndarray | None

    def loss_tokens(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.example, self.start, self.ids[:at], None if self.loss is None else self.loss[:at]),
            Piece(
                self.example, self.start + at, self.ids[at:], None if self.loss is None else self.loss[at:]
            ),
        )

    def longest(self, tokens: int, loss: int) -> int:
        """How many of its first ids keep to both limits."""
        if self.loss is None:
            return min(len(self.ids), tokens, loss)
        return min(tokens, int(np.searchsorted(np.cumsum(self.loss), loss, "right")), len(self.ids))


class Packer:
    """Bins filled by the dot-product rule, from a pool of pieces.

    The piece placed next is, among those that keep to all limits, the one
    whose demand (tokens, segments, loss-bearing tokens, each over its limit)
    has the largest dot product with what the bin has left. If none fits whole,
    the one with the largest product is cut so that it does. A bin that cannot
    be filled, as other limits bind or no pieces are left, gives back what lies
    above a power of two, where a sequence needs no padding.
    """

    def __init__(self, limits: Limits):
        if limits.tokens & (limits.tokens - 1):
            raise ValueError("the limit of tokens is to be a power of two")
        self._limits = limits
        self._pool: list[Piece] = []
        self._tokens = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        if not len(piece.ids):
            return
        full = self._limits.tokens
        while len(piece.ids) >= full and piece.longest(full, self._limits.loss_tokens) == full:
            head, piece = piece.cut(full)
            yield [head]
        self._put(piece)
        if self._tokens >= POOL_TOKENS:
            # The last bins wait, to have more to choose from.
            yield from self._fill(POOL_TOKENS // 4)

    def close(self) -> Iterator[list[Piece]]:
        yield from self._fill(0)

    def _put(self, piece: Piece) -> None:
        if len(piece.ids):
            self._pool.append(piece)
            self._tokens += len(piece.ids)

    def _fill(self, leave: int) -> Iterator[list[Piece]]:
        limits = np.array(
            [self._limits.tokens, self._limits.segments, self._limits.loss_tokens], np.float64
        )
        while self._tokens > leave:
            pool, self._pool, self._tokens = self._pool, [], 0
            demand = np.array([[len(p.ids), 1, p.loss_tokens()] for p in pool], np.float64)
            free = np.ones(len(pool), bool)
            waiting = float(demand[:, 0].sum())
            while waiting > leave and free.any():
                bin_: list[Piece] = []
                left = limits.copy()
                while left[0] >= 1 and left[1] >= 1 and free.any():
                    value = demand @ (left / limits**2)
                    value[~free] = -1
                    fits = free & (demand <= left).all(axis=1)
                    if fits.any():
                        i = int(np.argmax(np.where(fits, value, -1)))
                        bin_.append(pool[i])
                        left -= demand[i]
                        waiting -= demand[i, 0]
                        free[i] = False
                        continue
                    i = int(np.argmax(value))
                    n = pool[i].longest(int(left[0]), int(left[2]))
                    if not n:
                        break
                    head, pool[i] = pool[i].cut(n)
                    bin_.append(head)
                    left -= [n, 1, head.loss_tokens()]
                    waiting -= n
                    demand[i] = [len(pool[i].ids), 1, pool[i].loss_tokens()]
                kept, back = self._level(bin_)
                for p in back:
                    self._put(p)
                if kept:
                    yield kept
                else:
                    break
            for i in np.flatnonzero(free):
                self._put(pool[i])

    @staticmethod
    def _level(bin_: list[Piece]) -> tuple[list[Piece], list[Piece]]:
        """The bin up to the largest power of two, and the rest."""
        total = sum(len(p.ids) for p in bin_)
        over = total - (1 << (total.bit_length() - 1)) if total else 0
        back = []
        while over:
            last = bin_.pop()
            if len(last.ids) > over:
                head, last = last.cut(len(last.ids) - over)
                bin_.append(head)
            over -= len(last.ids)
            back.append(last)
        return bin_, back


def packed(
    examples: DataFrame,
    encode,
    read: list[str | Column],
    keep: list[str],
    limits: Limits = Limits(),
) -> DataFrame:
    """Sequences of examples, one row for each piece.

    encode takes a list of values for each of the read columns and returns for
    each row its ids and which of them bear loss (None: all). Returned are the columns in keep
    and start (the example's ids before the piece), length, ids (little-endian
    unsigned 32-bit numbers), example_tokens, sequence_id, offset (in the
    sequence, gapless from 0) and loss_tokens; clashing names get a _ behind.

    Every id lies in exactly one piece; examples may be cut anywhere. Each task
    packs the rows it reads, with POOL_TOKENS of them in memory at a time, and
    ends on sequences whose lengths are powers of two, so nothing is shuffled
    and nothing needs padding however many tasks there are. An id that alone
    goes over a limit cannot be placed: limits are at least 1. Rows without ids
    give no piece; rows may repeat, each is packed.
    """
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("each limit is to be 1 at least")
    kept = examples.select(*named(keep))
    new = [
        ("start", "bigint"), ("length", "bigint"), ("ids", "binary"), ("example_tokens", "bigint"),
        ("sequence_id", "bigint"), ("offset", "bigint"), ("loss_tokens", "bigint"),
    ]
    new = [(free_name(kept, name), kind) for name, kind in new]
    schema = fields(kept, *new)
    wanted = [F.col(c) if isinstance(c, str) else c for c in read]
    source = examples.select(
        F.struct(*named(keep)).alias("kept"), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(wanted)]).alias("read")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits)
        sequence = TaskContext.get().partitionId() << 33
        rows: dict[int, tuple] = {}
        done: list[tuple] = []
        number = 0

        def flush() -> pa.RecordBatch:
            own = pa.array([d[0] for d in done], kept_type)
            columns = [pa.array([d[i] for d in done], t) for i, t in enumerate(_TYPES, 1)]
            done.clear()
            return pa.RecordBatch.from_arrays([*own.flatten(), *columns], names=[f.name for f in schema])

        def place(bins: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in bins:
                offset = 0
                for p in pieces:
                    n = len(p.ids)
                    held = rows[p.example]
                    done.append((held[0], p.start, n, p.ids.astype("<u4").tobytes(), held[1],
                                 sequence, offset, p.loss_tokens()))
                    offset += n
                    held[2] -= n
                    if not held[2]:
                        del rows[p.example]
                sequence += 1

        kept_type = None
        for batch in batches:
            kept_type = batch.schema.field("kept").type
            kept_values = batch.column("kept").to_pylist()
            arguments = [c.to_pylist() for c in batch.column("read").flatten()]
            for i in range(0, batch.num_rows, ENCODED_ROWS):
                to = i + ENCODED_ROWS
                coded = encode(*[a[i:to] for a in arguments])
                for values, (ids, loss) in zip(kept_values[i:to], coded):
                    if len(ids):
                        rows[number] = [values, len(ids), len(ids)]
                        place(packer.add(Piece(number, 0, ids, loss)))
                        number += 1
                    if len(done) >= FLUSHED_PIECES:
                        yield flush()
        place(packer.close())
        if done:
            yield flush()

    return source.mapInArrow(run, schema)


_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def packed_documents(
    docs: DataFrame,
    tokenizer_path: str,
    limits: Limits = Limits(),
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Documents as examples whose every token bears loss, each ended by end_id; null is empty."""

    end = np.array([end_id], np.uint32)

    def encode(values: list[str | None]) -> list[tuple[np.ndarray, None]]:
        coded = encoder(tokenizer_path).encode([v or "" for v in values])
        return [(np.concatenate([ids, end]), None) for ids in coded]

    return packed(docs, encode, [F.col(text).cast("string")], [key], limits)


def packed_turns(
    turns: DataFrame, ids: str = "ids", loss: str = "loss", keep: list[str] | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Examples that are tokenized already: ids and, beside them, whether each bears loss.

    A null list of ids is empty; a null list or mark of loss means none.
    """

    def encode(values: list[list | None], marks: list[list | None]) -> list[tuple]:
        out = []
        for own, marked in zip(values, marks):
            own, marked = own or [], [bool(m) for m in marked or []][: len(own or [])]
            marked += [False] * (len(own) - len(marked))
            out.append((np.array(own, np.uint32), np.array(marked, bool)))
        return out

    return packed(turns, encode, [ids, loss], keep or [c for c in turns.columns if c not in (ids, loss)], limits)
