"""Blocks of rows ask the owners of ranges of hashes which of theirs occur elsewhere.

A block sends each owner its distinct hashes, sorted and Golomb-coded, and gets
a bitmap back. A hash that very many rows hold goes out once a block, so no
owner gets more than one entry of it from each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from widemetrics.llm import golomb

MESSAGE = "owner bigint, block bigint, level int, n bigint, k bigint, code binary, checks binary, ids binary"
ANSWER = "owner bigint, block bigint, level int, bitmap binary"

_MESSAGE = pa.schema(
    [
        ("owner", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("n", pa.int64()),
        ("k", pa.int64()), ("code", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary()),
    ]
)

#: Hashes an owner is to hold, about.
OWNED = 1 << 18


def owner_bits(hashes: int, partitions: int, owned: int = OWNED) -> int:
    """How many first bits of a hash name its owner: owners enough for `owned` hashes each."""
    return (max(partitions, hashes // owned) - 1).bit_length()


def by_owner(hashes: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Where in the sorted hashes each owner's lie."""
    if not len(hashes):
        return []
    owners = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    begins = np.flatnonzero(np.diff(owners, prepend=-1))
    ends = np.append(begins[1:], len(hashes))
    return [(int(owners[b]), slice(int(b), int(e))) for b, e in zip(begins, ends)]


def messages(
    block: int, hashes: np.ndarray, bits: int, level: int = 0,
    checks: np.ndarray | None = None, ids: np.ndarray | None = None,
) -> pa.Table:
    """What a block sends: sorted distinct hashes, with 32 more bits and the least id of each
    where they are asked for."""
    rows = []
    for owner, own in by_owner(hashes, bits):
        k, code = golomb.encoded(hashes[own])
        rows.append(
            (
                owner, block, level, own.stop - own.start, k, code,
                b"" if checks is None else checks[own].astype("<u4").tobytes(),
                b"" if ids is None else ids[own].astype("<i8").tobytes(),
            )
        )
    columns = list(zip(*rows)) or [[]] * len(_MESSAGE)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE)], schema=_MESSAGE)


def _answered(received: pa.Table, bitmaps: list[np.ndarray]) -> pa.Table:
    return pa.table(
        {
            **{c: received.column(c) for c in ("owner", "block", "level")},
            "bitmap": pa.array([np.packbits(b).tobytes() for b in bitmaps], pa.binary()),
        }
    )


def lists(received: pa.Table) -> list[np.ndarray]:
    """The hashes of each message."""
    return [
        golomb.decoded(*m) for m in zip(*(received.column(c).to_pylist() for c in ("n", "k", "code")))
    ]


def occurs_elsewhere(received: pa.Table) -> pa.Table:
    """For each hash a block sent: whether another block sent it too."""
    sent = lists(received)
    seen, times = np.unique(np.concatenate(sent), return_counts=True)
    return _answered(received, [times[np.searchsorted(seen, own)] > 1 for own in sent])


def smaller_elsewhere(received: pa.Table) -> pa.Table:
    """For each hash a block sent: whether another block has it with a smaller id."""
    sent = lists(received)
    hashes = np.concatenate(sent)
    checks = np.frombuffer(b"".join(received.column("checks").to_pylist()), "<u4")
    ids = np.frombuffer(b"".join(received.column("ids").to_pylist()), "<i8")
    order = np.lexsort((ids, checks, hashes))
    h, c = hashes[order], checks[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    least = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    smaller = np.empty(len(h), bool)
    smaller[order] = least < ids[order]
    return _answered(received, np.split(smaller, np.cumsum([len(x) for x in sent])[:-1]))


def totals(received: pa.Table) -> pa.Table:
    """For each hash a block sent: in how many rows of all blocks it is, 65535 or more as that.

    checks holds how many rows of the block have it, of 32 bits each.
    """
    sent = lists(received)
    times = np.frombuffer(b"".join(received.column("checks").to_pylist()), "<u4").astype(np.int64)
    hashes = np.concatenate(sent)
    order = np.argsort(hashes, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = hashes[order][1:] != hashes[order][:-1]
    sums = np.add.reduceat(times[order], np.flatnonzero(first))
    each = np.empty(len(order), np.int64)
    each[order] = sums[np.cumsum(first) - 1]
    cut = np.split(np.minimum(each, 65535).astype("<u2"), np.cumsum([len(x) for x in sent])[:-1])
    return pa.table(
        {
            **{c: received.column(c) for c in ("owner", "block", "level")},
            "bitmap": pa.array([c.tobytes() for c in cut], pa.binary()),
        }
    )


def ties(received: pa.Table) -> pa.Table:
    """Those who sent one hash are tied to the least id among them: (a, b)."""
    hashes = np.concatenate(lists(received))
    ids = np.frombuffer(b"".join(received.column("ids").to_pylist()), "<i8")
    return tied(hashes, ids)[0]


def tied(hashes: np.ndarray, ids: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Distinct pairs of an id and the least id with the same hash, the distinct hashes, and the
    least id of each."""
    order = np.lexsort((ids, hashes))
    h, ids = hashes[order], ids[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    least = ids[first]
    own = least[np.cumsum(first) - 1]
    pairs = np.unique(np.stack([ids, own], axis=1)[ids != own], axis=0)
    table = pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})
    return table, h[first], least


def numbers_of(hashes: np.ndarray, answers: pa.Table, bits: int) -> np.ndarray:
    """The owners' totals for the hashes that a block sent, in their order."""
    told = dict(zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist()))
    out = np.zeros(len(hashes), np.int64)
    for owner, own in by_owner(hashes, bits):
        out[own] = np.frombuffer(told[owner], "<u2")
    return out


def bits_of(hashes: np.ndarray, answers: pa.Table, bits: int, level: int = 0) -> np.ndarray:
    """The owners' answers for the hashes that a block sent, in their order."""
    told = {
        o: b
        for o, l, b in zip(*(answers.column(c).to_pylist() for c in ("owner", "level", "bitmap")))
        if l == level
    }
    out = np.zeros(len(hashes), bool)
    for owner, own in by_owner(hashes, bits):
        n = own.stop - own.start
        out[own] = np.unpackbits(np.frombuffer(told[owner], np.uint8))[:n]
    return out


#: What messages by whole columns hold: for each hash 32 bits after those that name its owner, and
#: how often the block has it.
COUNTED = "owner bigint, block bigint, hashes binary, times binary"


def _cut(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Bytes cut into values of these lengths, without a step for each."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)]
    )


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _owners(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The owners of sorted hashes, ascending, and how many each has."""
    owners = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    begins = np.flatnonzero(np.diff(owners, prepend=-1))
    return owners[begins], np.diff(begins, append=len(owners))


def _in_bytes(lengths: np.ndarray) -> np.ndarray:
    """Where each bit lies if every run of so many begins with a byte of its own."""
    whole = (lengths + 7) // 8 * 8
    shift = np.cumsum(whole - lengths) - (whole - lengths)
    return np.arange(lengths.sum()) + np.repeat(shift, lengths)


def _times_kind(least: int) -> str:
    return "<u1" if least < 256 else "<u4"


def counted(block: int, hashes: np.ndarray, times: np.ndarray, bits: int, least: int) -> pa.Table:
    """What a block sends to ask which of its sorted hashes all blocks have `least` times.

    All messages are made together: a block has one for each owner, so their number grows with
    the square of the input. Hashes that differ may be sent as equal, a few in 10,000 if an owner
    has a million: the answer is yes to all that are frequent, and to some that are not.
    """
    owners, sizes = _owners(hashes, bits)
    low = ((hashes << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
    # a sum reaches `least` with the counts cut there if it does so with all
    own = np.minimum(times, max(least, 0)).astype(_times_kind(least))
    return pa.table(
        {
            "owner": pa.array(owners, pa.int64()),
            "block": pa.array(np.full(len(owners), block), pa.int64()),
            "hashes": _cut(low.view(np.uint8), sizes * low.itemsize),
            "times": _cut(own.view(np.uint8), sizes * own.itemsize),
        }
    )


def often(received: pa.Table, least: int, level: int) -> pa.Table:
    """For each hash a block sent by counted(): whether all blocks together have it so often."""
    sizes = pc.binary_length(received.column("hashes")).to_numpy().astype(np.int64) // 4
    hashes = _joined(received.column("hashes"), "<u4")
    times = _joined(received.column("times"), _times_kind(least))
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    sums = np.add.reduceat(times[order], np.flatnonzero(first), dtype=np.int64)
    bits = np.zeros(((sizes + 7) // 8 * 8).sum(), bool)
    bits[_in_bytes(sizes)[order]] = (sums >= least)[np.cumsum(first) - 1]
    return pa.table(
        {
            "owner": received.column("owner"),
            "block": received.column("block"),
            "level": pa.array(np.full(len(sizes), level), pa.int32()),
            "bitmap": _cut(np.packbits(bits), (sizes + 7) // 8),
        }
    )


def heard(hashes: np.ndarray, answers: pa.Table, bits: int) -> np.ndarray:
    """The answers of often() for the sorted hashes that a block sent."""
    _, sizes = _owners(hashes, bits)
    bitmaps = answers.sort_by("owner").column("bitmap")
    return np.unpackbits(_joined(bitmaps, "u1"))[_in_bytes(sizes)].astype(bool)
