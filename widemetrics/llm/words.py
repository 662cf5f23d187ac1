"""Words of whole texts as 64-bit hashes, and hashes of windows of them, in arrays."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

# A word is a longest run of bytes other than these.
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_BLANK = re.compile(rb"[\x20\x09-\x0d]")

#: Bytes hashed at a time.
CHUNK = 1 << 17

_STEP = 0x9E3779B97F4A7C15
_OTHER_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are blank, and a random odd number for each byte."""
    blank = np.zeros(256, bool)
    blank[list(_BLANKS)] = True
    random = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64)
    return blank, random * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(1024, 1 << (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and where it begins."""
    blank_byte, random = _tables()
    raw = np.frombuffer(data, np.uint8)
    word = ~blank_byte[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.flatnonzero(word)
    number = np.cumsum(begins)[at] - 1
    place = at - starts[number]
    values = random[raw[at]] * _powers(_STEP, int(place.max()) + 1)[place]
    first = np.flatnonzero(np.diff(number, prepend=-1))
    return mixed(np.add.reduceat(values, first)), starts


def string_hashes(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string's bytes."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset :][: len(strings) + 1]
    offsets = offsets.astype(np.int64)
    lengths = np.diff(offsets)
    out = (np.zeros(len(strings), np.uint64), np.zeros(len(strings), np.uint64))
    if not lengths.sum():
        return out
    raw = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    filled = np.flatnonzero(lengths)
    begins = offsets[filled] - offsets[0]
    place = np.arange(len(raw)) - np.repeat(begins, lengths[filled])
    most = int(place.max()) + 1
    for own, random, step in zip(out, _two_tables(), (_STEP, _OTHER_STEP)):
        own[filled] = mixed(np.add.reduceat(random[raw] * _powers(step, most)[place], begins))
    return out


@lru_cache(maxsize=1)
def _two_tables() -> np.ndarray:
    return np.random.default_rng(21).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def _pieces(text: bytes) -> list[bytes]:
    out, at = [], 0
    while len(text) - at > CHUNK:
        cut = _BLANK.search(text, at + CHUNK)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text by text, and where each text's begin and the last one's end."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    batch: list[bytes] = []
    owner: list[int] = []
    held = 0

    def done() -> None:
        nonlocal held
        if batch:
            found, starts = _hash_chunk(b"\n".join([*batch, b""]))
            ends = np.cumsum([len(b) + 1 for b in batch])
            at = np.searchsorted(ends, starts, "right")
            np.add.at(counts, np.array(owner), np.bincount(at, minlength=len(batch)))
            hashes.append(found)
            batch.clear()
            owner.clear()
            held = 0

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            batch.append(piece)
            owner.append(i)
            held += len(piece)
            if held >= CHUNK:
                done()
    done()
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), offsets


def windows(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of so many words; runs over the end of a text are among them."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = mixed(words ^ np.uint64(salt)) if salt else words
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_BACK, len(words)), dtype=np.uint64, out=sums[1:])
    return mixed((sums[length:] - sums[:n]) * _powers(_STEP, n))


def starts_within(offsets: np.ndarray, length: int) -> np.ndarray:
    """Where runs of so many words begin that lie within one text, and the text of each."""
    counts = np.maximum(0, np.diff(offsets) - length + 1)
    total = int(counts.sum())
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return offsets[:-1][text] + np.arange(total) - first[text], text


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values, where its least lies; the first of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.arange(len(values))
    span = 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while span * 2 <= width:
        at = lesser(at[: len(at) - span], at[span:])
        span *= 2
    return lesser(at[:n], at[width - span : width - span + n])


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct runs of n words; a text of fewer words
    has them all as one, and one without words nothing."""
    hashes, offsets = hashed(texts)
    runs = windows(hashes, n)
    counts = np.diff(offsets)
    out = []
    for begin, count in zip(offsets[:-1].tolist(), counts.tolist()):
        if count >= n:
            own = np.sort(runs[begin : begin + count - n + 1])
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            out.append(own[new])
        elif count:
            out.append(windows(hashes[begin : begin + count], count, salt=count))
        else:
            out.append(np.empty(0, np.uint64))
    return out
