"""Token ids of whole texts, by a public tokenizer and a cache of its words."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from widemetrics.llm.words import string_hashes

#: Cached words in a Python worker, about 40 bytes each; a full cache starts anew.
CACHED_WORDS = 4_000_000

#: Characters encoded at a time.
CHUNK = 1 << 22

# Fixed value: how the vocabulary's own rules cut lower-case Latin-1 text into pieces.
_PIECES = regex.compile(r"\p{L}+|\p{N}|'s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+")


class _Known:
    """The ids of words, by 128 bits of hash, in sorted arrays."""

    def __init__(self) -> None:
        self._keys = np.empty(0, np.uint64)
        self._checks = np.empty(0, np.uint64)
        self._slots = np.empty(0, np.int32)
        self._begin = np.zeros(1 << 16, np.int64)
        self._length = np.zeros(1 << 16, np.int32)
        self._ids = np.zeros(1 << 18, np.uint32)
        self._used = self.size = 0

    def slots(self, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Where the ids of each word are; -1 for a word that is not known."""
        keys, checks = hashes
        if not self.size:
            return np.full(len(keys), -1, np.int64)
        order = np.argsort(keys)
        at = np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(self._keys, keys[order])
        at = np.minimum(at, len(self._keys) - 1)
        found = (self._keys[at] == keys) & (self._checks[at] == checks)
        return np.where(found, self._slots[at], -1).astype(np.int64)

    def store(self, hashes: tuple[np.ndarray, np.ndarray], lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Keep the ids of words that are not known; where they are."""
        n, first = len(lengths), self.size
        while first + n > len(self._begin):
            self._begin = np.concatenate([self._begin, np.zeros_like(self._begin)])
            self._length = np.concatenate([self._length, np.zeros_like(self._length)])
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._length[first : first + n] = lengths
        self._begin[first : first + n] = self._used + np.cumsum(lengths) - lengths
        self._ids[self._used : self._used + len(flat)] = flat
        self._used += len(flat)
        self.size += n
        slots = np.arange(first, first + n)
        keys, at = np.unique(hashes[0], return_index=True)
        place = np.searchsorted(self._keys, keys)
        # Should two words agree in the first 64 bits, the second is not kept.
        new = np.ones(len(keys), bool)
        if len(self._keys):
            new = self._keys[np.minimum(place, len(self._keys) - 1)] != keys
        keys, at, place = keys[new], at[new], place[new]
        self._checks = np.insert(self._checks, place, hashes[1][at])
        self._slots = np.insert(self._slots, place, slots[at].astype(np.int32))
        self._keys = np.insert(self._keys, place, keys)
        return slots

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        lengths = self._length[slots]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self._begin[slots] - ends + lengths, lengths) + np.arange(total)
        return self._ids[places], lengths


class WordEncoder:
    """Ids as the tokenizer file gives them for the whole text, without special tokens added.

    Its rules never join anything across a blank or line end, so a text's ids
    are those of its words one after another. A text of Latin-1 characters
    without the signs of a special token is lower-cased, and a word of it that
    is not all letters is cut into pieces, as the rules would; so words that
    differ in case or punctuation alone share what is known. Words of any other
    text go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known = _Known()

    def _tokenize(self, words: list[str], hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if not words:
            return np.empty(0, np.int64)
        coded = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [e.ids for e in coded]
        flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        return self._known.store(hashes, np.fromiter(map(len, ids), np.int64, len(ids)), flat)

    def _learn(self, words: pa.Array, hashes: tuple[np.ndarray, np.ndarray], cut: bool) -> np.ndarray:
        """Slots of distinct words that are not known."""
        named = words.to_pylist()
        if not cut:
            return self._tokenize(named, hashes)
        letters = np.fromiter((w.isalpha() for w in named), bool, len(named))
        out = np.empty(len(named), np.int64)
        whole, mixed = np.flatnonzero(letters), np.flatnonzero(~letters)
        out[whole] = self._tokenize([named[i] for i in whole.tolist()], tuple(h[whole] for h in hashes))
        if len(mixed):
            pieces = [_PIECES.findall(named[i]) for i in mixed.tolist()]
            each = np.fromiter(map(len, pieces), np.int64, len(pieces))
            coded = pa.array(list(chain.from_iterable(pieces)), pa.string()).dictionary_encode()
            own = string_hashes(coded.dictionary)
            slots = self._known.slots(own)
            new = np.flatnonzero(slots < 0)
            fresh = coded.dictionary.take(pa.array(new)).to_pylist()
            slots[new] = self._tokenize(fresh, tuple(h[new] for h in own))
            flat, lengths = self._known.gather(slots[coded.indices.to_numpy()])
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.cumsum(each)]
            out[mixed] = self._known.store(
                tuple(h[mixed] for h in hashes), np.diff(ends, prepend=0), flat
            )
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts, owner, held = [], [], 0
        for i, text in enumerate(texts):
            for part in _parts(text):
                parts.append(part)
                owner.append(i)
                held += len(part)
                if held >= CHUNK:
                    self._encode_into(out, parts, owner)
                    parts, owner, held = [], [], 0
        self._encode_into(out, parts, owner)
        return [o[0] if len(o) == 1 else np.concatenate(o) for o in out]

    def _encode_into(self, out: list[list[np.ndarray]], parts: list[str], owner: list[int]) -> None:
        latin = [_latin(t) and "<|" not in t for t in parts]
        for cut in (True, False):
            own = [i for i, x in enumerate(latin) if x == cut]
            if own:
                lowered = [parts[i].lower() if cut else parts[i] for i in own]
                for i, ids in zip(own, self._encode_all(lowered, cut)):
                    out[owner[i]].append(ids)

    def _encode_all(self, texts: list[str], cut: bool) -> list[np.ndarray]:
        if self._known.size > CACHED_WORDS:
            self._known = _Known()
        split = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        # One cache serves both kinds, as a lower-case word has the same ids either way.
        hashes = string_hashes(coded.dictionary)
        slots = self._known.slots(hashes)
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            words = coded.dictionary.take(pa.array(unknown))
            slots[unknown] = self._learn(words, tuple(h[unknown] for h in hashes), cut)
        flat, lengths = self._known.gather(slots[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return np.split(flat, ends[split.offsets.to_numpy()[1:-1]])


def _parts(text: str) -> Iterator[str]:
    """The text, cut at blanks if it is very long."""
    at = 0
    while len(text) - at > CHUNK:
        blank = text.find(" ", at + CHUNK)
        if blank < 0:
            break
        yield text[at:blank]
        at = blank
    yield text[at:]


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker and file."""
    return WordEncoder(path)
