"""Golomb-Rice coding of sorted 64-bit numbers."""

from __future__ import annotations

import numpy as np


def encoded(values: np.ndarray) -> tuple[int, bytes]:
    """The parameter and the code of ascending distinct unsigned numbers.

    The first number is written out. Each distance to the number before, less
    one, is a quotient by 2**k in unary and a remainder of k bits; k follows
    from the mean distance. All quotients come first, then, from a whole byte
    on, all remainders.
    """
    if not len(values):
        return 0, b""
    gaps = values[1:] - values[:-1] - np.uint64(1)
    mean = int(values[-1] - values[0]) // max(1, len(gaps))
    k = max(0, mean.bit_length() - 1)
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if len(stops) else 0, np.uint8)
    unary[stops] = 1
    bits = np.empty((len(gaps), k), np.uint8)
    for i in range(k):
        bits[:, i] = (gaps >> np.uint64(k - 1 - i)) & np.uint64(1)
    head = int(values[0]).to_bytes(8, "little")
    return k, head + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def decoded(n: int, k: int, code: bytes) -> np.ndarray:
    """The n numbers that encoded() was given."""
    if not n:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(code, np.uint8)[8:]
    tail = ((n - 1) * k + 7) // 8
    stops = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[: n - 1]
    quotients = np.diff(stops, prepend=-1) - 1
    bits = np.unpackbits(raw[len(raw) - tail :])[: (n - 1) * k].reshape(n - 1, k)
    rest = np.zeros(n - 1, np.uint64)
    for i in range(k):
        rest = (rest << np.uint64(1)) | bits[:, i]
    out = np.empty(n, np.uint64)
    out[0] = int.from_bytes(code[:8], "little")
    out[1:] = ((quotients.astype(np.uint64) << np.uint64(k)) | rest) + np.uint64(1)
    return np.cumsum(out, dtype=np.uint64)
