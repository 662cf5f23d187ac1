"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widemetrics.llm.common import by_place, free_name, named, saved

#: Words of a passage; the last of a text (or of a slice of a long one) may be shorter.
PASSAGE_WORDS = 64
#: Characters worked on at a time; longer texts are cut between words.
SLICE = 1 << 18

#: At most so many labelled documents of each class are learned from, those with
#: the smallest hashes, and passages of them in all: the longest are thinned to it.
SAMPLE_PER_CLASS = 2500
SAMPLE_PASSAGES = 60_000

HASHED = 64
STATS = 16
HIDDEN = 24
GATES = 12
EPOCHS = 30

# Kinds of characters.
_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _POINT, _MARK = range(8)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each character."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            out[i] = _DIGIT
        elif c.isspace():
            out[i] = _LINE if c == "\n" else _SPACE
    out[[ord(c) for c in ".,;:?'\"()-"]] = _POINT
    out[[ord(c) for c in "!#$%&*|@^~<>=_+/\\{}[]`"]] = _MARK
    return out


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(" ", at + SLICE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _described(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and how many each text has."""
    # One blank ends each text with words, so that none runs into the next.
    bare = [t.strip() for t in texts]
    ended = [t + " " if t else "" for t in bare]
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in ended]
    codes = np.concatenate(raw)
    kinds = _kinds()[codes]
    blank = (kinds == _SPACE) | (kinds == _LINE)
    begins = ~blank
    begins[1:] &= blank[:-1]
    text_ends = np.cumsum([len(r) for r in raw])
    starts = np.flatnonzero(begins)
    text_of_word = np.searchsorted(text_ends, starts, "right")
    words = np.bincount(text_of_word, minlength=len(texts))
    first_word = np.cumsum(words) - words
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    first_passage = np.cumsum(passages) - passages
    nth = np.arange(len(starts)) - first_word[text_of_word]
    passage_of_word = first_passage[text_of_word] + nth // PASSAGE_WORDS
    n = int(passages.sum())
    out = np.zeros((n, STATS + HASHED), np.float32)
    if not len(starts):
        out[:, 0] = 1
        return out, passages
    # Each character belongs to the passage of the last word begun.
    passage = np.repeat(passage_of_word, np.diff(np.append(starts, len(codes))))
    kind, code = kinds, codes
    by_kind = np.bincount(passage * 8 + kind, minlength=n * 8).reshape(n, 8).astype(np.float32)
    chars = np.maximum(1, by_kind.sum(axis=1))
    count = np.maximum(1, np.bincount(passage_of_word, minlength=n)).astype(np.float32)
    out[:, 0] = np.bincount(passage_of_word, minlength=n) == 0
    out[:, 1:9] = by_kind / chars[:, None]
    letters = by_kind[:, _LOWER] + by_kind[:, _UPPER]
    out[:, 9] = by_kind[:, _UPPER] / np.maximum(1, letters)
    out[:, 10] = by_kind[:, _MARK] / count
    out[:, 11] = np.log1p(letters / count)
    # Words by a sum over their characters; like ones side by side, and distinct ones.
    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed[blank] = 0
    word = np.add.reduceat(mixed, starts)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (passage_of_word[1:] == passage_of_word[:-1])
    out[:, 12] = np.bincount(passage_of_word, same, minlength=n) / count
    keyed = (passage_of_word.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24))
    distinct = np.unique(keyed) >> np.uint64(40)
    out[:, 13] = np.bincount(distinct.astype(np.int64), minlength=n) / count
    alone = np.add.reduceat((kind == _LOWER) | (kind == _UPPER), starts) == 0
    out[:, 14] = np.bincount(passage_of_word, alone, minlength=n) / count
    out[:, 15] = np.log1p(np.bincount(passage_of_word, minlength=n)) / np.log1p(PASSAGE_WORDS)
    pairs = ((code[:-1] * np.uint32(0x85EBCA6B)) ^ (code[1:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    within = np.ones(len(code) - 1, bool)
    within[text_ends[(text_ends > 0) & (text_ends < len(code))] - 1] = False
    bins = passage[:-1][within] * HASHED + (pairs[within] >> np.uint32(26)).astype(np.int64)
    hashed = np.bincount(bins, minlength=n * HASHED).reshape(n, HASHED)
    out[:, STATS:] = np.sqrt(hashed / chars[:, None])
    return out, passages


def described(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of the whole texts, and how many each text has.

    A text without words has one passage, marked as empty.
    """
    rows, sizes = [], np.zeros(len(texts), np.int64)
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def done() -> None:
        nonlocal held
        if batch:
            made, n = _described(batch)
            rows.append(made)
            np.add.at(sizes, owner, n)
            batch.clear()
            owner.clear()
            held = 0

    for i, text in enumerate(texts):
        for part in _slices(text):
            batch.append(part)
            owner.append(i)
            held += len(part)
            if held >= SLICE:
                done()
    done()
    return (np.concatenate(rows) if rows else np.zeros((0, STATS + HASHED), np.float32)), sizes


@dataclass
class Model:
    """Weights of encoder (w, b), gated attention (v, u, a) and classifier (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    #: The score of any text where labels of two classes were not to be had.
    constant: float = 0.5

    def scores(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each bag of sizes[i] passages."""
        if not len(sizes):
            return np.zeros(0)
        if self.weights is None:
            return np.full(len(sizes), self.constant)
        return _forward(self.weights, (rows - self.mean) / self.scale, sizes)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    begins = np.cumsum(sizes) - sizes
    bag = np.repeat(np.arange(len(sizes)), sizes)
    h = np.tanh(x @ w["w"] + w["b"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, begins)[bag])
    attention = e / np.add.reduceat(e, begins)[bag]
    z = np.add.reduceat(attention[:, None] * h, begins, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return {"bag": bag, "h": h, "t": t, "g": g, "attention": attention, "z": z, "p": p}


def _gradients(
    w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray
) -> dict[str, np.ndarray]:
    f = _forward(w, x, sizes)
    begins = np.cumsum(sizes) - sizes
    out = (f["p"] - label) * weight / weight.sum()
    d_z = out[:, None] * w["c"]
    d_attention = (d_z[f["bag"]] * f["h"]).sum(axis=1)
    mean = np.add.reduceat(f["attention"] * d_attention, begins)
    d_e = f["attention"] * (d_attention - mean[f["bag"]])
    d_gated = d_e[:, None] * w["a"]
    d_t = d_gated * f["g"] * (1 - f["t"] ** 2)
    d_g = d_gated * f["t"] * f["g"] * (1 - f["g"])
    d_h = f["attention"][:, None] * d_z[f["bag"]] + d_t @ w["v"].T + d_g @ w["u"].T
    d_x = d_h * (1 - f["h"] ** 2)
    return {
        "w": x.T @ d_x, "b": d_x.sum(axis=0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_g,
        "a": (f["t"] * f["g"]).T @ d_e, "c": f["z"].T @ out, "d": out.sum(keepdims=True),
    }


def trained(rows: np.ndarray, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Fit by Adam over batches of bags; weight is each bag's in the loss."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    x = ((rows - mean) / scale).astype(np.float64)
    rng = np.random.default_rng(5)
    shapes = {"w": (x.shape[1], HIDDEN), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES)}
    w = {k: rng.normal(0, s[0] ** -0.5, s) for k, s in shapes.items()}
    w |= {"b": np.zeros(HIDDEN), "a": rng.normal(0, 0.1, GATES), "c": rng.normal(0, 0.1, HIDDEN), "d": np.zeros(1)}
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    begins = np.cumsum(sizes) - sizes
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(sizes))
        for i in range(0, len(order), 128):
            own = order[i : i + 128]
            at = np.concatenate([np.arange(begins[b], begins[b] + sizes[b]) for b in own])
            grads = _gradients(w, x[at], sizes[own], label[own], weight[own])
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
            for k, g in grads.items():
                g = g + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return Model(mean, scale, w)


def _level(lengths: list[tuple[int, int]], bound: int) -> int:
    """The most passages a bag may keep so that all keep bound at most; 1 at least.

    lengths are (passages, how many bags have so many)."""
    left, bags = bound, sum(count for _, count in lengths)
    for n, count in sorted(lengths):
        if n * bags > left:
            return max(1, left // bags)
        left -= n * count
        bags -= count
    return bound


def _share(n: int, most: int) -> np.ndarray:
    """The places, in order, of the passages with the smallest hashes among n."""
    mixed = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.sort(np.argsort(mixed, kind="stable")[:most])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = SAMPLE_PER_CLASS,
    passages: int = SAMPLE_PASSAGES,
) -> Model:
    """Learn from at most per_class documents of each label, and passages of them in all.

    Where a class has more than half of passages, its longest documents are
    thinned for training, all to one number of passages, the largest that keeps
    to the bound; those with the smallest hashes of their places stay. So no
    document goes for the length of another, or for its own. Only if a class
    has more documents than half of passages, those with the largest hashes go.

    learn says of a row of labels whether it may be learned from. A document
    labelled more than once counts as what most of its labels say, and not at
    all on a tie; null keys and labels go. The classes are weighted as often as
    they occur among all those labels, so that scores are probabilities. Their
    passages' features go through a scratch table to the driver, which trains;
    nothing else of the corpus comes there. With labels of one class or none,
    every score is the smoothed share of label 1.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    known = known.filter(learn) if learn is not None else known
    known = known.groupBy(F.col(key).alias("key")).agg(F.avg(F.col(label)).alias("share"))
    known = known.filter("share != 0.5").select("key", (F.col("share") > 0.5).cast("int").alias("y"))
    known = known.withColumn("lot", F.xxhash64("key", F.lit(3)))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    constant = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    if len(totals) < 2:
        return Model(np.zeros(1), np.ones(1), None, constant)
    rank = F.row_number().over(Window.partitionBy("y").orderBy("lot", "key"))
    # Only the smallest hashes are ranked.
    part = {y: min(1.0, (1.3 * per_class + 50) / n) for y, n in totals.items()}
    low = F.pmod("lot", F.lit(1 << 30)) / float(1 << 30) <= F.when(F.col("y") == 1, part[1]).otherwise(part[0])
    chosen = known.filter(low).withColumn("rank", rank).filter(F.col("rank") <= per_class)
    chosen = F.broadcast(saved(chosen.select("key", "y", "rank"), "quality-sample"))
    read = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                rows, sizes = described([t or ""])
                out.append((rows.astype("<f4").tobytes(), int(sizes[0])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("y"),
                    batch.column("rank"),
                    pa.array([o[0] for o in out], pa.binary()),
                    pa.array([o[1] for o in out], pa.int64()),
                ],
                names=["y", "rank", "rows", "n"],
            )

    bags = saved(
        read.join(chosen, "key")
        .select("y", "rank", "text")
        .mapInArrow(features, "y int, rank int, rows binary, n bigint"),
        "quality-bags",
    )
    bound = max(1, passages // 2)
    lengths: dict[int, list[tuple[int, int]]] = {0: [], 1: []}
    for r in bags.groupBy("y", "n").count().collect():
        lengths[r["y"]].append((r["n"], r["count"]))
    level = {y: _level(found, bound) for y, found in lengths.items()}

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, rows, n in zip(*(batch.column(c).to_pylist() for c in ("y", "rows", "n"))):
                if n > level[y]:
                    rows = np.frombuffer(rows, "<f4").reshape(n, -1)[_share(n, level[y])].tobytes()
                out.append((rows, min(n, level[y])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("y"),
                    batch.column("rank"),
                    pa.array([o[0] for o in out], pa.binary()),
                    pa.array([o[1] for o in out], pa.int64()),
                ],
                names=["y", "rank", "rows", "n"],
            )

    bags = bags.mapInArrow(thinned, bags.schema)
    # Of a bounded sample: no thinned bag passes the bound, so the first of each class stays.
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    bags = bags.withColumn("before", F.coalesce(so_far, F.lit(0)))
    bags = bags.filter(F.col("before") + F.col("n") <= bound).orderBy("y", "rank")
    found = bags.select("y", "rows", "n").collect()
    if len({r["y"] for r in found}) < 2:
        return Model(np.zeros(1), np.ones(1), None, constant)
    rows = np.concatenate([np.frombuffer(r["rows"], "<f4").reshape(r["n"], -1) for r in found])
    y = np.array([r["y"] for r in found], np.float64)
    each = {c: totals[c] / (y == c).sum() for c in (0, 1)}
    weight = np.where(y == 1, each[1], each[0])
    return trained(rows, np.array([r["n"] for r in found]), y, weight / weight.mean())


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with quality_score: the probability that the label is 1, from 0 to 1.

    Every passage of the whole text is encoded, and the score is that of the
    attention-weighted mean of the passages. A null text is read as empty; a
    text without words has one empty passage. keep names the columns to return,
    all by default; a clashing name gets a _ behind.
    """
    names = docs.columns if keep is None else keep
    kept = docs.select(*named(names))
    out = free_name(kept, "quality_score")
    read = by_place(docs.select(*named(names), F.col(text).cast("string").alias("__text__")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            score: list[float] = []
            at, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= SLICE or i + 1 == len(texts):
                    score += model.scores(*described(texts[at : i + 1])).tolist()
                    at, held = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(score, pa.float64())], names=[*names, out]
            )

    return read.mapInArrow(run, kept.withColumn(out, F.lit(0.0)).schema)
