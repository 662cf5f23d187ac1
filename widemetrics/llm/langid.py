"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widemetrics.llm.common import by_place, free_name, named, saved

#: Hashed n-grams of one to three letters, words padded with a blank at each end.
DIMS = 1 << 13

#: At most so many documents of each language are learned from.
SAMPLE_PER_LANG = 1000

#: Up to so many languages their sampling rates are sent to every task; beyond, they are joined.
BROADCAST_LANGS = 10_000

CENTROIDS = 4
ROUNDS = 12

#: A document goes if its similarity is below this part of what the least
#: similar hundredth of the learned documents of its length has.
REJECT_BELOW = 0.35

#: Bins of learned documents fewer than this set no bound of their own.
LEAST_IN_BIN = 20

UNKNOWN = "und"
#: Characters worked on at a time; longer texts are cut between words.
SLICE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(" ", at + SLICE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _grams(text: str) -> np.ndarray:
    """The dimension of each n-gram of the text; empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    # Each run of other characters becomes one blank, and the ends get one.
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    codes = np.concatenate([codes[keep], [np.uint32(32)]]).astype(np.uint32)
    if codes[0] != 32:
        codes = np.concatenate([[np.uint32(32)], codes]).astype(np.uint32)
    if len(codes) < 3:
        return np.empty(0, np.uint32)
    a, b = codes[:-1], codes[1:]
    one = (codes * np.uint32(0x9E3779B1)) >> np.uint32(19)
    two = (a * np.uint32(0x85EBCA6B) ^ b * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    three = (two[:-1] ^ codes[2:] * np.uint32(0x165667B1)) * np.uint32(0x9E3779B1)
    # An n-gram lies within a padded word.
    inner = codes[1:-1] != 32
    return np.concatenate(
        [one[codes != 32], (two >> np.uint32(19)), (three >> np.uint32(19))[inner]]
    )


def counts(texts: list[str]) -> np.ndarray:
    """A row of n-gram counts for each whole text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, text in enumerate(texts):
        for part in _slices(text):
            out[i] += np.bincount(_grams(part), minlength=DIMS)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(tf * idf)


def length_bin(tf: np.ndarray) -> np.ndarray:
    """The power of two of the number of distinct n-grams."""
    return np.log2(np.maximum(1, (tf > 0).sum(axis=1))).astype(np.int64)


def clustered(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    centre = unit(rows.mean(axis=0, keepdims=True))
    chosen = [int(np.argmax(rows @ centre[0]))]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        far = int(np.argmin(nearest))
        if nearest[far] > 0.999:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, rows @ rows[far])
    centroids = rows[chosen].copy()
    for _ in range(ROUNDS):
        own = np.argmax(rows @ centroids.T, axis=1)
        sums = np.stack([rows[own == c].sum(axis=0) for c in range(len(centroids))])
        centroids = unit(sums[np.bincount(own, minlength=len(centroids)) > 0])
    return centroids.astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    #: The least similarity by length bin.
    bounds: np.ndarray


def fit(
    docs: DataFrame,
    learn: Column | None = None,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_lang: int = SAMPLE_PER_LANG,
) -> Model:
    """Learn centroids from at most per_lang documents of each language.

    The documents are those with the smallest hashes of their key among the
    rows with text and lang where learn holds. Their vectors go into a scratch
    table; document frequencies are counted from it, each language's vectors
    are clustered in one task, and the similarity bounds are taken over all of
    them. The driver gets the centroids, the frequencies and one bound for each
    length bin. Without any document to learn from, no language is known.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    known = known.filter(learn) if learn is not None else known
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    lot = (F.pmod(F.xxhash64(named, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)).alias("lot")
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), lot)
    totals = known.groupBy("lang").count()
    # Somewhat more than is needed by hash, then exactly the bound by rank.
    part = F.least(F.lit(1.0), F.lit(1.3 * per_lang + 50) / F.col("count")).alias("part")
    parts = totals.select("lang", part)
    listed = parts.limit(BROADCAST_LANGS + 1).collect()
    if len(listed) <= BROADCAST_LANGS:
        parts = F.broadcast(spark.createDataFrame(listed, parts.schema))
    drawn = known.join(parts, "lang").filter("lot <= part")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, t, place in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "lot"))):
                tf = counts([t])[0]
                dims = np.flatnonzero(tf)
                if len(dims):
                    out.append((name, place, dims.astype(np.int32), tf[dims]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.string()),
                    pa.array([r[1] for r in out], pa.float64()),
                    pa.array([r[2] for r in out], pa.list_(pa.int32())),
                    pa.array([r[3] for r in out], pa.list_(pa.float32())),
                ],
                names=["lang", "lot", "dims", "tf"],
            )

    sampled = saved(
        drawn.select("lang", "text", "lot").mapInArrow(
            vectors, "lang string, lot double, dims array<int>, tf array<float>"
        ),
        "langid-vectors",
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("lot"))
    sampled = sampled.withColumn("rank", rank).filter(F.col("rank") <= per_lang).drop("rank", "lot")
    n = sampled.count()
    idf = np.full(DIMS, np.log(1.0 + n) + 1, np.float32)
    for r in sampled.select(F.explode("dims").alias("d")).groupBy("d").count().collect():
        idf[r["d"]] = np.log((1.0 + n) / (1.0 + r["count"])) + 1

    def dense(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        out = np.zeros((rows.num_rows, DIMS), np.float32)
        for i, (d, v) in enumerate(zip(rows.column("dims").to_pylist(), rows.column("tf").to_pylist())):
            out[i, d] = v
        return out

    def cluster(rows: pa.Table) -> pa.Table:
        found = clustered(weighted(dense(rows), idf), CENTROIDS)
        return pa.table(
            {
                "lang": pa.array([rows.column("lang")[0].as_py()] * len(found), pa.string()),
                "centroid": pa.array([c.tobytes() for c in found], pa.binary()),
            }
        )

    learned = sampled.groupBy("lang").applyInArrow(cluster, "lang string, centroid binary")
    found = sorted((r["lang"], bytes(r["centroid"])) for r in learned.collect())
    langs = [name for name, _ in found]
    centroids = np.array([np.frombuffer(c, np.float32) for _, c in found]).reshape(-1, DIMS)

    def similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf = dense(batch)
            best = (weighted(tf, idf) @ centroids.T).max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(length_bin(tf)), pa.array(best.astype(np.float64))], names=["bin", "best"]
            )

    bounds = np.zeros(64)
    if langs:
        seen = sampled.select("dims", "tf").mapInArrow(similarities, "bin bigint, best double")
        low = F.percentile_approx("best", 0.01, 10_000).alias("low")
        least = seen.rollup("bin").agg(F.count("*").alias("n"), low).collect()
        set_by = {r["bin"]: r["low"] for r in least if r["bin"] is not None and r["n"] >= LEAST_IN_BIN}
        overall = next(r["low"] for r in least if r["bin"] is None)
        for b in range(64):
            # A bin with too few takes the bound of the nearest that has enough, or of all; the
            # cosine of a shorter text is less, at most about as the root of its n-grams.
            near = min(set_by, key=lambda x: (abs(x - b), x), default=int(np.log2(DIMS)))
            bounds[b] = REJECT_BELOW * set_by.get(near, overall) * 2 ** (min(0, b - near) / 2)
    return Model(langs, centroids, idf, bounds)


def identified(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Each row of docs with lang_pred, score and rejected.

    lang_pred is the language of the nearest centroid and score the cosine
    with it, between 0 and 1. rejected is true where even that centroid is far,
    for a text of this length. A null text and one without a letter is und,
    score 0, and rejected; so is every text if no language was learned. keep
    names the columns of docs to return, all by default; clashing names get a _
    behind. Texts are read whole, where they are, without a shuffle.
    """
    names = docs.columns if keep is None else keep
    kept = docs.select(*named(names))
    out = [free_name(kept, n) for n in ("lang_pred", "score", "rejected")]
    read = by_place(docs.select(*named(names), F.col(text).cast("string").alias("__text__")))
    schema = kept.withColumns(
        {
            out[0]: F.lit("").cast("string"),
            out[1]: F.lit(0.0),
            out[2]: F.lit(True),
        }
    ).schema
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array(model.langs + [UNKNOWN], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            pred, score, gone = [], [], []
            for i in range(0, len(texts), 64):
                tf = counts(texts[i : i + 64])
                some = tf.any(axis=1) & bool(model.langs)
                if not model.langs:
                    best, sim = np.full(len(tf), -1), np.zeros(len(tf))
                else:
                    sims = weighted(tf, model.idf) @ model.centroids.T
                    best = np.where(some, sims.argmax(axis=1), -1)
                    sim = np.where(some, sims.max(axis=1), 0.0)
                pred += langs[best].tolist()
                score += np.clip(sim, 0.0, 1.0).tolist()
                gone += (~some | (sim < model.bounds[length_bin(tf)])).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:at],
                    pa.array(pred, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(gone, pa.bool_()),
                ],
                names=[*names, *out],
            )

    return read.mapInArrow(run, schema)
