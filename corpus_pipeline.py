"""From documents to packed training sequences, stage by stage.

Each stage takes the documents its predecessor kept, whole, and all but the last
return documents' columns. run() puts each stage's result into the shared scratch
folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widemetrics.llm import dedup, jaccard, langid, mixing, packing
from widemetrics.llm.common import named, prepare, saved, table
from widemetrics.llm.queries import tokenizer_path

#: Word n-grams and similarity of near duplicates.
SHINGLE, PERCENT = 5, 80

#: Targets of the mix: bytes of a source to this power.
ALPHA = 0.5
SEED = 7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that occur; those without a letter, and those far from
    every centroid, go. A missing lang becomes the one found."""
    prepare(spark)
    names = docs.columns
    found = langid.identified(docs, langid.fit(docs))
    lang = F.coalesce("lang", found.columns[len(names)]).alias("lang")
    kept = found.filter(~F.col(found.columns[-1]))
    return kept.select(*[lang if c == "lang" else x for c, x in zip(names, named(names))])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    prepare(spark)
    return dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    prepare(spark)
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says, in random order."""
    prepare(spark)
    return mixing.mix(docs, alpha=ALPHA, seed=SEED).select(*named(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    prepare(spark)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing to target weights", mix),
    ("packing", pack),
]

#: Language ID and packing have no SQL; tests/llm checks the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
