"""Columns whose names hold points or quotes, and columns named like those that operators add."""

import corpus_pipeline
import pytest
from llm.test_rows import KEY
from pyspark.sql import functions as F

from widemetrics.llm import dedup, jaccard, langid, mixing, packing, pii, quality, repeats, sharding
from widemetrics.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def pointed(odd):
    """Odd rows with such columns, made of the number of the row."""
    added = ["a.b", "c`d", "lang_pred", "score", "rejected", "quality_score", "start", "shard", "pii_spans", "n_copies"]
    return odd.select("*", *[F.col("row_key").alias(n) for n in added])


def others(df, names):
    """How often each content of the given columns is there."""
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).collect()
    at = [df.columns.index(n) for n in names]
    return sorted(str([r[i] for i in at]) for r in rows)


def test_operators_carry_columns_of_any_name(spark, pointed):
    names = [c for c in pointed.columns if c != "text"]
    labels = spark.createDataFrame([(1, 1, 0), (12, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(pointed, labels)
    whole = {
        "langid": langid.identified(pointed, langid.fit(pointed)),
        "quality": quality.scored(pointed, model),
        "pii": pii.pseudonymised(pointed, KEY),
        "sharding": sharding.shuffled_shards(pointed, 3),
        "repeats": repeats.kept_text(pointed, repeats.repeated_words(pointed, 5)),
    }
    for name, found in whole.items():
        assert found.columns[: len(pointed.columns)] == pointed.columns, name
        assert others(found, names) == others(pointed, names), name
        assert len(set(found.columns)) == len(found.columns), name
    rates = spark.createDataFrame([(s, 1, 3.0) for s in ("s0", "s1", "s2", None)], "source string, size bigint, rate double")
    mixed = mixing.replicate(pointed, rates)
    assert mixed.columns[: len(pointed.columns)] == pointed.columns and "n_copies_" in mixed.columns
    for kept in (dedup.without_copies(pointed), jaccard.one_of_each(pointed, 5, 80)):
        assert kept.columns == pointed.columns and 0 < kept.count() < pointed.count()


def test_stages_carry_columns_of_any_name(spark, pointed):
    docs = pointed
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == pointed.columns, name
        assert docs.count() > 0
    assert packing.packed_documents(docs, tokenizer_path()).count() > 0
