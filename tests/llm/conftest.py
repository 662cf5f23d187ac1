import random

import pytest
from conftest import SF

from widemetrics.llm.common import prepare

SYLLABLES = "ba co di fu ga he ji ko lu ma ne po ra si to vu".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, near copies, a long text."""
    rng = random.Random(4)
    base, other = prose(rng, 130), prose(rng, 90)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    shifted = f"{prose(rng, 20)} {base}"
    texts = [
        (1, base), (2, near), (3, base.upper()), (4, base), (4, base), (5, shifted), (None, base),
        (None, base), (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "one"), (11, "two words"),
        (12, other), (12, other + " more"), (13, f"{other}  été {base}"), (14, prose(rng, 30_000)),
        (None, None), (15, "x " * 300), (16, "x " * 120), (17, "日本語 ΣΣ"), (18, "12 34 !?"),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        lang, source = (None, None) if i % 7 == 3 else (("aa", "bb")[i % 2], f"s{i % 3}")
        out.append((doc_id, text, lang, source, None if text is None else len(text), i, "extra"))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns named like those that operators add or use on the way."""
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        "row_key int, copy string"
    )
    return spark.createDataFrame(odd_rows(), schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
