import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from widemetrics.llm import divergence as module
from widemetrics.llm.divergence import divergence, share, shares, terms


def plain_terms(text):
    return re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain(rows, least, top):
    """Rows of divergence() for (text, lang, source)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = plain_terms(text)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = Counter()
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}

        def p(c):
            size = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (n + 5) // size for t, n in c.items()}

        q = p(whole)
        for s in sources:
            mine = p(own[s])
            pairs = [(sum(abs(mine[t] - p(own[o])[t]) for t in kept), o.encode()) for o in sources if o != s]
            found = [(mine[t] - q[t], t) for t in kept if own[s][t] and mine[t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", found, top)):
                items.sort(key=lambda x: (-x[0], x[1]))
                for i, (value, item) in enumerate(items[:limit]):
                    out[lang, s, part, item.decode(), value, i + 1] += 1
    return out


def got(found):
    return Counter(tuple(r[n] for n in ("lang", "source", "part", "item", "value", "rank")) for r in found.collect())


@pytest.mark.parametrize("least, top", [(1, 3), (2, 50), (100, 5)])
def test_divergence_of_odd_rows(odd, least, top):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert got(divergence(odd, least, top)) == plain(rows, least, top)


@pytest.mark.parametrize("tile, shard_rows", [(128, 1 << 17), (2, 30)])
def test_divergence_of_many_sources_with_ties(spark, monkeypatch, tile, shard_rows):
    """Cells that hold more terms than the first ranks do, equal values in several cells."""
    monkeypatch.setattr(module, "TILE", tile)
    monkeypatch.setattr(module, "SHARD_ROWS", shard_rows)
    rng = random.Random(5)
    names = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["é", "ÉA", "zz9zz", "Q-q"]
    rows = [
        (" ".join(rng.choices(names, k=rng.randint(0, 12))), rng.choice(["l", "m"]), f"s{rng.randint(0, 6)}")
        for _ in range(250)
    ]
    rows += [(None, "l", "empty"), ("", "n", None), (None, None, None), ("alone", "o", "s1")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    want = plain(rows, 3, 7)
    assert got(divergence(docs, 3, 7)) == want and len(want) > 150


def test_empty_table(empty):
    assert divergence(empty).count() == 0


def test_shares_are_exact(spark):
    cases = [(0, 10, 1), (7, 7, 3), (10**13, 3 * 10**13, 10**9), (2**62, 2**62, 1), (123456789, 10**18, 77)]
    want = [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    frame = spark.createDataFrame(cases, "c bigint, n bigint, v bigint")
    assert [r[0] for r in frame.select(share(F.col("c"), F.col("n"), F.col("v"))).collect()] == want
    for (c, n, v), w in zip(cases, want):
        assert shares(np.array([c]), np.array([n]), v)[0] == w
    assert shares(np.array([0]), np.array([0]), 0)[0] == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(module, "SLICE", 10)
    text = "Ab cdé FGH1ijk  lm" * 20 + "x" * 40 + " end"
    assert [t for part in terms(text) for t in part] == plain_terms(text)
    assert len(list(terms(text))) > 5
