import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from widemetrics.llm import exchange, phrases
from widemetrics.llm.phrases import collocations, in_lockstep, runs


def pieces(text):
    data = (text or "").encode().lower()
    return [re.findall(rb"[^\x20\x09]+", p) for p in re.split(rb"[.,;:!?\x0a-\x0d]", data)]


def plain(rows, least, longest=4, covered=80, scale=2_000_000, top=None):
    """Rows of collocations() for (lang, text), by dictionaries."""
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        found = []
        often = {p: a for p, a in own.items() if a >= least}
        inner = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        for p, a in often.items():
            if len(p) < 2 or (p in inner and 100 * inner[p] >= covered * a):
                continue
            score, k = min((scale * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, b" ".join(p).decode(), own[p[:k]], own[p[k:]], sizes[lang]))
        found.sort(key=lambda f: (-f[0], -f[1], f[2].encode()))
        out += [(lang, p, a, l, r, n, s, i + 1) for i, (s, a, p, l, r, n) in enumerate(found[:top])]
    return Counter(out)


def got(found):
    names = ("lang", "phrase", "a", "l", "r", "n", "score", "rank")
    return Counter(tuple(r[n] for n in names) for r in found.collect())


@pytest.mark.parametrize("least, longest", [(1, 2), (2, 4), (3, 3)])
def test_collocations_of_odd_rows(odd, least, longest):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    want = plain(rows, least, longest, top=50)
    assert got(collocations(odd, least, longest, top=50)) == want and want


def test_collocations_of_generated_texts(spark, monkeypatch):
    """Few words, so that counts tie, with control characters below a space and ends of pieces."""
    rng = random.Random(3)
    words = ["a", "A", "b", "a\x01", "a\x1c", "\x00", "é", "É", "b\x85", "c\tc", "d,", "e.\n", "f\x0b"]
    rows = [
        (rng.choice(["x", "y", None]), " ".join(rng.choices(words, weights=range(13, 0, -1), k=rng.randint(0, 60))))
        for _ in range(300)
    ]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    monkeypatch.setattr(phrases, "STREAM_ROWS", 16)
    for covered in (80, 30):
        want = plain(rows, 5, covered=covered)
        assert len(want) > 100
        assert got(collocations(docs, 5, covered_percent=covered, top=10**6)) == want


def test_streams_cut_anywhere_give_all_counts(spark, monkeypatch):
    counts = Counter()
    rng = random.Random(8)
    for _ in range(400):
        run = rng.choices("ab", k=6)
        for k in range(1, 5):
            for i in range(7 - k):
                counts[" ".join(run[i : i + k])] += 1
    rows = [("l", p, n) for p, n in counts.items()]
    frame = spark.createDataFrame(rows, "lang string, phrase string, f bigint")
    monkeypatch.setattr(phrases, "STREAM_ROWS", 2)
    for backwards in (False, True):
        found = {r["phrase"]: r for r in in_lockstep(frame, backwards).collect()}
        assert set(found) == set(counts)
        for p, r in found.items():
            w = p.split(" ")[:: -1 if backwards else 1]
            part = lambda ws: " ".join(ws[:: -1 if backwards else 1])
            assert r["heads"] == [counts[part(w[:k])] for k in range(1, len(w))]
            longer = [counts[part([*w, c])] for c in "ab" if part([*w, c]) in counts]
            assert r["extended"] == max(longer, default=0)


def test_long_pieces_are_cut_into_runs_with_context(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 20)
    text = " ".join(f"w{i}" for i in range(200)) + ". " + "x" * 90 + " y\tz" + " , ; tail"
    plain_runs = [p for p in pieces(text) if p]
    for longest in (2, 4):
        grams = Counter()
        for words, after in runs(text, longest - 1):
            both = [*words, *after]
            for k in range(1, longest + 1):
                grams.update(tuple(both[i : i + k]) for i in range(len(words)) if i + k <= len(both))
        want = Counter()
        for p in plain_runs:
            for k in range(1, longest + 1):
                want.update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
        assert grams == want
    assert len(list(runs(text, 3))) > len(plain_runs)


def test_counts_beyond_64_bits_when_multiplied_and_an_empty_table(spark, empty):
    assert collocations(empty, top=5).count() == 0
    docs = spark.createDataFrame([("l", "a b " * 40)], "lang string, text string")
    found = collocations(docs, 30, scale=10**9, top=1).first()
    assert (found["phrase"], found["score"]) == ("a b a b", 10**9 * 39 // (40 + 40))


def test_a_block_holds_all_languages_together(spark):
    """Each block sends a message to each owner, so a block a language would multiply them."""
    rows = [(f"l{i % 40}", "a b c. " * 5) for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    blocks = phrases_blocks(docs)
    assert len({r["block"] for r in blocks}) == 1
    assert sum(sum(r["n"]) for r in blocks) == 200 * 15


def phrases_blocks(docs):
    kinds = "lang array<string>, words array<binary>, codes array<binary>, context array<binary>, n array<bigint>"
    return docs.mapInArrow(phrases._blocks(4), f"block bigint, {kinds}").collect()


def test_blocks_ask_many_owners_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 300)
    monkeypatch.setattr(phrases, "OWNED_PAIRS", 4)
    monkeypatch.setattr(phrases, "SLICE", 150)
    rng = random.Random(5)
    rows = []
    for i in range(150):
        words = rng.choices("abcdefgh", weights=range(8, 0, -1), k=rng.randint(0, 200))
        rows.append((rng.choice(["x", "y", "z", None]), "".join(w + rng.choice([" "] * 8 + [". ", ",\n"]) for w in words)))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for longest, least in ((4, 30), (5, 4)):
        want = plain(rows, least, longest, top=10**6)
        assert want and got(collocations(docs, least, longest, top=10**6)) == want


def test_rare_phrases_of_frequent_pairs_are_not_sent(monkeypatch):
    """Of three words only phrases that are frequent leave the blocks, not all whose pairs are."""
    monkeypatch.setattr(phrases, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(12)], k=60)) + "." for _ in range(200)]
    docs = pa.record_batch([pa.array(["l"] * 200), pa.array(texts)], ["lang", "text"])
    blocks = list(phrases._blocks(4)(iter([docs])))
    block = pa.Table.from_batches(blocks)

    def answers(asked, level):
        owners = asked["owner"].unique().to_pylist()
        each = [asked.filter(pa.compute.equal(asked["owner"], o)) for o in owners]
        return pa.concat_tables(map(phrases._often(30, level), each))

    told = answers(pa.Table.from_batches(phrases._ask(2, 30)(iter(blocks))), 2)
    told = pa.concat_tables([told, answers(phrases._ask_longer(2, 30, 3)(block, told), 3)])
    sent = phrases._count(2, 4)(block, told).column("phrase").to_pylist()
    assert len(sent) == 12 + 144 and {len(p.split(" ")) for p in sent} == {1, 2}


@pytest.mark.parametrize("least", [0, 1, 3, 300])
@pytest.mark.parametrize("bits", [0, 3, 11])
def test_owners_hear_counts_of_whole_columns(least, bits):
    rng = np.random.default_rng(2)
    known = np.unique(rng.integers(0, 1 << 63, 900, np.uint64) * np.uint64(2))
    sums, sent = Counter(), []
    for block in range(40):
        own = np.sort(rng.choice(known, rng.integers(0, 300), replace=False))
        times = rng.integers(0, 400 if least > 255 else 3, len(own))
        sent.append((own, exchange.counted(block, own, times, bits, least)))
        for h, t in zip(own.tolist(), times.tolist()):
            sums[h] += t
    told = pa.concat_tables(m for _, m in sent)
    answers = pa.concat_tables(
        exchange.often(told.filter(pa.compute.equal(told["owner"], o)), least, 2)
        for o in reversed(told["owner"].unique().to_pylist())
    )
    for block, (own, _) in enumerate(sent):
        heard = exchange.heard(own, answers.filter(pa.compute.equal(answers["block"], block)), bits)
        assert heard.tolist() == [sums[h] >= least for h in own.tolist()]
