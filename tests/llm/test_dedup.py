import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from llm.conftest import odd_rows
from llm.plain import lowered, near_groups, repeats

from widemetrics.llm import components, dedup, golomb, jaccard, trie
from widemetrics.llm import repeats as repeated
from widemetrics.llm import words


@given(st.sets(st.integers(0, 2**64 - 1), max_size=200))
def test_golomb_round_trip(values):
    own = np.array(sorted(values), np.uint64)
    k, code = golomb.encoded(own)
    assert (golomb.decoded(len(own), k, code) == own).all()


def test_golomb_is_short():
    own = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 50_000, np.uint64))
    assert len(golomb.encoded(own)[1]) < 3.6 * len(own)


def test_exact_groups_of_odd_rows(odd):
    rows = odd_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    got = dedup.exact_groups(odd).collect()
    assert len(got) == len(rows)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[bytes(r["sha"])].append(r)
    for text, ids in groups.items():
        own = by_sha[hashlib.sha256(text).digest()]
        known = [i for i in ids if i is not None]
        assert sorted(map(str, ids)) == sorted(str(r["id"]) for r in own)
        assert {r["keep_id"] for r in own} == {max(known) if known else None}
        assert {r["group_size"] for r in own} == {len(ids)}
        kept = [r for r in own if r["kept"]]
        assert len(kept) == 1 and kept[0]["id"] == kept[0]["keep_id"]


def test_equal_fingerprints_of_different_texts_are_told_apart(odd, monkeypatch):
    monkeypatch.setattr(dedup, "fingerprint", lambda text: len(text) % 2)
    sizes = defaultdict(int)
    for r in odd_rows():
        sizes[hashlib.sha256(lowered(r[1])).digest()] += 1
    got = dedup.exact_groups(odd).collect()
    assert {bytes(r["sha"]): r["group_size"] for r in got} == sizes
    assert sum(r["kept"] for r in got) == len(sizes)


def test_without_copies_keeps_one_row_each_and_all_columns(odd, empty):
    got = dedup.without_copies(odd)
    assert got.columns == odd.columns
    texts = [lowered(r["text"]) for r in got.collect()]
    assert sorted(texts) == sorted({lowered(r[1]) for r in odd_rows()})
    assert dedup.without_copies(empty).count() == 0
    assert dedup.exact_groups(empty).count() == 0


def test_words_are_runs_between_blanks():
    texts = [b"a  b\tc", b"", b"\x0b\x0c", "é \x1c 　 x".encode(), b"abc " * 400_000]
    hashes, offsets = words.hashed(texts)
    assert np.diff(offsets).tolist() == [len(t.split()) for t in texts]
    by_word = {}
    for h, w in zip(hashes.tolist(), b" ".join(texts).split()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_windows_and_their_least():
    rng = np.random.default_rng(1)
    own = words.mixed(rng.integers(0, 6, 300).astype(np.uint64))
    got = words.windows(own, 7)
    seen = {}
    for i, h in enumerate(got.tolist()):
        assert seen.setdefault(own[i : i + 7].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
    least = words.least_in(got, 5)
    assert least.tolist() == [i + int(np.argmin(got[i : i + 5])) for i in range(len(got) - 4)]


@pytest.mark.parametrize("length", [2, 5, 50])
def test_repeats_of_odd_rows(odd, length):
    want = repeats([(r[0], r[1]) for r in odd_rows()], length)
    keys = {
        r["row_key_"]: (r["doc_id"], r["text"])
        for r in odd.withColumn("row_key_", dedup.row_key()).collect()
    }
    got = repeated.repeated_words(odd, length).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[keys[r["row_key"]]]
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_kept_text_and_empty_table(odd, empty):
    found = repeated.repeated_words(odd, 50)
    out = repeated.kept_text(odd, found)
    assert out.columns == odd.columns and out.count() == odd.count()
    by_id = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by_id[13].startswith("été") or "été" in by_id[13]
    assert by_id[6] is None and by_id[8] == " \n\t "
    assert repeated.repeated_words(empty).count() == 0


def test_repeats_of_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = repeats(rows, 13)
    got = repeated.repeated_words(documents.repartition(5), 13).collect()
    texts = dict(rows)
    assert {(r["doc_id"], texts[r["doc_id"]]): (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert sum(r["n_removed"] for r in got) > 0


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_near_duplicates_of_odd_rows(odd, n, percent):
    want = near_groups([(r[0], r[1]) for r in odd_rows()], n, percent)
    got = jaccard.near_duplicates(odd, n, percent).select(
        "doc_id", "n_shingles", "component_id", "n_links"
    )
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(
        str((i, size, c if size else i, links)) for i, _, size, c, links in want
    )


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 40)])
def test_near_duplicates_of_documents(documents, n, percent):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {i: (size, c if size else i, links) for i, _, size, c, links in near_groups(rows, n, percent)}
    got = jaccard.near_duplicates(documents.repartition(6), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == want


def test_families_cut_into_blocks(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "TREE_SETS", 2)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {i: (c if size else i, links) for i, _, size, c, links in near_groups(rows, 2, 40)}
    got = jaccard.near_duplicates(documents, 2, 40).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in got} == want


def test_one_of_each_group(odd, empty):
    rows = near_groups([(r[0], r[1]) for r in odd_rows()], 3, 90)
    got = jaccard.one_of_each(odd, 3, 90)
    assert got.columns == odd.columns
    alone = sum(1 for *_, links in rows if not links)
    groups = len({c for *_, c, links in rows if links})
    assert got.count() == alone + groups
    assert jaccard.one_of_each(empty).count() == 0


@given(st.lists(st.frozensets(st.integers(0, 25), min_size=1, max_size=12), min_size=1, max_size=12),
       st.sampled_from([40, 80, 90]))
def test_trie_finds_all_links(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = trie.links(arrays, None, percent)
    want = {
        (i, j)
        for j in range(len(sets))
        for i in range(j)
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    }
    assert len(got) == len(want) and set(got) == want


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: top(x) for x in root}
    assert got.count() == len(root)
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components.components(none).count() == 0


def test_row_key_tells_null_ids_and_texts(spark):
    rows = [(None, "a"), (0, "a"), (None, None), (1, ""), (1, None)]
    keys = [r[0] for r in spark.createDataFrame(rows, "doc_id bigint, text string").select(dedup.row_key()).collect()]
    assert len(set(keys)) == 4 and keys[3] == keys[4]
