import check_oracle
import corpus_pipeline
import pytest
from conftest import SF
from llm.plain import lowered, near_groups

from widemetrics.llm import langid, mixing
from widemetrics.llm import queries as corpus
from widemetrics.llm.queries import tokenizer_path


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert check_oracle.compare(spark, check_oracle.tables(SF), name, SF, corpus) == ""


@pytest.mark.parametrize("name", sorted(set(corpus.queries()) - set(corpus.oracle_sql())))
def test_query_has_a_row_for_each_document(spark, documents, name):
    got = corpus.queries()[name](spark, SF)
    assert got.select("doc_id").distinct().count() == documents.count()


def test_pipeline_equals_plain_stages(spark, documents):
    from tokenizers import Tokenizer

    docs = [r.asDict() for r in documents.collect()]
    found = langid.identified(documents, langid.fit(documents)).filter("not rejected")
    kept = {r["doc_id"] for r in found.select("doc_id").collect()}
    assert {d["doc_id"] for d in docs if any(c.isalpha() for c in d["text"] or "")} == kept
    last = {}
    for d in docs:
        if d["doc_id"] in kept:
            own = last.setdefault(lowered(d["text"]), d)
            last[lowered(d["text"])] = max(own, d, key=lambda x: x["doc_id"])
    rows = [(d["doc_id"], d["text"]) for d in last.values()]
    groups = near_groups(rows, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    first = {i for i, _, size, c, _ in groups if i == c or not size}
    assert len(first) < len(rows) < len(docs)
    left = documents.filter(documents["doc_id"].isin(sorted(first)))
    mixed = mixing.mix(left, alpha=corpus_pipeline.ALPHA, seed=corpus_pipeline.SEED)
    copies = {r["doc_id"]: r["n_copies"] for r in mixed.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = dict(rows)
    want = {i: n * (len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in copies.items()}
    lengths: dict[int, int] = {}
    for p in got:
        lengths[p["doc_id"]] = lengths.get(p["doc_id"], 0) + p["length"]
    assert lengths == want


def test_stages_on_odd_rows_and_an_empty_table(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == table.columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0) == (table is odd)
