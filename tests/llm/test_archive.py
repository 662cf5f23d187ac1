import gzip
from collections import Counter

import pytest
from conftest import SF
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from widemetrics.llm import archive
from widemetrics.llm.archive import Archive, parsed, record_header, record_name

ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2 x\r\nEvil: y", "<p>one</p>"), (3, None, "<p>été</p>"),
    (4, "http://a/4", None), (5, "http://a/5", ""), (5, "http://a/5", ""), (None, "u", "<p>one</p>"),
    (None, None, None), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", "x" * 500_000), (8, "é", "y" * 70),
    (9, "u", "y" * 70),
]


@pytest.fixture(scope="module")
def pages(spark):
    schema = "page_id bigint, url string, html string, digest string, `a.b` int"
    return spark.createDataFrame([(*r, "clash", 1) for r in ROWS], schema).repartition(3)


def expected(rows, least=0):
    """(key, bytes, digest, type, refers_to) of each row, by sorting."""
    out = []
    firsts = {}
    for key, _, html in rows:
        payload = (html or "").encode()
        firsts.setdefault(payload, []).append(key)
    for payload, keys in firsts.items():
        keys.sort(key=lambda k: (k is not None, k or 0))
        first = keys.pop()
        about = (len(payload), archive.sha1_text(payload))
        out.append((first, *about, "response", None))
        for k in keys:
            small = len(payload) < least
            out.append((k, *about, "response" if small else "revisit", None if small else first))
    return Counter((*map(str, row),) for row in out)


@pytest.mark.parametrize("least", [0, 11, 10**6])
def test_index_of_odd_pages(spark, pages, tmp_path, least):
    store = Archive(spark, str(tmp_path / "a"))
    store.write(pages, least_bytes=least)
    got = Counter(tuple(map(str, r)) for r in store.index().collect())
    assert got == expected(ROWS, least)
    payloads = [bytes(r["payload"]) for r in store.payloads().collect()]
    assert Counter(payloads) == Counter({(h or "").encode() for _, _, h in ROWS})


def test_restored_payloads_and_copies(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "RECORDS_A_COPY", 2)
    store = Archive(spark, str(tmp_path / "a"))
    store.write(pages)
    got = Counter((r["key"], bytes(r["payload"]).decode()) for r in store.restored().collect())
    assert got == Counter((k, h or "") for k, _, h in ROWS)
    assert store.records().count() == len(ROWS)


def test_records_are_the_headers_and_payloads_byte_by_byte(spark, pages, tmp_path):
    store = Archive(spark, str(tmp_path / "a"))
    store.write(pages)
    headers = {r["uid"]: r for r in store.headers().collect()}
    payloads = {bytes(r["digest"]): bytes(r["payload"]) for r in store.payloads().collect()}
    records = store.records().collect()
    assert len(records) == len(headers) == len(ROWS)
    for r in records:
        h = headers[r["uid"]]
        own = payloads[bytes(h["digest"])] if h["record_type"] == "response" else b""
        assert bytes(r["record"]) == bytes(h["header"]) + own + b"\r\n\r\n"
        assert bytes(r["record"]).split(b"\r\n\r\n")[0].count(b"\r\nEvil") == 0


def test_exported_files_hold_the_records(spark, pages, tmp_path):
    store = Archive(spark, str(tmp_path / "a"))
    store.write(pages.filter("page_id <> 6"))
    store.export(str(tmp_path / "warc"))
    data = b"".join(gzip.open(f).read() for f in (tmp_path / "warc").glob("*.gz"))
    want = [bytes(r["record"]) for r in store.records().collect()]
    found = [b"WARC/1.1\r\n" + r for r in data.split(b"WARC/1.1\r\n")[1:]]
    assert Counter(found) == Counter(want)


def test_changed_payload_is_noticed(spark, pages, tmp_path):
    header = record_header(record_name(1, 0), "u", "d", 3, b"\0" * 20, None)
    with pytest.raises(ValueError, match="payload"):
        parsed(header + b"abc\r\n\r\n")
    with pytest.raises(ValueError, match="length"):
        parsed(header + b"ab\r\n\r\n")
    store = Archive(spark, str(tmp_path / "a"))
    store.write(pages)
    changed = store.payloads().withColumn("payload", F.reverse("payload").cast("binary"))
    rows = changed.collect()
    spark.createDataFrame(rows, changed.schema).write.mode("overwrite").parquet(f"{store.root}/payloads")
    with pytest.raises(PySparkException):
        store.index().collect()


def test_keys_of_any_kind_and_an_empty_table(spark, pages, tmp_path):
    rows = [("a:b>c", "u", "x"), ("", "u", "x"), (None, "u", "y"), ("é%41", "u", "z")]
    named = spark.createDataFrame(rows, "page_id string, url string, html string")
    store = Archive(spark, str(tmp_path / "a"))
    store.write(named)
    assert Counter((r["key"], r["record_type"], r["refers_to"]) for r in store.index().collect()) == Counter(
        [("a:b>c", "response", None), ("", "revisit", "a:b>c"), (None, "response", None), ("é%41", "response", None)]
    )
    none = Archive(spark, str(tmp_path / "b"))
    none.write(pages.limit(0))
    assert none.index().count() == none.restored().count() == 0


def test_given_pages_come_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    store = Archive(spark, str(tmp_path / "a"))
    store.write(pages)
    want = {r["page_id"]: r["html"] for r in pages.collect()}
    assert {r["key"]: bytes(r["payload"]).decode() for r in store.restored().collect()} == want
