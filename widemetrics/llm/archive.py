"""A content-addressed archive of WARC records: payloads once, headers apart, joined to read."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widemetrics.llm.common import discard, saved_at

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"

#: Tasks that the records of a payload that several share are spread over to learn the response.
SALTS = 16

#: Records of one payload that read one copy of it where whole payloads are restored.
RECORDS_A_COPY = 1 << 12

_RECORD_ID = re.compile(rb"^WARC-Record-ID: (<.*>)\r$", re.M)
_REFERS_TO = re.compile(rb"^WARC-Refers-To: (<.*>)\r$", re.M)
_NAME = re.compile(rb"<urn:page:([^:>]*):\d+>")
_DIGEST = re.compile(rb"^WARC-Payload-Digest: sha1:([A-Z2-7]{32})\r$", re.M)
_TYPE = re.compile(rb"^WARC-Type: ([a-z]+)\r$", re.M)
_LENGTH = re.compile(rb"^Content-Length: ([0-9]+)\r$", re.M)


#: Characters of an address that stay as they are in a header.
_URL_SAFE = ":/?#[]@!$&'()*+,;=%-._~"


def record_name(key: object, uid: int) -> str:
    """A name for a record, with the key unless it is null."""
    return f"<urn:row:{uid}>" if key is None else f"<urn:page:{quote(str(key), safe='')}:{uid}>"


def key_of(name: bytes) -> str | None:
    found = _NAME.fullmatch(name)
    return unquote(found.group(1).decode()) if found else None


def sha1_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_header(
    name: str, url: str | None, date: str, payload_bytes: int, payload_sha1: bytes, original: str | None
) -> bytes:
    """All of a record before its payload: its own header lines and those of the HTTP message.

    name and original name this record and, for a revisit, the one it refers to.
    """
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
    ).encode()
    block = len(http) + (payload_bytes if original is None else 0)
    lines = [
        VERSION,
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(payload_sha1).decode()}",
    ]
    if original is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {original}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode() + http


def parsed(record: bytes) -> tuple[str | None, int, str, str, str | None]:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of a whole record, keys as text.

    Raises ValueError if lengths or digest are not those of what is there.
    """
    end = record.index(b"\r\n\r\n") + 4
    begin = record.index(b"\r\n\r\n", end) + 4
    head, http, block = record[:end], record[end:begin], record[end : -len(RECORD_END)]
    key = key_of(_RECORD_ID.search(head).group(1))
    kind = _TYPE.search(head).group(1).decode()
    digest = _DIGEST.search(head).group(1).decode()
    length = int(_LENGTH.search(http).group(1))
    if int(_LENGTH.search(head).group(1)) != len(block) or not record.endswith(RECORD_END.encode()):
        raise ValueError(f"record {key}: its block is not of the length its header states")
    if kind == "revisit":
        return key, length, digest, kind, key_of(_REFERS_TO.search(head).group(1))
    payload = block[begin - end :]
    if len(payload) != length or sha1_text(payload) != digest:
        raise ValueError(f"record {key}: its payload is not the one its header states")
    return key, length, digest, kind, None


def _with_header(date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            of = zip(*(own[n] for n in ("key", "uid", "url", "payload_bytes", "sha1", "first")))
            headers, kinds = [], []
            for key, uid, url, size, sha1, first in of:
                original = None if first is None else record_name(first["key"], first["uid"])
                headers.append(record_header(record_name(key, uid), url, date, size, sha1, original))
                kinds.append("response" if first is None else "revisit")
            carried = ["key", "uid", "digest", "payload_bytes", "records", "responses"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in carried), pa.array(kinds), pa.array(headers, pa.binary())],
                names=[*carried, "record_type", "header"],
            )

    return run


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        found = list(zip(*map(parsed, batch.column(0).to_pylist()))) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], names=names)


class Archive:
    """Records below one folder: `headers` of each record, `payloads` of each digest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def headers(self) -> DataFrame:
        """(key, uid, digest, payload_bytes, records, responses, record_type, header).

        header holds the exact bytes; records share the payload, and responses of them carry it.
        """
        return self.spark.read.parquet(f"{self.root}/headers")

    def payloads(self) -> DataFrame:
        """(digest, payload), each digest once."""
        return self.spark.read.parquet(f"{self.root}/payloads")

    def write(
        self,
        pages: DataFrame,
        key: str = "page_id",
        url: str = "url",
        payload: str = "html",
        least_bytes: int = 0,
        date: str = "2024-01-01T00:00:00Z",
    ) -> None:
        """A record for each row of pages, which the archive then holds.

        The payload is the text in UTF-8; null counts as empty. Of records with
        equal payloads of least_bytes or more the one with the largest key is
        the response and the others revisit it; of several with that key one is,
        and null keys are below any other. Smaller payloads are responses each.
        Record names have a number of the row behind the key, so repeated rows
        are records of their own. No row of an empty table gives an empty
        archive. Other columns are not read.

        A payload's address is its SHA-256. Records that share it must agree in
        length and in a further hash, or the write stops.
        """
        read = pages.select(
            F.col(key).alias("key"),
            F.col(url).cast("string").alias("url"),
            F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
        )
        address = F.unhex(F.sha2("payload", 256)).alias("digest")
        staged, folder = saved_at(
            read.select(
                "key",
                F.monotonically_increasing_id().alias("uid"),
                "url",
                address,
                F.unhex(F.sha1("payload")).alias("sha1"),
                F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            ),
            "archive-staged",
        )
        # Only a payload that several records share has to be looked up, in one of SALTS tasks.
        shared = (
            staged.groupBy("digest")
            .agg(F.max(F.struct("key", "uid")).alias("response"), F.count("*").alias("records"))
            .filter("records > 1")
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1))))
        )
        salted = staged.withColumn("salt", F.col("uid") % SALTS)
        revisits = (F.col("response.uid") != F.col("uid")) & (F.col("payload_bytes") >= least_bytes)
        records = F.coalesce("records", F.lit(1).cast("bigint"))
        typed = salted.join(shared, ["digest", "salt"], "left").select(
            "key", "uid", "url", "digest", "sha1", "payload_bytes", records.alias("records"),
            F.when(F.col("payload_bytes") >= least_bytes, F.lit(1).cast("bigint")).otherwise(records).alias("responses"),
            F.when(revisits, F.col("response")).alias("first"),
        )
        key_type = read.schema["key"].dataType.simpleString()
        typed.mapInArrow(
            _with_header(date),
            f"key {key_type}, uid bigint, digest binary, payload_bytes bigint, records bigint, "
            "responses bigint, record_type string, header binary",
        ).write.parquet(f"{self.root}/headers")
        discard(self.spark, folder)

        # Equal payloads of a task are one before they are shuffled.
        once = read.select(address, "payload").groupBy("digest").agg(
            F.first("payload").alias("payload"),
            F.min(F.xxhash64("payload")).alias("low"),
            F.max(F.xxhash64("payload")).alias("high"),
        )
        differing = F.raise_error(F.concat(F.lit("payloads differ that share "), F.hex("digest")))
        verified = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(
            differing.cast("binary")
        )
        once.select("digest", verified.alias("payload")).sortWithinPartitions("digest").write.parquet(
            f"{self.root}/payloads"
        )

    def _bodies(self) -> DataFrame:
        """(key, uid, body): records without what ends them."""
        headers = self.headers()
        responses = self._with_payload(headers.filter("record_type = 'response'"), "responses")
        revisits = headers.filter("record_type <> 'response'").select("key", "uid", F.col("header").alias("body"))
        return responses.select("key", "uid", F.concat("header", "payload").alias("body")).unionByName(revisits)

    def records(self) -> DataFrame:
        """(key, uid, record): the original records, byte by byte.

        Responses are joined with their payloads; revisits have none of their own.
        """
        end = F.lit(RECORD_END).cast("binary")
        return self._bodies().select("key", "uid", F.concat("body", end).alias("record"))

    def restored(self) -> DataFrame:
        """(key, uid, payload) of every record, revisits with the payload they refer to."""
        return self._with_payload(self.headers(), "records").select("key", "uid", "payload")

    def _with_payload(self, headers: DataFrame, asking: str) -> DataFrame:
        """Headers with their payloads. `asking` names the column that says how many of them have
        the same; a payload for more than RECORDS_A_COPY is there in copies, each for so many."""
        few = headers.filter(F.col(asking) <= RECORDS_A_COPY)
        many = headers.filter(F.col(asking) > RECORDS_A_COPY)
        found = few.join(self.payloads().hint("merge"), "digest")
        if many.isEmpty():
            return found
        copies = F.floor((F.col(asking) - 1) / RECORDS_A_COPY).cast("bigint") + 1
        needed = many.groupBy("digest").agg(F.max(copies).alias("copies"))
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")
        copied = self.payloads().join(needed, "digest").select("digest", "payload", each)
        spread = many.withColumn("copy", F.pmod("uid", copies)).join(copied.hint("merge"), ["digest", "copy"])
        return found.unionByName(spread.drop("copy"))

    def index(self) -> DataFrame:
        """(key, payload_bytes, payload_digest, record_type, refers_to), read from the records and
        checked against their bytes; keys as text."""
        return self.records().select("record").mapInArrow(
            _indexed,
            "key string, payload_bytes bigint, payload_digest string, record_type string, refers_to string",
        )

    def export(self, path: str) -> None:
        """WARC files, gzipped, one for each task's records. A header's line ends and a text
        payload are text to Spark, whose writer ends each record by the bytes that records end with."""
        bodies = self._bodies().select(F.col("body").cast("string").alias("value"))
        bodies.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)
