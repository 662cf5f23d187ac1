"""Time-chunked wide tables with a schema that heals itself.

Folders below the root:

    registry/N                                        version N of the schema: what it added (JSON)
    data/outcome=row/table=T/chunk=C/writer=W/batch=B/  rows, newest first in each file
    data/outcome=.../table=T/chunk=.../writer=W/batch=B/  datums that went into no table, by reason
    staging/                                          a batch while it is being loaded
    attempts/writer=W/B                               the batch that a named writer was last at

A version of the schema belongs to the writer that makes its file; one that
comes too late reads the registry again and decides anew, so all versions
follow from one another whoever writes. ``chunk`` is the start of four hours in epoch seconds; it lies above the
batches, so a read with bounds lists the folders of its chunks and no others.
Every batch belongs to a writer: a stream is one for as long as it has its
checkpoint, and each other write is one of its own. Writing a batch again
replaces that batch's folders and nothing else, and writers cannot meet.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from widemetrics.functions.ident import clean_id, clean_name
from widemetrics.functions.timefn import chunk_of, nanos_to_ts
from widemetrics.operators import wide
from widemetrics.operators.wide import ColumnSpec
from widemetrics.schema import CHUNK_SECONDS, DATUM_DDL, DEFAULT_RETENTION_SECONDS
from widemetrics.session import Folder

#: A datum as it came, the text of one that could not be read, and why it is here.
REJECTS_DDL = f"table string, {DATUM_DDL}, malformed string, conflicts array<string>, reason string"

#: Where a reject lies among the columns of rows, which cannot have this name.
_DATUM = "!datum"

_ROW, _STRAY = "row", "stray"


def epoch_seconds(moment: datetime | int) -> int:
    """Epoch seconds of a datetime; one without a zone is UTC."""
    if isinstance(moment, int):
        return moment
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp() // 1)


class MetricStore:
    """Wide metric tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, parallel_jobs: int = 4):
        self.spark = spark
        self.root = root.rstrip("/")
        self.parallel_jobs = parallel_jobs

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _each(self, work: Callable, items: Iterable) -> None:
        with ThreadPoolExecutor(max_workers=self.parallel_jobs) as pool:
            list(pool.map(work, items))

    # Schema registry

    def _registry(self) -> list[dict]:
        """All entries in the order of their versions."""
        folder = Folder(self.spark, self._path("registry"))
        return [
            {"version": int(v)} | json.loads(line) for v in folder.names() for line in folder.read(v).splitlines()
        ]

    @staticmethod
    def _merged(registry: list[dict]) -> dict[str, list[ColumnSpec]]:
        merged: dict[str, dict[str, ColumnSpec]] = {}
        for r in registry:
            columns = merged.setdefault(r["table"], {})
            if r["column"] is None:
                continue
            sources = tuple(map(tuple, r["sources"]))
            held = columns.get(r["column"])
            if held is None:
                held = ColumnSpec(r["column"], r["kind"], r["type"], sources)
            else:
                both = tuple(sorted({*held.sources, *sources}))
                held = ColumnSpec(held.name, held.kind, held.type, both)
            columns[r["column"]] = held
        return {t: wide.column_order(c.values()) for t, c in merged.items()}

    def schemas(self) -> dict[str, list[ColumnSpec]]:
        """Columns of every table. The first entry for a column fixes its type."""
        return self._merged(self._registry())

    def heal(self, found: dict[str, list[ColumnSpec]]) -> dict[str, list[ColumnSpec]]:
        """Register missing tables, columns and source keys; give each table's columns.

        Of the columns given, only those found are returned, with the types the
        registry holds for them. Doing it twice changes nothing.
        """
        while True:
            registry = self._registry()
            news, healed = self._missing(registry, found)
            if not news:
                return healed
            version = registry[-1]["version"] + 1 if registry else 1
            text = "\n".join(map(json.dumps, news))
            if Folder(self.spark, self._path("registry")).claim(f"{version:012d}", text):
                return healed

    def _missing(self, registry: list[dict], found: dict[str, list[ColumnSpec]]) -> tuple[list, dict]:
        """Entries that the registry lacks, and each table's columns as they are with them."""
        known = {t: {c.name: c for c in cols} for t, cols in self._merged(registry).items()}
        news, healed = [], {}

        def add(table: str, column: ColumnSpec | None) -> None:
            entry = {"table": table, "column": column and column.name}
            if column is not None:
                entry |= {"kind": column.kind, "type": column.type, "sources": column.sources}
            news.append(entry)

        for table, columns in found.items():
            if table not in known:
                add(table, None)
            held = known.get(table, {})
            resolved = []
            for spec in columns:
                old = held.get(spec.name)
                if old is None or not set(spec.sources) <= set(old.sources):
                    add(table, spec)
                if old is not None:
                    same = spec.uniform and spec.type == old.type
                    spec = ColumnSpec(spec.name, old.kind, old.type, spec.sources, same)
                resolved.append(spec)
            healed[table] = wide.column_order(resolved)
        return news, healed

    # Writing

    def write(
        self,
        datums: DataFrame,
        writer: str | None = None,
        batch: int = 0,
        on_conflict: str = "quarantine",
    ) -> str:
        """Load datums into their tables; gives the writer's name.

        Every row ends up in a table or among the rejects. A datum without any
        value is a row with the time alone. Rejected, with the reason, are
        datums without a name, without a time, and those whose text could not
        be read (a ``malformed`` column, as parse_datums gives, is heeded);
        also rows with a value that does not read as its column's type
        (``conflict``), or with ``drop_batch`` all rows of such a table (the
        others being ``companion``).

        The columns are found in a first pass over the keys, which also tells
        whether there are strays. A second pass then writes rows and rejects in
        one go, by their outcome. If tables differ in their columns, that pass
        splits the datums by table into a staging folder, and each set of
        columns is loaded from there; the input is decoded twice in any case.
        """
        if on_conflict not in ("quarantine", "drop_batch"):
            raise ValueError(f"unknown conflict policy: {on_conflict}")
        if writer is None:
            writer = uuid.uuid4().hex
        else:
            self._begin(writer, batch)
        text = F.col("malformed") if "malformed" in datums.columns else F.lit(None).cast("string")
        table = F.nullif(clean_id("metric"), F.lit(""))
        reason = (
            F.when(text.isNotNull(), "malformed")
            .when(table.isNull(), "unnamed")
            .when(F.col("unix_nanos").isNull(), "untimed")
        )
        placed = datums.select(
            table.alias("table"),
            chunk_of(nanos_to_ts("unix_nanos")).alias("chunk"),
            "metric",
            "unix_nanos",
            "dimensions",
            "measurements",
            text.alias("malformed"),
            reason.alias("reason"),
        )
        fine = F.col("reason").isNull()
        # Strays show as a table without a name, and bring no keys along.
        loadable = placed.select(
            *[F.when(fine, F.col(c)).alias(c) for c in ("metric", "unix_nanos", "dimensions", "measurements")]
        )
        found = wide.collect_schema(wide.discover_tables(loadable))
        strays = found.pop(None, None) is not None
        # Tables with the same columns from the same keys share one job.
        groups: dict[tuple[ColumnSpec, ...], list[str]] = {}
        for name, columns in self.heal(found).items():
            groups.setdefault(tuple(columns), []).append(name)
        if len(groups) < 2:
            columns = next(iter(groups), ())
            self._load(placed, columns, writer, batch, on_conflict, strays)
            return writer

        folder = self._path("staging", uuid.uuid4().hex)
        staged = placed.withColumn("stray", ~fine).hint("rebalance", "stray", "table")
        staged.write.partitionBy("stray", "table").parquet(folder)
        schema = StructType([*placed.schema.fields, StructField("stray", BooleanType())])
        source = self.spark.read.schema(schema).parquet(folder)

        def load(item: tuple[tuple[ColumnSpec, ...], list[str] | None]) -> None:
            columns, tables = item
            chosen = F.col("stray") if tables is None else ~F.col("stray") & F.col("table").isin(*tables)
            rows = source.where(chosen).drop("stray")
            self._load(rows, columns, writer, batch, on_conflict, tables is None)

        try:
            self._each(load, [*groups.items(), *[((), None)] * strays])
        finally:
            Folder(self.spark, folder).delete()
        return writer

    def _load(
        self,
        source: DataFrame,
        columns: Sequence[ColumnSpec],
        writer: str,
        batch: int,
        on_conflict: str,
        strays: bool,
    ) -> None:
        """Rows and rejects of tables with these columns, in one write."""
        carried = ["table", "metric", "unix_nanos", "dimensions", "measurements", "malformed"]
        datum = F.struct(*carried, "reason").alias(_DATUM)
        mixed = not all(c.uniform for c in columns)
        keep = ["table", "chunk", *[datum] * (mixed or strays)]
        rows = wide.project(source, columns, keep)
        given = F.lit(_ROW)
        if mixed or strays:
            why = F.col(f"`{_DATUM}`.reason")
            conflict = F.size("__conflicts") > 0
            given = F.when(why.isNotNull(), _STRAY).when(conflict, "conflict")
            if mixed and on_conflict == "drop_batch":
                clash = rows.where(why.isNull() & conflict).select("table").distinct()
                # Names of tables, of this group alone.
                bad = [r["table"] for r in clash.toLocalIterator()]
                given = given.when(F.col("table").isin(*bad), "companion") if bad else given
            given = given.otherwise(_ROW)
            reason = F.when(why.isNotNull(), why).otherwise(F.col("outcome"))
            fields = [F.col(f"`{_DATUM}`.{c}").alias(c) for c in carried]
            reject = F.struct(*fields, F.col("__conflicts").alias("conflicts"), reason.alias("reason"))
            rejected = F.col("outcome") != _ROW
            rows = rows.withColumn("outcome", given).withColumns(
                {
                    _DATUM: F.when(rejected, reject),
                    "chunk": F.when(~rejected, F.col("chunk")),
                }
            )
        else:
            rows = rows.withColumn("outcome", given)
        parts = ["outcome", "table", "chunk", "writer", "batch"]
        folder = self._path("staging", uuid.uuid4().hex)
        # Rebalancing splits a chunk that holds too much and joins small ones,
        # so a busy table keeps no single task waiting.
        (
            rows.drop("__conflicts")
            .withColumns({"writer": F.lit(writer), "batch": F.lit(batch).cast("bigint")})
            .hint("rebalance", "outcome", "table", "chunk")
            .sortWithinPartitions(*parts, F.col("time").desc())
            .write.partitionBy(*parts)
            .parquet(folder)
        )
        # Each job has a folder of its own, as several may write at a time; what
        # it wrote takes its place then, folder by folder.
        written = Folder(self.spark, folder)
        leaves = written.glob("/".join(f"{p}=*" for p in parts))
        placed = [leaf[leaf.index("/outcome=") :] for leaf in leaves]
        self._each(lambda part: written.move(part[1:], f"{self._path('data')}{part}"), placed)
        written.delete()

    def _begin(self, writer: str, batch: int) -> None:
        """Take away what an earlier attempt at this batch has left; the last attempt is on file."""
        attempts = Folder(self.spark, self._path("attempts", f"writer={writer}"))
        before, mark = attempts.names(), f"{batch:012d}"
        if not attempts.claim(mark, ""):
            pattern = f"outcome=*/table=*/chunk=*/writer={writer}/batch={batch}"
            left = Folder(self.spark, self._path("data")).glob(pattern)
            self._each(lambda path: Folder(self.spark, path).delete(), left)
        for name in before:
            if name != mark:
                attempts.child(name).delete()

    # Reading

    def read(
        self,
        metric: str,
        lo: datetime | int | None = None,
        hi: datetime | int | None = None,
        layout: bool = False,
    ) -> DataFrame:
        """A metric's wide table, with ``lo < time <= hi`` where those are given.

        Chunks out of bounds are not even listed. ``layout`` keeps the chunk column.
        """
        table = clean_name(self.spark, metric)
        columns = self.schemas().get(table)
        if columns is None:
            raise KeyError(f"no table {table}")
        body = "time timestamp" + "".join(f", `{c.name}` {c.spark_type}" for c in columns)
        low = None if lo is None else epoch_seconds(lo) - CHUNK_SECONDS
        high = None if hi is None else epoch_seconds(hi)
        paths = [
            path
            for path, _, chunk in self._chunks(table)
            if (low is None or chunk > low) and (high is None or chunk <= high)
        ]
        schema = f"{body}, chunk bigint, writer string, batch bigint"
        if paths:
            base = self._path("data", f"outcome={_ROW}", f"table={table}")
            rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        else:
            rows = self.spark.createDataFrame([], schema)
        if lo is not None:
            rows = rows.where(F.col("time") > _moment(lo))
        if hi is not None:
            rows = rows.where(F.col("time") <= _moment(hi))
        return rows.select("time", *[c.name for c in columns], *["chunk"] * layout)

    def latest(self, metric: str) -> datetime | None:
        """The newest time in a metric's table; None if it has no row.

        Only the newest chunk's files are opened, and of those the times alone.
        """
        table = clean_name(self.spark, metric)
        if table not in self.schemas():
            raise KeyError(f"no table {table}")
        for path, _, _ in sorted(self._chunks(table), key=lambda c: -c[2]):
            # A chunk without a row is one that a writer is at, or left at a fault.
            newest = self.spark.read.schema("time timestamp").parquet(path).agg(F.max("time")).first()[0]
            if newest is not None:
                return newest
        return None

    def _schema(self, ddl: str) -> StructType:
        return self.spark.createDataFrame([], ddl).schema

    def rejects(self) -> DataFrame:
        """Datums that went into no table, as they came, with the reason."""
        found = Folder(self.spark, self._path("data")).glob("outcome=*")
        paths = [p for p in found if not p.endswith(f"={_ROW}")]
        if not paths:
            return self.spark.createDataFrame([], f"{REJECTS_DDL}, writer string, batch bigint")
        datum = StructType([StructField(_DATUM, self._schema(REJECTS_DDL))])
        placed = self._schema("outcome string, table string, chunk bigint, writer string, batch bigint")
        schema = StructType([*datum.fields, *placed.fields])
        rows = self.spark.read.schema(schema).option("basePath", self._path("data")).parquet(*paths)
        return rows.select(f"`{_DATUM}`.*", "writer", "batch")

    # Maintenance

    def _chunks(self, table: str = "*") -> list[tuple[str, str, int]]:
        """(path, table, chunk) of every chunk's folder; nothing below is listed."""
        pattern = re.compile(r"table=([^/]*)/chunk=(-?\d+)$")
        rows = Folder(self.spark, self._path("data", f"outcome={_ROW}"))
        found = rows.glob(f"table={table}/chunk=*")
        matches = [(p, pattern.search(p)) for p in found]
        return [(p, m.group(1), int(m.group(2))) for p, m in matches if m]

    def apply_retention(
        self, now: datetime | int, keep_seconds: int = DEFAULT_RETENTION_SECONDS
    ) -> list[str]:
        """Delete chunks that end at or before ``now - keep``; gives their folders."""
        limit = epoch_seconds(now) - keep_seconds
        gone = [path for path, _, chunk in self._chunks() if chunk + CHUNK_SECONDS <= limit]
        self._each(lambda path: Folder(self.spark, path).delete(), gone)
        return gone


def daily_copy(rows: DataFrame, path: str, time: str = "time") -> None:
    """A wide table as one folder a day, newest rows first, in files of narrow spans of time."""
    newest = F.col(time).desc()
    (
        rows.withColumn("day", F.to_date(time))
        # The second column lets rows of one instant go to several tasks.
        .repartitionByRange(newest, F.xxhash64(*rows.columns[:4]))
        .sortWithinPartitions("day", newest)
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )


def _moment(value: datetime | int) -> Column:
    if isinstance(value, int):
        return F.timestamp_seconds(F.lit(value))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(round(value.timestamp() * 1_000_000)))


def write_metrics(datums: DataFrame, root: str, **options) -> str:
    """Load datums into the store at ``root``."""
    return MetricStore(datums.sparkSession, root).write(datums, **options)
