"""Shapes shared by every module: the long datum form and the value types."""

from __future__ import annotations

STATSET_DDL = "struct<minimum:double,maximum:double,samplesum:double,samplecount:bigint>"
HISTOGRAM_DDL = "map<bigint,bigint>"
CENTROID_DDL = "struct<mean:double,weight:bigint>"
TDIGEST_DDL = (
    "struct<max_buckets:int,count:bigint,sum:double,min:double,max:double,"
    f"centroids:array<{CENTROID_DDL}>>"
)

# One field per member of the wire oneof; at most one of them is not null.
DIMENSION_MEMBERS = {"String": "string", "Number": "decimal(20,0)", "Boolean": "boolean"}
MEASUREMENT_MEMBERS = {
    "I64": "bigint",
    "I32": "int",
    "F64": "double",
    "F32": "float",
    "StatisticSet": STATSET_DDL,
    "Histogram": HISTOGRAM_DDL,
    "Tdigest": TDIGEST_DDL,
}


def _struct_ddl(members: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{name}:{ddl}" for name, ddl in members.items()) + ">"


DIMENSION_DDL = _struct_ddl(DIMENSION_MEMBERS)
MEASUREMENT_DDL = _struct_ddl(MEASUREMENT_MEMBERS)

# unix_nanos is an unsigned 64-bit number on the wire.
DATUM_DDL = (
    "metric string, unix_nanos decimal(20,0), "
    f"dimensions map<string,{DIMENSION_DDL}>, "
    f"measurements map<string,{MEASUREMENT_DDL}>"
)

# Oneof member -> column type. The position is the type rank that settles
# which type a column gets when several arrive at the same instant, so
# dimensions come before measurements.
COLUMN_TYPES = [
    ("dimension", "String", "string"),
    ("dimension", "Number", "bigint"),
    ("dimension", "Boolean", "boolean"),
    ("measurement", "I64", "bigint"),
    ("measurement", "I32", "int"),
    ("measurement", "F64", "double"),
    ("measurement", "F32", "float"),
    ("measurement", "StatisticSet", "statistic_set"),
    ("measurement", "Histogram", "histogram"),
    ("measurement", "Tdigest", "tdigest"),
]

SPARK_TYPES = {
    "string": "string",
    "bigint": "bigint",
    "boolean": "boolean",
    "int": "int",
    "double": "double",
    "float": "float",
    "statistic_set": STATSET_DDL,
    "histogram": HISTOGRAM_DDL,
    "tdigest": TDIGEST_DDL,
}

# Column names the storage layout needs for itself.
RESERVED_COLUMNS = ("time", "chunk", "table", "writer", "batch")

CHUNK_SECONDS = 4 * 3600
DEFAULT_RETENTION_SECONDS = 7 * 24 * 3600
