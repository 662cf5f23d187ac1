"""Run each registered query beside its SQL and compare the rows.

    python tests/check_oracle.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from widemetrics import queries as registered  # noqa: E402
from widemetrics.session import local_session  # noqa: E402


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    rows = sorted(map(tuple, df.itertuples(index=False)), key=repr)
    return pd.DataFrame(rows, columns=df.columns)


def compare(spark, con, name: str, sf_dir: str, source=registered) -> str:
    """Empty where equal, else what differs; source has queries() and oracle_sql()."""
    got = source.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(source.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for c in got.columns:
        if str(got[c].dtype).replace("us", "ns") != str(want[c].dtype).replace("us", "ns"):
            if got[c].notna().all() and want[c].notna().all():
                return f"types of {c}: {got[c].dtype} and {want[c].dtype}"
    a, b = normal(got), normal(want)
    for x, y in zip(a.itertuples(index=False), b.itertuples(index=False)):
        if repr(tuple(map(plain, x))) != repr(tuple(map(plain, y))):
            return f"{tuple(x)} and {tuple(y)}"
    return "" if len(got) else "no rows"


def plain(value):
    return str(float(value)) if isinstance(value, (float, int)) else str(value)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(registered.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = tables(sf_dir), 0
    for name in chosen:
        began = time.time()
        try:
            found = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(found)
        print(f"{'DIFF' if found else 'ok  '} {name} {time.time() - began:.2f}s {found}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
