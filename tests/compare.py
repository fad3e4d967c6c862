"""Run registered queries against their SQL in DuckDB.

    python tests/compare.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bizlake import suite  # noqa: E402
from bizlake.suite.base import TABLES  # noqa: E402


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value if value is None else str(value)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(str, r))
    )


_KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "date": "DATE", "boolean": "BOOLEAN"}


def compare(name: str, spark: SparkSession, con, folder: str) -> tuple[bool, str]:
    started = time.time()
    df = suite.run(name, spark, folder)
    rows = df.collect()
    took = time.time() - started
    text = suite.oracle(name)
    if text is None:
        return bool(rows), f"rows only: {len(rows)} ({took:.1f}s)"
    result = con.execute(text)
    columns = [d[0] for d in result.description]
    kinds = dict(zip(columns, (str(d[1]) for d in result.description)))
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    wrong = {
        f.name: (f.dataType.simpleString(), kinds[f.name]) for f in df.schema
        if _KIND.get(f.dataType.simpleString(), "?") != kinds[f.name]
    }
    ours, theirs = _rows(df.columns, rows), _rows(columns, expected)
    if ours != theirs:
        differing = [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
        return False, f"{len(ours)} vs {len(theirs)} rows; {sorted(columns)}; {differing}"
    if wrong:
        return False, f"types {wrong}"
    return True, f"{len(rows)} rows ({took:.1f}s)"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    folder = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(folder)
    failed = 0
    for name in suite.QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            good, note = compare(name, spark, con, folder)
        except Exception as error:  # keep going, report all
            good, note = False, "".join(traceback.format_exception_only(error))[:1500]
        failed += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
