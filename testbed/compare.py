"""Run registered queries in Spark and their oracles in DuckDB and compare every value.

    python -m testbed.compare [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from caudal.session import local_session
import testbed.more_queries  # noqa: F401  registers its queries
from testbed.queries import ORACLE, QUERIES
from testbed.recast import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{type(value).__name__}:{value!r}"


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    table = df.select(*[f"`{n}`" for n in names]).toArrow()
    return names, sorted(tuple(_cell(v) for v in r.values()) for r in table.to_pylist())


def rows_of_duckdb(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = sorted(tuple(_cell(r[i]) for i in order) for r in cursor.fetchall())
    return sorted(names), rows


def difference(spark, con, name: str, sf_dir: str) -> str:
    """Empty if both sides agree."""
    names, ours = rows_of_spark(QUERIES[name](spark, sf_dir))
    if name not in ORACLE:
        return "" if ours else "no rows"
    expected_names, theirs = rows_of_duckdb(con, ORACLE[name])
    if names != expected_names:
        return f"columns {sorted(set(names) ^ set(expected_names))}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, expected {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if not wrong:
        return ""
    cells = {n: (x, y) for n, x, y in zip(names, *wrong[0]) if x != y}
    return f"{len(wrong)} of {len(ours)} rows differ, e.g. {cells}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        started = time.time()
        try:
            problem = difference(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
