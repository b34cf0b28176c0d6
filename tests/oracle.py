"""Run registered queries on Spark and DuckDB and compare rows.

    python tests/oracle.py [sf] [name or prefix* ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def normalized(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
         "DATE": "date", "SMALLINT": "smallint"}


def compare(df, con, sql: str) -> str | None:
    """None when rows and types agree, else a short account of the difference."""
    rel = con.sql(sql)
    got_cols, want_cols = df.columns, list(rel.columns)
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want_types = {c: KINDS.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    got = normalized(got_cols, [tuple(r) for r in df.collect()])
    want = normalized(want_cols, rel.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {a!r} != {b!r}"[:600]
    bad = {c: (got_types[c], want_types[c]) for c in got_types if got_types[c] != want_types[c]}
    return f"types {bad}" if bad else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from paperweave.session import build_session

    sf, picks = (argv + ["0.01"])[0], argv[1:]
    sf_dir = f"{ROOT}/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if picks and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in picks):
            continue
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                message = compare(df, con, oracle[name])
                status = "ok" if message is None else f"FAIL {message}"
            else:
                status = f"rows-only {df.count()}"
        except Exception as exc:  # noqa: BLE001
            status = f"FAIL {type(exc).__name__}: {str(exc)[:500]}"
        failed += status.startswith("FAIL")
        print(f"{name:32s} {time.time() - start:6.2f}s {status}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
