"""Run registered queries next to their SQL and compare whole results.

    python tests/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from seriesloom.plans.registry import TABLES  # noqa: E402
from seriesloom.session import build_session  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item") and not isinstance(value, (list, tuple)):
        try:
            value = value.item()
        except ValueError:
            pass
    if isinstance(value, decimal.Decimal):
        return float(value)
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, folder, fn, sql):
    """Empty string when equal, else a short account of the difference."""
    got = fn(spark, folder)
    cols, mine = rows_of(got.columns, got.collect())
    if sql is None:
        return "" if mine else "no rows"
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(mine) != len(want):
        return f"rows {len(mine)} != {len(want)}; e.g. {mine[:1]} / {want[:1]}"
    if not mine:
        return "no rows"
    bad = [(a, b) for a, b in zip(mine, want) if a != b]
    kinds = [
        (c, type(x), type(y))
        for row_a, row_b in zip(mine[:50], want[:50])
        for c, x, y in zip(cols, row_a, row_b)
        if x is not None and y is not None and type(x) is not type(y)
    ]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ; {cols}; first {bad[0]}"
    return f"types {kinds[:3]}" if kinds else ""


def main(argv):
    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        folder, argv = argv[1], argv[2:]
    from __spark_entry__ import oracle_sql, queries

    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        begin = time.time()
        try:
            problem = compare(spark, con, folder, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += bool(problem)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind:4} {time.time() - begin:6.2f}s {name} {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
