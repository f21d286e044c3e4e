"""Compare registered queries with their SQL on DuckDB: python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}" if not v.is_integer() else f"{int(v)}.0"
        return repr(v.item() if hasattr(v, "item") else v)

    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


def compare(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    # Integers with NULLs come as floats from the one and as nullable integers from the other.
    whole = [c for c in sql_rows.columns if str(sql_rows[c].dtype).startswith("Int") and spark_rows[c].dtype == float]
    a, b = canonical(spark_rows.astype(dict.fromkeys(whole, "Int64"))), canonical(sql_rows)
    if a == b:
        return ""
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}"


def kinds(spark_types, sql_types) -> str:
    """Column types that would compare as different kinds of value."""
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "float": "FLOAT", "timestamp": "TIMESTAMP",
    }
    off = [f"{n}: {t} vs {sql_types[n]}" for n, t in spark_types.items() if same.get(t, t) != sql_types.get(n)]
    return "; ".join(off)


def main() -> int:
    import __spark_entry__ as entry
    from tessitura.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = args[1:]
    queries, sqls = entry.queries(), entry.oracle_sql()
    if names:
        queries = {k: v for k, v in queries.items() if any(k == n or (n.endswith("*") and k.startswith(n[:-1])) for n in names)}
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name, query in queries.items():
        t0 = time.time()
        try:
            frame = query(spark, sf_dir)
            types = dict(frame.dtypes)
            got = frame.toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark {type(e).__name__}: {str(e)[:900]}", flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"rows  {name}: {len(got)} rows, spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            sql_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            want = rel.df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: sql {type(e).__name__}: {str(e)[:900]}", flush=True)
            continue
        t2 = time.time()
        msg = compare(got, want) or (f"types {kinds(types, sql_types)}" if kinds(types, sql_types) else "")
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '}  {name}: {len(got)} rows, spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s {msg[:700]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
