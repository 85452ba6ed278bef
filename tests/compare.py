"""Run registered queries and their SQL side by side.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()]), {
        f.name: f.dataType.simpleString() for f in df.schema
    }


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    return sorted(columns), _rows(columns, cur.fetchall()), types


_SAME = {
    "bigint": "bigint", "int": "integer", "string": "varchar", "double": "double",
    "boolean": "boolean", "timestamp_ntz": "timestamp",
}


def difference(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    cols_a, a, types_a = spark_rows(df)
    cols_b, b, types_b = duck_rows(con, sql)
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}"
    for c in cols_a:
        if _SAME.get(types_a[c], types_a[c]) != types_b[c]:
            return f"type of {c}: {types_a[c]} != {types_b[c]}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if a != b:
        pairs = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(pairs)} rows differ, first {pairs[0]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from wattframe.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                note = difference(df, con, oracle[name]) or "equal"
            else:
                note = f"no sql, {df.count()} rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            note = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += note != "equal" and not note.startswith("no sql")
        print(f"{name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
