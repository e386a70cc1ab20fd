"""Side-by-side comparison of a registered query and its SQL on the same tables."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='oracle-', dir='/tmp')}'")
    con.execute("SET max_temp_directory_size = '2GB'")
    con.execute("SET memory_limit = '6GB'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def type_family(name: str) -> str:
    name = name.lower()
    table = {
        "integer": "int", "int32": "int", "bigint": "bigint", "int64": "bigint", "long": "bigint",
        "varchar": "string", "string": "string", "boolean": "boolean", "double": "double", "float": "float",
        "blob": "binary",
    }
    return table.get(name, name)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, types and all rows agree."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    types = {d[0]: type_family(str(d[1])) for d in relation.description}
    want = _canonical(names, relation.fetchall())
    got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} != {sorted(names)}")
        return out
    for field in df.schema.fields:
        mine = type_family(field.dataType.simpleString())
        if mine != types[field.name]:
            out.append(f"type of {field.name}: {mine} != {types[field.name]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        gs, ws = set(map(repr, got)), set(map(repr, want))
        out.append(f"{sorted(names)}")
        out.append(f"only here: {sorted(gs - ws)[:4]} ({len(gs - ws)})")
        out.append(f"only in SQL: {sorted(ws - gs)[:4]} ({len(ws - gs)})")
    return out


def main() -> None:
    """python -m tests.oracle FOLDER [NAME ...]"""
    import __spark_entry__ as entry
    from frameloom.session import build_session

    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = build_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if chosen and name not in chosen:
            continue
        begin = time.time()
        own = 0.0
        try:
            df = build(spark, folder)
            df.write.format("noop").mode("overwrite").save()
            own = time.time() - begin
            if name in sqls:
                found = differences(df, con, sqls[name])
            else:
                found = [] if df.collect() else ["no rows"]
        except Exception as problem:
            found = [f"{type(problem).__name__}: {str(problem)[:1500]}"]
        spent = time.time() - begin
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} spark {own:.1f}s all {spent:.1f}s" + ("" if name in sqls else " (rows only)"), flush=True)
        for line in found:
            print("     ", line[:1500], flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
