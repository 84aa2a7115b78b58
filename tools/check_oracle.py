"""Compare registered queries with their SQL oracle: check_oracle.py [sf_dir] [name ...]."""

import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
entry = importlib.import_module("__spark_entry__")
from poolspark.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in argv[1:] or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name:24s} {len(got[1]):8d} rows {took:6.2f}s", flush=True)
                continue
            start = time.time()
            con.execute(sql[name])
            want = rows_of([d[0] for d in con.description], con.fetchall())
            ok = got == want
            types = {d[0]: str(d[1]) for d in con.description}
            print(f"{'ok   ' if ok else 'DIFF '} {name:24s} {len(got[1]):8d} rows {took:6.2f}s (sql {time.time() - start:.2f}s)", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", got[0], want[0], "n", len(got[1]), len(want[1]))
                g, w = set(got[1]), set(want[1])
                print("   only spark", sorted(g - w)[:3])
                print("   only sql  ", sorted(w - g)[:3])
            spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            odd = {c: (t, types.get(c)) for c, t in spark_types.items() if same.get(t, types.get(c)) != types.get(c)}
            if odd:
                print("   types differ", odd)
        except Exception as error:  # report and go on to the next query
            bad.append(name)
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
