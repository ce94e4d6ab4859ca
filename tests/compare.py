"""Compares registered queries with their SQL twins: column names, row counts and every value."""

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else repr(value)
    if isinstance(value, float):
        return repr(float(f"{value:.10g}"))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def check(spark, con, folder, query, text):
    """(ok, message) for one query."""
    start = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = f"spark {time.time() - start:.1f}s"
    if text is None:
        return True, f"{len(got)} rows, no SQL twin, {took}"
    result = con.execute(text)
    want_names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} != {sorted(want_names)}"
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a == b:
        return True, f"{len(a)} rows, {took}"
    sa, sb = set(a), set(b)
    return False, (f"{len(a)} rows vs {len(b)}; only spark: {sorted(sa - sb)[:3]} ({len(sa - sb)}); "
                   f"only sql: {sorted(sb - sa)[:3]} ({len(sb - sa)})")


def main(folder, names):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from folioscope.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ok, message = check(spark, con, folder, query, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {message} ({time.time() - start:.1f}s)", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) and 1)
