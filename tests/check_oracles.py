"""Compare registered queries with their SQL counterparts (`python tests/check_oracles.py [names]`)."""

import sys
import time
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Problem text, or None when both results are equal."""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(want_cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a != b:
        only_a = sorted(set(a) - set(b))[:4]
        only_b = sorted(set(b) - set(a))[:4]
        return (f"rows {len(a)} vs {len(b)} cols={sorted(want_cols)}\n"
                f"   spark only: {only_a}\n   sql only:   {only_b}")
    floats = {c for c, k in df.dtypes if k in ("double", "float")}
    for i, c in enumerate(want_cols):
        sample = next((r[i] for r in want if r[i] is not None), None)
        if isinstance(sample, float) != (c in floats) and sample is not None:
            return f"type of {c}: {dict(df.dtypes)[c]} vs {type(sample).__name__}"
    return None


def main(names, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from tests.conftest import make_session
    import __spark_entry__ as entry

    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, con, oracles[name]) if name in oracles else (
                None if df.count() else "no rows")
            n = "" if name in oracles else " (no sql)"
        except Exception as exc:  # report and go on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{n} {time.time() - start:.1f}s"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
