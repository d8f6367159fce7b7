"""Runs queries and their SQL side by side: python tests/compare.py [sf0.01] [NAME...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings flights airports train_routes master_elite_routes_full stations cities country_zones mix_targets reading_labels".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v) if v != int(v) else int(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf, name, query, sql):
    """An empty text if both sides agree."""
    df = query(spark, f"{DATA}/{sf}")
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{sf}/{t}.parquet')")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if got != want:
        g, w = set(got), set(want)
        a, b = [r for r in got if r not in w][:3], [r for r in want if r not in g][:3]
        return f"{len(got)} rows against {len(want)}; only here {a}, only in SQL {b}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    from itinera.session import get_session

    spark = get_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args or sorted(queries):
        began = time.time()
        try:
            said = compare(spark, sf, name, queries[name], sql[name]) if name in sql else f"no SQL; {queries[name](spark, f'{DATA}/{sf}').count()} rows"
        except Exception as e:
            said = f"ERROR {str(e)[:600]}"
        print(f"{name}: {said or 'agrees'} ({time.time() - began:.1f} s)", flush=True)
