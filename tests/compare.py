"""Run catalogue queries and their SQL side by side: python tests/compare.py [sf] [names...]"""

import pathlib
import sys
import time

import duckdb
import numpy as np

sys.path.insert(0, str(pathlib.Path(__file__).parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame):
    """Column names sorted, and the rows as sorted tuples of plain values."""
    names = sorted(frame.columns)

    def plain(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (float, np.floating)):
            return repr(float(v))
        if isinstance(v, (int, np.integer)):
            return str(int(v))
        return str(v)

    return names, sorted(tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False, name=None))


def difference(spark, con, sf_dir, name):
    """None when equal, else a short description."""
    ours = entry.queries()[name](spark, sf_dir).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    (names_a, a), (names_b, b) = rows_of(ours), rows_of(theirs)
    if names_a != names_b:
        return f"columns {names_a} / {names_b}"
    if a == b:
        return None if len(a) else "no rows"
    bag_a, bag_b = set(a), set(b)
    return f"{len(a)} / {len(b)} rows; only ours {sorted(bag_a - bag_b)[:3]}; only SQL {sorted(bag_b - bag_a)[:3]}"


if __name__ == "__main__":
    from lodestream.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    chosen = sys.argv[2:] or list(entry.oracle_sql())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{scale}"
    con = duck(sf_dir)
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error).split('JVM stacktrace')[0][:900]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - started:.2f}s {found or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} equal")
