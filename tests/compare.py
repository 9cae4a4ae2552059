"""Run registered queries next to their SQL and compare the rows."""

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


def compare(spark, con, name, fn, sql, folder):
    """None if equal, else what differs."""
    df = fn(spark, folder)
    spark_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if spark_names != want_names:
        return f"columns {spark_names} != {want_names}"
    if got != want:
        only_got = [r for r in got[:200000] if r not in set(want)][:3]
        only_want = [r for r in want[:200000] if r not in set(got)][:3]
        return f"{len(got)} rows != {len(want)} rows\n   spark only: {only_got}\n   sql only:   {only_want}"
    return None


def main(folder: str, *wanted: str):
    import __spark_entry__ as entry
    from sentrylane.session import local_session

    spark = local_session("compare", "8")
    spark.sparkContext.setLogLevel("OFF")
    con = database(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, fn, sqls[name], folder)
                note = "ok" if problem is None else "DIFF " + problem
            else:
                problem, note = None, f"rows {fn(spark, folder).count()}"
        except Exception as e:
            problem, note = e, "ERROR " + str(e)[:700]
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
