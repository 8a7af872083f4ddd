"""Run registered queries against their SQL in DuckDB, row for row."""

from __future__ import annotations

import collections
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(spark_df):
    names = sorted(spark_df.columns)
    return names, collections.Counter(tuple(r) for r in spark_df.select(*names).collect())


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), collections.Counter(tuple(r[i] for i in order) for r in cur.fetchall())


def difference(spark, con, build, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short account of the difference."""
    names, ours = rows_of(build(spark, sf_dir))
    sql_names, theirs = sql_rows(con, sql)
    if names != sql_names:
        return f"columns {names} / {sql_names}"
    if ours != theirs:
        only, other = ours - theirs, theirs - ours
        return (
            f"{sum(ours.values())} / {sum(theirs.values())} rows; "
            f"only here {list(only.items())[:2]}; only SQL {list(other.items())[:2]}"
        )
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from archivemill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    checks = entry.oracle_sql()
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            found = difference(spark, con, build, checks[name], folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            found = str(error)[:600]
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
