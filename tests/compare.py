"""Run registered queries against their SQL. ``python -m tests.compare FOLDER [name ...]``"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0  # no negative zero
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(frame, con, sql: str) -> str | None:
    """None when columns and rows agree, else what is wrong."""
    result = con.execute(sql)
    wanted_columns = [d[0] for d in result.description]
    wanted = rows_of(wanted_columns, result.fetchall())
    if sorted(frame.columns) != sorted(wanted_columns):
        return f"columns {sorted(frame.columns)} != {sorted(wanted_columns)}"
    found = rows_of(frame.columns, frame.collect())
    if found == wanted:
        return None
    extra, missing = found - wanted, wanted - found
    return (
        f"rows {found.total()} != {wanted.total()}; "
        f"only here {str(list(extra)[:2])[:600]}; only there {str(list(missing)[:2])[:600]}"
    )


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as contract
    from utterance_guard.session import local_session

    spark = local_session(cores="8")
    con = connect(folder)
    queries, sql = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in sql:
                wrong = difference(frame, con, sql[name])
            else:
                wrong = None if frame.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            wrong = f"{type(error).__name__}: {str(error)[:700]}"
        bad += wrong is not None
        print(f"{name:24s} {time.time() - start:6.2f}s {wrong or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
