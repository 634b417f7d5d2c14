"""Run registered queries and their SQL twins on one folder and compare rows: `python -m checks.compare DIR [names]`."""

from __future__ import annotations

import sys
import time

import duckdb

from checks.catalog import QUERIES
from checks.oracles import ORACLES
from tiltmeter.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> str:
    df = QUERIES[name](spark, folder)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return f"rows only: {len(mine)}"
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS differ: {sorted(set(columns) ^ set(df.columns))}"
    if len(mine) != len(theirs):
        return f"ROWS differ: {len(mine)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"VALUES differ in {len(bad)} of {len(mine)} rows of {sorted(columns)}:\n  spark {bad[0][0]}\n  sql   {bad[0][1]}"
    return f"ok {len(mine)} rows"


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                              "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in names:
        start = time.time()
        try:
            verdict = compare(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        if not verdict.startswith(("ok", "rows only")):
            failed.append(name)
        print(f"{name:28s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
