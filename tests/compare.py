"""Run registered queries against their DuckDB SQL: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(spark, con, sf_dir: str, fn, sql: str) -> list[str]:
    """Messages about schema, row count and value differences; empty when equal."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    types = dict(df.dtypes)
    cursor = con.execute(sql)
    got_types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    order = [d[0] for d in cursor.description]
    out = []
    if sorted(order) != names:
        return [f"columns {names} != {sorted(order)}"]
    for n in names:
        want = TYPES.get(types[n], types[n])
        if want != got_types[n] and not got_types[n].endswith("[]"):
            out.append(f"type of {n}: {types[n]} vs {got_types[n]}")
    index = [order.index(n) for n in names]
    right = sorted((tuple(map(repr, (r[i] for i in index))) for r in expected))
    left = sorted((tuple(map(repr, (r[n] for n in names))) for r in df.collect()))
    if len(left) != len(right):
        out.append(f"rows {len(left)} vs {len(right)}")
    if left != right:
        only = sorted(set(left) - set(right))[:3]
        missing = sorted(set(right) - set(left))[:3]
        out.append(f"values differ: spark {only} sql {missing}")
    return out


def main() -> None:
    from panelsmith.queries import ORACLES, QUERIES
    from panelsmith.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            if name in ORACLES:
                problems = differences(spark, con, sf_dir, QUERIES[name], ORACLES[name])
                status = "ok" if not problems else "DIFF " + "; ".join(problems)[:700]
            else:
                status = f"rows {len(QUERIES[name](spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001 - report and go on
            status = "ERROR " + str(e)[:900]
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - started:6.1f}s {status}", flush=True)
    print(f"{len(names)} queries, {bad} not equal")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
