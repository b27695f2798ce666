"""Compare every registered query with its SQL: names, types, rows and values.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from panelspark.session import local_session  # noqa: E402

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


def duck(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def key(row):
    return tuple(
        (value is None, "" if value is None else (f"{value:.12g}" if isinstance(value, float) else str(value)))
        for value in row
    )


def differences(spark_df, con, sql) -> list[str]:
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    kinds = [str(d[1]) for d in relation.description]
    theirs = relation.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    columns = sorted(spark_df.columns)
    problems = []
    if columns != sorted(names):
        return [f"columns {columns} != {sorted(names)}"]
    spark_kinds = dict(spark_df.dtypes)
    for i in order:
        want = KINDS.get(spark_kinds[names[i]], spark_kinds[names[i]])
        if want != kinds[i]:
            problems.append(f"type of {names[i]}: {want} != {kinds[i]}")
    ours = [tuple(r[c] for c in columns) for r in spark_df.collect()]
    theirs = [tuple(r[i] for i in order) for r in theirs]
    if len(ours) != len(theirs):
        return problems + [f"rows {len(ours)} != {len(theirs)}"]
    if not ours:
        problems.append("no rows")
    bad = 0
    for mine, other in zip(sorted(ours, key=key), sorted(theirs, key=key)):
        for a, b in zip(mine, other):
            same = a == b or (
                isinstance(a, float) and isinstance(b, float) and (a == b or (math.isnan(a) and math.isnan(b)))
            )
            if not same:
                bad += 1
                if bad <= 3:
                    problems.append(f"{mine} != {other}")
                break
    if bad:
        problems.append(f"{bad} of {len(ours)} rows differ")
    return problems


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = 0
    oracles = entry.oracle_sql()
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                found = differences(df, con, oracles[name])
                rows = ""
            else:
                rows, found = f"{len(df.collect())} rows, no oracle", []
        except Exception as error:  # report and go on
            found, rows = [f"{type(error).__name__}: {str(error)[:700]}"], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {rows}", flush=True)
        for line in found:
            print("     ", line[:900], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
