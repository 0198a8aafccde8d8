"""Run registered queries beside their SQL and compare the results as multisets."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(p)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{p}')")
    return con


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN",
          "date": "DATE", "double": "DOUBLE"}


def compare(spark: SparkSession, con, sf_dir: str, run, sql: str | None) -> tuple[bool, str]:
    """Whether types, row counts and values agree, and a short account."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    if sql is None:
        return True, f"{len(rows)} rows, no SQL"
    inner = ", ".join(f'"{n}"' for n in names)
    cur = con.execute(f"select {inner} from ({sql}) as q")
    types = [str(d[1]) for d in cur.description]
    other = cur.fetchall()
    mine = [_TYPES[df.schema[n].dataType.simpleString()] for n in names]
    if mine != types:
        return False, f"types {mine} vs {types}"
    a = Counter(tuple(_cell(v) for v in r) for r in rows)
    b = Counter(tuple(_cell(v) for v in r) for r in other)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, (f"{len(rows)} vs {len(other)} rows, {sum((a - b).values())} differ\n"
                       f"   columns {names}\n   spark {only_a}\n   sql   {only_b}")
    return True, f"{len(rows)} rows"


def main(argv: list[str]) -> int:
    from tallyframe.session import local_session
    from tallyframe.workload import catalog

    sf_dir = argv[0]
    wanted = argv[1:]
    spark, con = local_session("check"), connect(sf_dir)
    bad = 0
    for name, run in catalog.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, run, catalog.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001 - reported, and the rest still runs
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:45s} {time.time() - t:6.2f}s  {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
