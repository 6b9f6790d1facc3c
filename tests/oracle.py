"""Compare registered queries with their SQL on the small tables; as a script: python tests/oracle.py [name...]."""

from __future__ import annotations

import math
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.01"


def views(sf_dir: str = SF):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def cell(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else "inf" if math.isinf(x) else round(x, 5)
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    return x


def differs(spark, con, name: str, query, sql: str, sf_dir: str = SF) -> str:
    got = query(spark, sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(got.columns):
        return f"{name}: columns {sorted(got.columns)} against {sorted(names)}"
    order = sorted(names)
    mine = sorted((tuple(cell(r[c]) for c in order) for r in got.collect()), key=repr)
    theirs = sorted((tuple(cell(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:2]
        return f"{name}: {len(mine)} rows against {len(theirs)}; {order}; first differences {bad}"
    return ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, sqls, con = entry.queries(), entry.oracle_sql(), views()
    names = [n for n in queries if any(n.startswith(a) for a in sys.argv[1:])] if len(sys.argv) > 1 else list(queries)
    for n in names:
        t = time.time()
        try:
            said = differs(spark, con, n, queries[n], sqls[n]) if n in sqls else f"{n}: no SQL, {queries[n](spark, SF).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{n}: {type(e).__name__} {str(e)[:600]}"
        print(f"{n} {time.time() - t:.1f}s", said or "ok", flush=True)
