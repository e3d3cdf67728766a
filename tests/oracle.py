"""Compare registered queries with their SQL twins.

    python -m tests.oracle [--sf 0.01] [--explain] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridpanel.sources import scratch  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cores: int = 8, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridpanel-tests")
        .config(scratch.SETTING, tempfile.mkdtemp(prefix="gridpanel-"))  # one machine, so it is shared
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sf_path(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return repr(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    from driver_queries import ORACLES, QUERIES

    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got_names, got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in ORACLES:
        return len(got) > 0, f"{len(got)} rows, no twin, {t1 - t0:.1f}s"
    cur = con.execute(ORACLES[name])
    want_names, want = _canonical([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    timing = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; {timing}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        sample = "\n".join(f"   spark {g}\n   sql   {w}" for g, w in bad[:3])
        return False, f"{len(bad)} rows differ; {timing}\n   {got_names}\n{sample}"
    # a few queries have nothing to report on the smallest tables
    return True, timing


def main() -> int:
    from driver_queries import QUERIES

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()
    spark = session()
    sf_dir = sf_path(args.sf)
    con = duck(sf_dir)
    failed = 0
    for name in args.names or QUERIES:
        if args.explain:
            QUERIES[name](spark, sf_dir).explain("formatted")
            continue
        try:
            ok, message = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
