"""Ranks a pool for a role description: ``python -m tallyrank --pool pool.json --jd role.txt --as-of 2026-05-20``."""

from __future__ import annotations

import argparse
import time
from datetime import date


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from tallyrank.operators import rank as R
    from tallyrank.sources import candidates as S
    from tallyrank.sources.store import write_outputs

    p = argparse.ArgumentParser(prog="tallyrank")
    p.add_argument("--pool", required=True, help="candidates: JSON")
    p.add_argument("--jd", required=True, help="the role description, a text file")
    p.add_argument("--seniority", default="Senior", choices=["Junior", "Mid", "Senior", "Lead", "Principal"])
    p.add_argument("--sector", default="TECH")
    p.add_argument("--out", default="tallyrank_output", help="folders <out>.csv and <out>.json")
    p.add_argument("--top_k", type=int, default=50)
    p.add_argument("--as-of", type=date.fromisoformat, default=None, help="today, as year-month-day")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tallyrank").getOrCreate()
    if not S.exists(spark, a.jd):
        print(f"no role description at {a.jd}")
        return 1
    description = S.read_description(spark, a.jd)
    print(R.preview(description))
    began = time.perf_counter()
    pool, rejected = S.validate(S.read_pool(spark, a.pool))
    if not pool.take(1):
        print(f"no candidates ({rejected.count()} rejected)")
        return 0
    # the command is the one place that reads the clock
    ranked = R.rank(pool, description, a.seniority, a.sector, a.as_of or date.today())
    write_outputs(ranked.rows, f"{a.out}.csv", f"{a.out}.json")
    print(R.console(ranked.rows.filter(ranked.rows["rank"] <= a.top_k), a.seniority))
    print(f"sector {ranked.sector}; {time.perf_counter() - began:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
