"""Command line: run named queries over a folder of test tables and print or write them.

    python -m churnlens.run --sf-dir /root/testdata/sf0.01 --query churn_rate --query reason_share
    python -m churnlens.run --sf-dir ... --all --out /shared/marts     (parquet per query)
    python -m churnlens.run --list
"""

from __future__ import annotations

import argparse


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="churnlens.run")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--query", action="append", default=[])
    ap.add_argument("--all", action="store_true")
    ap.add_argument("--list", action="store_true")
    ap.add_argument("--out", help="write each result as parquet under this folder instead of printing")
    ap.add_argument("--rows", type=int, help="print at most so many rows of a table (default: all)")
    ap.add_argument("--cores", default="*")
    args = ap.parse_args(argv)

    from .plans.catalog import QUERIES

    if args.list:
        print("\n".join(sorted(QUERIES)))
        return
    from .plans.context import Context
    from .plans.presentation import present
    from .session import local_session

    spark = local_session(args.cores)
    ctx = Context.from_testdata(spark, args.sf_dir)
    names = sorted(QUERIES) if args.all else args.query
    for name in names:
        df = QUERIES[name](ctx)
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
            print(f"{name}: written")
        else:
            print(f"== {name}")
            table = present(name, df)
            table.show(table.count() if args.rows is None else args.rows, truncate=False)


if __name__ == "__main__":
    main()
