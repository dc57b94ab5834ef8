"""Command line: ``python -m vitrine list`` or
``python -m vitrine run <query> <sf_dir> [--out PATH] [--format parquet|csv] [--show N]``.

Runs one registered query over the TPC-H-style tables in ``sf_dir`` and
writes the whole result (distributed write) or shows its first rows.
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="vitrine")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered queries")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("query")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    run.add_argument("--show", type=int, default=20)
    run.add_argument("--master", default=os.environ.get("VITRINE_MASTER"))
    args = ap.parse_args(argv)

    from vitrine import catalog

    if args.cmd == "list":
        sql = catalog.oracle_sql()
        for name, fn in sorted(catalog.queries().items()):
            doc = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
            print(f"{name:32s} {'oracle' if name in sql else 'rows  '}  {doc}")
        return 0

    from vitrine.session import build_session
    from vitrine.sources.sinks import write_result

    spark = build_session(app=f"vitrine-{args.query}", master=args.master)
    df = catalog.queries()[args.query](spark, args.sf_dir)
    if args.out:
        write_result(df, args.out, args.format)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
