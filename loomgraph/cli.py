"""``python -m loomgraph.cli pagerank|sssp|upload|download|delete|vacuum|report ...``"""

from __future__ import annotations

import argparse
import time

from .operators import pagerank as pr
from .operators import sssp as sp
from .operators.dedup_store import DedupStore, report_lines
from .session import session, ship
from .sources import edges as src


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("pagerank")
    a.add_argument("alpha", type=float)
    a.add_argument("iterations", type=int)
    a.add_argument("input")
    a.add_argument("output")
    a = sub.add_parser("sssp")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("source", type=int)
    a.add_argument("iterations", type=int)
    a.add_argument("mode", help="weighted, or anything else for hops")
    a = sub.add_parser("upload")
    for name in ("min", "avg", "max", "base"):
        a.add_argument(name, type=int)
    a.add_argument("path")
    a.add_argument("store", help="a folder of any file system that Spark can write")
    a = sub.add_parser("download")
    a.add_argument("path")
    a.add_argument("target")
    a.add_argument("store")
    a = sub.add_parser("delete")
    a.add_argument("path")
    a.add_argument("store")
    for name in ("vacuum", "repair", "report"):
        sub.add_parser(name).add_argument("store")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    began = time.perf_counter()
    spark = session()
    ship(spark)
    if args.command == "pagerank":
        ranks = pr.pagerank(src.read_edges(spark, args.input, weighted=False), args.alpha, args.iterations)
        src.write_lines(src.rank_lines(ranks), args.output)
    elif args.command == "sssp":
        weighted = args.mode == "weighted"
        found = sp.sssp(src.read_edges(spark, args.input, weighted), args.source, args.iterations, weighted)
        src.write_lines(src.path_lines(found), args.output)
    else:
        store = DedupStore(spark, args.store)
        if args.command == "upload":
            told = store.upload(src.binary_files(spark, args.path), args.min, args.avg, args.max, args.base)
        elif args.command == "delete":
            told = store.delete(args.path)
        else:
            told = None
            if args.command == "download":
                store.fetch(args.path, args.target)
            elif args.command == "vacuum":
                store.vacuum()
            elif args.command == "repair":
                print(f"removed markers: {len(store.repair())}")
            else:
                told = store.report()
        if told is not None:
            print("\n".join(report_lines(told)))
    print(f"seconds: {time.perf_counter() - began:.2f}")


if __name__ == "__main__":
    main()
