"""python -m relstore PATH [--execute SQL] [--stats] [--serve PORT] | --connect HOST:PORT [--execute SQL]"""

from __future__ import annotations

import argparse
import sys
import threading

from .client import Client
from .errors import RelError
from .result import format_result, table_text
from .wire import Rows


def show(result, stats: bool) -> str:
    if isinstance(result, Rows):
        s = result.stats
        out = table_text(result.columns, result.rows)
        return out + (f"access: {s.access_path}\nrows examined: {s.rows_examined}\nrows returned: {s.rows_returned}\nindex lookups: {s.index_lookups}\n" if stats else "")
    return format_result(result, stats)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="relstore")
    p.add_argument("path", nargs="?", help="database folder")
    p.add_argument("--connect", metavar="HOST:PORT")
    p.add_argument("--execute", metavar="SQL")
    p.add_argument("--serve", metavar="PORT", type=int)
    p.add_argument("--stats", action="store_true")
    a = p.parse_args(argv)
    if bool(a.path) == bool(a.connect):
        p.error("give a database folder or --connect")
    if a.connect:
        host, _, port = a.connect.rpartition(":")
        target = Client((host, int(port)))
    else:
        from pyspark.sql import SparkSession

        from .engine import Engine

        target = Engine.open(a.path, SparkSession.builder.appName("relstore").getOrCreate())
    try:
        if a.serve is not None:
            from .server import Server

            with Server(target, port=a.serve) as server:
                print("listening on {}:{}".format(*server.address), flush=True)
                try:
                    threading.Event().wait()
                except KeyboardInterrupt:
                    return 0
        if a.execute is not None:
            return run(target, a.execute, a.stats)
        for line in sys.stdin:
            if line.strip() in (".exit", ".quit"):
                break
            if line.strip():
                run(target, line, a.stats)
        return 0
    finally:
        target.close()


def run(target, sql: str, stats: bool) -> int:
    try:
        print(show(target.execute(sql), stats), end="", flush=True)
        return 0
    except RelError as e:
        print(f"{e.kind} error: {e}", file=sys.stderr, flush=True)
        return 1


if __name__ == "__main__":
    sys.exit(main())
