"""Command line: python -m caslake.cli --data DIR COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import reads
from .operators.locations import Manager, NotFound
from .sources.log import EventLog
from .streaming.watch import Watchers


def write_lines(lines) -> None:
    """Prints lines until the reader goes away."""
    try:
        for x in lines:
            print(x)
        sys.stdout.flush()
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="caslake", description="A content-addressed, event-sourced file index on Spark")
    p.add_argument("--data", default=os.path.expanduser("~/.caslake"), help="folder of the log and the store")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arg, text_ in (("index", "path", "scan a tree and log what is new"), ("find", "term", "files whose path has a term"), ("watch", "path", "add a location, scan it and log its changes until interrupted"), ("unwatch", "path", "remove a location")):
        one = sub.add_parser(name, help=text_)
        one.add_argument(arg)
        if name == "watch":
            one.add_argument("--once", action="store_true", help="stop after the scan")
    for name, text_ in (("ls", "all live files"), ("locations", "active locations"), ("rebuild-projection", "fold the log anew")):
        sub.add_parser(name, help=text_)
    sub.add_parser("gc", help="drop chunks that nothing refers to").add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{a.data}/checkpoints")
    log = EventLog(spark, f"{a.data}/log")
    m = Manager(spark, log, a.data)
    if a.command == "index":
        r = m.index(a.path)
        print(f"new {r['new']}, modified {r['modified']}, unchanged {r['unchanged']}, errors {r['errors']}, {r['bytes']} bytes")
    elif a.command == "watch":
        if not a.once:
            Watchers(m, f"{a.data}/watch")
        try:
            print(f"Watching {m.add(a.path)['path']}", flush=True)
            if m.watchers:
                spark.streams.awaitAnyTermination()
        except KeyboardInterrupt:
            pass
        finally:
            if m.watchers:
                m.watchers.close()
    elif a.command == "unwatch":
        try:
            m.remove(a.path)
        except NotFound as e:
            print(f"failed: no location {e}", file=sys.stderr)
            return 1
    elif a.command == "ls":
        rows = reads.ls(m.files()).select(F.concat(text.pad_left(F.col("size").cast("string")), F.lit("  "), "path"))
        write_lines(r[0] for r in rows.toLocalIterator())
    elif a.command == "find":
        write_lines(r[0] for r in reads.find(m.files(), a.term).toLocalIterator())
    elif a.command == "locations":
        rows = [r["path"] for r in reads.active_locations(m.locations()).collect()]
        write_lines(rows or ["(no locations)"])
    elif a.command == "rebuild-projection":
        from .streaming.live import Snapshots, rebuild

        print(f"rebuilt up to {rebuild(log, Snapshots(spark, f'{a.data}/snapshots'))}")
    elif a.command == "gc":
        r = m.collect_garbage(a.dry_run)
        size = spark.range(1).select(text.format_bytes(F.lit(r["bytes_reclaimed"]))).first()[0]
        print(f"Scanned:    {r['scanned']} orphan chunks\nRemoved:    {r['removed']}\nReclaimed:  {size}" + "  (dry run)" * a.dry_run)
    return 0


if __name__ == "__main__":
    sys.exit(main())
