"""Directory trees as a data source: batch scans that prune ignored folders, and a stream of changes by re-stat.

Scanned folders must be visible to all executors. Regular files come with their size and whole-second mtime; links are
followed unless told otherwise, with a guard against cycles; names that begin with a dot are files like others. What
can't be read is skipped. Ignore patterns and the engine's own folders prune whole subtrees before they are listed.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.ignore import Matcher, compile_patterns

SCHEMA = "path string, size long, mtime_us long"


def walk(root: str, matcher: Matcher, internal: list[str], follow: bool = True) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime_us) of regular files, depth first. A root that is a file gives itself; one that isn't there gives nothing."""

    def pruned(path: str) -> bool:
        if any(path == p or path.startswith(p + "/") for p in internal):
            return True
        rel = path[len(root.rstrip("/")) + 1 :] if path != root else ""
        return bool(rel) and matcher.matches(rel)

    todo = [(root, ())]
    while todo:
        path, above = todo.pop()
        if pruned(path):
            continue
        try:
            s = os.stat(path, follow_symlinks=follow)
            if stat.S_ISREG(s.st_mode):
                yield path, s.st_size, int(s.st_mtime // 1) * 1_000_000
            elif stat.S_ISDIR(s.st_mode) and (s.st_dev, s.st_ino) not in above:
                seen = (*above, (s.st_dev, s.st_ino))
                todo += [(os.path.join(path, n), seen) for n in reversed(os.listdir(path))]
        except OSError:
            continue


class _Subtree(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(os.path.expanduser(options["path"]))
        self.matcher = compile_patterns(json.loads(options.get("ignore", "[]")))
        self.internal = json.loads(options.get("internal", "[]"))
        self.follow = options.get("followlinks", "true").lower() == "true"
        self.parts = int(options.get("partitions", "64"))

    def partitions(self):
        """Entries of the first levels, dealt out; folders are split while there are fewer entries than partitions."""
        level = [self.root]
        for _ in range(3):
            if len(level) >= self.parts:
                break
            deeper = []
            for p in level:
                if os.path.isdir(p) and (self.follow or not os.path.islink(p)) and not (p != self.root and self.matcher.matches(p[len(self.root.rstrip("/")) + 1 :])):
                    try:
                        deeper += [os.path.join(p, n) for n in sorted(os.listdir(p))]
                    except OSError:
                        continue
                else:
                    deeper.append(p)
            level = deeper
        return [_Subtree(level[k :: self.parts]) for k in range(self.parts) if level[k :: self.parts]]

    def read(self, partition):
        root = self.root
        for start in partition.paths:
            yield from (walk(root, self.matcher, self.internal, self.follow) if start == root else _pruned(start, root, self.matcher, self.internal, self.follow))


def _pruned(start: str, root: str, matcher: Matcher, internal: list[str], follow: bool) -> Iterator[tuple[str, int, int]]:
    """walk() of a subtree with patterns relative to the whole tree's root."""

    class Shifted:
        lead = start[len(root.rstrip("/")) + 1 :]

        def matches(self, rel: str) -> bool:
            return matcher.matches(f"{self.lead}/{rel}")

    if not matcher.matches(Shifted.lead):
        yield from walk(start, Shifted(), internal, follow)


class TreeSource(DataSource):
    """spark.read.format("caslake_tree").option("path", root).option("ignore", JSON list).load()"""

    @classmethod
    def name(cls):
        return "caslake_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Changes(self.options)


class _Changes(SimpleDataSourceStreamReader):
    """Files that appeared or changed since the last poll, and a size of null for those that went. The offset holds what the last poll saw, so a restart misses nothing."""

    def __init__(self, options: dict):
        self.reader = _Reader(options)

    def initialOffset(self):
        return {"seen": "{}"}

    def read(self, start):
        old = json.loads(start["seen"])
        r = self.reader
        now = {p: [s, m] for p, s, m in walk(r.root, r.matcher, r.internal, r.follow)}
        rows = [(p, *v) for p, v in now.items() if old.get(p) != v] + [(p, None, None) for p in old if p not in now]
        return iter(rows), {"seen": json.dumps(now, sort_keys=True)}

    def readBetweenOffsets(self, start, end):
        old, now = json.loads(start["seen"]), json.loads(end["seen"])
        return iter([(p, *v) for p, v in now.items() if old.get(p) != v] + [(p, None, None) for p in old if p not in now])


def scan(spark: SparkSession, root: str, ignore: list[str] = (), internal: list[str] = (), follow: bool = True, partitions: int = 64) -> DataFrame:
    spark.dataSource.register(TreeSource)
    options = {"path": root, "ignore": json.dumps(list(ignore)), "internal": json.dumps(list(internal)), "followlinks": str(follow), "partitions": str(partitions)}
    return spark.read.format("caslake_tree").options(**options).load()


def scan_binary(spark: SparkSession, root: str) -> DataFrame:
    """The same columns by Spark's own reader, which leaves out names that begin with a dot or an underscore; for stores that only Spark reads."""
    from pyspark.sql import functions as F

    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", F.col("length").alias("size"), (F.unix_seconds("modificationTime") * 1_000_000).alias("mtime_us"))
