"""Watchers: a streaming query per active location that turns changes of its tree into events.

A change is only a hint: what counts is the file as it is found. Files that appear or change are classified against
what is known, hashed if they are new or modified, and logged; whatever is gone is logged as deleted, known or not. A
query's checkpoint holds what its last poll saw, so a restart misses nothing; its first batch is the whole tree, of
which unchanged files give no events.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import inside_any, in_store, normalized
from ..operators.locations import Manager, watched_change
from ..sources.walk import TreeSource


def log_changes(manager: Manager, rows: DataFrame, mode: str) -> int:
    """Appends the events of re-stats (path, size, mtime_us; null size: gone); how many."""
    seen = rows.withColumn("path", normalized(F.col("path"))).where(~inside_any(F.col("path"), manager.internal) & ~in_store(F.col("path")))
    events = watched_change(seen, manager.files()).checkpoint()
    made = events.where(F.col("kind") != "file_deleted")
    hashes = manager.read_files(made, mode).where(~F.col("failed")).select("path", "root_hash", "chunks")
    out = made.join(hashes, "path").unionByName(events.where(F.col("kind") == "file_deleted"), allowMissingColumns=True).withColumn("at", F.lit(manager.clock())).withColumn("v", F.lit(1)).checkpoint()
    if n := out.count():
        manager.log.append(out, ["path"])
    return n


class Watchers:
    """The running queries by path."""

    def __init__(self, manager: Manager, checkpoints: str, interval: str = "1 second"):
        self.manager, self.checkpoints, self.interval = manager, checkpoints.rstrip("/"), interval
        self._running: dict[str, StreamingQuery] = {}
        manager.spark.dataSource.register(TreeSource)
        manager.watchers = self

    def watching(self) -> list[str]:
        return sorted(p for p, q in self._running.items() if q.isActive)

    def watched(self, locations: DataFrame) -> DataFrame:
        """locations with watching: whether a query runs for each."""
        return locations.withColumn("watching", F.col("path").isin(self.watching()) if self.watching() else F.lit(False))

    def start(self, path: str) -> StreamingQuery:
        """Starts a watcher; one that runs stays."""
        if path in self.watching():
            return self._running[path]
        loc = self.manager.active(path)
        options = {"path": path, "ignore": json.dumps(loc["ignore_patterns"]), "internal": json.dumps(self.manager.internal)}
        stream = self.manager.spark.readStream.format("caslake_tree").options(**options).load()
        place = f"{self.checkpoints}/{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        query = stream.writeStream.foreachBatch(lambda df, _: log_changes(self.manager, df, loc["index_mode"])).option("checkpointLocation", place).trigger(processingTime=self.interval).start()
        self._running[path] = query
        return query

    def stop(self, path: str) -> None:
        query = self._running.pop(path, None)
        if query is not None:
            query.stop()

    def bounce(self, path: str) -> StreamingQuery:
        """Starts a watcher anew, after its location's patterns or mode were changed."""
        self.stop(path)
        return self.start(path)

    def boot(self) -> list[str]:
        """A watcher for each active location; what runs stays."""
        for r in self.manager.locations().where(F.col("removed_at_us").isNull()).orderBy("path").collect():
            self.start(r["path"])
        return self.watching()

    def close(self) -> None:
        for p in list(self._running):
            self.stop(p)
