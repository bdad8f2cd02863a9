"""Driver routines over a log: locations are added, scanned, changed and removed by appending events."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import blake3, sampled_file
from ..functions.ignore import DEFAULT_PATTERNS
from ..functions.paths import real_prefixes
from ..schemas import MODES, one_of
from ..sources import cas, walk
from ..sources.cas import ChunkStore
from ..sources.log import EventLog
from . import detect, fold


def now_us() -> int:
    return time.time_ns() // 1000


class NotFound(LookupError):
    """No active location has this path."""


class Manager:
    """Locations of one log. data_dir: the engine's own folder, which is never indexed; content mode stores chunks in its folder `store`. Watchers that know the manager start, stop and are bounced with its locations."""

    def __init__(self, spark: SparkSession, log: EventLog, data_dir: str, clock: Callable[[], int] = now_us):
        self.spark, self.log, self.internal, self.clock = spark, log, real_prefixes(data_dir), clock
        self.data, self.store, self.watchers = data_dir.rstrip("/"), ChunkStore(spark, f"{data_dir.rstrip('/')}/store"), None

    def files(self) -> DataFrame:
        return fold.files(fold.file_states(self.log.read()))

    def locations(self) -> DataFrame:
        return fold.locations(self.log.read())

    def active(self, path: str) -> dict:
        row = self.locations().where((F.col("path") == path) & F.col("removed_at_us").isNull()).first()
        if row is None:
            raise NotFound(path)
        return row.asDict()

    def admitted(self, path: str) -> str:
        """'ok', or why a path can't be a location."""
        if any(path == p or path.startswith(p + "/") for p in self.internal):
            return "internal_path"
        root = path if path.endswith("/") else path + "/"
        return "contains_internal_path" if any(p.startswith(root) for p in self.internal) else "ok"

    def _emit(self, *events: dict) -> None:
        self.log.append_rows([{"at": self.clock(), "v": 1, **e} for e in events])

    def add(self, path: str, mode: str = "shallow") -> dict:
        """Adds a location, seeds the default patterns if it has none, sets the mode if it isn't the default, and scans."""
        one_of(mode, MODES, "mode")
        path = os.path.abspath(os.path.expanduser(path))
        if (why := self.admitted(path)) != "ok":
            raise ValueError(f"{path}: {why}")
        self._emit({"kind": "location_added", "path": path})
        if not self.active(path)["ignore_patterns"]:
            self._emit({"kind": "location_ignore_set", "path": path, "patterns": DEFAULT_PATTERNS})
        if mode != "shallow":
            self._emit({"kind": "location_mode_set", "path": path, "mode": mode})
        self.rescan(path)
        if self.watchers:
            self.watchers.start(path)
        return self.active(path)

    def remove(self, path: str) -> None:
        """The location goes; its files stay known."""
        path = os.path.abspath(os.path.expanduser(path))
        self.active(path)
        if self.watchers:
            self.watchers.stop(path)
        self._emit({"kind": "location_removed", "path": path})

    def set_ignore(self, path: str, patterns: list[str]) -> None:
        """Replaces the patterns; known files stay, and nothing is scanned."""
        self.active(path)
        clean = list(dict.fromkeys(p.strip() for p in patterns if p.strip()))
        self._emit({"kind": "location_ignore_set", "path": path, "patterns": clean})
        self._bounce(path)

    def set_mode(self, path: str, mode: str) -> None:
        one_of(mode, MODES, "mode")
        self.active(path)
        self._emit({"kind": "location_mode_set", "path": path, "mode": mode})
        self._bounce(path)

    def _bounce(self, path: str) -> None:
        if self.watchers and path in self.watchers.watching():
            self.watchers.bounce(path)

    def rescan(self, path: str) -> dict:
        """Scans between two events; a scan that fails leaves the second out."""
        loc = self.active(path)
        begun = self.clock()
        self._emit({"kind": "location_scan_started", "path": path})
        result = self.index(path, loc["ignore_patterns"], loc["index_mode"])
        self._emit({"kind": "location_scan_completed", "path": path, "files": result["new"] + result["modified"] + result["unchanged"], "bytes": result["bytes"], "duration_us": self.clock() - begun})
        return result

    def index(self, root: str, ignore: list[str] = (), mode: str = "shallow") -> dict:
        """Scans a tree and appends events for what is new or modified. Only those files are read."""
        one_of(mode, MODES, "mode")
        root = os.path.abspath(os.path.expanduser(root))
        found = detect.classify(walk.scan(self.spark, root, ignore, self.internal), self.files())
        outcome = self.read_files(detect.changed(found), mode)
        whole = found.join(outcome, "path", "left").withColumn("outcome", F.when(F.col("failed"), "error").otherwise(F.col("outcome"))).drop("failed").checkpoint()
        self.log.append(detect.events(whole, F.lit(self.clock())), ["path"])
        return detect.tally(whole).first().asDict()

    def read_files(self, rows: DataFrame, mode: str) -> DataFrame:
        """path, root_hash, chunks and failed of rows (path, ...). In content mode the files are read once, to a folder of the engine; the bytes that the store lacks go there before any event names them."""
        if mode == "shallow":
            return hash_files(rows).select("path", "root_hash", "chunks", "failed")
        staged = f"{self.data}/staging/{uuid.uuid4().hex}"
        chunk_files(rows).write.parquet(staged)
        read = self.spark.read.schema(STAGED).parquet(staged)
        try:
            self.store.put(read.where(F.col("hash").isNotNull()).select("hash", "bytes"))
            parts = F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("ordinal", "offset", "length", "hash"))))
            out = read.drop("bytes").groupBy("path").agg(parts.alias("p"), F.max("root_hash").alias("root_hash"), F.max("failed").alias("failed"))
            chunks = F.when(~F.col("failed"), F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["hash"].alias("hash"))))
            return out.select("path", "root_hash", chunks.alias("chunks"), "failed").checkpoint()
        finally:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def collect_garbage(self, dry_run: bool = False) -> dict:
        """Sweeps the store of chunks that no live file refers to; the totals."""
        events = self.log.read()
        counted = cas.reference_counts(fold.chunks_ever(events), fold.file_chunks(fold.file_states(events)))
        return self.store.sweep(counted, dry_run)

    def forget_missing(self, root: str) -> int:
        """Appends deletions for live files below a root that a scan doesn't see. Not part of a scan; to be asked for."""
        root = os.path.abspath(os.path.expanduser(root))
        known = self.files().where((F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/"))
        gone = detect.delete_candidates(known, walk.scan(self.spark, root, (), self.internal)).checkpoint()
        if n := gone.count():
            self.log.append(gone.select(F.lit("file_deleted").alias("kind"), F.lit(self.clock()).alias("at"), F.lit(1).alias("v"), "path"), ["path"])
        return n


def hash_files(rows: DataFrame) -> DataFrame:
    """rows (path, ...) with root_hash, chunks (none) and failed, by reading samples of the files on the executors."""
    schema = rows.select("path").schema.simpleString()[7:-1].replace(":", " ") + ", root_hash binary, chunks array<struct<offset:bigint,length:bigint,hash:binary>>, failed boolean"

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    out.append((path, sampled_file(path), [], False))
                except OSError:
                    out.append((path, None, None, True))
            yield pd.DataFrame(out, columns=["path", "root_hash", "chunks", "failed"])

    return rows.select("path").mapInPandas(run, schema)


STAGED = "path string, ordinal int, offset long, length long, hash binary, bytes binary, root_hash binary, failed boolean"


def chunk_files(rows: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A row per chunk of the files of rows (path, ...), with its bytes, and one per file (no hash) with its root hash or its failure. Files are streamed; about `most` bytes are held at once."""
    from ..functions.chunking import stream

    def run(batches):
        import pandas as pd

        out, size = [], 0
        frame = lambda: pd.DataFrame(out, columns=["path", "ordinal", "offset", "length", "hash", "bytes", "root_hash", "failed"]).astype({"ordinal": "Int32", "offset": "Int64", "length": "Int64"})
        for batch in batches:
            for path in batch["path"]:
                hashes = []
                try:
                    with open(path, "rb") as f:
                        for k, (o, b) in enumerate(stream(f.read)):
                            hashes.append(blake3(b))
                            out.append((path, k, o, len(b), hashes[-1], b, None, False))
                            size += len(b)
                            if size > most:
                                yield frame()
                                out, size = [], 0
                    out.append((path, None, None, None, None, None, blake3(b"".join(hashes)), False))
                except OSError:
                    out.append((path, None, None, None, None, None, None, True))
        if out:
            yield frame()

    return rows.select("path").mapInPandas(run, STAGED)


def watched_change(path_rows: DataFrame, files: DataFrame) -> DataFrame:
    """The events of a batch of re-stats (path, size, mtime_us; null size: gone): new and modified files, and deletions of whatever is gone, known or not."""
    there = path_rows.where(F.col("size").isNotNull())
    found = detect.changed(detect.classify(there, files)).select(F.when(F.col("outcome") == "new", "file_indexed").otherwise("file_modified").alias("kind"), "path", "size", "mtime_us")
    gone = path_rows.where(F.col("size").isNull()).select(F.lit("file_deleted").alias("kind"), "path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime_us"))
    return found.unionByName(gone)

