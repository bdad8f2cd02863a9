"""The live projection: micro-batches of the log folded into versioned snapshots, and what pages do with changes.

A snapshot is a folder of Parquet files named by the last seq it has; a file DONE, made once all of them are there, makes
it count. The newest that counts is current, so a crash at any moment leaves the one before. A batch that a restart
repeats has no seq past the snapshot and is skipped, so each event takes effect once; changes are sent before the
snapshot counts, so that a crash sends them again rather than never.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fold
from ..sources.log import EventLog


class GapError(RuntimeError):
    """A batch begins past the seq that comes next."""


class Snapshots:
    """Versions v=<seq>/files and v=<seq>/locations under a folder, each with a file DONE. The last `keep` stay."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _seqs(self, done: bool = True) -> list[int]:
        root, fs = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and (not done or fs.exists(self._fs(f"{self.path}/{n}/DONE")[0])))

    def last(self) -> int:
        return max(self._seqs(), default=0)

    def read(self, table: str) -> DataFrame | None:
        seq = self.last()
        return self.spark.read.parquet(f"{self.path}/v={seq}/{table}") if seq else None

    def commit(self, seq: int, tables: dict[str, DataFrame]) -> None:
        """Writes a version, then the file that makes it count."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v={seq}/{name}")
        done, fs = self._fs(f"{self.path}/v={seq}/DONE")
        fs.create(done, True).close()
        # older versions go, and what a crash left of others below this one
        kept = self._seqs()[-self.keep :]
        for s in self._seqs(done=False):
            if s not in kept and s < seq:
                fs.delete(self._fs(f"{self.path}/v={s}")[0], True)


def as_events(states: DataFrame) -> DataFrame:
    """A snapshot of files as the events that make it: an index event each, and a deletion for what is gone."""
    null = lambda t: F.lit(None).cast(t)
    made = states.select(F.col("id").alias("seq"), F.lit("file_indexed").alias("kind"), F.col("indexed_at_us").alias("at"), "path", "size", "mtime_us", "root_hash", "chunks")
    gone = states.where(F.col("deleted_at_us").isNotNull()).select(F.col("last_seq").alias("seq"), F.lit("file_deleted").alias("kind"), F.col("deleted_at_us").alias("at"), "path", null("long").alias("size"), null("long").alias("mtime_us"), null("binary").alias("root_hash"), null("array<struct<offset:bigint,length:bigint,hash:binary>>").alias("chunks"))
    return made.unionByName(gone)


def advance(old: DataFrame | None, batch: DataFrame, seq: int) -> DataFrame:
    """File states after a batch: touched paths are folded from their old state and the batch; others are carried over. A batch with moves is folded with the old states of all its paths, by the same rules."""
    if old is None:
        return fold.file_states(batch).withColumn("last_seq", F.lit(seq))
    moved = batch.where(F.col("kind") == "file_moved")
    touched = batch.select("path").where(F.col("path").isNotNull()).unionByName(moved.select(F.col("from_path").alias("path"))).unionByName(moved.select(F.col("to_path").alias("path"))).distinct()
    before = as_events(old.join(touched, "path", "left_semi"))
    rows = batch.select("seq", "kind", "at", "path", "from_path", "to_path", "size", "mtime_us", "root_hash", "chunks").unionByName(before, allowMissingColumns=True)
    folded = fold.file_states(rows).withColumn("last_seq", F.lit(seq))
    return old.join(touched, "path", "left_anti").unionByName(folded)


def apply_batch(snapshots: Snapshots, log: DataFrame, batch: DataFrame, on_change: Callable[[DataFrame], None] | None = None) -> int:
    """Folds the events of a batch that are new; the seq that is current then."""
    last = snapshots.last()
    new = batch.where(F.col("seq") > last)
    bounds = new.agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n")).first()
    if not bounds["n"]:
        return last
    if bounds["a"] != last + 1 or bounds["b"] - last != bounds["n"]:
        raise GapError(f"a batch of {bounds['n']} events from {bounds['a']} to {bounds['b']} follows {last}")
    seq = bounds["b"]
    states = advance(snapshots.read("files"), new, seq)
    # locations are few events: they are folded from the log, up to this seq
    if on_change:
        on_change(new)
    snapshots.commit(seq, {"files": states, "locations": fold.locations(fold.until(log, 0, seq))})
    return seq


def start(log: EventLog, snapshots: Snapshots, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None, once: bool = False):
    """A streaming query that keeps the snapshots up to the log."""

    def each(batch: DataFrame, _: int) -> None:
        last = snapshots.last()
        head = batch.agg(F.max("seq")).first()[0]
        if head is not None and head > last:  # files may come out of order within the source: the log itself has what is between
            whole = log.read().where((F.col("seq") > last) & (F.col("seq") <= head))
            apply_batch(snapshots, log.read(), whole, on_change)

    writer = log.read_stream().writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def catch_up(log: EventLog, snapshots: Snapshots, target: int | None = None) -> int:
    """Applies what the log has past the snapshot, up to a target."""
    return apply_batch(snapshots, log.read(), fold.until(log.read(), snapshots.last(), target))


def rebuild(log: EventLog, snapshots: Snapshots) -> int:
    """Folds the whole log anew. Sends no changes."""
    head = log.head()
    if head:
        snapshots.commit(head, {"files": fold.file_states(log.read()).withColumn("last_seq", F.lit(head)), "locations": fold.locations(log.read())})
    return head


def page_after(page: DataFrame, changes: DataFrame, files: DataFrame, location_id: int) -> DataFrame:
    """What changes do to a loaded page: (file_id, action) for each of its rows that leaves ('remove') or is read anew ('refresh'). Changes of other locations and without an id do nothing; the last change of a row counts."""
    mine = changes.where((F.col("location_id") == location_id) & F.col("file_id").isNotNull())
    last = mine.groupBy("file_id").agg(F.max_by("kind", "seq").alias("kind")).join(page.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return last.select("file_id", F.when(F.col("kind").isin("deleted", "moved_out"), "remove").otherwise("refresh").alias("action"))


def pending_new(page: DataFrame, changes: DataFrame, location_id: int) -> DataFrame:
    """How many changes were of rows beyond the page."""
    mine = changes.where((F.col("location_id") == location_id) & F.col("file_id").isNotNull() & F.col("kind").isin("indexed", "modified", "moved_in"))
    return mine.join(page.select(F.col("id").alias("file_id")), "file_id", "left_anti").agg(F.count("*").alias("pending_new"))

