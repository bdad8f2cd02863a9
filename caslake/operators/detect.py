"""Change detection: a scan against the files that are known, and the events that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, hashing
from ..schemas import one_of


def classify(scan: DataFrame, files: DataFrame, revive_tombstones: bool = False) -> DataFrame:
    """scan with outcome: new, modified or unchanged. Deleted files count as known, unless they are to be revived: then an unchanged one is modified."""
    known = files.select(F.col("path"), F.col("size").alias("size_"), F.col("mtime_us").alias("mtime_"), F.col("deleted_at_us").alias("deleted_"), F.lit(True).alias("known_"))
    same = (F.col("size") == F.col("size_")) & (F.col("mtime_us") == F.col("mtime_"))
    if revive_tombstones:
        same = same & F.col("deleted_").isNull()
    outcome = F.when(F.col("known_").isNull(), "new").when(same, "unchanged").otherwise("modified")
    return scan.join(known, "path", "left").withColumn("outcome", outcome).drop("size_", "mtime_", "deleted_", "known_")


def tally(classified: DataFrame) -> DataFrame:
    """Counts by outcome, and the bytes of all but errors, unchanged ones too."""
    of = lambda x: F.count_if(F.col("outcome") == x)
    read = F.col("outcome") != "error"
    return classified.agg(of("new").alias("new"), of("modified").alias("modified"), of("unchanged").alias("unchanged"), of("error").alias("errors"), F.coalesce(F.sum(F.when(read, F.col("size"))), F.lit(0).cast("long")).alias("bytes"))


def completed_totals(classified: DataFrame) -> DataFrame:
    """files and bytes of the event that ends a scan."""
    return tally(classified).select((F.col("new") + F.col("modified") + F.col("unchanged")).alias("files"), "bytes")


def delete_candidates(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Live files that a scan didn't see. A scan doesn't delete by itself; this is for callers that ask for it."""
    return files.where(F.col("deleted_at_us").isNull()).join(scan.select("path"), "path", "left_anti")


def changed(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome").isin("new", "modified"))


def hashed(rows: DataFrame, content: Column, mode: str, scheme: str = "blake3") -> DataFrame:
    """rows with root_hash and chunks: shallow mode samples and keeps no chunks, content mode chunks and hashes the hashes."""
    if one_of(mode, ("shallow", "content"), "mode") == "shallow":
        return rows.withColumn("root_hash", hashing.sampled(content, scheme)).withColumn("chunks", F.array().cast("array<struct<offset:bigint,length:bigint,hash:binary>>"))
    parts = rows.withColumn("chunks", chunking.chunk_column(scheme)(content))
    return parts.withColumn("root_hash", hashing.root_hash(F.transform("chunks", lambda c: c["hash"]), scheme))


def events(classified: DataFrame, at: Column) -> DataFrame:
    """The log's rows for new and modified files; unchanged ones give none. Sizes and mtimes are the scan's."""
    kind = F.when(F.col("outcome") == "new", "file_indexed").otherwise("file_modified")
    have = [c for c in ("root_hash", "chunks") if c in classified.columns]
    return changed(classified).select(kind.alias("kind"), at.alias("at"), F.lit(1).alias("v"), "path", "size", "mtime_us", *have)
