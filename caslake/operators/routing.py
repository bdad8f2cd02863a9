"""Routing of paths to locations, and the change feed.

The longest location that holds a path is found by an equality join on the path's own ancestors, never by comparing
each path with each location. Locations are broadcast while they are few, by count; beyond, the join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import ancestors
from ..functions.text import location_topic, scan_topic
from ..schemas import CONTENT_KINDS
from .fold import event_ids

MOST_BROADCAST = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def resolve(paths: DataFrame, locations: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths with location_id: the longest location that is the path or above it, or null."""
    each = paths.select(path).distinct()
    up = each.select(path, F.explode(ancestors(F.col(path))).alias("above_"))
    found = up.join(_small(locations.select(F.col("id").alias("location_id"), F.col("path").alias("above_"))), "above_")
    best = found.groupBy(path).agg(F.max_by("location_id", F.length("above_")).alias("location_id"))
    return each.join(best, path, "left")


def intervals(log: DataFrame) -> DataFrame:
    """(location_id, location, start, end): when each location was active, by seq; the end is open."""
    rows = log.where(F.col("kind").isin("location_added", "location_removed"))
    w = Window.partitionBy("path").orderBy("seq")
    first = F.min(F.when(F.col("kind") == "location_added", F.col("seq"))).over(Window.partitionBy("path"))
    spans = rows.select("path", "kind", F.col("seq").alias("start"), F.lead("seq").over(w).alias("end"), first.alias("location_id"))
    return spans.where(F.col("kind") == "location_added").select("location_id", F.col("path").alias("location"), "start", F.coalesce("end", F.lit(2**63 - 1)).alias("end"))


def owners(events: DataFrame, spans: DataFrame, path: str, name: str) -> DataFrame:
    """(seq, name): of each event, the longest location that held the path when the event was applied."""
    up = events.select("seq", F.explode(ancestors(F.col(path))).alias("location"))
    found = up.join(_small(spans), "location").where((F.col("start") <= F.col("seq")) & (F.col("seq") < F.col("end")))
    return found.groupBy("seq").agg(F.max_by("location_id", F.length("location")).alias(name))


def file_feed(log: DataFrame, moves: bool | None = None) -> DataFrame:
    """topic, kind, path, file_id, location_id, seq of file events with an owner; others are dropped. Ids follow moves."""
    rows = log.where(F.col("kind").isin(*CONTENT_KINDS, "file_deleted")).select("seq", "path", F.substring("kind", 6, 20).alias("kind"))
    owned = rows.join(owners(rows, intervals(log), "path", "location_id"), "seq")
    named = owned.join(event_ids(log, moves), "seq", "left")
    return named.select(location_topic(F.col("location_id")).alias("topic"), "kind", "path", "file_id", "location_id", "seq")


def move_feed(log: DataFrame) -> DataFrame:
    """What moves send: one moved_in within a location; moved_out at the origin's and moved_in at the target's otherwise, where there is one."""
    spans = intervals(log)
    rows = log.where(F.col("kind") == "file_moved").select("seq", "from_path", "to_path")
    both = rows.join(owners(rows, spans, "from_path", "out_id"), "seq", "left").join(owners(rows, spans, "to_path", "in_id"), "seq", "left")
    entry = lambda kind, path, loc: F.struct(F.lit(kind).alias("kind"), F.col(path).alias("path"), F.col(loc).alias("location_id"))
    arrives, leaves = entry("moved_in", "to_path", "in_id"), entry("moved_out", "from_path", "out_id")
    sent = F.when(F.col("out_id") == F.col("in_id"), F.array(arrives)).otherwise(F.filter(F.array(leaves, arrives), lambda x: x["location_id"].isNotNull()))
    out = both.join(event_ids(log), "seq", "left").select("seq", "file_id", F.explode(sent).alias("x"))
    return out.select(location_topic(F.col("x.location_id")).alias("topic"), "x.kind", "x.path", "file_id", "x.location_id", "seq")


def _known(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows with location_id, null before the location was first added."""
    ids = log.where(F.col("kind") == "location_added").groupBy("path").agg(F.min("seq").alias("first_"))
    return rows.join(ids, "path", "left").withColumn("location_id", F.when(F.col("first_") <= F.col("seq"), F.col("first_"))).drop("first_")


LOCATION_FEED = {"location_added": "added", "location_removed": "removed", "location_scan_started": "scan_started", "location_scan_completed": "scan_completed", "location_ignore_set": "ignore_set", "location_mode_set": "mode_set"}


def location_feed(log: DataFrame) -> DataFrame:
    rows = log.where(F.col("kind").isin(*LOCATION_FEED)).select("seq", "path", F.substring("kind", 10, 30).alias("kind"))
    return _known(rows, log).select(F.lit("locations").alias("topic"), "kind", "path", "location_id", "seq")


def scan_progress_feed(log: DataFrame) -> DataFrame:
    """Progress of scans, on a topic of their own; only of locations that are known."""
    rows = log.where(F.col("kind") == "location_scan_progress").select("seq", "path", "files_done", "bytes_done", "current_path", "total_files", "total_bytes")
    known = _known(rows, log).where(F.col("location_id").isNotNull())
    return known.select(scan_topic(F.col("location_id")).alias("topic"), "location_id", "files_done", "bytes_done", "current_path", "total_files", "total_bytes", "seq")
