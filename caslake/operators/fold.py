"""The fold: event log to tables, a whole set at a time.

Without moves, what an event leaves depends on the last event of each kind of its path, so each table is one
aggregation by path with partial maxima; no join, no window, no order beyond seq. A row's id is the seq of the event
that made it: unique, stable under replay and in the order of appearance, without a global numbering.

Moves tie paths together. The paths that moves link are grouped into components, whose events, few as moves are, are
folded one after the other per component; all others take the fast way.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CONTENT_KINDS, LOCATION_KINDS


class ProjectionConflict(ValueError):
    """A move onto a path that has a row already."""


def until(log: DataFrame, after: int = 0, target: int | None = None) -> DataFrame:
    """Events past a checkpoint, up to a target."""
    out = log.where(F.col("seq") > after)
    return out if target is None else out.where(F.col("seq") <= target)


def checkpoint(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("last_applied_seq"))


def _last(kind: str | tuple, *fields: str) -> Column:
    kinds = (kind,) if isinstance(kind, str) else kind
    return F.max_by(F.struct("seq", *fields), F.when(F.col("kind").isin(*kinds), F.col("seq")))


def _first(kind: str | tuple) -> Column:
    kinds = (kind,) if isinstance(kind, str) else kind
    return F.min(F.when(F.col("kind").isin(*kinds), F.col("seq")))


def _states(log: DataFrame) -> DataFrame:
    rows = log.where(F.col("kind").isin(*CONTENT_KINDS, "file_deleted"))
    return rows.groupBy("path").agg(_first(CONTENT_KINDS).alias("id"), _last(CONTENT_KINDS, "at", "size", "mtime_us", "root_hash", "chunks").alias("c"), _last("file_deleted", "at").alias("d")).where(F.col("id").isNotNull())


FILE_STATE = "id long, path string, size long, mtime_us long, root_hash binary, deleted_at_us long, indexed_at_us long, chunks array<struct<offset:bigint,length:bigint,hash:binary>>"


def _fast(log: DataFrame) -> DataFrame:
    gone = F.col("d.seq") > F.col("c.seq")
    none = F.array().cast("array<struct<offset:bigint,length:bigint,hash:binary>>")
    return _states(log).select(
        "id", "path", "c.size", "c.mtime_us", "c.root_hash", F.when(gone, F.col("d.at")).alias("deleted_at_us"), F.col("c.at").alias("indexed_at_us"),
        F.when(F.coalesce(gone, F.lit(False)), none).otherwise(F.coalesce("c.chunks", none)).alias("chunks"),
    )


def components(edges: DataFrame) -> DataFrame:
    """(path, root) of the paths that moves link: least labels with shortcuts, checkpointed each round."""
    both = edges.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")).distinct()
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = both.select(F.col("a").alias("path"), F.col("a").alias("root")).distinct()
    sign = None
    while True:
        near = both.join(labels.withColumnsRenamed({"path": "b", "root": "l"}), "b").groupBy(F.col("a").alias("path")).agg(F.min("l").alias("l"))
        hooked = labels.join(near, "path").select("path", F.least("root", "l").alias("root"))
        jump = hooked.select(F.col("path").alias("root"), F.col("root").alias("top"))
        labels = hooked.join(jump, "root", "left").select("path", F.least("root", F.coalesce("top", "root")).alias("root")).checkpoint()
        now = tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("path", "root").cast("decimal(38,0)"))).first())
        if now == sign:
            return labels
        sign = now


def _sequential(on_conflict: str):
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        files: dict[str, dict] = {}
        for e in rows.sort_values("seq").to_dict("records"):
            kind, path = e["kind"], e["path"]
            if kind in CONTENT_KINDS:
                old = files.get(path)
                files[path] = {"id": old["id"] if old else e["seq"], "size": e["size"], "mtime_us": e["mtime_us"], "root_hash": e["root_hash"], "deleted_at_us": None, "indexed_at_us": e["at"], "chunks": e["chunks"] if e["chunks"] is not None else []}
            elif kind == "file_deleted" and path in files:
                files[path] |= {"deleted_at_us": e["at"], "chunks": []}
            elif kind == "file_moved" and e["from_path"] in files and e["from_path"] != e["to_path"]:
                if e["to_path"] in files:
                    if on_conflict == "raise":
                        raise ProjectionConflict(f"event {e['seq']} moves {e['from_path']} onto {e['to_path']}, which exists")
                    continue
                files[e["to_path"]] = files.pop(e["from_path"])
        names = ["id", "path", "size", "mtime_us", "root_hash", "deleted_at_us", "indexed_at_us", "chunks"]
        out = pd.DataFrame([{"path": p, **v} for p, v in files.items()], columns=names)
        return out.astype({k: "Int64" for k in ("id", "size", "mtime_us", "deleted_at_us", "indexed_at_us")})

    return fold


def _edges(log: DataFrame) -> DataFrame:
    return log.where((F.col("kind") == "file_moved") & (F.col("from_path") != F.col("to_path"))).select("from_path", "to_path")


def _named(on_conflict: str):
    def name(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out = []
        for e in rows.sort_values("seq").to_dict("records"):
            kind, path = e["kind"], e["path"]
            if kind in CONTENT_KINDS:
                out.append((e["seq"], held.setdefault(path, e["seq"])))
            elif kind == "file_deleted":
                out.append((e["seq"], held.get(path)))
            else:
                a, b = e["from_path"], e["to_path"]
                out.append((e["seq"], held.get(a)))
                if a in held and a != b:
                    if b not in held:
                        held[b] = held.pop(a)
                    elif on_conflict == "raise":
                        raise ProjectionConflict(f"event {e['seq']} moves {a} onto {b}, which exists")
        return pd.DataFrame(out, columns=["seq", "file_id"]).astype({"seq": "int64", "file_id": "Int64"})

    return name


def event_ids(log: DataFrame, moves: bool | None = None, on_conflict: str = "raise") -> DataFrame:
    """(seq, file_id) of file events: the row that each finds at its path, or that it makes; of a move, the row that it moves. Null if there is none. As in file_states, only the paths that moves link are taken one event after the other."""
    edges = _edges(log)
    if moves is None:
        moves = not edges.isEmpty()
    rows = log.where(F.col("kind").isin(*CONTENT_KINDS, "file_deleted", "file_moved")).withColumn("path", F.coalesce("path", "from_path"))
    parts = components(edges) if moves else None
    plain = rows.join(parts, "path", "left_anti") if moves else rows
    first = plain.groupBy("path").agg(_first(CONTENT_KINDS).alias("file_id"))
    ids = plain.select("seq", "path").join(first, "path").select("seq", F.when(F.col("file_id") <= F.col("seq"), F.col("file_id")).alias("file_id"))
    if not moves:
        return ids
    tied = rows.join(parts, "path").select("root", "seq", "kind", "path", "from_path", "to_path")
    return ids.unionByName(tied.groupBy("root").applyInPandas(_named(on_conflict), "seq long, file_id long"))


def file_states(log: DataFrame, moves: bool | None = None, on_conflict: str = "raise") -> DataFrame:
    """Files with their chunks. moves: whether the log has moves; if not said, the log is asked. on_conflict: 'raise' or 'skip'."""
    edges = _edges(log)
    if moves is None:
        moves = not edges.isEmpty()
    if not moves:
        return _fast(log)
    parts = components(edges)
    rows = log.where(F.col("kind").isin(*CONTENT_KINDS, "file_deleted", "file_moved")).withColumn("path", F.coalesce("path", "from_path"))
    fast = _fast(rows.where(F.col("kind") != "file_moved").join(parts, "path", "left_anti"))
    tied = rows.join(parts, "path").select("root", "seq", "kind", "at", "path", "from_path", "to_path", "size", "mtime_us", "root_hash", "chunks")
    return fast.unionByName(tied.groupBy("root").applyInPandas(_sequential(on_conflict), FILE_STATE))


def files(states: DataFrame) -> DataFrame:
    return states.drop("chunks")


def file_chunks(states: DataFrame) -> DataFrame:
    rows = states.select(F.col("id").alias("file_id"), F.posexplode("chunks").alias("ordinal", "c"))
    return rows.select("file_id", "ordinal", "c.offset", "c.length", F.col("c.hash").alias("chunk_hash"))


def chunks_ever(log: DataFrame) -> DataFrame:
    """Every chunk that content events named; the first length wins."""
    seen = log.where(F.col("kind").isin(*CONTENT_KINDS)).select("seq", F.posexplode("chunks").alias("ordinal", "c"))
    return seen.groupBy(F.col("c.hash").alias("hash")).agg(F.min_by("c.length", F.struct("seq", "ordinal")).alias("length"))


def locations(log: DataFrame, preserve: bool = False) -> DataFrame:
    """Adding a location again resets all but its id; with preserve, patterns and mode stay as they were."""
    rows = log.where(F.col("kind").isin(*LOCATION_KINDS))
    each = rows.groupBy("path").agg(
        _first("location_added").alias("id"), _last("location_added", "at").alias("a"), _last("location_removed", "at").alias("r"), _last("location_scan_started", "at").alias("s"),
        _last("location_scan_completed", "at").alias("z"), _last("location_ignore_set", "patterns").alias("p"), _last("location_mode_set", "mode").alias("m"),
    )
    since = lambda x: F.col(f"{x}.seq") > F.col("a.seq")
    kept = lambda x: (F.col(f"{x}.seq") > F.col("id")) if preserve else since(x)
    return each.where(F.col("id").isNotNull()).select(
        "id", "path", F.col("a.at").alias("added_at_us"), F.when(since("r"), F.col("r.at")).alias("removed_at_us"), F.when(since("s"), F.col("s.at")).alias("scan_started_at_us"),
        F.when(since("z"), F.col("z.at")).alias("last_scanned_at_us"), F.coalesce(F.when(kept("p"), F.col("p.patterns")), F.array().cast("array<string>")).alias("ignore_patterns"),
        F.coalesce(F.when(kept("m"), F.col("m.mode")), F.lit("shallow")).alias("index_mode"),
    )


def interrupted(locs: DataFrame) -> DataFrame:
    """Locations with a scan that began after the last one ended."""
    return locs.where(F.col("scan_started_at_us") > F.coalesce("last_scanned_at_us", F.lit(0)))

