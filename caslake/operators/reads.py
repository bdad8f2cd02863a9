"""Read operators over the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import matches_term, under
from ..schemas import SORTS, one_of

DEFAULT_LIMIT, MOST_LIMIT = 100, 500


def live(df: DataFrame, tombstone: str = "deleted_at_us") -> DataFrame:
    return df.where(F.col(tombstone).isNull())


def active_locations(locations: DataFrame) -> DataFrame:
    return live(locations, "removed_at_us").orderBy("path")


def all_locations(locations: DataFrame) -> DataFrame:
    return locations.orderBy("path")


def by_length(locations: DataFrame) -> DataFrame:
    return live(locations, "removed_at_us").orderBy(F.length("path").desc(), "path")


def ls(files: DataFrame) -> DataFrame:
    """Size and path of all live files, by path, whether or not their location is still there."""
    return live(files).select("size", "path").orderBy("path")


def find(files: DataFrame, term: str) -> DataFrame:
    return live(files).where(matches_term(F.col("path"), term)).select("path").orderBy("path")


def under_location(files: DataFrame, location: str, sqlite_like: bool = False) -> DataFrame:
    return live(files).where(under(F.col("path"), location, sqlite_like))


def location_stats(files: DataFrame, location: str) -> DataFrame:
    """File count and bytes of one location; zeros if it has none."""
    return under_location(files, location).agg(F.count("id").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("bytes"))


def all_location_stats(files: DataFrame, locations: DataFrame) -> DataFrame:
    """The same of every active location at once; a file counts in each location that holds it. By an equality join on ancestors, after sums per folder."""
    from ..functions.paths import ancestors
    from .routing import _small

    active = live(locations, "removed_at_us").select(F.col("id").alias("location_id"), F.col("path").alias("location"), "last_scanned_at_us")
    # files of one folder have the same ancestors, so they are summed before the join
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    rows = live(files)
    sums = rows.groupBy(folder.alias("folder")).agg(F.count("id").alias("n"), F.sum("size").alias("b"))
    up = sums.select(F.explode(ancestors(F.when(F.col("folder") == "", F.lit("/")).otherwise(F.col("folder")))).alias("location"), "n", "b")
    exact = rows.select(F.col("path").alias("location"), F.lit(1).cast("long").alias("n"), F.col("size").alias("b"))
    small = _small(active)
    hits = up.join(small, "location").unionByName(exact.join(small, "location")).groupBy("location_id").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    return active.join(hits, "location_id", "left").select("location_id", "location", F.coalesce("n", F.lit(0).cast("long")).alias("file_count"), F.coalesce("b", F.lit(0).cast("long")).alias("bytes"), "last_scanned_at_us")


def past(sort_by: str, order: str, after: tuple | None) -> Column | None:
    """Rows past a cursor (value, id), in an order that goes the same way for both."""
    if after is None:
        return None
    value, row_id = after
    k, i = F.col(sort_by), F.col("id")
    return (k > value) | ((k == value) & (i > row_id)) if order == "asc" else (k < value) | ((k == value) & (i < row_id))


def list_files(files: DataFrame, location: str, sort_by: str = "path", order: str = "asc", limit: int = DEFAULT_LIMIT, after: tuple | None = None, more: int = 0) -> DataFrame:
    """A page of the live files of a location. Filters, cursor and columns reach the files; the page is a top-n, not a sort."""
    one_of(sort_by, SORTS, "sort_by"), one_of(order, ("asc", "desc"), "order")
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    rows = under_location(files, location)
    cut = past(sort_by, order, after)
    rows = rows if cut is None else rows.where(cut)
    keys = [F.col(sort_by), F.col("id")]
    return rows.orderBy(*(k.asc() if order == "asc" else k.desc() for k in keys)).limit(min(limit, MOST_LIMIT) + more)


def page(files: DataFrame, location: str | None, sort_by: str = "path", order: str = "asc", limit: int = DEFAULT_LIMIT, after: tuple | None = None) -> tuple[list, tuple | None]:
    """(rows, cursor): at most 500 rows, and None for the cursor at the end. An unknown location, None, gives nothing."""
    if location is None:
        return [], None
    rows = list_files(files, location, sort_by, order, limit, after, more=1).collect()
    n = min(limit, MOST_LIMIT)
    kept = rows[:n]
    return kept, (kept[-1][sort_by], kept[-1]["id"]) if len(rows) > n else None


def get_file(files: DataFrame, file_chunks: DataFrame, file_id: int) -> DataFrame:
    """A file, deleted or not, with its number of chunks; no row if it isn't known."""
    n = file_chunks.where(F.col("file_id") == file_id).agg(F.count("ordinal").alias("chunk_count"))
    return files.where(F.col("id") == file_id).withColumn("one_", F.lit(1)).join(n.withColumn("one_", F.lit(1)), "one_").drop("one_")


def chunk_counts(files: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """(id, chunk_count) of all files."""
    n = file_chunks.groupBy(F.col("file_id").alias("id")).agg(F.count("ordinal").alias("chunk_count"))
    return files.select("id").join(n, "id", "left").select("id", F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"))


def chunks_of(files: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """Files with their chunks, in order."""
    return files.select(F.col("id").alias("file_id"), "path").join(file_chunks, "file_id").orderBy("file_id", "ordinal")
