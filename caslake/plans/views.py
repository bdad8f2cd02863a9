"""The driver's tables as the engine's: files, locations, log, scan and chunks, on Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chunking import fixed_chunks
from ..functions.hashing import sha256

EPOCH = 1704067200000000
CHUNK = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mtime = F.lit(EPOCH) + (F.col("doc_id") * 7919 % 86400) * 1_000_000
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        (F.col("doc_id") + 1).alias("id"), path.alias("path"), F.octet_length("text").cast("long").alias("size"), mtime.alias("mtime_us"), sha256(F.col("text")).alias("root_hash"),
        F.when(F.col("doc_id") % 11 == 0, mtime + 1).alias("deleted_at_us"), (mtime + F.col("doc_id") % 5).alias("indexed_at_us"),
    )


FILES = f"""files AS (
    SELECT doc_id + 1 AS id, '/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size,
        {EPOCH} + (doc_id * 7919 % 86400) * 1000000 AS mtime_us, sha256(text) AS root_hash,
        CASE WHEN doc_id % 11 = 0 THEN {EPOCH} + (doc_id * 7919 % 86400) * 1000000 + 1 END AS deleted_at_us,
        {EPOCH} + (doc_id * 7919 % 86400) * 1000000 + doc_id % 5 AS indexed_at_us
    FROM documents)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location per source, a nested one for each source with a number of two digits; one was removed. There are as many as sources, so numbering them is a small sort."""
    s = table(spark, sf_dir, "documents").select("source").distinct()
    top = F.concat(F.lit("/"), "source")
    paths = s.select(F.explode(F.when(F.length("source") >= 5, F.array(top, F.concat(top, F.lit("/en")))).otherwise(F.array(top))).alias("path"))
    n = paths.withColumn("id", F.row_number().over(Window.orderBy("path")).cast("long"))
    at = F.lit(EPOCH) + F.col("id")
    return n.select(
        "id", "path", at.alias("added_at_us"), F.when(F.col("path") == "/src3", at + 1000).alias("removed_at_us"), F.when(F.col("id") % 4 != 0, at + 10).alias("scan_started_at_us"),
        F.when(F.col("id") % 3 != 0, at + 5 + F.col("id") % 7 * 2).alias("last_scanned_at_us"), F.array().cast("array<string>").alias("ignore_patterns"),
        F.when(F.col("id") % 2 == 0, "content").otherwise("shallow").alias("index_mode"),
    )


LOCATIONS = f"""locations AS (
    SELECT id, path, {EPOCH} + id AS added_at_us, CASE WHEN path = '/src3' THEN {EPOCH} + id + 1000 END AS removed_at_us,
        CASE WHEN id % 4 <> 0 THEN {EPOCH} + id + 10 END AS scan_started_at_us, CASE WHEN id % 3 <> 0 THEN {EPOCH} + id + 5 + id % 7 * 2 END AS last_scanned_at_us,
        CASE WHEN id % 2 = 0 THEN 'content' ELSE 'shallow' END AS index_mode
    FROM (SELECT path, row_number() OVER (ORDER BY path) AS id FROM (
        SELECT DISTINCT '/' || source AS path FROM documents UNION SELECT DISTINCT '/' || source || '/en' FROM documents WHERE length(source) >= 5)))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    view = F.element_at(F.array(*(F.lit(f"location_{k}") for k in ("added", "removed", "scan_started", "scan_completed", "ignore_set", "mode_set"))), (F.col("event_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "signup", "file_indexed").when(F.col("event_type") == "click", "file_modified").when(F.col("event_type") == "error", "file_deleted").when(F.col("event_type") == "purchase", "location_scan_progress").otherwise(view)
    top = F.concat(F.lit("/u/"), (u % 17).cast("string"))
    content = F.col("kind").isin("file_indexed", "file_modified")
    progress = F.col("kind") == "location_scan_progress"
    seq = F.col("event_id") + 1
    rows = e.withColumn("kind", kind)
    chunk = lambda k: F.struct((k * 100).cast("long").alias("offset"), F.lit(100).cast("long").alias("length"), sha256(F.concat(F.lit("c"), ((F.col("event_id") + k) % 50).cast("string"))).alias("hash"))
    size = (F.col("event_id") % 3 + 1) * 100
    return rows.select(
        seq.alias("seq"), "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("v"),
        F.when(F.col("kind").startswith("file_"), F.concat(top, F.lit("/f"), u.cast("string"))).otherwise(top).alias("path"), F.lit(None).cast("string").alias("from_path"), F.lit(None).cast("string").alias("to_path"),
        F.when(content, size).alias("size"), F.when(content, F.lit(EPOCH) + F.col("event_id") * 1_000_000).alias("mtime_us"), F.when(content, sha256(F.concat(F.lit("r"), (F.col("event_id") % 97).cast("string")))).alias("root_hash"),
        F.when(content, F.transform(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3), chunk)).alias("chunks"),
        *(F.when(progress, F.col("event_id") % n).alias(c) for c, n in (("files_done", 10), ("bytes_done", 1000))), F.when(progress, F.concat(top, F.lit("/now"))).alias("current_path"),
        F.when(progress & (F.col("event_id") % 2 == 0), F.lit(10).cast("long")).alias("total_files"), F.when(progress & (F.col("event_id") % 2 == 0), F.lit(1000).cast("long")).alias("total_bytes"),
        F.when(F.col("kind") == "location_ignore_set", F.array(F.lit("*.log"), F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")))).alias("patterns"),
        F.when(F.col("kind") == "location_mode_set", F.when(F.col("event_id") % 4 < 2, "content").otherwise("shallow")).alias("mode"),
    )


LOG = f"""log AS (
    SELECT event_id, event_id + 1 AS seq, kind, epoch_us(ts) AS at, user_id,
        CASE WHEN starts_with(kind, 'file_') THEN '/u/' || user_id % 17 || '/f' || user_id ELSE '/u/' || user_id % 17 END AS path,
        CASE WHEN kind IN ('file_indexed', 'file_modified') THEN (event_id % 3 + 1) * 100 END AS size,
        CASE WHEN kind IN ('file_indexed', 'file_modified') THEN {EPOCH} + event_id * 1000000 END AS mtime_us,
        CASE WHEN kind IN ('file_indexed', 'file_modified') THEN sha256('r' || event_id % 97) END AS root_hash,
        CASE WHEN kind = 'location_ignore_set' THEN ['*.log', 'p' || event_id % 5] END AS patterns,
        CASE WHEN kind = 'location_mode_set' THEN CASE WHEN event_id % 4 < 2 THEN 'content' ELSE 'shallow' END END AS mode
    FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'file_indexed' WHEN 'click' THEN 'file_modified' WHEN 'error' THEN 'file_deleted' WHEN 'purchase' THEN 'location_scan_progress'
        ELSE ['location_added', 'location_removed', 'location_scan_started', 'location_scan_completed', 'location_ignore_set', 'location_mode_set'][event_id % 6 + 1] END AS kind FROM events)),
    log_chunks AS (
        SELECT l.seq, l.path, CAST(k AS INTEGER) AS ordinal, k * 100 AS "offset", CAST(100 AS BIGINT) AS length, sha256('c' || (event_id + k) % 50) AS hash
        FROM log l, range(3) t(k) WHERE kind IN ('file_indexed', 'file_modified') AND k <= event_id % 3)"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    doc = F.col("id") - 1
    seen = f.where(doc % 13 != 0).select("path", (F.col("size") + F.when(doc % 7 == 0, 1).otherwise(0)).alias("size"), (F.col("mtime_us") + F.when(doc % 14 == 0, 1_000_000).otherwise(0)).alias("mtime_us"))
    new = f.where(doc % 17 == 0).select(F.concat("path", F.lit(".new")).alias("path"), "size", "mtime_us")
    return seen.unionByName(new)


SCAN = f"""{FILES}, scan AS (
    SELECT path, size + CASE WHEN (id - 1) % 7 = 0 THEN 1 ELSE 0 END AS size, mtime_us + CASE WHEN (id - 1) % 14 = 0 THEN 1000000 ELSE 0 END AS mtime_us FROM files WHERE (id - 1) % 13 <> 0
    UNION ALL SELECT path || '.new', size, mtime_us FROM files WHERE (id - 1) % 17 = 0)"""


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 512 bytes of each document's text."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("file_id"), F.posexplode(fixed_chunks(F.encode("text", "UTF-8"), CHUNK)).alias("ordinal", "c"))
    return d.select("file_id", "ordinal", "c.offset", "c.length", F.col("c.hash").alias("chunk_hash"))


#: DuckDB has no slices of blobs; hex digits are cut in pairs instead.
FILE_CHUNKS = f"""file_chunks AS (
    SELECT file_id, CAST(k AS INTEGER) AS ordinal, k * {CHUNK} AS "offset", CAST(length(x) / 2 AS BIGINT) AS length, sha256(unhex(x)) AS chunk_hash
    FROM (SELECT doc_id + 1 AS file_id, k, substr(hex(encode(text)), CAST(k * {2 * CHUNK} + 1 AS INTEGER), {2 * CHUNK}) AS x
        FROM documents, range(100000) t(k) WHERE k < (strlen(text) + {CHUNK - 1}) // {CHUNK}))"""


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks ever seen: those of live files are referenced, others only if another live file has them."""
    return file_chunks(spark, sf_dir).groupBy(F.col("chunk_hash").alias("hash")).agg(F.min("length").alias("length"))


def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_chunks(spark, sf_dir).where((F.col("file_id") - 1) % 11 != 0)


CHUNKS = f"""{FILE_CHUNKS}, live_chunks AS (SELECT * FROM file_chunks WHERE (file_id - 1) % 11 <> 0),
    chunks AS (SELECT c.hash, c.length, coalesce(n, 0) AS ref_count FROM (SELECT chunk_hash AS hash, min(length) AS length FROM file_chunks GROUP BY 1) c
        LEFT JOIN (SELECT chunk_hash AS hash, count(*) AS n FROM live_chunks GROUP BY 1) r USING (hash))"""


def pages_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))


PAGES_REL = "pages_rel AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)"
