"""The content-addressed store: a Parquet dataset of (hash, bytes), parted by the first byte of the hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_hex, hash_shard


def chunk_path(root: str, h: Column) -> Column:
    """Where a chunk is in a store of files: a folder of two hex digits, a file of the others."""
    x = hash_hex(h)
    return F.concat_ws("/", F.lit(root), F.substring(x, 1, 2), F.substring(x, 3, 62))


def absent(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """The distinct chunks that aren't stored yet: what a put writes."""
    return chunks.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def fetched(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Each wanted hash with its bytes, null if it isn't stored."""
    return wanted.join(stored.select("hash", "bytes"), "hash", "left")


def present(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored.select("hash"), "hash", "left_semi")


def reference_counts(chunks: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """chunks with ref_count: rows that refer to each, so a chunk twice in one file counts twice."""
    n = file_chunks.groupBy(F.col("chunk_hash").alias("hash")).agg(F.count("*").alias("n_"))
    return chunks.drop("ref_count").join(n, "hash", "left").withColumn("ref_count", F.coalesce("n_", F.lit(0).cast("long"))).drop("n_")


def recount(chunks: DataFrame, file_chunks: DataFrame, touched: DataFrame) -> DataFrame:
    """chunks with the counts of the touched hashes renewed; others keep theirs."""
    hashes = touched.select("hash").distinct()
    refs = file_chunks.join(hashes.withColumnRenamed("hash", "chunk_hash"), "chunk_hash", "left_semi")
    renewed = reference_counts(chunks.join(hashes, "hash", "left_semi"), refs)
    return chunks.join(hashes, "hash", "left_anti").unionByName(renewed)


def orphans(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("ref_count") == 0)


def sweep_totals(chunks: DataFrame, dry_run: bool = False) -> DataFrame:
    """What a sweep finds: orphans scanned, removed (none on a dry run), and the bytes of all of them either way."""
    found = orphans(chunks).agg(F.count("*").alias("scanned"), F.coalesce(F.sum("length"), F.lit(0).cast("long")).alias("bytes_reclaimed"))
    return found.select("scanned", (F.lit(0).cast("long") if dry_run else F.col("scanned")).alias("removed"), "bytes_reclaimed")


def survivors(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("ref_count") > 0)


def dedup_totals(file_chunks: DataFrame) -> DataFrame:
    """Logical bytes of all references, physical bytes of the distinct chunks, and both counts; one pass with partial sums."""
    each = file_chunks.groupBy("chunk_hash").agg(F.count("*").alias("n"), F.sum("length").alias("logical"), F.min("length").alias("physical"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("references"), F.count("*").alias("chunks"),
        F.coalesce(F.sum("logical"), F.lit(0).cast("long")).alias("logical_bytes"), F.coalesce(F.sum("physical"), F.lit(0).cast("long")).alias("physical_bytes"),
    )


class ChunkStore:
    """A store in a folder. put is idempotent; a sweep writes what stays of the shards that lose chunks to new files, then deletes the old ones, so that a sweep that dies loses nothing: chunks may be stored twice until the next, and are read once."""

    SCHEMA = "hash binary, length long, bytes binary, shard string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if self._exists() else self.spark.createDataFrame([], self.SCHEMA)

    def put(self, chunks: DataFrame) -> None:
        """chunks: hash, bytes."""
        new = absent(chunks.select("hash", "bytes"), self.read())
        out = new.select("hash", F.octet_length("bytes").cast("long").alias("length"), "bytes", hash_shard(F.col("hash")).alias("shard"))
        out.repartition("shard").write.mode("append").partitionBy("shard").parquet(self.path)

    def get(self, wanted: DataFrame) -> DataFrame:
        found = present(self.read(), wanted.select("hash").distinct()).dropDuplicates(["hash"])
        return fetched(wanted, found)

    def held(self, chunks: DataFrame) -> DataFrame:
        """The chunks (hash, ...) whose bytes are stored: what a sweep may count."""
        return present(chunks, self.read().select("hash").distinct())

    def sweep(self, chunks: DataFrame, dry_run: bool = False) -> dict:
        """Drops the bytes of orphans that are stored; the totals of those, so that a second sweep finds none."""
        chunks = self.held(chunks)
        totals = sweep_totals(chunks, dry_run).first().asDict()
        if dry_run or not totals["scanned"]:
            return totals
        gone = orphans(chunks).select("hash")
        shards = [r[0] for r in gone.select(hash_shard(F.col("hash"))).distinct().collect()]  # at most 256
        hit = self.read().where(F.col("shard").isin(shards))
        old = [r[0] for r in hit.select(F.input_file_name()).distinct().collect()]  # the names of their files
        keep = hit.join(gone, "hash", "left_anti").dropDuplicates(["hash"])
        keep.repartition("shard").write.mode("append").partitionBy("shard").parquet(self.path)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in old:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(name))
            p.getFileSystem(conf).delete(p, False)
        return totals
