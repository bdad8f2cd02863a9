"""The event log: a Parquet dataset that is only appended to and totally ordered by seq."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import KINDS, LOG, columns


def stream_from(log: DataFrame, after: int = 0) -> DataFrame:
    """Events past a seq, in order; 0 replays all. The bound is pushed down to the files."""
    return log.where(F.col("seq") > after).orderBy("seq")


def head(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("head"))


def event_at(log: DataFrame, seq: int) -> DataFrame:
    """The first event at a seq or after it."""
    return log.where(F.col("seq") > seq - 1).orderBy("seq").limit(1)


def numbered(events: DataFrame, after: int, order: list[str | Column]) -> DataFrame:
    """Events with gap-free seqs past `after`. Sorted in ranges; each range's offset comes from the counts before it, so no task gets all rows."""
    part = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    ranked = part.withColumn("at_", F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    counts = ranked.groupBy("part_").agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_"))
    return ranked.join(counts.select("part_", "before_"), "part_").withColumn("seq", F.lit(after).cast("long") + F.col("before_") + F.col("at_")).drop("part_", "at_", "before_")


def conform(events: DataFrame) -> DataFrame:
    """All columns of the log, null where the events lack them."""
    spark = events.sparkSession
    have = set(events.columns)
    fields = spark.createDataFrame([], LOG).schema.fields
    return events.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def encode(log: DataFrame) -> DataFrame:
    """Envelope and payload: seq, kind, at, v, payload (JSON of the columns that are set)."""
    rest = [c for c in columns(LOG) if c not in ("seq", "kind", "at", "v")]
    return log.select("seq", "kind", "at", "v", F.to_json(F.struct("kind", "at", "v", *rest)).alias("payload"))


def decode(coded: DataFrame) -> DataFrame:
    """The log of an encoded one; kind, at and v come from the payload, whatever the envelope says."""
    rest = ", ".join(x for x in _fields(LOG) if not x.startswith("seq "))
    return conform(coded.select("seq", F.from_json("payload", rest).alias("p")).select("seq", "p.*"))


def _fields(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return out


class EventLog:
    """A log in a folder. One writer at a time appends; each append is one Parquet write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(fs_path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def read_stream(self, max_files: int = 100) -> DataFrame:
        return self.spark.readStream.schema(LOG).option("maxFilesPerTrigger", max_files).parquet(self.path)

    def head(self) -> int:
        return head(self.read()).first()["head"]

    @contextmanager
    def writer(self) -> Iterator[None]:
        """Holds the log's lock, a file that can be made only once; in stores whose files can't be made exclusively, appends must be kept apart by the caller."""
        if "://" in self.path and not self.path.startswith("file://"):
            mark = self.spark._jvm.org.apache.hadoop.fs.Path(self.path.rstrip("/") + ".lock")
            fs = mark.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            try:
                fs.create(mark, False).close()
            except Py4JJavaError as e:
                if not fs.exists(mark):
                    raise
                raise RuntimeError(f"another writer holds {mark}") from e
            try:
                yield
            finally:
                fs.delete(mark, False)
            return
        lock = Path(self.path.removeprefix("file://") + ".lock")
        lock.parent.mkdir(parents=True, exist_ok=True)
        try:
            lock.open("x").close()
        except FileExistsError:
            raise RuntimeError(f"another writer holds {lock}") from None
        try:
            yield
        finally:
            lock.unlink()

    def append(self, events: DataFrame, order: list[str | Column] | None = None) -> int:
        """Appends events in an order; the new head."""
        bad = events.where(~F.col("kind").isin(*KINDS) | F.col("kind").isNull()).limit(1).collect()
        if bad:
            raise ValueError(f"unknown event kind {bad[0]['kind']!r}")
        with self.writer():
            conform(numbered(events, self.head(), order or ["at"])).write.mode("append").parquet(self.path)
        return self.head()

    def append_rows(self, rows: list[dict]) -> int:
        """Appends a few events in the given order."""
        have = {k for r in rows for k in r}
        fields = ["n_ long", *(x for x in _fields(LOG) if x.split()[0] in have)]
        df = self.spark.createDataFrame([(k, *(r.get(f.split()[0]) for f in fields[1:])) for k, r in enumerate(rows)], ", ".join(fields))
        return self.append(df, ["n_"])
