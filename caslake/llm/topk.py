"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging.

Queries are taken in blocks of bounded bytes, and the vectors in shards that are streams of tiles. A tile is multiplied
with a block in matrix products of bounded size, the k best of each query are selected from each product and merged with
the running lists of block and shard, so that these send at most k rows a query. If the queries are one block, which is
counted first, it is broadcast and each partition is a shard. Beyond that nothing goes through the driver: blocks and
shards of bounded bytes are dealt to the cells of a grid, and each cell has one block and one shard. All lists then meet in a
tree: first the k best within each of `fan` groups of lists, then the k best of the groups. Spark's limit on ranked
windows keeps only k rows a query before each shuffle, so that no task gets more than k rows of a query from another.

Defined cases: null vectors, and vectors that hold null, NaN or infinite components, take no part; nor do rows with a
null id. Vectors of another length than the query's are no candidates of it. Rows with the query's own id are never
its candidates; every other row is one, repeated rows too. A query id that is stored with several vectors asks with the
smallest of them. Ties go to the smaller id. With fewer than k candidates, all are returned; an empty table gives no rows.
Components whose products could leave 53 bits are multiplied as Python integers, and scores are clamped to 64 bits.
Other columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "query_id long, vec_id long, score long, shard int"
ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int32())])


def quantised(x: Column) -> Column:
    """floor(256 x) of each component, as double; null if the vector can't take part."""
    # floor() to long would clamp; doubles past 2^53 are whole already
    exact = F.transform(x, lambda c: F.when(F.abs(c.cast("double")) < F.lit(2.0**45), F.floor(c.cast("double") * F.lit(256.0)).cast("double")).otherwise(c.cast("double") * F.lit(256.0)))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return F.when(x.isNotNull() & ~F.coalesce(bad, F.lit(True)), exact)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number products of rows, as int64."""
    most = lambda a: float(np.abs(a).max(initial=0.0))
    if most(q) * most(v) * q.shape[1] < 2.0**53:
        return np.rint(q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q.tolist()], dtype=object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in v.tolist()], dtype=object).reshape(v.shape).T
    return np.array([[max(-(2**63), min(2**63 - 1, s)) for s in r] for r in exact], dtype=np.int64).reshape(len(q), len(v))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by (score desc, id asc). ids has the shape of scores."""
    if scores.shape[1] > k:
        # all that reach the k-th score stay until the exact sort: ties are settled by id
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        keep = scores >= kth[:, None]
        width = int(keep.sum(axis=1).max())
        if width < scores.shape[1]:
            order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
            pad = ~np.take_along_axis(keep, order, axis=1)
            scores, ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
            ids = np.where(pad, np.iinfo(np.int64).max, ids)
            scores = np.where(pad, np.iinfo(np.int64).min, scores)
    order = _order(scores, ids)
    return np.take_along_axis(scores, order, axis=1)[:, :k], np.take_along_axis(ids, order, axis=1)[:, :k]


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    by_id = np.argsort(ids, axis=1, kind="stable")
    by_score = np.argsort(~np.take_along_axis(scores, by_id, axis=1), axis=1, kind="stable")  # ~s falls as s grows, without overflow
    return np.take_along_axis(by_id, by_score, axis=1)


#: What stands for "no candidate" in a list.
NONE = np.iinfo(np.int64).max


#: Scores that a matrix product has at most, unless the tile alone has more.
PRODUCT = 2 << 20


def _matrices(ids: np.ndarray, vecs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of each length."""
    dims = np.asarray(pc.list_value_length(vecs), dtype=np.int64)
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield ids[at], np.asarray(vecs.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), d)


def _search(blocks: dict, k: int, tile: int):
    """blocks: by vector length, (query ids, query matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        step = max(1, PRODUCT // tile)
        held = {d: (np.full((len(q), k), np.iinfo(np.int64).min), np.full((len(q), k), NONE)) for d, (q, _) in blocks.items()}
        for batch in batches:
            ids, vecs = np.asarray(batch.column(0), dtype=np.int64), batch.column(1)
            for a in range(0, len(ids), tile):
                for own, v in _matrices(ids[a : a + tile], vecs.slice(a, tile)):
                    if v.shape[1] not in blocks:
                        continue
                    qid, q = blocks[v.shape[1]]
                    scores, found = held[v.shape[1]]
                    for c in range(0, len(qid), step):
                        part = slice(c, c + step)
                        s = _products(q[part], v)
                        i = np.broadcast_to(own, s.shape)
                        mine = i == qid[part, None]
                        if mine.any():
                            s, i = np.where(mine, np.iinfo(np.int64).min, s), np.where(mine, NONE, i)
                        s, i = best(s, i, k)
                        s, i = np.concatenate([scores[part], s], axis=1), np.concatenate([found[part], i], axis=1)
                        scores[part], found[part] = best(s, i, k)
        shard = TaskContext.get().partitionId() if TaskContext.get() else 0
        for d, (s, i) in held.items():
            row, col = np.nonzero(i != NONE)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(blocks[d][0][row]), pa.array(i[row, col]), pa.array(s[row, col]), pa.array(np.full(len(row), shard, np.int32))], schema=ARROW)

    return run


def _grid(rows: DataFrame, queries: DataFrame, blocks: int, shards: int, k: int, tile: int) -> DataFrame:
    """The lists of each block in each shard; both sides are dealt evenly, however often an id is repeated."""
    # a cogroup mixes up columns of both sides that are the same, so the ids of queries get another name
    left = queries.select(F.col("i").alias("query_id"), F.col("v").alias("query")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # such tables lack columns
            return ARROW.empty_table()
        block = {v.shape[1]: (ids, v) for b in left.select(["query_id", "query"]).combine_chunks().to_batches() for ids, v in _matrices(np.asarray(b.column(0), dtype=np.int64), b.column(1))}
        return pa.Table.from_batches(_search(block, k, tile)(right.select(["i", "v"]).to_batches()), schema=ARROW)

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(cell, SCHEMA)


def _top(rows: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), F.asc("vec_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = 8 << 20, tile: int = 2048, fan: int = 16, cell_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on the id column. block_bytes bounds what is broadcast; cell_bytes, beyond that, is about what a block and a shard of the grid have each."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), quantised(F.col(vector_col)).alias("v"), is_query.alias("q")).where(F.col("i").isNotNull() & F.col("v").isNotNull())
    queries = rows.where(F.col("q")).groupBy("i").agg(F.min("v").alias("v"))
    size = rows.agg(F.count("*").alias("rows"), F.count_if(F.coalesce("q", F.lit(False))).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = 8 * max(1, size["d"])
    if size["n"] * width <= block_bytes:
        held: dict = {}
        for r in queries.collect():  # at most block_bytes, as counted
            held.setdefault(len(r["v"]), []).append((r["i"], r["v"]))
        block = {d: (np.array([i for i, _ in x], dtype=np.int64), np.array([v for _, v in x], dtype=np.float64).reshape(len(x), d)) for d, x in held.items()}
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _search(shared.value, k, tile)(batches)

        out = rows.select("i", "v").mapInArrow(run, SCHEMA)
    else:
        out = _grid(rows.select("i", "v"), queries, -(-size["n"] * width // cell_bytes), -(-size["rows"] * width // cell_bytes), k, tile)
    lists = _top(out.withColumn("node", F.col("shard") % fan), k, "node").drop("rank", "node")
    return _top(lists, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
