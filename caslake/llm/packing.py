"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt to shards of about `shard_docs` by a hash of their id; a shard is packed on its own, longest first.
A shard's bins are kept in the order of what is left in them, and each carries two bitmaps: the duplicate clusters it
holds, and the sources of which it holds as many documents as the quota allows. For each document the search starts at
the least residual that is enough, and goes on to the next larger one until a bin has neither bit; a new bin is opened
if there is none. Copies of one document follow each other, and each search goes on where the last one ended, since
what conflicts with one copy conflicts with the next; so a group of copies costs a pass over the bins.

Only ids, lengths, sources and cluster hashes are shuffled, never texts. Texts longer than a bin are cut into pieces:
whole bins, and a rest that is packed like any document, so nothing is dropped.

Defined cases: null and empty texts have nothing to pack: one row, piece 0, no bin, length 0. A null source is a source
of its own. Rows with a null id are dealt by their position. Repeated rows are copies: they are packed into different
bins. Equal lengths go in the order of cluster, source and id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SCHEMA = "doc_id long, piece int, bin_id long, start int, n_tokens int, cluster long, source string"


def words(text: str = "text") -> Column:
    """The default length: runs of characters that aren't white space."""
    return F.regexp_count(text_or_empty(text), F.lit(r"\S+"))


def exact_cluster(text: str = "text") -> Column:
    """The default cluster: texts that are equal but for case and white space."""
    return F.xxhash64(F.regexp_replace(F.lower(F.trim(text_or_empty(text))), r"\s+", " "))


def best_fit(items: list[tuple[int, int, str | None]], capacity: int, quota: int) -> list[tuple[int, int]]:
    """(bin, start) of each (length, cluster, source); items are sorted by falling length, then cluster and source. Lengths are 1 to capacity."""
    bits: dict = {}
    bit = lambda kind, x: 1 << bits.setdefault((kind, x), len(bits))
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    clusters: list[int] = []
    full: list[int] = []
    held: list[dict] = []
    out, last, resume = [], None, None
    for item in items:
        length, cluster, source = item
        c, s = bit("c", cluster), bit("s", source)
        i = bisect_right(order, resume) if item == last else bisect_left(order, (length, -1))
        while i < len(order) and (clusters[order[i][1]] & c or full[order[i][1]] & s):
            i += 1
        if i < len(order):
            resume = order.pop(i)
            residual, b = resume
        else:
            residual, b = capacity, len(clusters)
            resume = (capacity + 1, -1)
            clusters.append(0)
            full.append(0)
            held.append({})
        out.append((b, capacity - residual))
        clusters[b] |= c
        held[b][source] = held[b].get(source, 0) + 1
        if held[b][source] >= quota:
            full[b] |= s
        if residual > length:
            insort(order, (residual - length, b))
        last = item
    return out


def pack(docs: DataFrame, capacity: int = 2048, quota: int = 4, shard_docs: int = 4096, length: Column | None = None, cluster: Column | None = None, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, bin_id, start, n_tokens, cluster, source. quota: documents of one source that a bin may hold."""
    meta = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length if length is not None else words(text), F.lit(0)).cast("long").alias("n"),
        F.coalesce(cluster if cluster is not None else exact_cluster(text), F.lit(0)).cast("long").alias("cluster"), F.col(source).cast("string").alias("source"),
    )
    shards = max(1, -(-docs.count() // shard_docs))
    dealt = meta.withColumn("shard", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.monotonically_increasing_id()), F.lit(11)), F.lit(shards)).cast("int"))

    def shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base, out = int(key[0]) << 32, []
        ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
        sources = [None if pd.isna(x) else x for x in rows["source"]]
        work, whole = [], 0
        for d, n, c, s in zip(ids, rows["n"].tolist(), rows["cluster"].tolist(), sources, strict=True):
            if not n:
                out.append((d, 0, None, 0, 0, c, s))
                continue
            pieces, rest = divmod(n, capacity)
            for p in range(pieces):
                out.append((d, p, base + (1 << 31) + whole, 0, capacity, c, s))
                whole += 1
            if rest:
                work.append((-rest, c, s is not None, s or "", d is not None, d or 0, pieces))
        work.sort()
        items = [(-n, c, s if known else None) for n, c, known, s, *_ in work]
        for (n, c, s), (*_, known, d, p), (b, start) in zip(items, work, best_fit(items, capacity, quota), strict=True):
            out.append((d if known else None, p, base + b, start, n, c, s))
        frame = pd.DataFrame(out, columns=["doc_id", "piece", "bin_id", "start", "n_tokens", "cluster", "source"])
        return frame.astype({"doc_id": "Int64", "bin_id": "Int64", "piece": "int32", "start": "int32", "n_tokens": "int32", "cluster": "int64"})

    return dealt.groupBy("shard").applyInPandas(shard, SCHEMA)
