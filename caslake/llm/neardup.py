r"""Near-duplicate detection by BagMinHash.

A text's words (runs of letters, digits and underscores, in lower case) give a multiset of shingles of `WORDS` words.
BagMinHash signs it: each shingle has a Poisson process over time and weight, cut hierarchically into the dyadic cells
[0,1), [1,2), [2,4), ... of the discretised weight; a cell's points come in the order of time, from a hash of shingle
and cell; a point counts if its weight is below the shingle's multiplicity, and it goes to a register drawn by hash.
Each register keeps its earliest point; a process stops when it is later than all registers. Two signatures agree in a
register with a probability that is the weighted Jaccard similarity (least over greatest multiplicities).

Signatures are cut into bands, whose equal values make buckets. No pairs are made of a bucket: its members are compared
with one of them, the pivot, by their exact multiset overlap, and those that reach `SIMILARITY` are linked to it. The
pivot is the member that shares the most buckets with others, so that all buckets of a crowd of copies have the same
one and it is close to most. What may be alike beyond that is among the members that one pivot was compared with, and
of different classes:

- Up to `CROWD` members and `CROWD_BYTES` of texts, one task links them all exactly: a pair at the threshold has one of
  its rarest shingles in common (prefix filtering), its sizes are close, and so are its distances to the pivot, since
  1 - similarity is a metric; pairs that already are in one class need no comparison.
- Larger crowds go by their buckets: one within those bounds is linked by one task; a larger one takes rounds. It gets
  a new pivot, attached members are compared with others only at distances to the pivot that the metric allows, and what
  isn't attached goes on in the same bucket, until it is within the bounds or has no members of different classes that
  weren't compared or ruled out.

Classes are the connected components of the verified links.

Equal texts are one node from the start, whatever their number. No bucket, class or list of partners is bounded.

Defined cases: null texts count as empty; texts without words are alike only if they are equal; a text of fewer than
WORDS words is one shingle; the class id is the least doc_id of the class, or a negative number from a hash if it has
none; repeated rows are in one class. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, mix64, release, slices, text_or_empty
from .graph import components

WORDS, SIMILARITY = 5, 0.8
#: Bands of so many registers: at a similarity of 0.8, two texts have no band in common with a probability of 3e-6.
BANDS, ROWS = 24, 4
PHI = np.uint64(0x9E3779B97F4A7C15)
FACTOR = np.uint64(0xD1342543DE82EF95)
#: Bounds of what one task links at once.
CROWD, CROWD_BYTES = 20_000, 32 << 20


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Names of the shingles of all texts, one text after the other, and each text's number of them."""
    import xxhash

    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}_]+", " "))
    split = pc.split_pattern(plain, " ")
    flat = split.flatten()
    some = np.asarray(pc.not_equal(plain, ""), dtype=bool)
    n = np.asarray(split.value_lengths(), dtype=np.int64)
    enc = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in enc.dictionary.to_pylist()), dtype=np.uint64, count=len(enc.dictionary))
    w = own[np.asarray(enc.indices, dtype=np.int64)] if len(flat) else np.zeros(0, np.uint64)
    start = np.cumsum(n) - n
    size = np.where(some, np.maximum(n - words + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), size)
    at = start[doc] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    span = np.minimum(n, words)[doc]
    x = span.astype(np.uint64) * PHI
    for k in range(words):
        step = mix64(x + w[np.minimum(at + k, max(len(w) - 1, 0))]) if len(w) else x
        x = np.where(k < span, step * FACTOR, x)
    return mix64(x), size


def signatures(hashes: np.ndarray, size: np.ndarray, registers: int) -> np.ndarray:
    """BagMinHash of each multiset: earliest times by register; infinite for empty ones."""
    docs = len(size)
    doc = np.repeat(np.arange(docs), size)
    out = np.full((docs, registers), np.inf)
    if not len(hashes):
        return out
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    weight = np.diff(np.append(first, len(h))).astype(np.float64)
    h, d = h[first], d[first]
    parts = []
    for j in range(int(weight.max()).bit_length() + 1):
        low, length = (0.0, 1.0) if j == 0 else (2.0 ** (j - 1), 2.0 ** (j - 1))
        on = weight > low
        parts.append((mix64(h[on] + np.uint64((j + 1) * int(PHI) % 2**64)), d[on], weight[on], np.full(on.sum(), low), np.full(on.sum(), length)))
    x, d, weight, low, length = (np.concatenate(p) for p in zip(*parts, strict=True))
    t = np.zeros(len(x))
    flat = out.reshape(-1)
    worst = np.full(docs, np.inf)
    unit = 2.0**-53
    while len(x):
        x = mix64(x + PHI)
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * unit) / (length * registers)
        on = t < worst[d]
        x, d, t, weight, low, length = x[on], d[on], t[on], weight[on], low[on], length[on]
        y = mix64(x ^ FACTOR)
        below = low + (y >> np.uint64(33)).astype(np.float64) * 2.0**-31 * length < weight
        np.minimum.at(flat, d[below] * registers + ((y & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)[below], t[below])
        live = np.unique(d)
        worst[live] = out[live].max(axis=1)
    return out


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    v = np.ascontiguousarray(sign).view(np.uint64)
    n = v.shape[1] // rows
    x = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64) * PHI, (len(v), n)).copy()
    for k in range(rows):
        x = mix64(x + v[:, k::rows][:, :n]) * FACTOR
    return x


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of names."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    u, p = np.unique(a, return_counts=True)
    v, q = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(p[i], q[j]).sum())
    return both / (len(a) + len(b) - both)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        h, size = shingles(b.column("text"))
        v = bands(signatures(h, size, BANDS * ROWS))
        flat = pa.array(v.reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(size) * BANDS + 1, BANDS, dtype=np.int32)), flat)
        keep = pa.array(size > 0)
        yield pa.RecordBatch.from_arrays([b.column("k"), lists], names=["k", "v"]).filter(keep)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text_a"):
        one, size = shingles(b.column("text_a"))
        end = np.cumsum(size)
        keys = b.column("b").to_pylist()
        first = [r for r in range(len(keys)) if not r or keys[r] != keys[r - 1]]  # rows come sorted by b: each of its texts is read once
        run = np.cumsum(np.isin(np.arange(len(keys)), first)) - 1
        two, size_b = shingles(b.column("text_b").take(pa.array(first)))
        end_b = np.cumsum(size_b)
        out = [1 - similarity(one[end[r] - size[r] : end[r]], two[end_b[k] - size_b[k] : end_b[k]]) for r, k in enumerate(run.tolist())]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], names=["a", "b", "d"])


def link_crowd(bags: list[np.ndarray], classes: list, far: list[float], least: float) -> list[tuple[int, int]]:
    """Pairs that join different classes until no two members of different classes are alike. bags: the names of each member's shingles; far: its distance to one text."""
    sets = []
    for x in bags:
        u, at, n = np.unique(x, return_index=True, return_counts=True)
        more = [u] + [mix64(u[n > k] + np.uint64(k * int(PHI) % 2**64)) for k in range(1, int(n.max(initial=1)))]  # the k-th repeat of a shingle is a member of its own
        sets.append(np.unique(np.concatenate(more)))
    if not sets:
        return []
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    root = list(range(len(sets)))
    start: dict = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, c in enumerate(classes):
        root[find(k)] = find(start.setdefault(c, k))
    index: dict[int, dict[int, list[int]]] = {}
    out = []
    for x in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        s = sets[x]
        if not len(s):
            continue
        rare = s[np.lexsort((s, count[np.searchsorted(every, s)]))][: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1].tolist()
        tried = set()
        for token in rare:
            for group, rows in index.get(token, {}).items():
                if find(group) == find(x):
                    continue
                for y in rows:
                    if y in tried or len(sets[y]) < least * len(s) - 1e-9 or abs(far[x] - far[y]) > 1 - least + 1e-9:
                        continue
                    tried.add(y)
                    both = len(np.intersect1d(s, sets[y], assume_unique=True))
                    if both / (len(s) + len(sets[y]) - both) >= least - 1e-9:
                        out.append((x, y))
                        root[find(x)] = find(y)
                        break
        own = start[classes[x]]
        for token in rare:
            index.setdefault(token, {}).setdefault(own, []).append(x)
    return out


def _crowds(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by b: the members of each crowd follow each other."""
        now, keys, classes, far, bags = None, [], [], [], []

        def flush():
            pairs = link_crowd(bags, classes, far, least) if len(set(classes)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in pairs], pa.binary()), pa.array([keys[y] for _, y in pairs], pa.binary())], names=["a", "b"])

        for b in slices(batches):
            h, size = shingles(b.column("text"))
            end = np.cumsum(size)
            for r, (p, k, c, d) in enumerate(zip(*(b.column(x).to_pylist() for x in ("b", "k", "c", "d")), strict=True)):
                if p != now and keys:
                    yield flush()
                    keys, classes, far, bags = [], [], [], []
                now = p
                keys.append(k)
                classes.append(c)
                far.append(d)
                bags.append(h[end[r] - size[r] : end[r]].copy())
        if keys:
            yield flush()

    return run


def _distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, d) of each different pair; a is many, b few."""
    left = pairs.select("a", "b").distinct().join(texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b")
    return materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a binary, b binary, d double"), "distances")


def _merge(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links."""
    if classes is None:
        return materialise(components(links), "classes")
    lift = links.join(classes.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(classes.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
    lifted = lift.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = components(lifted).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = classes.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh_nodes = up.select(F.col("root").alias("node"), F.col("top").alias("root")).join(classes.select("node"), "node", "left_anti")
    out = materialise(moved.unionByName(fresh_nodes), "classes")
    release(classes)
    return out


def _of(rows: DataFrame, classes: DataFrame, key: str, name: str) -> DataFrame:
    c = classes.select(F.col("node").alias(key), F.col("root").alias("root_"))
    return rows.join(c, key, "left").withColumn(name, F.coalesce("root_", key)).drop("root_")


def _open(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, k, c) of the buckets whose members are of several classes."""
    rows = _of(rows, classes, "k", "c")
    mixed = rows.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where(F.col("x") != F.col("y")).select("bucket")
    return rows.join(mixed, "bucket", "left_semi")


def _pairs(rows: DataFrame) -> DataFrame:
    """(bucket, a, b, ca, cb) of each member and its bucket's pivot: a member of the class that is rarest in the bucket, the same one in as many buckets as can be."""
    rare = rows.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("k").alias("o"), F.col("k"))).alias("p"))
    pivot = rare.groupBy("bucket").agg(F.min(F.struct("n", "p.o", "p.k", "c")).alias("p")).select("bucket", F.col("p.k").alias("b"), F.col("p.c").alias("cb"))
    return rows.withColumnsRenamed({"k": "a", "c": "ca"}).join(pivot, "bucket").where(F.col("a") != F.col("b"))


def _central(members: DataFrame) -> DataFrame:
    """(bucket, a, b) of each member and its bucket's pivot: the one with the most bucket mates in all."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = members.join(sizes, "bucket").groupBy("k").agg(F.sum("n").alias("mates"))
    held = materialise(members.join(weight, "k"), "weighed")
    pivot = held.groupBy("bucket").agg(F.max(F.struct("mates", "k")).alias("p")).select("bucket", F.col("p.k").alias("b"))
    return held.select("bucket", F.col("k").alias("a")).join(pivot, "bucket").where(F.col("a") != F.col("b"))


def _link_small(now: DataFrame, texts: DataFrame, classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Classes after one task linked each bucket of (bucket, k, c) within the bounds of a crowd, and the open rest."""
    size = now.join(texts.select("k", F.octet_length("text").alias("bytes")), "k").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    size = materialise(size.select("bucket", ((F.col("n") <= CROWD) & (F.col("bytes") <= CROWD_BYTES)).alias("small")), "sizes")
    small = now.join(size.where(F.col("small")).select("bucket"), "bucket").join(texts, "k").select(F.col("bucket").alias("b"), "k", "c", F.lit(0.0).alias("d"), "text")
    links = materialise(small.repartition("b").sortWithinPartitions("b", "k").mapInArrow(_crowds(least), "a binary, b binary"), "links")
    classes = _merge(classes, links)
    rest = materialise(_open(now.join(size.where(~F.col("small")).select("bucket"), "bucket").select("bucket", "k"), classes), "open")
    release(size, links, now)
    return classes, rest


def _rounds(members: DataFrame, texts: DataFrame, classes: DataFrame, far: float) -> DataFrame:
    """Classes after the members of each bucket were compared with pivots until none is left that could join another class."""
    least = 1 + 1e-9 - far
    classes, now = _link_small(materialise(_open(members.select("bucket", "k"), classes), "open"), texts, classes, least)
    while not now.isEmpty():
        pairs = materialise(_pairs(now), "pairs")
        d = _distances(pairs.where(F.col("ca") != F.col("cb")), texts)
        placed = materialise(pairs.join(d, ["a", "b"], "left"), "placed")
        near = placed.where(F.col("d") <= far)
        classes = _merge(classes, near.select("a", "b").distinct())
        # attached members and others, at distances to the pivot that allow them to be alike
        reach = near.groupBy("bucket").agg(F.max("d").alias("most"))
        doubt = placed.where(F.col("d") > far).join(reach, "bucket").where(F.col("d") <= far + F.col("most")).select("bucket", F.col("a").alias("x"), F.col("d").alias("dx"))
        doubt = _of(doubt, classes, "x", "cx")
        there = _of(near.select("bucket", F.col("a").alias("y"), F.col("d").alias("dy")), classes, "y", "cy")
        doubtful = materialise(doubt.join(there, "bucket").where((F.col("dy") >= F.col("dx") - far) & (F.col("cx") != F.col("cy"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "doubtful")
        if not doubtful.isEmpty():
            more = _distances(doubtful, texts)
            classes = _merge(classes, more.where(F.col("d") <= far).select("a", "b"))
            release(more)
        left = placed.where(F.col("d").isNull() | (F.col("d") > far)).select("bucket", F.col("a").alias("k"))
        after = materialise(_open(left, classes), "open")
        release(pairs, d, placed, doubtful, now)
        classes, now = _link_small(after, texts, classes, least)
    release(now)
    return classes


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, text_md5: a row per document."""
    far = 1 - similarity + 1e-9
    base = docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text).alias("text")).withColumn("k", F.unhex(F.md5("text")))
    nodes = base.groupBy("k").agg(F.min("i").alias("one"))
    # copies of a text have one signature; partial aggregation leaves one row of them a task
    signed = materialise(base.select("k", "text").mapInArrow(_sign, "k binary, v array<long>").groupBy("k").agg(F.first("v").alias("v")), "signed")
    band = signed.select("k", F.posexplode("v").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "k")
    many = band.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("bucket")
    members = materialise(band.join(many, "bucket", "left_semi"), "members")
    release(signed)
    pool = members.select("k").distinct().join(nodes, "k").select("k", F.coalesce("one", F.lit(-(2**63))).alias("one"))
    own = base.select("k", F.coalesce("i", F.lit(-(2**63))).alias("one"), "text")
    texts = materialise(own.join(pool, ["k", "one"], "left_semi").dropDuplicates(["k", "one"]).select("k", "text"), "texts")
    first = materialise(_central(members), "pairs")
    d = _distances(first, texts)
    classes = _merge(None, d.where(F.col("d") <= far).select("a", "b"))
    # crowds: all that one pivot was compared with, and itself; those of one class are done
    crowd = d.select("b", F.col("a").alias("k"), "d").unionByName(d.select("b", F.col("b").alias("k"), F.lit(0.0).alias("d")).distinct())
    crowd = _of(crowd, classes, "k", "c")
    size = materialise(crowd.join(texts.select("k", F.octet_length("text").alias("bytes")), "k").groupBy("b").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("c").alias("x"), F.max("c").alias("y")).where((F.col("x") != F.col("y")) & (F.col("n") > 2)).select("b", ((F.col("n") <= CROWD) & (F.col("bytes") <= CROWD_BYTES)).alias("small")), "crowds")
    small = crowd.join(size.where(F.col("small")).select("b"), "b").join(texts, "k").select("b", "k", "c", "d", "text")
    more = materialise(small.repartition("b").sortWithinPartitions("b", "k").mapInArrow(_crowds(similarity), "a binary, b binary"), "links")
    classes = _merge(classes, more)
    large = size.where(~F.col("small")).select("b")
    if not large.isEmpty():
        buckets = first.join(large, "b", "left_semi").select("bucket").distinct()
        classes = _rounds(members.join(buckets, "bucket", "left_semi"), texts, classes, far)
    release(first, d, size, more)
    release(texts, members)
    tops = _of(nodes, classes, "k", "root")
    ids = tops.groupBy("root").agg(F.min("one").alias("least"))
    numbered = tops.join(ids, "root").select(F.col("k").alias("k_"), F.coalesce("least", -F.shiftrightunsigned(F.xxhash64("root"), 1) - 1).alias("class_id"))
    own = base.select("i", "k")
    return own.join(numbered, own["k"] == F.col("k_")).select(F.col("i").alias("doc_id"), "class_id", F.lower(F.hex("k")).alias("text_md5"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each class: the one with the least id, and one of its rows."""
    names = {x: fresh(docs, f"dedup_{x}") for x in ("md5", "class", "id")}
    classes = near_duplicates(docs, id_col=id_col, text=text)
    # per class one (id, text): the least id, then the least digest
    best = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "text_md5")).alias("one")).select(F.col("one.doc_id").alias(names["id"]), F.col("one.text_md5").alias(names["md5"]))
    keyed = docs.withColumn(names["class"], F.md5(text_or_empty(text)))
    kept = keyed.join(best, F.col(id_col).cast("long").eqNullSafe(F.col(names["id"])) & (F.col(names["class"]) == F.col(names["md5"])), "left_semi")
    return kept.dropDuplicates([id_col, names["class"]]).drop(names["class"])
