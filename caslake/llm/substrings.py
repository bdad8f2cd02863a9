"""Duplicate substrings, by prefix doubling over a sampled suffix array.

A byte goes if a string of `LEAST` bytes that covers it also starts anywhere else. Ranks are names of strings: two
positions have one rank at a length if their strings of that length are equal. Names at length 2d come from the pair
of names at d, as in prefix doubling; they are hashes, so the pair (position, position + d) needs no sort of its own,
and the sorts that remain are those that find which names are unique.

1. Length `GRAM`: in each window of LEAST bytes the gram with the least name, the first if several have it, is the
   window's anchor. It is chosen by content alone, so equal windows have equal anchors at equal offsets, and windows
   that follow each other mostly share one: about one position in eighty is sorted, as (rank, position) pairs. Anchors
   whose rank is unique are dropped; none of their windows repeats.
2. Runs: the windows of an anchor make a string of LEAST bytes and more. Runs with one rank are repeats throughout,
   whatever the number of copies, and one of them stands for all from here on. Only where several different runs have
   one gram, their representatives go on.
3. Parts of `PART` distances from window to anchor, by the same rule: those of one rank are repeats; those whose core (the bytes that all
   windows at those distances from the anchor share) has a unique rank are dropped; the few that are left go on.
4. Single windows at LEAST bytes, the threshold, where ranks are final.

What a comparison needs is equal in both of two 64-bit names (the gram's and the string's). No pairs are made: every
step counts rows by name, with partial sums, and joins back. Texts are shuffled by id twice: for
the bytes of the representatives, and to be cut.

Defined cases: null texts count as empty; texts under LEAST bytes lose nothing; repeated rows, also of one id, are
copies of each other; ids may be null, since a document's key has 64 bits or more of its text. Texts of any length are read whole. An empty table gives no rows. Other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, release, slices, text_or_empty

LEAST, GRAM, PART = 200, 32, 16
SLICE = 256 << 10
#: Names of single bytes and the odd factors of the doublings, by rule.
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = {d: mix64(np.array([d * 7919 + 5], dtype=np.uint64))[0] | np.uint64(1) for d in (1, 2, 4, 8, 16, 32)}


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, one text after the other, and its offsets."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def names(data: np.ndarray) -> np.ndarray:
    """Names at length GRAM, by doubling: of a position from those of the position and the one d further on."""
    h, d = BYTES[data], 1
    while d < GRAM:
        h = h[:-d] * FACTORS[d] + h[d:] if len(h) > d else h[:0]
        d *= 2
    return h


def name_of(h: np.ndarray, start: np.ndarray, length: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Names of strings of GRAM bytes and more, from those of their grams; salt: what else must be equal."""
    x = mix64(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(salt).astype(np.uint64))
    for o in range(0, int(length.max(initial=0)), GRAM):
        at = start + np.minimum(o, length - GRAM)
        x = np.where(o < length, mix64(x * FACTORS[32] + h[at]), x)
    return x


def anchors(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` names, the position of its least name, the first of equals."""
    m, s = g, 1
    while s * 2 <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if width > s:
        m = np.minimum(m[: len(m) - (width - s)], m[width - s :])
    n = len(m)
    start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    first = np.concatenate([s + np.argmax(np.lib.stride_tricks.sliding_window_view(g, width)[s] == m[s][:, None], axis=1) for s in np.array_split(start, max(1, len(start) // 4096))])
    end = np.append(start[1:], n)
    if (end - 1 <= first).all():
        return np.repeat(first, end - start)
    # equal names follow each other, as in repetitive texts: carry positions along
    m, at, s = g, np.arange(len(g)), 1
    for d in [*(2**k for k in range(width.bit_length() - 1)), width - 2 ** (width.bit_length() - 1)]:
        if d:
            left = m[:-d] <= m[d:]
            m, at = np.where(left, m[:-d], m[d:]), np.where(left, at[:-d], at[d:])
    return at


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts: text, first window, windows, anchor (in the text), name of the gram, name of the run."""
    none = np.zeros(0, np.int64)
    if len(data) < LEAST:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = names(data)
    g = mix64(h)
    at = anchors(g, LEAST - GRAM + 1)
    n = len(at)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + LEAST <= offsets[1:][text]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])]))
    end = np.append(cut[1:], n)
    start, end = cut[inside[cut]], end[inside[cut]]
    a, t = at[start], text[start]
    c = name_of(h, start, end - start - 1 + LEAST, a - start)
    return t, start - offsets[t], end - start, a - offsets[t], g[a], c


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=SLICE):
        t, start, n, a, g, c = runs(*buffer(b.column("text")))
        if len(t):
            at = pa.array(t)
            yield pa.RecordBatch.from_arrays([b.column("i").take(at), b.column("h").take(at), pa.array(start << 16 | (n - 1) << 8 | (a - start)), _signed(g), _signed(c)], names=["i", "h", "place", "g", "c"])


def _lists(col: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """The row of each element of a column of lists of structs, and the elements' fields."""
    sizes = np.asarray(col.value_lengths().fill_null(0), dtype=np.int64)
    flat = col.flatten()
    return np.repeat(np.arange(len(col)), sizes), *(np.asarray(flat.field(f), dtype=np.int64) for f in fields)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs in `todo`."""
    for b in slices(batches, most=SLICE):
        data, offsets = buffer(b.column("text"))
        row, place, g, n = _lists(b.column("todo"), "place", "g", "n")
        start = offsets[row] + (place >> 16)
        end = start + (place >> 8 & 255) + LEAST
        raw = pa.array([data[x:y].tobytes() for x, y in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column("i").take(at), b.column("h").take(at), pa.array(place), pa.array(g), pa.array(n), raw], names=["i", "h", "run", "g", "n", "raw"])


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the runs: names of the whole part and of its core."""
    for b in slices(batches, "raw", SLICE):
        data, offsets = buffer(b.column("raw"))
        h = names(data)
        run, g, n = (np.asarray(b.column(x), dtype=np.int64) for x in ("run", "g", "n"))
        start, count, lead = run >> 16, (run >> 8 & 255) + 1, run & 255
        # parts are cut by the distance to the anchor, so that those of equal windows are cut alike
        least, most = (lead - count + 1) // PART, lead // PART
        pieces = most - least + 1
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        row = np.repeat(np.arange(len(run)), pieces)
        start, count, lead, g, n = (x[row] for x in (start, count, lead, g, n))
        m = least[row] + k
        first = np.maximum(0, lead - (m * PART + PART - 1))
        windows = np.minimum(count - 1, lead - m * PART) - first + 1
        full = name_of(h, offsets[row] + first, windows - 1 + LEAST, (lead - first) * 64 + windows)
        core = name_of(h, offsets[row] + lead - m * PART, np.full(len(row), LEAST - PART + 1), m + 1)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column("i").take(at), b.column("h").take(at), b.column("run").take(at), pa.array((start + first) << 16 | (windows - 1) << 8 | (lead - first)), pa.array(g), _signed(full), _signed(core), pa.array(n)], names=["i", "h", "run", "place", "g", "full", "core", "n"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of the parts in `todo`."""
    for b in slices(batches, "raw", SLICE):
        data, offsets = buffer(b.column("raw"))
        h = names(data)
        row, place, g, n = _lists(b.column("todo"), "place", "g", "n")
        count = (place >> 8 & 255) + 1
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row, place, g, n = (np.repeat(x, count) for x in (row, place, g, n))
        start = (place >> 16) + k
        run = np.asarray(b.column("run"), dtype=np.int64)[row] >> 16
        w = name_of(h, offsets[row] + start - run, np.full(len(start), LEAST), (place & 255) - k)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column("i").take(at), b.column("h").take(at), pa.array(start << 16), pa.array(g), _signed(w), pa.array(n)], names=["i", "h", "place", "g", "w", "n"])


def _often(rows: DataFrame, *by: str) -> DataFrame:
    """The names that occur more than once."""
    return rows.groupBy(*by).agg(F.count("*").alias("times")).where(F.col("times") > 1).select(*by)


def _join(left: DataFrame, lists: DataFrame, how: str, *by: str) -> DataFrame:
    """left with the lists of its key. The lists, which are small, are what is hashed."""
    return left.join(lists.hint("shuffle_hash"), list(by), how)


def repeats(base: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(i, h, place) of runs of repeated windows of the rows (i, h, text), and what was written for it."""
    seen = materialise(base.mapInArrow(_anchor_rows, "i long, h long, place long, g long, c long"), "anchors")
    alive = materialise(seen.join(_often(seen, "g"), "g", "left_semi"), "alive")
    release(seen)
    classes = alive.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("i", "h", "place")).alias("one"))
    whole = alive.join(classes.where(F.col("n") > 1).select("g", "c"), ["g", "c"], "left_semi").select("i", "h", "place")
    unlike = classes.groupBy("g").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1).select("g")
    ones = classes.join(unlike, "g", "left_semi").select("one.i", "one.h", "one.place", "g", "n")
    todo = ones.groupBy("i", "h").agg(F.collect_list(F.struct("place", "g", "n")).alias("todo"))
    pieces = materialise(_join(base, todo, "inner", "i", "h").select("i", "h", "text", "todo").mapInArrow(_pieces, "i long, h long, run long, g long, n long, raw binary"), "pieces")
    parts = materialise(pieces.mapInArrow(_part_rows, "i long, h long, run long, place long, g long, full long, core long, n long"), "parts")
    equal = parts.where(F.col("n") == 1).join(_often(parts, "g", "full"), ["g", "full"], "left_semi").select("i", "h", "place")
    # one part stands for all of its rank, whose windows are known to repeat if it has several members
    kinds = parts.groupBy("g", "core", "full").agg(F.min(F.struct("i", "h", "run", "place", "n")).alias("one"), F.count("*").alias("times"))
    near = kinds.groupBy("g", "core").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1).select("g", "core")
    rest = kinds.join(near, ["g", "core"], "left_semi").select("one.i", "one.h", "one.run", "one.place", "g", F.when(F.col("times") > 1, F.lit(2)).otherwise(F.col("one.n")).cast("long").alias("n"))
    lists = rest.groupBy("i", "h", "run").agg(F.collect_list(F.struct("place", "g", "n")).alias("todo"))
    single = materialise(_join(pieces.select("i", "h", "run", "raw"), lists, "inner", "i", "h", "run").select("i", "h", "run", "raw", "todo").mapInArrow(_window_rows, "i long, h long, place long, g long, w long, n long"), "windows")
    release(pieces)
    last = single.where(F.col("n") == 1).join(_often(single, "g", "w"), ["g", "w"], "left_semi").select("i", "h", "place")
    return whole.unionByName(equal).unionByName(last), [alive, parts, single]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=4 * SLICE):
        data, offsets = buffer(b.column("text"))
        row, place = _lists(b.column("todo"), "place")
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        start = offsets[row] + (place >> 16)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + (place >> 8 & 255) + LEAST, -1)
        gone = np.cumsum(edge[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = gone[offsets[:-1][np.diff(offsets) > 0]]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        kept = []
        removed = total(gone)
        for k in range(b.num_rows):
            a, e = offsets[k], offsets[k + 1]
            kept.append((data[a:e] if not removed[k] else data[a:e][~gone[a:e]]).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(total(first).astype(np.int64)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _cut(batches):
        sha = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column("kept")], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], sha], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, digest: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, and kept (bytes) or, if asked, their kept_sha256."""
    # a document's key: its id and a hash of its text; without an id, two hashes of 64 bits
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    base = base.withColumn("i", F.coalesce("doc_id", F.xxhash64("text", F.lit(7))))
    found, _ = repeats(base)
    todo = found.groupBy("i", "h").agg(F.collect_set(F.struct("place")).alias("todo"))
    joined = _join(base, todo, "left", "i", "h").select("doc_id", "text", "todo")
    if digest:
        return joined.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
