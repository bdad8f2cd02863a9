"""Content-defined chunking with normalised gear hashing (Xia et al., 2020).

The gear table is made by rule, so boundaries are this library's own. Each position's gear hash depends on the last
`MEMORY` bytes only, so the hashes of a whole buffer come from shifted sums; boundaries are then found by searching the
sorted candidates of the strict and the easy mask.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import blake3_many

LEAST, AVERAGE, MOST = 8 << 10, 64 << 10, 256 << 10
MEMORY = 32


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def _hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last MEMORY bytes' gears, each shifted by its distance."""
    h, d = GEAR[data], 1
    while d < MEMORY:
        older = np.zeros_like(h)
        older[d:] = h[:-d]
        h = h + (older << np.uint32(d))
        d *= 2
    return h


def boundaries(data: bytes, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> list[tuple[int, int]]:
    """(offset, length) of the chunks: contiguous from 0, of `least` to `most` bytes but for the last."""
    n = len(data)
    if not n:
        return []
    bits = max(2, average.bit_length() - 1)
    raw = np.frombuffer(data, dtype=np.uint8)
    high = _hashes(raw) >> np.uint32(32 - (bits + 2))
    easy_at = np.flatnonzero(high & np.uint32((1 << (bits - 2)) - 1) == 0)
    strict_at = easy_at[high[easy_at] == 0]
    out, start = [], 0
    while start < n:
        end = min(n, start + most)
        if n - start > least:
            turn = min(end, start + average)
            i = np.searchsorted(strict_at, start + least)
            j = np.searchsorted(easy_at, turn)
            if i < len(strict_at) and strict_at[i] < turn:
                end = int(strict_at[i]) + 1
            elif j < len(easy_at) and easy_at[j] < end:
                end = int(easy_at[j]) + 1
        else:
            end = n
        out.append((start, end - start))
        start = end
    return out


def stream(read: Callable[[int], bytes], least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the chunks of a stream, with the boundaries of the whole; no more than a few chunks are held."""
    if least < MEMORY:
        raise ValueError(f"least must be {MEMORY} or more: hashes look back so far")
    held, base, over = b"", 0, False
    while not over or held:
        while not over and len(held) < 4 * most:
            more = read(1 << 20)
            over = not more
            held += more
        cuts = boundaries(held, least, average, most)
        done = 0
        for offset, size in cuts:
            if not over and offset + size > len(held) - most:
                break
            yield base + offset, held[offset : offset + size]
            done = offset + size
        held, base = held[done:], base + done
        if over and not cuts:
            return


CHUNK = "offset long, length long, hash binary"


def chunk_column(scheme: str = "blake3", least: int = LEAST, average: int = AVERAGE, most: int = MOST):
    """A function of a binary column: array of (offset, length, hash)."""
    import hashlib

    own = blake3_many if scheme == "blake3" else (lambda parts: [hashlib.sha256(b).digest() for b in parts])

    def cut(b: bytes) -> list[dict]:
        spans = boundaries(b, least, average, most)
        return [{"offset": o, "length": n, "hash": h} for (o, n), h in zip(spans, own([b[o : o + n] for o, n in spans]), strict=True)]

    @F.pandas_udf(f"array<struct<{CHUNK.replace(' long', ':bigint').replace(' binary', ':binary')}>>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: None if b is None else cut(bytes(b)))

    return chunks


def exploded(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    """A row per chunk, with its ordinal from 0."""
    return df.select(key, F.posexplode(chunks).alias("ordinal", "c")).select(key, "ordinal", "c.offset", "c.length", "c.hash")


def fixed_chunks(content: Column, size: int) -> Column:
    """Chunks of a fixed size, with SHA-256, on the JVM."""
    n = F.octet_length(content)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    piece = lambda o: F.substring(content, o + 1, F.lit(size))
    return F.transform(starts, lambda o: F.struct(o.cast("long").alias("offset"), F.octet_length(piece(o)).cast("long").alias("length"), F.unhex(F.sha2(piece(o), 256)).alias("hash")))
