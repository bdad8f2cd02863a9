"""Content hashes: SHA-256 on the JVM, and BLAKE3 in numpy for Arrow batches.

Which scheme made a hash must be kept with it: hashes of different schemes, and of whole files and samples, never agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes at both ends, samples between, bytes of a sample: from their sum on, a sampled hash reads no more than that.
EDGE, SAMPLES, SAMPLE = 8192, 4, 10240

#: Bytes that are hashed side by side.
GROUP = 1 << 20

#: Fixed values of the published BLAKE3 specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """One compression of each of n inputs. cv: (8, n), words: (16, n), the others (n,)."""
    n = words.shape[1]
    s = np.empty((16, n), dtype=np.uint32)
    s[:8], s[8:12] = cv, IV[:4, None]
    s[12], s[13], s[14], s[15] = counter & 0xFFFFFFFF, counter >> np.uint64(32), length, flags

    def turn(x: np.ndarray, k: int) -> np.ndarray:
        return (x >> np.uint32(k)) | (x << np.uint32(32 - k))

    def mix(a, b, c, d, x, y):
        s[a] += s[b] + x
        s[d] = turn(s[d] ^ s[a], 16)
        s[c] += s[d]
        s[b] = turn(s[b] ^ s[c], 12)
        s[a] += s[b] + y
        s[d] = turn(s[d] ^ s[a], 8)
        s[c] += s[d]
        s[b] = turn(s[b] ^ s[c], 7)

    m = words
    quads = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
    for r in range(7):
        for k, q in enumerate(quads):
            mix(*q, m[2 * k], m[2 * k + 1])
        m = m[PERMUTATION] if r < 6 else m
    return s[:8] ^ s[8:]


def blake3_many(items: list[bytes]) -> list[bytes]:
    """BLAKE3-256 of each. All chunks of 1024 bytes of all inputs are compressed side by side, block by block, and so are the levels of their trees."""
    if not items:
        return []
    sizes = np.array([len(x) for x in items], dtype=np.int64)
    chunks = np.maximum(1, -(-sizes // 1024))
    first = np.cumsum(chunks) - chunks
    raw = np.zeros(int(chunks.sum()) * 1024, dtype=np.uint8)
    for x, f in zip(items, first.tolist(), strict=True):
        raw[f * 1024 : f * 1024 + len(x)] = np.frombuffer(x, dtype=np.uint8)
    words = raw.view("<u4").astype(np.uint32).reshape(-1, 16, 16)
    owner = np.repeat(np.arange(len(items)), chunks)
    counter = (np.arange(len(owner)) - first[owner]).astype(np.uint64)
    left = np.clip(sizes[owner] - counter.astype(np.int64) * 1024, 0, 1024)
    blocks = np.maximum(1, -(-left // 64))
    alone = chunks[owner] == 1
    cv = np.repeat(IV[:, None], len(owner), 1)
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        flags = np.where(last, CHUNK_END, 0) | (CHUNK_START if b == 0 else 0) | np.where(last & alone[on], ROOT, 0)
        cv[:, on] = _compress(cv[:, on], words[on, b].T, counter[on], np.clip(left[on] - 64 * b, 0, 64).astype(np.uint32), flags.astype(np.uint32))
    # a left subtree holds the largest power of two of chunks that leaves one for the right: pairing level by level, with an odd last one carried up, gives the same tree
    counts = chunks
    while counts.max() > 1:
        start, after = np.cumsum(counts) - counts, (counts + 1) // 2
        new = np.cumsum(after) - after
        pairs = counts // 2
        doc = np.repeat(np.arange(len(items)), pairs)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        at = start[doc] + 2 * k
        up = np.empty((8, int(after.sum())), dtype=np.uint32)
        flags = np.where(counts[doc] == 2, PARENT | ROOT, PARENT).astype(np.uint32)
        up[:, new[doc] + k] = _compress(np.repeat(IV[:, None], len(doc), 1), np.concatenate([cv[:, at], cv[:, at + 1]]), np.zeros(len(doc), dtype=np.uint64), np.full(len(doc), 64, dtype=np.uint32), flags)
        odd = np.flatnonzero(counts % 2)
        up[:, new[odd] + after[odd] - 1] = cv[:, start[odd] + counts[odd] - 1]
        cv, counts = up, after
    return [x.tobytes() for x in cv.T.astype("<u4")]


def blake3(data: bytes) -> bytes:
    return blake3_many([data])[0]


def _blake3(c: Column) -> Column:
    @F.pandas_udf("binary")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out, some = [None] * len(batch), [(k, bytes(x)) for k, x in enumerate(batch) if x is not None]
            while some:  # groups of bounded size
                n, size = 0, 0
                while n < len(some) and (not n or size + len(some[n][1]) < GROUP):
                    size += len(some[n][1])
                    n += 1
                for (k, _), h in zip(some[:n], blake3_many([x for _, x in some[:n]]), strict=True):
                    out[k] = h
                some = some[n:]
            yield pd.Series(out, dtype=object)

    return each(c)


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("binary"), 256))


def digest(c: Column, scheme: str = "sha256") -> Column:
    return _blake3(c) if scheme == "blake3" else sha256(c)


def _size_bytes(size: Column) -> Column:
    """Eight bytes of a number, least first."""
    h = F.lpad(F.hex(size), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, k, 2) for k in range(15, 0, -2))))


def sampled(content: Column, scheme: str = "sha256", edge: int = EDGE, samples: int = SAMPLES, sample: int = SAMPLE) -> Column:
    """Of small contents the hash of all; else of the first and last bytes, evenly spread samples between, and the size."""
    size = F.octet_length(content).cast("long")
    stride = F.floor((size - 2 * edge) / (samples + 1))
    cut = lambda start, n: F.substring(content, start.cast("int"), F.lit(n))
    parts = [cut(F.lit(1), edge), *(cut(edge + stride * i + 1, sample) for i in range(1, samples + 1)), cut(size - edge + 1, edge), _size_bytes(size)]
    return F.when(size < 2 * edge + samples * sample, digest(content, scheme)).otherwise(digest(F.concat(*parts), scheme))


def sampled_file(path: str, hasher=blake3, edge: int = EDGE, samples: int = SAMPLES, sample: int = SAMPLE) -> bytes:
    """The same of a file, by seeking; large files are never read whole."""
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        if size < 2 * edge + samples * sample:
            f.seek(0)
            return hasher(f.read())
        stride = (size - 2 * edge) // (samples + 1)
        out = []
        for start, n in [(0, edge), *((edge + stride * i, sample) for i in range(1, samples + 1)), (size - edge, edge)]:
            f.seek(start)
            out.append(f.read(n))
    return hasher(b"".join(out) + size.to_bytes(8, "little"))


def root_hash(hashes: Column, scheme: str = "sha256") -> Column:
    """Hash of the hashes in an array, in its order."""
    return digest(F.coalesce(F.aggregate(hashes, F.lit(b""), lambda a, h: F.concat(a, h)), F.lit(b"")), scheme)


def total_size(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda a, c: a + c["length"])

