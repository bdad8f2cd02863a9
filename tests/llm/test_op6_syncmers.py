import hashlib
import random

import pytest
import xxhash
from caslake.llm import syncmers as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = 2**32 - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hash_text(t):
    return signed(xxhash.xxh64_intdigest(t.encode(), 42))


def hash_wide(t):
    return signed(xxhash.xxh64_intdigest(t.encode("utf-32-be"), 42))


def fingerprint(t):
    h = [hash_wide(t[i : i + 5]) for i in range(len(t) - 4)]
    out = dict.fromkeys(hash_wide(t[i : i + 12]) & LOW for i in range(len(h) - 7) if min(h[i : i + 8]) in (h[i], h[i + 7]))
    return list(out) or ([hash_text(t) & LOW] if t else [])


def like(a, b):
    x, y = set(a), set(b)
    return 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0


def brute(rows):
    order = sorted(((i is not None, i if i is not None else hash_text(t or ""), hash_text(t or ""), t or "", i) for i, t in rows), reverse=True)
    out = []
    for k, (_, _, _, t, i) in enumerate(order):
        nxt = order[(k + 1) % len(order)][3]
        m = len(t) // 2
        e = t[: len(t) - m] + nxt[:m]
        f, g, x = fingerprint(t), fingerprint(e), fingerprint(nxt)
        hexes = lambda v: "".join(f"{n:08x}" for n in v)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), hexes(f), hexes(g), like(f, g), like(f, x)))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    for x in ("anchors", "inner", "bucket", "v", "ghost", "fingerprint", "cut", "at", "last"):
        df = df.withColumn(x, df.n_chars)
    e = S.edited(df)
    return [(r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest(), r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in e.collect()]


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_against_brute_force(spark):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choices("abcdeé ñü😀𝔸", k=r.randint(1, 9))) for _ in range(n))
    rows = [(k * 3 - 50, prose(r.choice([0, 1, 2, 5, 40, 300]))) for k in range(300)]
    rows += [(10**15, prose(900)), (10**15 + 1, None), (10**15 + 2, ""), (10**15 + 3, "a"), (10**15 + 4, "same text of a length"), (10**15 + 5, "same text of a length"), (10**15 + 6, "z" * 700), (10**15 + 7, "line\nline\r\n" * 30)]
    got, want = sorted(run(spark, rows), key=key), sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5:] == pytest.approx(w[5:]) for g, w in zip(got, want, strict=True))


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "first of the texts without an id"), (None, "second of the texts without an id"), (4, "four is the id of this"), (4, "four is the id of that"), (4, "four is the id of that"), (None, None)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert run(spark, [(1, "a lone document is its own next one")]) == brute([(1, "a lone document is its own next one")])


def test_empty_table(spark):
    assert S.edited(spark.createDataFrame([], SCHEMA)).collect() == []


def test_outliers_and_hot_ids_are_spread(spark):
    n = 6000
    ids = [*range(n), 10**18, *([7] * n)]
    df = spark.createDataFrame([(i, f"text number {k} of its own") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = df.selectExpr("doc_id", "text", "xxhash64(text) as x", "doc_id as v", "false as unnamed")
    found = S.bucketed(rows).collect()
    sizes = {}
    for r in found:
        sizes[r.bucket] = sizes.get(r.bucket, 0) + 1
    assert max(sizes.values()) < 6 * S.BUCKET and len(sizes) > 2 * n // S.BUCKET // 2
    order = sorted(found, key=lambda r: (r.v, r.x))
    assert all(a.bucket <= b.bucket for a, b in zip(order, order[1:], strict=False))


def test_whole_table(spark):
    from caslake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op6_syncmers"](spark, sf)
    got = sorted(tuple(r) for r in df.collect())
    want = sorted(brute(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_anchors_compare_the_lesser_end_once_with_what_lies_between(spark):
    rows = spark.createDataFrame([("a" * 30,), ("some text with anchors in it, and more",)], "text string").select(S.anchors(S.F.col("text")).alias("a"))
    assert 0 < rows._jdf.queryExecution().analyzed().toString().count("<=") <= S.WINDOW - 1
    assert [len({x >> 32 for x in r.a}) == len(r.a) > 0 for r in rows.collect()] == [True, True]
