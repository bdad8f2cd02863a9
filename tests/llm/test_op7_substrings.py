import hashlib
import random
from collections import Counter

import numpy as np
from caslake.llm import substrings as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = [True] * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "ä", "été", "sch", "ing", "x"]) + r.choice(["", "ed", "ñ", "on"])
    prose = lambda n: " ".join(word() for _ in range(n))
    a, b, c = prose(300), prose(120), prose(60)
    edited = a[:500] + "#" + a[501:]
    texts = [a, a, edited, b, prose(80) + b + prose(80), c + c + c, "", None, "x" * 199, "y" * 200, "z" * 201, "q" * 1500, "ab" * 400, "ab" * 301, prose(2000), b[:210], "w" + b[3:203] + "w", prose(9)]
    for k in range(30):
        cut = r.randint(0, len(a) - 230)
        texts.append(prose(r.randint(0, 60)) + a[cut : cut + r.randint(190, 230)] + prose(r.randint(0, 60)))
    return texts


def test_against_brute_force(spark):
    texts = cases()
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in S.dedup(df, digest=True).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)
    kept = {r.doc_id: bytes(r.kept) for r in S.dedup(df).collect()}
    assert all(hashlib.sha256(kept[k]).hexdigest() == got[k][3] for k in got)


def test_null_ids_repeated_rows_clashing_columns(spark):
    long = "abc def " * 40 + "end"
    rows = [(None, long, "en", "s", 1), (None, "short", "en", "s", 1), (5, "u" * 30 + "tail " * 50, None, None, None), (5, "another", "en", "s", 1), (None, long, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for x in ("i", "h", "place", "todo", "g", "n"):
        df = df.withColumn(x, df.n_chars)
    got = sorted(tuple(r)[1:] for r in S.dedup(df, digest=True).collect())
    assert got == sorted(brute([r[1] for r in rows]))


def test_null_ids_are_told_apart_by_their_texts(spark):
    text = "t0 " + "word again " * 40
    rows = [(None, text + "one"), (None, text + "two"), (None, "u64679"), (None, "t3194"), (1, "u64679")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in S.dedup(df, digest=True).collect())
    assert got == sorted(brute([r[1] for r in rows]))


def test_long_text(spark):
    r = random.Random(9)
    part = "".join(r.choices("abcdefgh ", k=5000))
    texts = ["".join(r.choices("abcdefgh ", k=150_000)) + part, part + "".join(r.choices("abcdefgh ", k=120_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in S.dedup(df, digest=True).collect()}
    assert [got[k] for k in range(2)] == brute(texts)


def test_empty_table(spark):
    assert S.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_anchors_are_chosen_by_content():
    r = np.random.default_rng(0)
    for g in (r.integers(0, 2**63, 2000).astype(np.uint64), r.integers(0, 3, 2000).astype(np.uint64)):
        w = 50
        want = [p + int(np.argmin(g[p : p + w])) for p in range(len(g) - w + 1)]
        assert S.anchors(g, w).tolist() == want


def test_whole_table(spark):
    from caslake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_substrings"](spark, sf).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])
