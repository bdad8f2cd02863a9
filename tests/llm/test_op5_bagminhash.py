import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from caslake.llm import neardup as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    if not a or not b:
        return 0.0
    return sum((a & b).values()) / sum((a | b).values())


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for k, b in enumerate(bags):
        for s in b:
            index.setdefault(s, []).append(k)
    for a, b in {(x, y) for v in index.values() for x in v for y in v if x < y}:
        if jaccard(bags[a], bags[b]) >= 0.8:
            root[find(b)] = find(a)
    at = {t: find(k) for k, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        c = at[t or ""]
        least[c] = min(least.get(c, i), i)
    return {i: least[at[t or ""]] for i, t in rows}


def cases():
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = ["", None, "one", "one", "One!", "a b c d e", "x y z", "...", "..."]
    for _ in range(25):
        base = prose(r.randint(20, 200))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            edit = list(base)
            for _ in range(r.randint(0, 6)):
                edit[r.randrange(len(edit))] = r.choice(vocabulary)
            texts.append(" ".join(edit))
    crowd = prose(150)
    for _ in range(60):
        edit = list(crowd)
        for _ in range(r.randint(0, 5)):
            edit[r.randrange(150)] = r.choice(vocabulary)
        texts.append(" ".join(edit))
    common = prose(30)
    texts += [" ".join(prose(25) + common + prose(25)) for _ in range(40)]
    texts += ["spam eggs " * 60 + "end", "spam eggs " * 58 + "end", "spam eggs " * 40 + "end"]
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_crowds_too_large_for_a_task_take_rounds(spark, monkeypatch):
    rows = [r for r in cases() if r[0] > 60]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    monkeypatch.setattr(N, "CROWD", 2)
    assert {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()} == brute(rows)


def test_crowds_against_all_pairs():
    r = np.random.default_rng(4)
    for _ in range(40):
        base = r.integers(0, 2**62, 60).astype(np.uint64)
        bags = []
        for _ in range(30):
            x = base.copy()
            x[r.integers(0, 60, r.integers(0, 14))] = r.integers(0, 2**62)
            bags.append(np.concatenate([x, x[: r.integers(0, 5)]]))
        far = [1 - N.similarity(b, bags[0]) for b in bags]
        classes = r.integers(0, 20, 30).tolist()
        root = list(range(30))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        first = {}
        for k, c in enumerate(classes):
            root[find(k)] = find(first.setdefault(c, k))
        got = root.copy()
        for x, y in N.link_crowd(bags, classes, far, 0.8):
            assert N.similarity(bags[x], bags[y]) >= 0.8
            got[find(x, got)] = find(y, got)
        for x in range(30):
            for y in range(x):
                if N.similarity(bags[x], bags[y]) >= 0.8:
                    root[find(x)] = find(y)
        parts = lambda q: {frozenset(k for k in range(30) if find(k, q) == find(j, q)) for j in range(30)}  # noqa: E731, B023
        assert parts(got) == parts(root)


def test_nulls_repeats_clashing_columns(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    df = spark.createDataFrame([(None, text, None, None, None), (3, text, "x", "s", 1), (3, text, "x", "s", 1), (None, "other", "x", "s", 1), (None, None, "x", "s", 1)], SCHEMA)
    for x in ("k", "bucket", "a", "b", "d", "class_id", "dedup_md5", "one"):
        df = df.withColumn(x, df.n_chars)
    got = N.near_duplicates(df).collect()
    assert len(got) == 5 and [r.class_id for r in got].count(3) == 3 and sum(r.class_id < 0 for r in got) == 2
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(3, text)] and kept.count() == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.near_duplicates(empty).collect() == [] and N.keep_one(empty).collect() == []


def test_registers_estimate_weighted_jaccard():
    a, b = "u v w x y z " * 30 + "p q r s t " * 10, "u v w x y z " * 20 + "p q r s t " * 25
    h, size = N.shingles(pa.array([a, b]))
    sign = N.signatures(h, size, 4096)
    true = jaccard(bag(a), bag(b))
    assert abs((sign[0] == sign[1]).mean() - true) < 0.04
    assert abs(N.similarity(h[: size[0]], h[size[0] :]) - true) < 1e-12
    # a register's time is exponential with the total weight as its rate
    assert abs(sign[0].mean() * size[0] - 1) < 0.06


def test_whole_table(spark):
    from caslake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in QUERIES["op5_bagminhash"](spark, sf).collect()} == brute(rows)
