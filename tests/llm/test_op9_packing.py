import random
from collections import Counter, defaultdict

from caslake.llm import packing as P
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def naive(items, capacity, quota):
    """Best fit by looking at all bins each time."""
    bins, out = [], []
    for n, c, s in items:
        fits = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins) if capacity - sum(x[0] for x in b) >= n and all(x[1] != c for x in b) and sum(x[2] == s for x in b) < quota]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([])
        out.append((k, sum(x[0] for x in bins[k])))
        bins[k].append((n, c, s))
    return out


def test_best_fit_against_naive():
    r = random.Random(5)
    for _ in range(60):
        items = sorted(((r.randint(1, 30), r.randint(0, r.choice([3, 40])), r.choice(["a", "a", "a", "b", None])) for _ in range(r.randint(0, 120))), key=lambda x: (-x[0], x[1], x[2] is not None, x[2] or ""))
        q = r.randint(1, 4)
        assert P.best_fit(items, 30, q) == naive(items, 30, q)


def test_a_crowd_of_copies_costs_one_pass():
    items = [(900 - k // 50, k, "a") for k in range(2000)] + [(100, 7, "b")] * 3000
    out = P.best_fit(items, 1000, 4)
    assert len({b for b, _ in out[2000:]}) == 3000


def check(rows, packed, capacity, quota):
    length = Counter()
    for i, t in rows:
        length[i] += len((t or "").split())
    got, bins = Counter(), defaultdict(list)
    for r in packed:
        got[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
        else:
            assert r.n_tokens == 0
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in length.items() if v}
    assert {r.doc_id for r in packed} == set(length)
    for b in bins.values():
        b.sort(key=lambda r: r.start)
        assert all(x.start + x.n_tokens == y.start for x, y in zip(b, b[1:], strict=False)) and b[0].start == 0 and b[-1].start + b[-1].n_tokens <= capacity
        assert len({r.cluster for r in b}) == len(b) and max(Counter(r.source for r in b).values()) <= quota
    return bins


def test_operator(spark):
    r = random.Random(6)
    rows = [(k, " ".join(f"w{r.randint(0, 9**9)}" for _ in range(r.choice([0, 1, 5, 30, 120, 260])))) for k in range(700)]
    rows += [(1000 + k, "the same text over and over") for k in range(300)] + [(None, "no id here"), (None, None), (2000, None), (2001, "twice"), (2001, "twice")]
    df = spark.createDataFrame([(i, t, "en", r.choice(["hot", "hot", "a", None]), 1) for i, t in rows], SCHEMA)
    for x in ("n", "shard", "cluster", "piece", "bin_id", "start"):
        df = df.withColumn(x, F.lit(1))
    check(rows, P.pack(df, capacity=100, shard_docs=128).collect(), 100, 4)
    assert P.pack(df.limit(0)).collect() == []


def test_whole_table(spark):
    from caslake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bins = check(rows, QUERIES["op9_packing"](spark, sf).collect(), 2048, 4)
    assert len(bins) < 1.3 * sum(len((t or "").split()) for _, t in rows) / 2048
