import hashlib
import math
from collections import Counter

from caslake.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, seed=7):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    share = sum(math.sqrt(v) for v in size.values() if v)
    total = sum(size.values())
    out = Counter()
    for i, t, s in rows:
        rate = math.sqrt(size[s]) / share * total / size[s] if size[s] else 1.0
        parts = max(1, math.ceil(rate / 16))
        each, n = rate / parts, 0
        key = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{key}:{seed}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            k, p, c = 0, math.exp(-each), math.exp(-each)
            while u >= c and k < 85:
                k += 1
                p *= each / k
                c += p
            n += k
        if n:
            out[i, t, s] += n
    return out


def test_against_brute_force(spark):
    rows = [(k, "x" * (k % 50), "hot" if k % 3 else f"s{k % 7}") for k in range(3000)]
    rows += [(9000, "y" * 3, "tiny"), (None, None, None), (9001, "", "blank"), (9002, "a", None), (9002, "a", None)]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    for x in ("copy", "mix_key", "mix_cdf", "rate", "size", "share"):
        df = df.withColumn(x, df.n_chars)
    out = M.mix(df)
    got = out.collect()
    assert out.columns[: len(df.columns)] == df.columns and out.columns[-2:] == ["n_copies", "copy_"]
    assert Counter((r.doc_id, r.text, r.source) for r in got) == brute(rows)
    order = [r.doc_id for r in got if r.doc_id is not None]
    assert sum(a > b for a, b in zip(order, order[1:], strict=False)) > len(order) / 3


def test_targets_and_large_rates(spark):
    df = spark.createDataFrame([(k, "word " * 10, "en", "a" if k < 1900 else "b", 1) for k in range(2000)], SCHEMA)
    n = Counter(r.source for r in M.mix(df, targets={"a": 1, "b": 3}, repetition=2.0).collect())
    assert abs(n["b"] / 3000 - 1) < 0.1 and abs(n["a"] / 1000 - 1) < 0.15
    assert {r.source for r in M.mix(df, targets={"b": 1}).collect()} == {"b"}


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    df = spark.createDataFrame([(k, "word " * (k % 9), "en", f"s{k % 40}" if k % 2 else None, 1) for k in range(600)], SCHEMA)
    want = sorted((r.doc_id, r.copy) for r in M.mix(df).collect())
    monkeypatch.setattr(M, "MOST_SOURCES", 0)
    assert sorted((r.doc_id, r.copy) for r in M.mix(df).collect()) == want


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
