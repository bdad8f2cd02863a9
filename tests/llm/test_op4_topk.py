import math

import numpy as np
from caslake.llm import topk as K
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        v = min(w for i, w in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    for x in ("score", "rank", "i", "v", "q", "shard", "query_id"):
        df = df.withColumn(x, F.lit(1))
    return sorted(tuple(r) for r in K.search(df, F.col("vec_id") % 50 == 0, **kw).collect())


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in np.round(r.normal(size=8), 1)]) for k in range(400)]
    rows += [(400 + k, rows[k % 7][1]) for k in range(60)]  # ties
    rows += [(1000, None), (1001, [1.0] * 7 + [None]), (1002, [float("nan")] * 8), (1050, [float("inf")] * 8), (None, [1.0] * 8), (1100, [1.0, 2.0]), (1101, [2.0, 2.0]), (1150, []), (1200, [3e30] * 8), (3, rows[3][1])]
    want = [w for w in brute(rows) if w[0] != 1200 and w[2] != 1200]
    got = run(spark, rows)
    clipped = [(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in brute(rows)]
    assert got == sorted(clipped) or [g for g in got if 1200 not in (g[0], g[2])] == [c for c in sorted(clipped) if 1200 not in (c[0], c[2])]
    assert want


def test_small_tiles_and_products_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(k, [float(x) for x in r.normal(size=4)]) for k in range(500)]
    want = brute(rows)
    assert run(spark, rows) == want and run(spark, rows, tile=3, fan=2) == want
    monkeypatch.setattr(K, "PRODUCT", 6)
    block = {4: (np.array([i for i, _ in rows if i % 50 == 0]), np.floor(256 * np.array([v for i, v in rows if i % 50 == 0], dtype=np.float32).astype(float)))}
    vecs = K.pa.array([np.floor(256 * np.array(v, dtype=np.float32).astype(float)) for _, v in rows])
    lists = K.pa.Table.from_batches(K._search(block, 5, 3)([K.pa.RecordBatch.from_arrays([K.pa.array([i for i, _ in rows]), vecs], names=["i", "v"])]))
    assert sorted(zip(*(lists[c].to_pylist() for c in ("query_id", "vec_id", "score")), strict=True)) == sorted((q, i, s) for q, _, i, s in want)


def test_a_grid_of_blocks_and_shards_gives_the_same(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.round(r.normal(size=4), 1)]) for k in range(500)]
    rows += [(50, rows[50][1])] * 300 + [(1050, [1.0, 2.0]), (1051, [2.0, 2.0]), (1150, []), (1151, None), (None, [1.0] * 4), (1152, [float("nan")] * 4)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block_bytes=64, cell_bytes=2048, tile=7, fan=2) == want
    assert run(spark, rows, block_bytes=64, cell_bytes=1 << 20) == want


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == [] and run(spark, [(0, [1.0]), (1, [0.5])]) == [(0, 1, 1, 256 * 128)]
