import hashlib
import random

import pytest
from caslake.llm import neardup as N


@pytest.mark.parametrize("crowd", [2, 20_000])
def test_texts_of_a_large_crowd_that_share_one_band_are_compared(spark, monkeypatch, crowd):
    monkeypatch.setattr(N, "CROWD", crowd)
    r = random.Random(3)
    words = lambda n: ["".join(r.choices("abcdefgh", k=6)) for _ in range(n)]
    pairs = [(" ".join(x), " ".join([*x, "more"])) for x in (words(60) for _ in range(2))]
    k = lambda t: hashlib.md5(t.encode()).digest()
    rows = [(k(t), t) for p in pairs for t in p]
    texts = spark.createDataFrame(rows, "k binary, text string")
    members = spark.createDataFrame([(i, 7) for i, _ in rows], "k binary, bucket long")
    none = spark.createDataFrame([], "node binary, root binary")
    root = {bytes(x.node): bytes(x.root) for x in N._rounds(members, texts, none, 0.2 + 1e-9).collect()}
    assert all(root[k(a)] == root[k(b)] for a, b in pairs) and len({root[k(a)] for a, _ in pairs}) == 2
