import random

import pytest
from caslake.llm import syncmers as S
from test_op6_syncmers import LOW, SCHEMA, hash_wide


def every(t):
    """The names of all closed syncmers by first position, however long the text is."""
    h = [hash_wide(t[i : i + 5]) for i in range(len(t) - 4)]
    return dict.fromkeys(hash_wide(t[i : i + 12]) & LOW for i in range(len(h) - 7) if min(h[i : i + 8]) in (h[i], h[i + 7]))


def test_long_texts_keep_every_syncmer(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("abcdefgh é", k=n)) for n in (150, 193, 1000, 14_000, 60_000)]
    texts.append(texts[3][:13_000] + "".join(r.choices("xyz", k=1000)))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    hexes = lambda v: "".join(f"{n:08x}" for n in v)
    like = lambda a, b: len(a.keys() & b) / len(a.keys() | b)
    assert {x.doc_id: x.fingerprint for x in S.fingerprints(df).collect()} == {i: list(every(t)) for i, t in enumerate(texts)}
    got = {x.doc_id: x for x in S.edited(df).collect()}
    for i, t in enumerate(texts):
        after = texts[i - 1]  # by falling ids, the first after the last
        m = len(t) // 2
        e = t[: len(t) - m] + after[:m]
        f, g = every(t), every(e)
        assert (got[i].edited_text, got[i].fingerprint, got[i].edited_fingerprint) == (e, hexes(f), hexes(g))
        assert got[i].near_edited == pytest.approx(like(f, g)) and got[i].near_next == pytest.approx(like(f, every(after)))
