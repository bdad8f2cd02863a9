import random
import zlib

import numpy as np
import pytest
from caslake.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy_on_the_whole_table(spark):
    from caslake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    toxic = [p for p, y in held if y]
    clean = [p for p, y in held if not y]
    # some labels are noise: a few texts without any mark of it are labelled toxic, in the held-out rows too
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01


def test_labels_of_held_out_rows_and_other_columns_have_no_say(spark):
    text = lambda k: "plain words of a text here " * 3 + ("you idiot vexword" if k % 4 == 0 else "number " + str(k))
    docs = spark.createDataFrame([(k, text(k), "en", "s", 1) for k in range(200)], SCHEMA)
    labels = [(k, int(k % 4 == 0)) for k in range(200)]
    flipped = [(k, y if zlib.crc32(str(k).encode()) % 5 else 1 - y) for k, y in labels]
    a = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = T.fit(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert a == b and a["weights"]


def test_odd_inputs(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 1), (None, "an idiot and a moron", "en", "s", 1), (3, "!?." * 5, "en", "s", 1), (3, "same id " * 50000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("y", T.F.lit(1)).withColumn("i", T.F.lit(2))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = T.scored(docs, none, "p").collect()
    assert len(got) == 5 and all(0 <= r.p <= 1 for r in got) and [r.p > 0.5 for r in got if r.doc_id is None] == [True]
    assert T.scored(docs.limit(0), none, "p").collect() == []
    nulls = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(T.scored(docs, nulls, "p").collect()) == 5


def test_label_model_recovers_accuracies_and_a_correlated_pair():
    r = np.random.default_rng(0)
    y = r.random(6000) < 0.3
    say = lambda right: np.where(r.random(len(y)) < right, y, ~y)
    v = np.stack([say(0.95), say(0.9), say(0.8), say(0.85)], 1)
    v = np.concatenate([v, np.where(r.random(len(y)) < 0.97, v[:, 2], ~v[:, 2])[:, None]], 1) + 1
    m = T.LabelModel(0.3).fit(v, np.ones(len(y)))
    assert m.parent[4] == 2 or m.parent[2] == 4
    assert abs(m.accuracy[0] - 0.95) < 0.04 and abs(m.accuracy[1] - 0.9) < 0.05 and abs(m.accuracy[2] - 0.8) < 0.06
    assert ((m.posterior(v)[:, 1] > 0.5) == y).mean() > 0.95


def test_texts_of_which_only_agreeing_voters_speak_keep_their_class():
    # half of the toxic texts have no word of the fixed lexicons; three lexicons that go together name them
    for seed in range(3):
        r = np.random.default_rng(seed)
        y = r.random(4000) < 0.1
        listed, mined = y & (r.random(4000) < 0.5), y | (r.random(4000) < 0.005)
        said = [listed & (r.random(4000) < 0.7), listed & (r.random(4000) < 0.4), mined, mined & (r.random(4000) < 0.98), mined, *((r.random(4000) < p) | (y & (r.random(4000) < 0.3)) for p in (0.1, 0.05, 0.02))]
        v = T.TOXIC * np.stack(said, 1).astype(int)
        v = np.concatenate([v, (v.max(1) == 0).astype(int)[:, None]], 1)
        names = ["lexicon en", "pattern you", "mined toxic beginning 5", "mined toxic end 5", "mined toxic word 5", "mined toxic beginning 2", "mined toxic word 2", "mined toxic word 3"]
        p = T.LabelModel(0.1, belief=T.beliefs([(n, T.TOXIC, None) for n in names])).fit(v, np.ones(4000)).posterior(v)[:, 1]
        assert (p[y & ~listed] >= 0.5).mean() > 0.9 and (p[~y] < 0.5).mean() > 0.95


@pytest.mark.parametrize("listed", [0.0, 0.3])
def test_toxic_texts_are_caught_whatever_share_of_them_the_fixed_lexicons_know(spark, listed):
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("tor", "mel", "sin", "kar") for b in ("a", "e", "o") for c in ("nd", "st", "lin", "rim")]

    def text(toxic):
        w = [r.choice(words) for _ in range(25)]
        if toxic:
            w += [r.choice(("grobmund", "vexatrix", "chollado"))] * r.choice((1, 2)) + ["idiot", "moron"] * (r.random() < listed)
        w += [r.choice(("torka", "melka"))] * (r.random() < (0.4 if toxic else 0.05))
        return " ".join(r.sample(w, len(w)))

    truth = {k: int(k % 8 == 0) for k in range(2000)}
    docs = spark.createDataFrame([(k, text(y), "en", "s", 1) for k, y in truth.items()], SCHEMA)
    labels = spark.createDataFrame([(k, y) for k, y in truth.items() if k % 3], "doc_id long, toxic int")
    got = {x.doc_id: x.p >= 0.5 for x in T.scored(docs, labels, "p").collect()}
    assert np.mean([got[k] for k, y in truth.items() if y]) > 0.98 and np.mean([got[k] for k, y in truth.items() if not y]) < 0.01


def test_posteriors_follow_the_votes_and_not_the_labels(spark):
    # every tenth label is wrong: the votes outvote it, so the posteriors agree with the truth and not with the labels
    truth = {k: int(k % 3 == 0) for k in range(900)}
    labels = [(k, 1 - y if k % 10 == 7 else y) for k, y in truth.items()]
    insults = ["idiot", "moron", "scum", "vexword", "grobian", "trottel", "depp", "imbécile"]
    text = lambda k: f"plain words of text number {k % 7} " + (f"{insults[k % 8]} and {insults[k // 8 % 8]}" if truth[k] else "calm seas")
    docs = spark.createDataFrame([(k, text(k), "en", "s", 1) for k in truth], SCHEMA)
    got = {r.doc_id: r.p > 0.5 for r in T.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "p").collect()}
    assert np.mean([got[k] == bool(y) for k, y in truth.items()]) > 0.99


def test_a_name_that_differs_in_case_only_is_refused(spark):
    docs = spark.createDataFrame([(1, "a", 7.0)], "doc_id long, text string, SCORE double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.raises(ValueError, match="score"):
        T.scored(docs, none)
    assert T.scored(docs, none, "p").first().SCORE == 7.0
