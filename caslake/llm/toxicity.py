r"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (`MOST_TOXIC` and `MOST_CLEAN`, the first by a hash of the id, from the rows that
   may be learned from) is counted on the executors: in how many texts of each label a feature occurs. Features are
   the words of a whole text in lower case, their beginnings and ends of some lengths, and which of these it has twice.
2. Voters: fixed lexicons, one a language; lexicons mined from those counts, toxic and clean ones, split by kind and
   by how telling they are; and patterns. A lexicon says its class of a text that has any of its features, and nothing of others; one more
   voter says clean of texts of which nobody says toxic. Labels have no other part in the votes.
3. A generative label model, fitted by expectation maximisation to the votes, estimates each voter's accuracy in
   both classes and the correlations between voters: a vote depends on the class and on the vote of the voter that it
   goes with most closely given the class (a tree of the largest conditional mutual informations). Of the labels it is
   told the share of toxic ones, as the prior of the classes; the tables that it starts from; and how the mined lexicons
   and the last voter vote on either class, `TRUST` times as much as the posteriors say of that. The tables of fixed
   lexicons and patterns follow from the votes, and no row's label is evidence in its own posterior. That one of the
   former says nothing is evidence as well, as measured; of the others it is none. Without this, texts of which only mined lexicons speak
   settle on either side by chance of the sample, since voters that agree are as one.
4. A linear classifier (logistic, ridge, Newton's method) is trained on the model's posterior labels; its features are
   those with the clearest counts, at most `MOST_FEATURES`. It scores every text by a function that needs nothing but
   the text.

Defined cases: null and empty texts, and texts without any known feature, score what the intercept says, between 0 and
1; null labels are ignored, and the largest of several labels of one id counts; rows with a null id are scored but not
learned from; repeated rows score alike; features of equal counts go by name. Without labels of both classes, as with
an empty table of labels, the fixed lexicons decide; an empty table of documents gives no rows. Whole texts are read,
whatever their length. Columns of the input stay; the score's name must not be one of them in any case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Bounds of the sample that the model is fitted on.
MOST_TOXIC, MOST_CLEAN = 3000, 6000
#: Features that voters and the linear classifier choose from: the most telling ones of the sample, which is bounded too.
MOST_FEATURES = 600
#: Log-likelihood ratio (chi-square with one degree of freedom) that a feature must reach.
LEAST_RATIO = 12.0
#: Log odds ratio of a mined lexicon's features, at least, either way.
LEXICON_ODDS = 2.5
#: Mined lexicons from these log odds on are believed beforehand as if by the first share of their votes, other voters by the second.
TELLING_ODDS, BELIEF_TELLING, BELIEF = 4, 0.5, 0.05
#: How often the votes of a mined lexicon, and of the last voter, count by the labels that it was mined from, beside once by the posteriors.
TRUST = 10.0
CLEAN, TOXIC = 1, 2

#: Common insults, by language.
LEXICONS = {
    "en": "asshole bastard bitch clown coward creep cretin crap damn degenerate disgusting dumb dumbass filth fool freak fuck fucking garbage hate hateful idiot idiotic imbecile jerk kill loser lowlife moron moronic pathetic pig psycho retard scum scumbag shit shitty slut stupid trash twat vermin whore worthless",
    "de": "abschaum arschloch bastard blödmann depp dreck dumm dummkopf fotze hurensohn idiot miststück penner scheiße schlampe schwachkopf trottel versager vollidiot wichser",
    "es": "asqueroso basura bastardo cabrón capullo escoria estúpido fracasado gilipollas idiota imbécil inútil maldito mierda patético payaso pendejo perdedor puta tonto",
    "fr": "abruti bâtard connard connasse crétin débile déchet enculé idiot imbécile merde minable ordure pathétique perdant pute salaud salope stupide",
}
PATTERNS = {"you": r"\b(you|your|du|tu|vous|eres)\b.{0,40}\b(idiot\w*|stupid\w*|moron|loser|trash|pathetic|worthless|scum)\b", "leet": r"\b(sh[i1!]t|f[u*]ck\w*|b[i1!]tch|a[s$]{2}hole|st[u*]p[i1!]d)\b", "shouting": r"!{3,}"}
WORD = r"\w+"
#: Marks a part that a text has more than once.
AGAIN = "~"


def _parts(word: str) -> tuple[str, ...]:
    n = len(word)
    return (word, *(f"{word[:k]}*" for k in (3, 4, 5, 6) if n > k), *(f"*{word[-k:]}" for k in (4, 5) if n > k))


def features(text: str) -> set[str]:
    """Parts of the text's words, and the parts that occur more than once, marked."""
    times: Counter[str] = Counter()
    for w, n in Counter(re.findall(WORD, text.lower())).items():
        for f in _parts(w):
            times[f] += n
    return set(times).union(f + AGAIN for f, n in times.items() if n > 1)


def _counts(rows: DataFrame) -> pd.DataFrame:
    """feature, pos, neg: texts of each label with the feature; the most telling ones, a bounded number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in slices(batches):
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                for f in features(text):
                    seen.setdefault(f, [0, 0])[y] += 1
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_pydict({"feature": list(seen), "pos": [v[1] for v in seen.values()], "neg": [v[0] for v in seen.values()]})
                seen = {}
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(seen), pa.string()), "pos": pa.array([v[1] for v in seen.values()], pa.int64()), "neg": pa.array([v[0] for v in seen.values()], pa.int64())})

    counts = rows.select("text", "y").mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = rows.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = total["p"] or 0, (total["n"] or 0) - (total["p"] or 0)
    odds = F.log((F.col("pos") + 0.5) / (p + 1.0)) - F.log((F.col("neg") + 0.5) / (n + 1.0))
    term = lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))
    x, y = F.col("pos").cast("double"), F.col("neg").cast("double")
    ratio = 2 * (term(x) + term(y) + term(p - x) + term(n - y) - term(x + y) - term(p + n - x - y) + term(F.lit(float(p + n))) - term(F.lit(float(p))) - term(F.lit(float(n))))
    best = counts.withColumn("odds", odds).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "feature").limit(MOST_FEATURES).select("feature", "pos", "neg", "odds", "ratio")
    return pd.DataFrame([r.asDict() for r in best.collect()], columns=["feature", "pos", "neg", "odds", "ratio"])


def voters(mined: pd.DataFrame) -> list[tuple[str, int, object]]:
    """(name, vote, set of features or pattern): a text with any of the features, or that matches, gets the vote."""
    out: list[tuple[str, int, object]] = [(f"lexicon {lang}", TOXIC, frozenset(x.split())) for lang, x in LEXICONS.items()]
    out += [(f"pattern {k}", TOXIC, re.compile(x, re.I | re.S)) for k, x in PATTERNS.items()]
    groups: dict[tuple[str, int], set] = {}
    for f, odds in zip(mined["feature"], mined["odds"], strict=True):
        if abs(odds) > LEXICON_ODDS:
            kind, vote = "end" if f[0] == "*" else "beginning" if "*" in f else "word", TOXIC if odds > 0 else CLEAN
            groups.setdefault((f"mined {'toxic' if vote == TOXIC else 'clean'} {kind} {min(int(abs(odds)), 5)}", vote), set()).add(f)
    return out + [(k, vote, frozenset(v)) for (k, vote), v in sorted(groups.items())]


def beliefs(panel) -> list[float]:
    """How far each voter is believed beforehand, and the last voter of votes()."""
    telling = [name.startswith("mined ") and int(name.split()[-1]) >= TELLING_ODDS for name, *_ in panel]
    return [*(BELIEF_TELLING if x else BELIEF for x in telling), BELIEF]


def trusts(panel) -> list[float]:
    """How far the labels say what a voter's votes are worth, and those of the last voter of votes(), which follow from the mined lexicons' too."""
    return [*(TRUST if name.startswith("mined ") else 0.0 for name, *_ in panel), TRUST]


def votes(text: str, found: set[str], panel) -> list[int]:
    """2 toxic, 1 clean, 0 nothing; the last voter says clean of texts with words of which no other says toxic."""
    out = [vote * bool(not found.isdisjoint(x) if isinstance(x, frozenset) else x.search(text)) for _, vote, x in panel]
    return [*out, int(bool(found) and TOXIC not in out)]


def majority(v: np.ndarray) -> np.ndarray:
    """First guesses of P(toxic): the share of toxic ones among the votes cast, with half a vote for either class."""
    toxic, clean = (v == TOXIC).sum(1), (v == CLEAN).sum(1)
    return (toxic + 0.5) / (toxic + clean + 1)


class LabelModel:
    """P(y) and P(vote | y, vote of the parent), by expectation maximisation; the parents form a tree."""

    def __init__(self, share: float, rounds: int = 60, smooth: float = 0.5, belief: float | list[float] = 0.05, trust: float | list[float] = 0.0):
        """belief, one for all or one a voter: so many of its votes a voter is taken to have cast rightly beforehand; without it, voters that always agree say nothing of the class. trust, likewise: so often its votes count by the rows' labels, if fit() is given any, beside once by the posteriors."""
        self.prior, self.rounds, self.smooth, self.belief, self.trust = np.array([1 - share, share]), rounds, smooth, belief, trust

    def _tables(self, v: np.ndarray, w: np.ndarray, told: np.ndarray | None = None) -> None:
        """w, told: the rows' weights of either class by the posteriors and by the labels."""
        m = v.shape[1]
        hot = [np.stack([v[:, j] == x for x in range(3)], 1).astype(float) for j in range(m)]
        link = np.full((m, m), -1.0)
        pair = {}
        for i in range(m):
            for j in range(i):
                t = np.stack([hot[i].T @ (hot[j] * w[:, [y]]) for y in (0, 1)])  # y, vote i, vote j
                pair[i, j] = t
                p = (t + 1e-9) / (t.sum() + 1e-9)
                link[i, j] = link[j, i] = (p * np.log(p * p.sum((1, 2), keepdims=True) / (p.sum(2, keepdims=True) * p.sum(1, keepdims=True)))).sum()
        self.link, parent, inside = link, [-1] * m, {0}
        while len(inside) < m:  # the tree that is heaviest in conditional mutual information
            i, j = max(((i, j) for i in range(m) if i not in inside for j in inside), key=lambda x: link[x])
            parent[i] = j
            inside.add(i)
        self.parent, self.table = parent, []
        belief, trust = np.broadcast_to(self.belief, m), np.broadcast_to(self.trust, m) * (told is not None)
        self.measured = trust > 0
        for i in range(m):
            j = parent[i]
            t = np.stack([(hot[i] * w[:, [y]]).sum(0) for y in (0, 1)])[:, None, :] if j < 0 else np.stack([(pair[i, j][y].T if i > j else pair[j, i][y]) for y in (0, 1)])
            for y in (0, 1):
                t[y, :, y + 1] += belief[i] * t[:, :, y + 1].sum(0)
            if self.measured[i]:
                of = np.ones((len(v), 1)) if j < 0 else hot[j]
                t = t + trust[i] * np.stack([of.T @ (hot[i] * told[:, [y]]) for y in (0, 1)])
            t = t + self.smooth
            self.table.append(t / t.sum(2, keepdims=True))  # y, vote of the parent, vote

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(class) of each row, from its votes."""
        log = np.tile(np.log(self.prior), (len(v), 1))
        for i, t in enumerate(self.table):
            says = np.log(t[:, v[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(v), int), v[:, i]]).T
            log += says if self.measured[i] else np.where(v[:, [i]] > 0, says, 0)  # saying nothing is no evidence, unless labels say what it is worth
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(1, keepdims=True)

    def fit(self, v: np.ndarray, weight: np.ndarray, label: np.ndarray | None = None) -> LabelModel:
        """label, 0 or 1 a row: the tables start from these, else from the voters' majority; trusted voters keep to them."""
        p, told = majority(v), None
        p = np.stack([1 - p, p], 1)
        if label is not None:
            told = np.stack([label == 0, label == 1], 1) * weight[:, None]
            self._tables(v, told, told)
            p = self.posterior(v)
        for _ in range(self.rounds):
            self._tables(v, p * weight[:, None], told)
            p = self.posterior(v)
        # the probability that a vote that was cast is right, and how much of each class the voter speaks on
        cast = [(v[:, j] > 0) * weight for j in range(v.shape[1])]
        self.accuracy = [float((c * p[np.arange(len(v)), np.maximum(v[:, j], 1) - 1]).sum() / max(1e-9, c.sum())) for j, c in enumerate(cast)]
        self.coverage = [[float((c * p[:, y]).sum() / max(1e-9, (weight * p[:, y]).sum())) for y in (0, 1)] for c in cast]
        return self


def distinct(x: np.ndarray, mined: pd.DataFrame) -> list[int]:
    """Features without those whose texts a clearer or as clear feature has too: what a word's beginning says needs no weight of the word."""
    both = x.T @ x
    n, odds = np.diag(both), mined["odds"].to_numpy(dtype=float)
    order = sorted(range(len(mined)), key=lambda k: (-mined["ratio"].iloc[k], -len(mined["feature"].iloc[k]), mined["feature"].iloc[k]))
    kept: list[int] = []
    for k in order:
        g = np.array(kept, dtype=int)
        if not len(g) or not ((both[k, g] >= 0.95 * n[k]) & (odds[g] * np.sign(odds[k]) >= abs(odds[k]) - 0.7)).any():
            kept.append(k)
    return kept


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft labels y and row weights w; the intercept isn't shrunk."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    b = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = ((x * (w * np.maximum(p * (1 - p), 1e-4)).astype(x.dtype)[:, None]).T @ x).astype(float)
        h[np.diag_indices_from(h)] += shrink
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - shrink * b)
        b += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return b[:-1], float(b[-1])


def trained_on(id_col: str = "doc_id") -> Column:
    """The rows that may be learned from: crc32 of the id's text isn't divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The classifier: {"weights": {feature: weight}, "intercept": ..., "voters": ...}."""
    known = labels.where(trained_on(id_col) & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label).cast("int")).alias("y")).where(F.col("y").isin(0, 1))
    sample = None
    for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):  # bounded: at most so many ids are broadcast
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("i", F.lit(5)), "i").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    ids = {r["i"]: r["y"] for r in sample.collect()}
    share = known.agg(F.avg("y")).first()[0]
    if len(set(ids.values())) < 2:
        weights = {w: 4.0 for x in LEXICONS.values() for w in x.split()}
        return {"weights": weights, "intercept": -2.5, "voters": [], "share": share}
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(list(ids.items()), "i long, y int"))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text).alias("text")).join(small, "i")
    mined = _counts(rows)
    panel = voters(mined)
    index = {f: k for k, f in enumerate(mined["feature"])}
    shared = spark.sparkContext.broadcast((panel, index))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel, index = shared.value
        for b in slices(batches):
            out = []
            for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = features(t)
                out.append((y, votes(t, found, panel), sorted(index[f] for f in found if f in index)))
            yield pa.RecordBatch.from_pydict({"y": pa.array([o[0] for o in out], pa.int32()), "votes": pa.array([o[1] for o in out], pa.list_(pa.int32())), "at": pa.array([o[2] for o in out], pa.list_(pa.int32()))})

    seen = rows.select("i", "y", "text").orderBy("i").mapInArrow(look, "y int, votes array<int>, at array<int>").collect()
    y = np.array([r["y"] for r in seen])
    v = np.array([r["votes"] for r in seen], dtype=int)
    rate = np.array([1 - share, share]) / np.maximum(np.bincount(y, minlength=2) / len(y), 1e-9)
    weight = rate[y] / rate[y].mean()
    model = LabelModel(share, belief=beliefs(panel), trust=trusts(panel)).fit(v, weight, y)
    posterior = model.posterior(v)[:, 1]
    x = np.zeros((len(seen), len(index)), dtype=np.float32)
    for k, r in enumerate(seen):
        x[k, r["at"]] = 1
    chosen = distinct(x, mined)
    w, b = logistic(x[:, chosen], posterior, weight)
    named = [mined["feature"].iloc[k] for k in chosen]
    return {"weights": {f: float(v) for f, v in zip(named, w, strict=True) if abs(v) > 1e-6}, "intercept": b, "voters": [*(n for n, *_ in panel), "quiet"], "accuracy": model.accuracy, "coverage": model.coverage, "posteriors_right": float(((posterior >= 0.5) == (y == 1)).mean()), "parents": model.parent, "share": share}


def scorer(spark, model: dict):
    """A function of a text column: P(toxic)."""
    shared = spark.sparkContext.broadcast((model["weights"], model["intercept"]))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, intercept = shared.value
        find = re.compile(WORD).findall
        bases = {f.removesuffix(AGAIN) for f in weights}
        known: dict[str, tuple] = {}
        for batch in batches:
            out = np.empty(len(batch))
            for k, text in enumerate(batch):
                hits: dict[str, int] = {}
                for w, n in Counter(find(text.lower())).items() if text else ():
                    h = known.get(w)
                    if h is None:
                        if len(known) > 50_000:
                            known.clear()
                        known[w] = h = tuple(f for f in _parts(w) if f in bases)
                    for f in h:
                        hits[f] = hits.get(f, 0) + n
                out[k] = intercept + sum(weights.get(f, 0.0) + (weights.get(f + AGAIN, 0.0) if n > 1 else 0.0) for f, n in sorted(hits.items()))
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score


def scored(docs: DataFrame, labels: DataFrame, name: str = "score", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one more column, which must not be one of theirs."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column {name}")
    return docs.withColumn(name, scorer(docs.sparkSession, fit(docs, labels, id_col, text))(text_or_empty(text)))
