r"""Secret scans by a character convolutional network.

Candidates of whole texts are the matches of three rules (`assign`, `access`, `hex`) and every other run of `LEAST`
or more key-like characters, dots inside included, that has both letters and digits or follows a word that names keys (`net`). A network in numpy reads each candidate with the
characters around it: filters over windows of characters, the largest answer of each filter inside and outside of the
candidate, and a logistic layer. A candidate longer than the network's window is read in overlapping windows, of which
the likeliest counts. It is trained on labelled findings; its answers are calibrated on findings held back from the
training (Platt's scaling), and the threshold is the highest that still finds `RECALL` of the secrets among those.
Matches of the rules are kept whatever the network says; `net` candidates are kept from the threshold on.

Labelled findings are texts with a span and a label. Without any given, a seeded generator writes them: secrets of
many forms in contexts that name them, and look-alikes (digests of commits, ids, paths, numbers, names) in theirs.

Defined cases: null texts count as empty and have no findings; ids may be null; repeated rows give a row each, in the
same way. Spans are in code points, ends exclusive. Whole texts are read, whatever their length. Columns of the input
stay in redact(), whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Fixed patterns of the rules, in the order of their kinds; letters of the first in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "net")
LEAST, RECALL = 16, 0.98
NET = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{{{LEAST - 2},}}[A-Za-z0-9+/_=-]")
#: Words that name keys, and how many characters before a candidate they may begin.
NAMING, REACH = re.compile(r"(?i)key|auth|bearer|credential|private|passphrase"), 24
#: What a text must have for the rules to match; for a library that looks at all texts of a batch at once.
MAY = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "net": rf"[A-Za-z0-9+/_=.-]{{{LEAST}}}"}
BEFORE, INSIDE, AFTER = 32, 48, 16
WIDTH, FILTERS = 5, 24
LENGTH = BEFORE + INSIDE + AFTER
#: Codes of characters: printable ASCII in order, then all others, then nothing.
OTHER, NOTHING, CODES = 95, 96, 97


def base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules' matches, sorted."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]{24,}", text)]  # runs are maximal either way
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def others(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that no match of a rule meets."""
    out, i = [], 0
    ends = sorted((a, b) for a, b, _ in taken)
    for m in NET.finditer(text):
        a, b = m.span()
        while i < len(ends) and ends[i][1] <= a and (i + 1 == len(ends) or ends[i + 1][0] <= a):
            i += 1
        if any(x < b and a < y for x, y in ends[max(0, i - 1) : i + 2]):
            continue
        s = m[0]
        if re.search("[0-9]", s) and re.search("[A-Za-z]", s) or NAMING.search(text, max(0, a - REACH), a):
            out.append((a, b, "net"))
    return out


def windows(text: str, a: int, b: int) -> list[np.ndarray]:
    """Codes of each window of a candidate; the candidate's part begins at BEFORE."""
    out = []
    for s in range(a, max(a + 1, b - INSIDE // 2), INSIDE // 2) if b - a > INSIDE else [a]:
        e = min(b, s + INSIDE)
        piece = [text[max(0, s - BEFORE) : s].rjust(BEFORE, "\0"), text[s:e].ljust(INSIDE, "\0"), text[b : b + AFTER].ljust(AFTER, "\0") if e == b else text[e : e + AFTER].ljust(AFTER, "\0")]
        c = np.frombuffer("".join(piece).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        out.append(np.where((c >= 32) & (c < 127), c - 32, np.where(c == 0, NOTHING, OTHER)).astype(np.int16))
    return out


class Network:
    """Filters over one-hot characters, largest answers inside and outside of the candidate, a logistic layer."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.15, (WIDTH, CODES, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5
        at = np.arange(LENGTH - WIDTH + 1)
        self.inside = (at + WIDTH // 2 >= BEFORE) & (at + WIDTH // 2 < BEFORE + INSIDE)

    def _answers(self, x: np.ndarray):
        n = LENGTH - WIDTH + 1
        z = np.broadcast_to(self.bias, (len(x), n, FILTERS)).copy()
        for k in range(WIDTH):
            z += self.table[k][x[:, k : k + n]]
        a, b = z[:, self.inside], z[:, ~self.inside]
        i, j = a.argmax(1), b.argmax(1)
        top = np.concatenate([np.take_along_axis(a, i[:, None], 1)[:, 0], np.take_along_axis(b, j[:, None], 1)[:, 0]], 1)
        return np.maximum(top, 0), np.concatenate([np.flatnonzero(self.inside)[i], np.flatnonzero(~self.inside)[j]], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._answers(x[k : k + 256])[0] @ self.out + self.shift for k in range(0, len(x), 256)] or [np.zeros(0, np.float32)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.offset, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 5) -> Network:
        r, state = np.random.default_rng(seed), {}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(order), 64):
                rows = order[k : k + 64]
                top, where = self._answers(x[rows])
                p = 1 / (1 + np.exp(-np.clip(top @ self.out + self.shift, -30, 30)))
                d = ((p - y[rows]) / len(rows)).astype(np.float32)
                g_top = d[:, None] * self.out * (top > 0)
                g_table, g_bias = np.zeros_like(self.table), g_top[:, :FILTERS].sum(0) + g_top[:, FILTERS:].sum(0)
                f = np.tile(np.arange(FILTERS), 2)[None, :].repeat(len(rows), 0)
                for o in range(WIDTH):
                    np.add.at(g_table[o], (np.take_along_axis(x[rows], where + o, 1), f), g_top)
                step += 1
                for name, g in (("table", g_table), ("bias", g_bias), ("out", top.T @ d + 1e-4 * self.out), ("shift", d.sum())):
                    m, v = state.get(name, (0, 0))
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    state[name] = m, v
                    setattr(self, name, (getattr(self, name) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> Network:
        """Platt's scaling and the threshold, on findings that weren't trained on."""
        z = self.raw(x).astype(float)
        a, b = 1.0, 0.0
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([((p - t) * z).sum(), (p - t).sum()])
            w = np.maximum(p * (1 - p), 1e-6)
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.scale, self.offset = float(a), float(b)
        found = np.sort(self.score(x)[y == 1])
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5
        return self


def findings(n: int = 6000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): written by rule."""
    r = random.Random(seed)
    hexa, upper, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(r.choices(chars, k=k))
    word = lambda: "".join(r.choices(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "sch", "ción", "eau", "é", "ung", "ar", "os"], k=r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 9)))
    secret = [
        lambda: (r.choice(["password=", "passwd: ", 'secret = "', "token: ", 'token = "', "api_key=", "apikey: "]), some(hexa, r.choice([18, 32, 40]))),
        lambda: (r.choice(["", "key ", "aws_access_key_id = "]), "AKIA" + some(upper, 16)),
        lambda: (r.choice(["", "Authorization: Bearer ", "auth=", "use "]), some(alnum, r.randint(24, 64))),
        lambda: (r.choice(["", "pat ", "export T="]), r.choice(["ghp_", "gho_", "sk_live_", "pk_live_", "xoxb-", "glpat-", "npm_"]) + some(alnum, r.randint(20, 40))),
        lambda: (r.choice(["", "jwt ", "Cookie: "]), "eyJ" + some(alnum + "_-", r.randint(30, 90))),
        lambda: (r.choice(["", "jwt ", "Bearer "]), ".".join(["eyJ" + some(alnum, r.randint(15, 40)), "eyJ" + some(alnum + "_-", r.randint(20, 60)), some(alnum + "_-", 43)])),
        lambda: (r.choice(["key ", "auth: ", "credential ", "private key ", "the key is "]), some(alnum, r.randint(16, 24))),
        lambda: (r.choice(["key ", "auth: ", "credential ", "private key ", "passphrase "]), some(r.choice([alnum[:26], alnum[26:52], alnum[:52]]), r.randint(20, 40))),
        lambda: (r.choice(["aws_secret_access_key = ", "secret: ", "private ", "credentials "]), some(alnum + "+/", 40)),
    ]
    plain = [
        lambda: (r.choice(["commit ", "sha1 ", "etag ", "revision ", "checksum: "]), some(hexa, 40)),
        lambda: (r.choice(["id ", "uuid ", "request "]), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (r.choice(["", "see ", "in "]), "/".join(r.choices(["src", "lib", "v2", "2019", "docs", "index", "main", "usr", "share", "page1"], k=r.randint(4, 8)))),
        lambda: (r.choice(["", "call "]), "_".join(r.choices(["get", "value", "of", "item", "row2", "test", "handler", "to", "utf8", "list1"], k=r.randint(4, 7)))),
        lambda: (r.choice(["", "nr. ", "on "]), "-".join(str(r.randint(1, 9999)) for _ in range(r.randint(5, 8))) + r.choice(["a", "b", "Z", "T"])),
        lambda: (r.choice(["", "# "]), r.choice("=-_") * r.randint(18, 40) + r.choice(["a1", "x2"])),
        lambda: (r.choice(["", "class "]), "".join(w.capitalize() for w in r.choices(["item", "page", "value", "list", "http", "utf8", "int32", "reader", "factory"], k=r.randint(4, 7))) + "1"),
        lambda: (r.choice(["", "http://", "at "]), ".".join(r.choices(["www", "example", "mail2", "static", "news", "blog", "cdn1", "shop24"], k=r.randint(2, 4))) + r.choice([".com", ".org", ".de"]) + "/" + r.choice(["page", "item", "2021", "archive"]) + str(r.randint(1, 999))),
        lambda: (r.choice(["", "file ", "get "]), r.choice(["library", "package", "release", "report"]) + r.choice([".", "-", "_"]) + r.choice(["core", "base", "final", "linux"]) + "-" + ".".join(str(r.randint(0, 20)) for _ in range(3)) + r.choice([".tar.gz", ".zip", ".x86_64", ".json"])),
        lambda: (r.choice(["on ", "at ", "", "key date "]), f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}Z"),
        lambda: (r.choice(["key ", "the key to ", "author ", "private ", "monkey "]), "".join(word() for _ in range(r.randint(6, 9))).replace("é", "e").replace("ó", "o").ljust(16, "e")),
        lambda: ("", "".join(word() for _ in range(6)).replace("é", "e").replace("ó", "o") + str(r.randint(0, 99))),
    ]
    out = []
    for _ in range(n):
        y = r.random() < 0.5
        lead, body = r.choice(secret if y else plain)()
        head = prose() + r.choice([" ", "\n", ". "]) + lead
        out.append((head + body + r.choice(['" ', " ", "\n", ". ", ""]) + prose(), len(head), len(head) + len(body), int(y)))
    return out


@functools.lru_cache(maxsize=4)
def network(labelled: tuple | None = None) -> Network:
    """Trained on three quarters of the labelled findings, calibrated on the rest."""
    rows = list(labelled) if labelled is not None else findings()
    x = np.stack([windows(t, a, b)[0] for t, a, b, _ in rows])
    y = np.array([label for *_, label in rows])
    held = np.array([int(hashlib.md5(f"{t}:{a}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % 4 == 0 for t, a, *_ in rows])
    return Network().train(x[~held], y[~held]).calibrate(x[held], y[held])


def scan_texts(texts: pa.Array, net: Network) -> list[list[tuple[int, int, str, float]]]:
    """The findings (start, end, kind, score) of each text."""
    texts = pc.fill_null(texts, "")
    may = {k: np.asarray(pc.match_substring_regex(texts, x)) for k, x in MAY.items()}
    out: list[list] = [[] for _ in range(len(texts))]
    codes, owner = [], []
    found: list[tuple[int, tuple]] = []
    for k in np.flatnonzero(may["assign"] | may["access"] | may["hex"] | may["net"]).tolist():
        text = texts[k].as_py()
        own = base(text) if may["assign"][k] or may["access"][k] or may["hex"][k] else []
        if may["net"][k]:
            own = own + others(text, own)
        for f in own:
            w = windows(text, f[0], f[1])
            codes += w
            owner += [len(found)] * len(w)
            found.append((k, f))
    if found:
        score = np.zeros(len(found))
        np.maximum.at(score, np.array(owner), net.score(np.stack(codes)))
        for (k, (a, b, kind)), s in zip(found, score.tolist(), strict=True):
            if kind != "net" or s >= net.threshold:
                out[k].append((a, b, kind, s))
        for x in out:
            x.sort(key=lambda f: (f[0], KINDS.index(f[2]), f[1]))
    return out


def scan(docs: DataFrame, labelled: list | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, findings: array of (start, end, kind, score) by start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(network(tuple(labelled) if labelled is not None else None)))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(shared.value)
        for b in slices(batches):
            rows = [[{"start": a, "end": e, "kind": k, "score": s} for a, e, k, s in x] for x in scan_texts(b.column(1), net)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "findings"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, findings array<struct<start int, end int, kind string, score double>>")


def redact(docs: DataFrame, labelled: list | None = None, text: str = "text", mark: str = "[SECRET]"):
    """A column: the text with each run of findings replaced by the mark. A null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(network(tuple(labelled) if labelled is not None else None)))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = pickle.loads(shared.value)
        for batch in batches:
            out = batch.tolist()
            for b in slices([pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(range(len(out)))], names=["text", "at"])]):
                for at, found in zip(b.column("at").to_pylist(), scan_texts(b.column("text"), net), strict=True):
                    if found:
                        parts, last, t = [], 0, out[at]
                        for a, e, *_ in found:
                            if a >= last:
                                parts += [t[last:a], mark]
                            last = max(last, e)
                        out[at] = "".join([*parts, t[last:]])
            yield pd.Series(out, dtype=object)

    return clean(F.col(text).cast("string"))
