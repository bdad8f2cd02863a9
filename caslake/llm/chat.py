"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, `<|role|>` text `<|end|>` newline a turn, and encoded once with character offsets.
The spans of the assistant's texts, sorted, are intersected with the sorted token spans by binary search: a token is
under the mask where it meets such a span. The markers are special tokens, so no token straddles a marker and a text.

Texts and roles are escaped reversibly before they are rendered: the escape character and every character that could
begin or end a marker are written as a backslash and a letter, so that no text can hold a marker.

Defined cases: a null text or role is the empty one; rows of one turn number come in the order of role and text, and
repeated rows are turns of their own; null turn numbers come first; rows with a null conv_id are one conversation. Very
long conversations are rendered whole. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
END = "<|end|>"
#: Fixed values of the template: the escape character comes first.
ESCAPES = {"\\": "\\\\", "<": "\\l", "|": "\\p", ">": "\\g"}
SCHEMA = "conv_id long, n_turns long, formatted string, ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>, span_start array<int>, span_end array<int>"


def escape(text: str) -> str:
    for raw, coded in ESCAPES.items():
        text = text.replace(raw, coded)
    return text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    back = {coded[1]: raw for raw, coded in ESCAPES.items()}
    head, *parts = text.split("\\")
    out, i = [head], 0
    while i < len(parts):
        if parts[i] == "":  # an escaped escape character: what follows is plain
            out.append("\\")
            if i + 1 < len(parts):
                out.append(parts[i + 1])
            i += 2
        else:
            out.append(back[parts[i][0]] + parts[i][1:])
            i += 1
    return "".join(out)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted text and the sorted spans of the texts to train on."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"<|{escape(role)}|>", escape(text)
        out += [head, body, END, "\n"]
        at += len(head)
        if role == trained:
            starts.append(at)
            ends.append(at + len(body))
        at += len(body) + len(END) + 1
    return "".join(out), starts, ends


def mask(token_start: np.ndarray, token_end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens meet a span; both are sorted and tokens of one character may share its offsets."""
    first, last = np.searchsorted(token_end, starts, side="right"), np.searchsorted(token_start, ends, side="left")
    edge = np.zeros(len(token_start) + 1, dtype=np.int64)
    full = ends > starts
    np.add.at(edge, first[full], 1)
    np.add.at(edge, np.maximum(first, last)[full], -1)
    return np.cumsum(edge[:-1]) > 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(END + "\n")[:-1]:
        role, _, body = piece[2:].partition("|>")
        turns.append((unescape(role), unescape(body)))
    return turns


def masked_text(formatted: str, loss_mask, token_start, token_end, span_start, span_end) -> str:
    """The text under the mask, unescaped. Tokens under the mask are clipped to their span."""
    m = np.asarray(loss_mask, dtype=bool)
    ts, te = np.asarray(token_start)[m], np.asarray(token_end)[m]
    out = []
    for a, b in zip(span_start, span_end, strict=True):
        i, j = np.searchsorted(te, a, side="right"), np.searchsorted(ts, b, side="left")
        if i < j:
            lo, hi = np.maximum(ts[i:j], a), np.minimum(te[i:j], b)
            lo = np.maximum(lo, np.concatenate([[a], np.maximum.accumulate(hi)[:-1]]))  # tokens within one character share its span
            out.append(unescape("".join(formatted[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True) if x < y)))
    return "".join(out)


def _tokenizer(config: str, roles: list[str]):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_str(config)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in [END, *(f"<|{escape(r)}|>" for r in roles)]])
    return t


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER, trained: str = "assistant", roles: tuple[str, ...] = ("system", "user", "assistant", "tool")) -> DataFrame:
    """A row per conversation: formatted text, token ids, offsets, loss mask, spans of the trained texts. The driver reads the tokenizer's file, whose bytes the executors get; a role that isn't among `roles` has a marker of several tokens."""
    spark = conversations.sparkSession
    config = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def one(tok, conv_id, turns):
        text, starts, ends = render(turns, trained)
        enc = tok.encode(text, add_special_tokens=False)
        off = np.asarray(enc.offsets, dtype=np.int32).reshape(-1, 2)
        s, e = np.asarray(starts, dtype=np.int32), np.asarray(ends, dtype=np.int32)
        return {"conv_id": conv_id, "n_turns": len(turns), "formatted": text, "ids": enc.ids, "token_start": off[:, 0], "token_end": off[:, 1], "loss_mask": mask(off[:, 0], off[:, 1], s, e), "span_start": s, "span_end": e}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(config.value, list(roles))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        done, size, turns, now = [], 0, [], None

        def flush():
            nonlocal done, size
            out = pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
            done, size = [], 0
            return out

        for batch in batches:
            for conv, role, text in zip([None if pd.isna(c) else int(c) for c in batch["conv_id"]], batch["role"], batch["text"], strict=True):
                if turns and conv != now:
                    done.append(one(tok, now, turns))
                    size += len(done[-1]["formatted"])
                    turns = []
                    if size > 1 << 20:
                        yield flush()
                now = conv
                turns.append((role, text))
        if turns:
            done.append(one(tok, now, turns))
        if done:
            yield flush()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInPandas(run, SCHEMA)


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted output says when it is read back."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                turns = parse(r.formatted)
                loss = masked_text(r.formatted, r.loss_mask, r.token_start, r.token_end, r.span_start, r.span_end)
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((r.conv_id, len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), sha(loss), len(r.formatted), len(r.ids), int(np.sum(r.loss_mask))))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({"conv_id": "Int64"})

    return chats.mapInPandas(run, schema)
