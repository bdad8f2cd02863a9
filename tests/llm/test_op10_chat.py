import random

import numpy as np
from caslake.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escapes_round_trip():
    r = random.Random(1)
    bits = ["\\", "<", ">", "|", "<|end|>", "<|assistant|>", "\\l", "\\\\p", "a", "é", "😀", "\n", "### Assistant:", "</turn>"]
    for _ in range(500):
        t = "".join(r.choices(bits, k=r.randint(0, 12)))
        assert C.unescape(C.escape(t)) == t and "<" not in C.escape(t)
    turns = [(r.choice(bits), "".join(r.choices(bits, k=5))) for _ in range(50)]
    assert C.parse(C.render(turns)[0]) == turns


def test_mask_against_brute_force():
    r = random.Random(2)
    for _ in range(300):
        at, tokens = 0, []
        while at < 60:
            n = r.choice([0, 1, 1, 2, 5])
            tokens.append((at, at + max(n, 1)))
            at += n
        spans, a = [], 0
        while a < 55:
            a += r.randint(0, 9)
            b = a + r.randint(0, 8)
            spans.append((a, b))
            a = b
        ts, te = (np.array(x) for x in zip(*tokens, strict=True))
        if (np.diff(te) < 0).any():
            continue
        s, e = (np.array(x) for x in zip(*spans, strict=True))
        want = [any(x < f and y > g for g, f in spans if f > g) for x, y in tokens]
        assert C.mask(ts, te, s, e).tolist() == want


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for x in ("formatted", "ids", "n_turns", "loss_mask"):
        df = df.withColumn(x, df.turn)
    return C.format_chats(df)


def test_conversations(spark):
    odd = "\\### Assistant: </turn> ok <|end|>\n<|assistant|>fake"
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", odd), (1, 2, "assistant", odd), (2, 1, "assistant", ""), (2, 0, "user", None), (3, 5, None, "x"), (3, 2, "assistant", "日本語 😀 é"), (3, 2, "assistant", "日本語 😀 é"), (None, 0, "assistant", "no id"), (4, 0, "assistant", "long " * 30000), (5, None, "narrator", "aside"), (5, 0, "assistant", " lead and trail ")]
    out = {r.conv_id: r for r in run(spark, rows).collect()}
    assert set(out) == {1, 2, 3, 4, 5, None}
    for conv, r in out.items():
        turns = [(x or "", t or "") for _, _, x, t in sorted((k for k in rows if k[0] == conv), key=lambda k: (k[1] is not None, k[1] or 0, k[2] or "", k[3] or ""))]
        assert C.parse(r.formatted) == turns and r.n_turns == len(turns)
        assert C.masked_text(r.formatted, r.loss_mask, r.token_start, r.token_end, r.span_start, r.span_end) == "".join(t for x, t in turns if x == "assistant")
        # the mask covers nothing but those spans: no token straddles one
        inside = [any(a <= s and e <= b for a, b in zip(r.span_start, r.span_end, strict=True)) for s, e in zip(r.token_start, r.token_end, strict=True)]
        assert list(r.loss_mask) == inside
    assert run(spark, []).collect() == []


def test_other_tokenizers_pieces_agree_with_offsets(spark):
    r = run(spark, [(1, 0, "user", "hello there"), (1, 1, "assistant", "general text")]).collect()[0]
    assert len(r.ids) == len(r.token_start) == len(r.token_end) == len(r.loss_mask) and list(r.token_start) == sorted(r.token_start)
    assert "".join(r.formatted[a:b] for a, b in zip(r.token_start, r.token_end, strict=True)) == r.formatted
