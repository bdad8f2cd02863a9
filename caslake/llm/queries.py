"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, mixing, neardup, packing, secrets, substrings, syncmers, topk, toxicity
from .common import table


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` replicated so that each source's share is in proportion to the root of its size."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, scored for toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", (~toxicity.trained_on()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every whole text of `documents`."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    line = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    rules = F.filter("findings", lambda f: f["kind"] != "net")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(line(rules), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"), n("net").alias("n_net"), F.round(F.array_max(F.transform("findings", lambda f: f["score"])), 4).alias("highest_score"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 5 best rows of `embeddings` by integer inner product."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document: linked multisets of five-word shingles at 0.8 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of `documents` and of its edited text."""
    rows = syncmers.edited(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` without the bytes that strings of 200 bytes repeat."""
    return substrings.dedup(table(spark, sf_dir, "documents"), digest=True)


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that each whole text and each notice line of `documents` matches."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of 2048 words; equal texts never meet in one."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `conversations` and one more, formatted and read back."""
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(rows.unionByName(more))).drop("n_tokens", "n_loss_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_poisson_mix": op1_poisson_mix, "op2_toxicity": op2_toxicity, "op3_secrets": op3_secrets, "op4_topk": op4_topk, "op5_bagminhash": op5_bagminhash, "op6_syncmers": op6_syncmers, "op7_substrings": op7_substrings, "op8_license": op8_license, "op9_packing": op9_packing, "op10_chat": op10_chat,
}

SQL: dict[str, str] = {
    "op1_poisson_mix": mixing.sql(),
    "op8_license": licenses.sql(),
    "op4_topk": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5""",
    "op10_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
            SELECT *, length(replace(replace(replace(replace(role || text, '\', '\\'), '<', '\l'), '|', '\p'), '>', '\g')) + 4 + 7 + 1 AS n FROM rows)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
