"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output, divided by its share of the input. Each
document draws a uniform number from a hash of its id and the seed, and a Poisson distribution with that mean is
inverted at it; the document is repeated so many times, and the copies are sorted by a hash, which shuffles them
globally. Rates over `PART` are sums of equal parts, each drawn on its own, so no table of probabilities is long.

The draws need no shuffle: the rates are a row per source, joined by broadcast while there are at most `MOST_SOURCES`
and by a salted join beyond, as one source may hold a third of all rows. The one shuffle is the global one, by ranges
of a uniform hash.

Defined cases: a null source is a source of its own; null texts count as empty, and sources without any character are
kept at a rate of 1; sources that the targets don't name get none if targets are given; rows with a null id draw by
their text's digest; repeated rows draw the same number of copies. An empty table gives no rows. Columns of the input
stay, whatever their names; copies get the columns `copy` and `n_copies`, with underscores added if those are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, text_or_empty

PART = 16.0
MOST_SOURCES = 50_000
#: Entries of the table of a distribution: past them, at a mean of PART, less than 2^-53 is left.
TABLE = 84


def uniform(key: Column, seed: int, draw: Column) -> Column:
    """52 bits of a digest, as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", key, F.lit(str(seed)), draw.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, source: str, text: str, targets: dict[str | None, float] | None, repetition: float, temper: float) -> DataFrame:
    """source, parts, cdf: for each source, the number of draws and the table to invert. Without targets, shares are in proportion to a power of the sources' sizes."""
    # a row per source, written once: without that, each use of the sizes reads all documents
    sizes = materialise(docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.sum(F.length(text_or_empty(text))).cast("double").alias("size")), "sizes")
    if targets is None:
        share = F.sqrt("size") if temper == 0.5 else F.pow("size", F.lit(temper))
    else:
        share = F.lit(0.0)
        for name, weight in targets.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    sizes = sizes.withColumn("share", share)
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("share"))).alias("all_share"))
    lam = F.when(F.col("size") > 0, F.col("share") / F.col("all_share") * F.col("all_size") * F.lit(float(repetition)) / F.col("size")).otherwise(F.lit(1.0))
    out = sizes.join(F.broadcast(total)).select("source", F.coalesce(lam, F.lit(0.0)).alias("rate"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PART))).cast("int"))
    each = F.col("rate") / F.col("parts")
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE)),
        F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("c"), F.array(F.exp(-each)).alias("t")),
        lambda acc, k: F.struct((acc["p"] * each / k).alias("p"), (acc["c"] + acc["p"] * each / k).alias("c"), F.concat(acc["t"], F.array(acc["c"] + acc["p"] * each / k)).alias("t")),
        lambda acc: acc["t"],
    )
    return out.withColumn("cdf", step)


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, repetition: float = 1.0, temper: float = 0.5, seed: int = 7, id_col: str = "doc_id", source: str = "source", text: str = "text", shuffle: bool = True) -> DataFrame:
    """Copies of the documents. repetition: expected characters of the output for each of the input."""
    copy, n_copies = fresh(docs, "copy"), fresh(docs, "n_copies")
    table = rates(docs, source, text, targets, repetition, temper)
    names = {k: fresh(docs, f"mix_{k}") for k in ("source", "parts", "cdf", "key", "order")}
    table = table.select(F.col("source").alias(names["source"]), F.col("parts").alias(names["parts"]), F.col("cdf").alias(names["cdf"]))
    same = F.col(source).cast("string").eqNullSafe(F.col(names["source"]))
    n_sources = table.count()
    if n_sources <= MOST_SOURCES:  # a row has under 1 kB
        joined = docs.join(F.broadcast(table), same)
    else:
        salt = fresh(docs, "mix_salt")
        salted = table.withColumn(f"{salt}_of", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(64)).cast("int")).join(salted, same & (F.col(salt) == F.col(f"{salt}_of"))).drop(salt, f"{salt}_of")
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(text_or_empty(text)))
    # the least k with u < cdf[k] is the number of entries that u has reached; past the table is under 2^-53
    few = F.aggregate(F.sequence(F.lit(1), F.col(names["parts"])), F.lit(0), lambda acc, j: acc + _reached(F.col(names["cdf"]), uniform(F.col(names["key"]), seed, j)))
    drawn = joined.withColumn(names["key"], key).withColumn(n_copies, few).where(F.col(n_copies) > 0)
    out = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    out = out.withColumn(names["order"], F.md5(F.concat_ws(":", F.lit("order"), F.col(names["key"]), F.lit(str(seed)), F.col(copy).cast("string")))).drop(names["source"], names["parts"], names["cdf"], names["key"])
    if shuffle:
        out = out.orderBy(names["order"], copy)
    return out.drop(names["order"])


def _reached(cdf: Column, u: Column) -> Column:
    """How many entries of the ascending table are at most u; u is computed once."""
    return F.aggregate(cdf, F.struct(u.alias("u"), F.lit(0).alias("n")), lambda acc, c: F.struct(acc["u"].alias("u"), (acc["n"] + (c <= acc["u"]).cast("int")).alias("n")), lambda acc: acc["n"])


def sql(seed: int = 7, repetition: float = 1.0) -> str:
    """DuckDB SQL for mix() over `documents` with its other parameters at their defaults."""
    return f"""
        WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
        rated AS (
            SELECT source, CASE WHEN size > 0 THEN sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes WHERE size > 0) * (SELECT sum(size) FROM sizes) * {float(repetition)} / size ELSE 1.0 END AS rate FROM sizes),
        cut AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {PART}) AS INTEGER)) AS parts, rate / greatest(1, ceil(rate / {PART})) AS each FROM rated),
        terms AS (SELECT source, parts, k, exp(-each) * exp(sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(each / k) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM cut, range({TABLE + 1}) t(k)),
        tables AS (SELECT source, parts, list(c ORDER BY k) AS cdf FROM (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source, parts),
        keyed AS (SELECT d.*, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS mix_key, parts, cdf FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
        drawn AS (
            SELECT doc_id, text, lang, source, n_chars,
                CAST(list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda c: c <= CAST(CAST('0x' || substr(md5(mix_key || ':{seed}:' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)))) AS INTEGER) AS n_copies
            FROM keyed)
        SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(copy AS INTEGER) AS copy FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM drawn WHERE n_copies > 0)"""
