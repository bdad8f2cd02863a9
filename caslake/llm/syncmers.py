"""Document fingerprints from closed syncmers, with SQL functions only.

A text's k-mers (`K` characters) are anchors if the least of their inner substrings (`S` characters, by hash) lies at
their beginning or end. Whether a k-mer is one depends on nothing around it, so an anchor that two texts share is found
in both, with its position. An anchor's name is a hash of the whole k-mer. The fingerprint has all names, each once, in
the order of their first positions: about a quarter as many as the text has characters. Two fingerprints are compared as
sets, by Jaccard similarity.

Substrings are taken from the text in UTF-32, where any position is found at once.

Anchors make edits cheap: those of a text that is put together from parts of others are the parts' own anchors, by
their positions, and the few across the seam.

The next document is found without a global sort: documents go to buckets between approximate quantiles of the id, each
of about `BUCKET` rows and at most `MOST_BUCKETS` in all; rows of one id that spans several buckets are dealt to them by
ranges of a hash of the text. The last row of each bucket is also sent to the bucket after it. Only one row per bucket
meets in one place, to link the buckets. Texts are sent without their anchors, which are larger and are found where the
text arrives.

Defined cases: null texts count as empty; texts without an anchor have one name, of the whole text, and the empty text
has none; equal fingerprints have a likeness of 1, and an empty one has 0 to any other. In the order of documents, rows
with a null id come last, by a hash of the text; rows of one id go by that hash too; rows equal in both are neighbours. A lone document is its own next. Very
long texts are read whole: no step looks for a character from a text's beginning for each of its positions. An empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty

K, S = 12, 5
WINDOW = K - S + 1
BUCKET, FAN = 128, 40
MOST_BUCKETS = FAN**3
LOW = 2**32 - 1


def bind(value: Column, body) -> Column:
    """body(value), with value computed once however often body needs it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchors(text: Column) -> Column:
    """position << 32 | name, by position, of the anchors of a text."""
    none = F.array().cast("array<bigint>")
    piece = lambda wide, i, n: F.substr(wide, i * 4 + 1, F.lit(4 * n))

    def inside(x: Column, h: Column, i: Column) -> Column:
        """x, the lesser end of the k-mer at i, is no more than what lies between its ends."""
        out = x <= F.get(h, i + 1)
        for j in range(2, WINDOW - 1):
            out = out & (x <= F.get(h, i + j))
        return out

    def found(wide: Column, h: Column) -> Column:
        # null where no whole k-mer begins
        ends = F.transform(h, lambda x, i: F.when(x <= F.get(h, i + (WINDOW - 1)), x).otherwise(F.get(h, i + (WINDOW - 1))))
        anchor = lambda i: F.shiftleft(i.cast("long"), 32).bitwiseOR(F.xxhash64(piece(wide, i, K)).bitwiseAND(F.lit(LOW)))
        return F.filter(F.transform(ends, lambda x, i: F.when(inside(x, h, i), anchor(i))), lambda a: a.isNotNull())

    def of(wide: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), (F.octet_length(wide) / 4).cast("int") - S), lambda i: F.xxhash64(piece(wide, i, S)))
        return bind(inner, lambda h: found(wide, h))

    return F.when(F.length(text) >= K, bind(F.encode(text, "UTF-32"), of)).otherwise(none)


def up_to(found: Column, end: Column) -> Column:
    """The anchors at positions below the one that `end` has in its upper half."""
    return F.filter(found, lambda a: a < end)


def whole(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text).bitwiseAND(F.lit(LOW))))


def settle(found: Column, text: Column) -> Column:
    """The names of anchors, each where it is first found, or that of the whole text."""
    out = F.array_distinct(F.transform(found, lambda a: a.bitwiseAND(F.lit(LOW))))
    return F.when(F.size(out) > 0, out).otherwise(whole(text))


def written(fingerprint: Column) -> Column:
    """8 hexadecimal digits a name."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    one = F.size(a) + F.size(b) - both
    return F.when(a == b, F.lit(1.0)).when(one > 0, both / one).otherwise(F.lit(0.0))


def anchored(rows: DataFrame) -> DataFrame:
    """rows with the anchors and the fingerprint (array of names) of their column text."""
    rows = rows.withColumn("anchors", anchors(F.col("text")))
    return rows.withColumn("fingerprint", settle(F.col("anchors"), F.col("text")))


def _base(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    return base.withColumn("n_chars", F.length("text").cast("long"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_chars, anchors, fingerprint (array of names)."""
    return anchored(_base(docs, id_col, text))


def fixed(value: list, kind: str) -> Column:
    """A constant array of any depth."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _below(rows: DataFrame, name: str, v: str, bounds: list[int], strict: bool) -> DataFrame:
    """rows with how many of the sorted bounds are below v (or equal to it): a search in a tree of FAN branches and three levels."""
    tree = [[bounds[k : k + FAN] for k in range(j, min(j + FAN**2, len(bounds)), FAN)] for j in range(0, len(bounds), FAN**2)]
    count = lambda values: F.size(F.filter(values, lambda b: b < F.col(v) if strict else b <= F.col(v)))
    rows = rows.withColumn("c1_", count(fixed([x[0][0] for x in tree], "array<bigint>")) - 1)
    rows = rows.withColumn("c2_", count(F.get(fixed([[y[0] for y in x] for x in tree], "array<array<bigint>>"), F.col("c1_"))) - 1)
    rows = rows.withColumn("c3_", count(F.get(F.get(fixed(tree, "array<array<array<bigint>>>"), F.col("c1_")), F.col("c2_"))))
    return rows.withColumn(name, F.when(F.col("c1_") < 0, F.lit(0)).otherwise(F.col("c1_") * FAN**2 + F.col("c2_") * FAN + F.col("c3_"))).drop("c1_", "c2_", "c3_")


def bucketed(rows: DataFrame) -> DataFrame:
    """rows with their bucket, which never falls as (v, x) rises; rows without an id go to buckets below 0."""
    named = rows.where(~F.col("unnamed"))
    total = rows.select(F.count("*").alias("n")).first()["n"]
    n = max(1, min(MOST_BUCKETS, -(-total // BUCKET)))
    share = fixed([k / n for k in range(1, n)], "array<double>")
    bounds = sorted(named.agg(F.percentile_approx("v", share, F.lit(max(10_000, 4 * n))).alias("q")).first()["q"] or []) if n > 1 else []
    unit = F.col("x").cast("double") / F.lit(2.0**64) + 0.5
    of_hash = F.least(F.floor(unit * n), F.lit(n - 1)) - n
    if not bounds:
        return rows.withColumn("bucket", F.when(F.col("unnamed"), of_hash).otherwise(F.lit(0)).cast("long"))
    rows = _below(_below(rows, "low_", "v", bounds, True), "high_", "v", bounds, False)
    spread = F.col("high_") - F.col("low_")
    of_id = F.col("low_") + F.least(F.floor(unit * (spread + 1)), spread)
    return rows.withColumn("bucket", F.when(F.col("unnamed"), of_hash).otherwise(of_id).cast("long")).drop("low_", "high_")


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, n_chars) with anchors and fingerprint, and all of these but doc_id of the next row by falling doc_id."""
    rows = rows.withColumn("x", F.xxhash64("text")).withColumn("v", F.coalesce(F.col("doc_id").cast("long"), F.col("x"))).withColumn("unnamed", F.col("doc_id").isNull())
    rows = bucketed(rows)
    linked = _linked(rows.groupBy("bucket").agg(F.max(F.struct("v", "x")).alias("last")))
    both = rows.join(F.broadcast(linked), "bucket")
    own, ghost = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost")), F.struct(F.col("after").alias("at"), F.lit(True).alias("ghost"))
    copies = F.when((F.col("v") == F.col("last.v")) & (F.col("x") == F.col("last.x")), F.array(own, ghost)).otherwise(F.array(own))
    sent = both.withColumn("to", F.explode(copies)).select("doc_id", "text", "n_chars", "v", "x", "to.at", "to.ghost")
    order = (F.desc("ghost"), "v", "x", "text")
    found = anchored(sent.repartition("at").sortWithinPartitions("at", *order))  # sorted while the rows are small
    w = Window.partitionBy("at").orderBy(*order)
    after = (("text", "next_text"), ("n_chars", "next_chars"), ("anchors", "next_anchors"), ("fingerprint", "next_fingerprint"))
    return found.select("doc_id", "text", "n_chars", "anchors", "fingerprint", "ghost", *(F.lag(a).over(w).alias(b) for a, b in after)).where(~F.col("ghost")).drop("ghost")


def _linked(light: DataFrame) -> DataFrame:
    """The bucket after each bucket, the first after the last; at most MOST_BUCKETS rows and as many again for null ids (2 MB)."""
    order = Window.orderBy("bucket")
    return light.select("bucket", "last", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("after"))


def edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next: each text and what it becomes when its last half gives way to the beginning of the next document."""
    rows = with_next(_base(docs, id_col, text))
    half = F.floor(F.col("n_chars") / 2)
    rows = rows.withColumn("cut", F.col("n_chars") - half).withColumn("taken", F.least(half, F.col("next_chars")))
    head, tail = F.expr("substring(text, 1, cast(cut as int))"), F.expr("substring(next_text, 1, cast(taken as int))")
    rows = rows.withColumn("edited_text", F.concat(head, tail))
    seam = F.expr(f"substring(edited_text, cast(greatest(cut - {K - 2}, 1) as int), cast(least(cut, {K - 1}) + least(taken, {K - 1}) as int))")
    rows = rows.withColumn("seam", anchors(seam))
    end = lambda last: F.shiftleft(F.col(last) - (K - 1), 32)
    rows = rows.withColumn("head_end", end("cut")).withColumn("tail_end", end("taken"))
    parts = F.concat(up_to(F.col("anchors"), F.col("head_end")), F.col("seam"), up_to(F.col("next_anchors"), F.col("tail_end")))
    rows = rows.select("doc_id", "n_chars", "edited_text", settle(parts, F.col("edited_text")).alias("e"), F.col("fingerprint").alias("f"), F.col("next_fingerprint").alias("x"))
    return rows.select("doc_id", "n_chars", "edited_text", written(F.col("f")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("x")).alias("near_next"))
