r"""License scans by canonical digests.

A text is brought into a canonical form: lower case, without copyright lines and lines of rights reserved, every run
of characters that are neither letters nor digits as one space, and equivalent spellings alike. The SHA-256 of the
form is joined by hash with the digests of known licences in the same form. What is looked up is each whole document,
and each of its lines that has a word which all known notices hold ("license" in some spelling), as a text of its own.

All of it are SQL functions. The table of digests has a row per known text and is broadcast while it has at most
`MOST_KNOWN` rows; beyond, the distinct digests of the documents are joined with it first.

Notices belong to texts: their lines are looked up once for each distinct text that has any, by its digest, and joined
back over `SALTS` salts, so that copies of one text meet in no single task.

Defined cases: null texts count as empty, whose form is empty and matches nothing; ids may be null or repeated, since
nothing is joined by id; each row gives one row with what its own text says. Very long texts are read whole. Two known
texts never share a digest: the first in the order of the registry names it. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_texts import DIGESTS, NAMES, OPENINGS, SPELLINGS, SUFFIXED, SUFFIXES, TEXTS, TITLES

MOST_KNOWN = 100_000
SALTS = 16
#: Fixed patterns, which Java, RE2 and Python read alike.
COPYRIGHT = r"(?m)^[ \t#/*;-]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]{4}|by |<|\[)[^\n]*$"
RIGHTS = r"(?m)^[ \t#/*;-]*all rights reserved[. ]*$"
OTHER = r"[^\p{L}\p{N}]+"
NOTICE = r"(?i)licen[sc]e|released under|distributed under"


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), RIGHTS, " ")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, OTHER, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def canonical_py(text: str) -> str:
    """The same form on the driver, for the known texts."""
    t = re.sub(RIGHTS, " ", re.sub(COPYRIGHT, " ", text.lower()))
    t = f" {' '.join(re.findall(r'[^\W_]+', t))} "
    for a, b in SPELLINGS:
        t = t.replace(f" {a} ", f" {b} ")
    return t.strip()


def known() -> list[tuple[str, str]]:
    """(digest, license) of the known texts: whole licences, with and without a title line, and notices."""
    out: dict[str, str] = {}
    put = lambda name, text: out.setdefault(hashlib.sha256(canonical_py(text).encode()).hexdigest(), name)
    for name, text in TEXTS.items():
        for title in ["", *TITLES[name]]:
            put(name, f"{title}\n\n{text}")
    for name, names in NAMES.items():
        for opening in OPENINGS:
            for x in names:
                for article in ("", "the ", "a "):
                    for suffix in SUFFIXES if name in SUFFIXED else [""]:
                        put(name, f"{opening} {article}{x}{suffix}")
    for name, digests in DIGESTS.items():
        for digest in digests:
            out.setdefault(digest, name)
    return sorted(out.items())


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known(), "digest string, license string")


def _look_up(units: DataFrame, table: DataFrame, digest: str) -> DataFrame:
    """units with the column license, null where the digest isn't known."""
    table = table.select(F.col("digest").alias("known_digest"), "license").dropDuplicates(["known_digest"])
    if table.count() <= MOST_KNOWN:
        return units.join(F.broadcast(table), F.col(digest) == F.col("known_digest"), "left").drop("known_digest")
    found = units.select(F.col(digest).alias("known_digest")).distinct().join(table, "known_digest")
    return units.join(found, F.col(digest) == F.col("known_digest"), "left").drop("known_digest")


def scan(docs: DataFrame, table: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license (of the whole text, or null), n_notices, notices (the licences of the notice lines, sorted and comma-joined, or '')."""
    table = registry(docs.sparkSession) if table is None else table
    own = F.md5(F.col("t"))
    lines = F.transform(F.filter(F.split("t", "\n"), lambda x: x.rlike(NOTICE)), lambda x: F.sha2(canonical(x), 256))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("t"))
    whole = rows.select("doc_id", F.when(F.col("t").rlike(NOTICE), own).alias("own"), F.sha2(canonical(F.col("t")), 256).alias("digest"))
    whole = _look_up(whole, table, "digest").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    texts = rows.where(F.col("t").rlike(NOTICE)).select(own.alias("known_own"), lines.alias("lines")).groupBy("known_own").agg(F.first("lines").alias("lines"))
    named = _look_up(texts.select("known_own", F.explode("lines").alias("line_digest")), table, "line_digest").where(F.col("license").isNotNull())
    notices = named.groupBy("known_own").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    salted = notices.withColumn("known_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = whole.join(salted, (F.col("own") == F.col("known_own")) & (F.col("salt") == F.col("known_salt")), "left")
    return joined.select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def sql() -> str:
    def form(t: str) -> str:
        quote = lambda x: "'" + x.replace("'", "''") + "'"
        t = f"regexp_replace(regexp_replace(lower({t}), {quote(COPYRIGHT)}, ' ', 'g'), {quote(RIGHTS)}, ' ', 'g')"
        t = f"' ' || trim(regexp_replace({t}, {quote(OTHER)}, ' ', 'g')) || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, {quote(f' {a} ')}, {quote(f' {b} ')})"
        return f"trim({t})"

    rows = ", ".join(f"('{d}', '{n}')" for d, n in known())
    return f"""
        WITH known(digest, license) AS (VALUES {rows}),
        whole AS (SELECT doc_id, coalesce(text, '') AS text, sha256({form("coalesce(text, '')")}) AS digest FROM documents),
        lines AS (SELECT text, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT text FROM documents)),
        named AS (SELECT l.text, k.license FROM (SELECT text, sha256({form("line")}) AS digest FROM lines WHERE regexp_matches(line, '{NOTICE}')) l JOIN known k USING (digest)),
        notices AS (SELECT text, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM named GROUP BY text)
        SELECT w.doc_id, w.digest, k.license, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
        FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN notices n ON n.text = w.text"""
