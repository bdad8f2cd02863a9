import os
from pathlib import Path

import duckdb
import pytest
from caslake.llm import license_texts as T
from caslake.llm import licenses as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_texts_and_notices(spark):
    mit = T.TEXTS["MIT"]
    odd = "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", "").replace(" ", "\n   ")
    rows = [(1, mit), (2, odd), (3, mit + " and more"), (4, "Licensed under the Apache License, Version 2.0.\nwords\nThis work is licenced under CC BY-NC 4.0"), (5, None), (6, ""), (None, T.TEXTS["ISC"]), (7, T.TEXTS["BSD-3-Clause"]), (7, T.TEXTS["BSD-3-Clause"]), (8, "x " * 60000 + "\nLicensed under MIT")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    for x in ("digest", "license", "line", "t", "n_notices"):
        df = df.withColumn(x, df.n_chars)
    got = sorted(((r.doc_id or 0), r.license, r.n_notices, r.notices) for r in L.scan(df).collect())
    assert got == [(0, "ISC", 0, ""), (1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, None, 0, ""), (4, None, 2, "Apache-2.0,CC-BY-NC-4.0"), (5, None, 0, ""), (6, None, 0, ""), (7, "BSD-3-Clause", 0, ""), (7, "BSD-3-Clause", 0, ""), (8, None, 1, "MIT")]


def test_join_beyond_the_broadcast_bound_and_empty_table(spark, monkeypatch):
    df = spark.createDataFrame([(k, T.TEXTS["MIT"] if k % 2 else "no", "en", "s", 1) for k in range(20)], SCHEMA)
    want = sorted(tuple(map(str, r)) for r in L.scan(df).collect())
    monkeypatch.setattr(L, "MOST_KNOWN", 0)
    assert sorted(tuple(map(str, r)) for r in L.scan(df).collect()) == want
    assert L.scan(df.limit(0)).collect() == []


def test_driver_and_sql_forms_agree(spark):
    texts = [*T.TEXTS.values(), "Ünïcode — «quotes» licences, sub-license; HTTP://x.org", "(c) 2001 Me\n© you\ncopyright notice stays\n copyright 2020 goes"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(L.canonical(df.t).alias("c")).collect()] == [L.canonical_py(t) for t in texts]


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = con.execute(L.sql())
    names = [c[0] for c in rows.description]
    want = sorted(tuple(map(str, r)) for r in rows.fetchall())
    df = L.scan(spark.read.parquet(f"{sf}/documents.parquet")).select(names)
    assert sorted(tuple(map(str, r)) for r in df.collect()) == want


def test_rows_without_or_with_one_id_keep_their_own_notices(spark):
    rows = [(None, "Licensed under MIT\nwords"), (None, "no notice"), (3, "SPDX-License-Identifier: GPL-2.0-or-later"), (3, "another text"), (None, "Licensed under MIT\nwords")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_notices, r.notices) for r in L.scan(df).collect())
    assert got == [(0, 0, ""), (0, 1, "MIT"), (0, 1, "MIT"), (3, 0, ""), (3, 1, "GPL-2.0")]


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-2"), reason="needs the system's licence texts")
def test_full_texts_of_long_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(k, Path("/usr/share/common-licenses", f).read_text()) for k, f in enumerate(names.values())]
    texts += [(9, texts[0][1] + " with a change"), (10, texts[1][1].upper().replace("\n", "\r\n  "))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.license for r in L.scan(df).collect()} == {**dict(enumerate(names)), 9: None, 10: "GPL-2.0"}
