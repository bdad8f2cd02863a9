import hashlib
import io
import random

import duckdb
import pytest
from caslake.functions import chunking, hashing, ignore, paths, text
from caslake.plans import catalog
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


GOLDEN = [
    (".git", "src/.git/config", True), ("*.log", "session.log.backup", False), ("*.log", "a/session.log", True), ("?.tmp", "ab.tmp", False), ("?.tmp", "a.tmp", True), ("tmp", "tmpfoo/bar", False), ("tmp", "a/tmp/b", True),
    ("build/out", "src/build/out", False), ("build/out", "build/out/i.html", True), ("/target", "crates/foo/target", False), ("/target", "target/x", True), ("**/dist", "a/b/c/dist", True), ("src/*/junk", "src/a/b/junk", False),
    ("src/*/junk", "src/a/junk/x", True), ("node_modules/", "packages/x/node_modules/react/index.js", True), (".env", "xenv", False), ("**/a/b", "x/a/b", False), ("**/a/b", "a/b", True), ("a+b(c)", "x/a+b(c)", True), ("a**c", "abbc", True), ("# x", "# x", False), ("  ", "  ", False),
]


def test_ignore_golden_cases(spark):
    for pattern, path, want in GOLDEN:
        assert one(spark, ignore.ignored(F.lit(path), [pattern])) is want, (pattern, path)
        assert ignore.compile_patterns([pattern]).matches(path) is want, (pattern, path)
    assert one(spark, ignore.ignored(F.lit("a"), [])) is False and one(spark, ignore.ignored(F.lit(None).cast("string"), ["a"])) is False
    assert len(ignore.DEFAULT_PATTERNS) == 30


def test_paths(spark):
    for raw, want in (("/private/tmp/x", "/tmp/x"), ("/private/var", "/var"), ("/private/etc/hosts", "/private/etc/hosts"), ("/private/tmpfoo", "/private/tmpfoo"), ("/x", "/x")):
        assert one(spark, paths.normalized(F.lit(raw))) == want
    assert one(spark, paths.shown_below(F.lit("/home/me/pics/cat.jpg"), F.lit("/home/me/pics"))) == "cat.jpg"
    assert one(spark, paths.shown_below(F.lit("/home/me/pics"), F.lit("/home/me/pics"))) == "pics"
    assert one(spark, paths.relative_to(F.lit("/elsewhere"), "/home")) is None
    assert one(spark, paths.ancestors(F.lit("/a/b/c"))) == ["/a/b/c", "/a/b", "/a", "/"]
    assert one(spark, paths.matches_term(F.lit("/A_b\\c"), "a_B\\C")) is True and one(spark, paths.matches_term(F.lit("/É"), "é")) is False
    assert one(spark, paths.under(F.lit("/Tmp/a"), "/tmp", ignore_case=True)) is True and one(spark, paths.under(F.lit("/tmpx/a"), "/tmp")) is False and one(spark, paths.under(F.lit("/x"), "/")) is True


def test_formats(spark):
    for n, want in ((0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1572864, "1.5 MiB"), (None, ""), (2**60, "1024.0 PiB")):
        assert one(spark, text.format_size(F.lit(n).cast("long"))) == want
    for n, want in ((1023, "1023 B"), (1024, "1.0 KB"), (1048576, "1.0 MB"), (1073741824, "1.0 GB"), (1610612736, "1.5 GB")):
        assert one(spark, text.format_bytes(F.lit(n).cast("long"))) == want
    now = 1_800_000_000_000_000
    for s, want in ((4, "just now"), (5, "5s ago"), (60, "1m ago"), (3600, "1h ago"), (86400, "1d ago"), (2592000, "1mo ago"), (-50, "just now"), (31536000, "2026-01-15")):
        assert one(spark, text.relative_time(F.lit(now - s * 1_000_000), now)) == want
    assert one(spark, text.relative_time(F.lit(None).cast("long"), now)) == ""
    assert one(spark, text.parse_patterns(F.lit("node_modules\n.git\n*.custom\n# a comment\n"))) == ["node_modules", ".git", "*.custom"]
    assert [one(spark, text.parse_id(F.lit(x))) for x in ("7", "+7", "-7", "7x", "", "99999999999999999999")] == [7, 7, None, None, None, None]
    assert one(spark, text.pad_left(F.lit("12345678901"))) == "12345678901" and one(spark, text.pad_left(F.lit("5"))) == "         5"
    assert one(spark, text.live_line(F.lit("file_moved"), F.lit(None).cast("string"), F.lit("/a"), F.lit("/b"))) == "↻  /a → /b"


def test_sizes_have_plain_digits_and_round_as_binary_products(spark):
    for n, want in ((2**30 * 12345678, "12345678.0 GB"), (2**63 - 1, "8589934592.0 GB"), (int(2**30 * 1.005), "1.0 GB"), (int(2**30 * 20000000.25), "20000000.25 GB"), (2**30 * 3 // 2, "1.5 GB"), (int(2**30 * 1.08), "1.08 GB"), (1024 * 1024 - 1, "1024.0 KB")):
        assert one(spark, text.format_bytes(F.lit(n).cast("long"))) == want
    for n, want in ((2**50, "1024.0 TiB"), (2**63 - 1, "8388608.0 TiB"), (1024, "1.0 KiB"), (None, "")):
        assert one(spark, text.format_size(F.lit(n).cast("long"), "TiB")) == want


def test_dates_long_ago_and_in_any_time_zone(spark):
    now = 1706745600000000
    for us, want in ((-62135596800000001, "0000-12-31"), (-62167219200000001, "-1-12-31"), (-93000000000000000, "-978-12-13"), (-9223372022400000000, "-290308-12-22"), (-(2**63), "-290308-12-21"), (-1, "1969-12-31"), (0, "1970-01-01")):
        assert one(spark, text.relative_time(F.lit(us).cast("long"), now)) == want
    assert one(spark, text.relative_time(F.lit(2**63 - 1).cast("long"), now)) == "just now"
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert one(spark, text.relative_time(F.lit(0).cast("long"), now)) == "1970-01-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_registered_times_and_sizes_at_keys_beyond_the_small_tables(spark, tmp_path):
    keys = [0, 1, 1200, 8701, 12345, 14000, 14939]
    spark.createDataFrame([(k,) for k in [*keys, 15000, 19999]], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k,) for k in (*range(900, 1100), *range(8_999_000, 9_000_000), *range(149_000, 150_000))], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet' where event_id < 14940")  # the SQL fails on the others
    for name in ("format_bytes_cli", "format_size_ui", "relative_time"):
        got = {r[0]: r[1] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        if name == "relative_time":
            assert got.pop(15000) == got.pop(19999) == ""
        assert got == dict(con.execute(catalog.SQL[name]).fetchall()), name


def test_hashes(spark):
    zero = bytes(32)
    assert one(spark, text.hash_hex(F.lit(zero))) == "0" * 64
    assert one(spark, text.hash_valid(F.lit(zero))) is True and one(spark, text.hash_valid(F.lit(zero[1:]))) is False and one(spark, text.hash_valid(F.lit(None).cast("binary"))) is False
    assert one(spark, text.hash_from_hex(F.lit("AB" * 32))) == b"\xab" * 32 and one(spark, text.hash_from_hex(F.lit("abc"))) is None and one(spark, text.hash_from_hex(F.lit("z" * 64))) is None


def test_blake3_published_vectors():
    v = bytes(i % 251 for i in range(31744))
    want = {0: "af1349b9f5f9a1a6", 1: "2d3adedff11b61f1", 1023: "10108970eeda3eb9", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3", 3073: "7124b49501012f81", 31744: "62b6960e1a44bcc1"}
    assert [h.hex()[:16] for h in hashing.blake3_many([v[:n] for n in want])] == list(want.values())


def test_sampled_hash(spark, tmp_path):
    r = random.Random(1)
    big = r.randbytes(57_344 + 20_000)
    flipped = big[:100] + bytes([big[100] ^ 1]) + big[101:]
    for data in (b"", r.randbytes(1024), big, flipped, big + b"x" * 1000):
        (tmp_path / "f").write_bytes(data)
        for scheme, hasher in (("blake3", hashing.blake3), ("sha256", lambda b: hashlib.sha256(b).digest())):
            assert one(spark, hashing.sampled(F.lit(data), scheme)) == hashing.sampled_file(str(tmp_path / "f"), hasher)
    small = r.randbytes(1024)
    (tmp_path / "f").write_bytes(small)
    assert hashing.sampled_file(str(tmp_path / "f")) == hashing.blake3(small)
    assert one(spark, hashing.sampled(F.lit(big))) != one(spark, hashing.sampled(F.lit(flipped)))


def test_root_hash_is_ordered(spark):
    a, b = F.lit(b"a" * 32), F.lit(b"b" * 32)
    x, y = one(spark, hashing.root_hash(F.array(a, b))), one(spark, hashing.root_hash(F.array(b, a)))
    assert x != y and x == hashlib.sha256(b"a" * 32 + b"b" * 32).digest()
    assert one(spark, hashing.root_hash(F.array().cast("array<binary>"), "blake3")) == hashing.blake3(b"")


@pytest.mark.parametrize("n", [0, 5, 8192, 150_000, 700_000])
def test_chunking_invariants(n):
    data = random.Random(n).randbytes(n)
    cuts = chunking.boundaries(data)
    assert sum(s for _, s in cuts) == n and [o for o, _ in cuts] == [sum(s for _, s in cuts[:k]) for k in range(len(cuts))]
    assert all(s <= chunking.MOST for _, s in cuts) and all(s >= chunking.LEAST for _, s in cuts[:-1])
    f = io.BytesIO(data)
    assert list(chunking.stream(f.read)) == [(o, data[o : o + s]) for o, s in cuts]


def test_an_edit_changes_few_chunks_and_streams_agree():
    data = random.Random(3).randbytes(3_000_000)
    edited = data[:1_000_000] + b"!" + data[1_000_000:]
    a, b = ({data_[o : o + s] for o, s in chunking.boundaries(data_)} for data_ in (data, edited))
    assert len(a) > 20 and len(a - b) <= 3
    f = io.BytesIO(edited)
    assert [(o, len(x)) for o, x in chunking.stream(f.read)] == chunking.boundaries(edited)
    f = io.BytesIO(b"z" * 700_000)
    assert [(o, len(x)) for o, x in chunking.stream(f.read)] == chunking.boundaries(b"z" * 700_000)
