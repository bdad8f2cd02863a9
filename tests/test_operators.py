import random

import pytest
from caslake.operators import detect, reads, routing
from caslake.plans import views
from caslake.schemas import FILE_CHUNKS, FILES, LOCATIONS, SCAN
from caslake.sources import cas
from caslake.sources.log import EventLog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def files(spark, rows):
    return spark.createDataFrame([(i, p, s, m, b"h" * 32, d, x) for i, p, s, m, d, x in rows], FILES)


def locations(spark, paths):
    return spark.createDataFrame([(k + 1, p, 0, None, None, None, [], "shallow") for k, p in enumerate(paths)], LOCATIONS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sort", ["path", "size", "mtime_us", "indexed_at_us"])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_put_together_are_the_sorted_list(spark, sort, order):
    r = random.Random(1)
    df = files(spark, [(k, f"/l/{r.randint(0, 9)}/{k}", r.randint(0, 3), r.randint(0, 2), 5 if k % 6 == 0 else None, r.randint(0, 2)) for k in range(40)]).cache()
    want = sorted((x for x in df.collect() if x.deleted_at_us is None), key=lambda x: (x[sort], x.id), reverse=order == "desc")
    got, cursor = [], None
    while True:
        rows, cursor = reads.page(df, "/l", sort, order, 7, cursor)
        got += rows
        if cursor is None:
            break
    assert [x.id for x in got] == [x.id for x in want]


def test_page_limits_and_unknown_locations(spark):
    df = files(spark, [(1, "/l/a", 1, 1, None, 1), (2, "/l/b", 1, 1, None, 1)])
    assert reads.page(df, None) == ([], None) and reads.page(df, "/x") == ([], None)
    rows, cursor = reads.page(df, "/l", limit=2)
    assert len(rows) == 2 and cursor is None
    assert reads.page(df, "/l", limit=1)[1] == ("/l/a", 1)
    for bad in ({"limit": 0}, {"sort_by": "id"}, {"order": "up"}):
        with pytest.raises(ValueError):
            reads.list_files(df, "/l", **bad)


def test_page_plan_is_a_pushed_top_n(spark, tmp_path):
    views.files(spark, SF).write.parquet(str(tmp_path / "files"))
    p = plan(reads.list_files(spark.read.parquet(str(tmp_path / "files")), "/src1", "size", "desc", 10, (500, 3)))
    assert "TakeOrderedAndProject" in p and "StringStartsWith(path,/src1/)" in p and "LessThan(size,500)" in p and "IsNull(deleted_at_us)" in p


def test_stats_and_counts(spark):
    df = files(spark, [(1, "/a/x", 100, 1, None, 1), (2, "/a/b/y", 200, 1, None, 1), (3, "/a/z", 7, 1, 9, 1), (4, "/ab/w", 1, 1, None, 1), (5, "/a", 3, 1, None, 1)])
    assert tuple(reads.location_stats(df, "/a").first()) == (3, 303) and tuple(reads.location_stats(df, "/none").first()) == (0, 0) and tuple(reads.location_stats(df, "/").first()) == (4, 304)
    got = {r.location: (r.file_count, r.bytes) for r in reads.all_location_stats(df, locations(spark, ["/a", "/a/b", "/ab", "/q", "/"])).collect()}
    assert got == {"/a": (3, 303), "/a/b": (1, 200), "/ab": (1, 1), "/q": (0, 0), "/": (4, 304)}
    chunks = spark.createDataFrame([(1, 0, 0, 5, b"a"), (1, 1, 5, 5, b"a")], FILE_CHUNKS)
    assert {r.id: r.chunk_count for r in reads.chunk_counts(df, chunks).collect()}[1] == 2
    assert [r.chunk_count for r in reads.get_file(df, chunks, 3).collect()] == [0] and reads.get_file(df, chunks, 99).collect() == []


def test_longest_prefix(spark):
    locs = locations(spark, ["/a", "/a/b", "/a/b/c"])
    paths = spark.createDataFrame([(p,) for p in ("/a/b/c/file.txt", "/a/b/file.txt", "/a/file.txt", "/abc/foo.txt", "/a/b")], "path string")
    got = {r.path: r.location_id for r in routing.resolve(paths, locs).collect()}
    assert got == {"/a/b/c/file.txt": 3, "/a/b/file.txt": 2, "/a/file.txt": 1, "/abc/foo.txt": None, "/a/b": 2}
    assert {r.location_id for r in routing.resolve(paths, locations(spark, ["/"])).collect()} == {1}
    p = plan(routing.resolve(paths, locs))
    assert "BroadcastHashJoin" in p and "NestedLoop" not in p


def test_longest_prefix_against_the_definition(spark, monkeypatch):
    r = random.Random(3)
    made = lambda: "/" + "/".join(r.choice(["a", "b", "ab"]) for _ in range(r.randint(1, 4)))
    locs, paths = sorted({made() for _ in range(12)}), sorted({made() for _ in range(150)})
    want = {}
    for p in paths:
        hold = [x for x in locs if p == x or p.startswith(x + "/")]
        want[p] = locs.index(max(hold, key=len)) + 1 if hold else None
    df, where = spark.createDataFrame([(p,) for p in paths], "path string"), locations(spark, locs)
    assert {x.path: x.location_id for x in routing.resolve(df, where).collect()} == want
    monkeypatch.setattr(routing, "MOST_BROADCAST", 0)
    assert {x.path: x.location_id for x in routing.resolve(df, where).collect()} == want


def test_classification_and_tally(spark):
    known = files(spark, [(1, "/a", 1, 1, None, 1), (2, "/b", 1, 1, None, 1), (3, "/gone", 1, 1, 5, 1)])
    scan = spark.createDataFrame([("/a", 1, 1), ("/b", 2, 1), ("/c", 4, 1), ("/gone", 1, 1)], SCAN)
    found = detect.classify(scan, known)
    assert {r.path: r.outcome for r in found.collect()} == {"/a": "unchanged", "/b": "modified", "/c": "new", "/gone": "unchanged"}
    assert tuple(detect.tally(found).first()) == (1, 1, 2, 0, 8)
    assert {r.path: r.outcome for r in detect.classify(scan, known, revive_tombstones=True).collect()}["/gone"] == "modified"


def test_hashing_comes_after_the_filter(spark):
    known = files(spark, [(1, "/a", 1, 1, None, 1)])
    scan = spark.createDataFrame([("/a", 1, 1, b"x"), ("/b", 2, 1, b"y")], SCAN + ", content binary")
    for mode, n in (("shallow", 0), ("content", 1)):
        rows = detect.hashed(detect.changed(detect.classify(scan, known)), F.col("content"), mode)
        p = plan(rows)
        assert p.index("ArrowEvalPython") < p.index("Filter")
        row = rows.first()
        assert (row.path, len(row.root_hash), len(row.chunks)) == ("/b", 32, n)


def test_log(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    assert log.head() == 0 and log.read().count() == 0
    assert log.append_rows([{"kind": "location_added", "at": 9, "v": 1, "path": "/a"}, {"kind": "location_removed", "at": 3, "v": 1, "path": "/a"}]) == 2
    big = spark.range(1000).select(F.lit("file_deleted").alias("kind"), F.col("id").alias("at"), F.lit(1).alias("v"), F.format_string("/f%d", "id").alias("path"))
    assert log.append(big) == 1002
    rows = log.read().orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 1003)) and [r["at"] for r in rows[2:]] == list(range(1000))
    with pytest.raises(ValueError):
        log.append_rows([{"kind": "file_eaten", "at": 1, "v": 1, "path": "/a"}])
    with log.writer(), pytest.raises(RuntimeError):
        log.append_rows([{"kind": "file_deleted", "at": 1, "v": 1, "path": "/a"}])


def test_the_lock_of_a_log_in_another_store(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./data", f"file://{tmp_path}")
    log = EventLog(spark, "viewfs://logs/data/log")
    assert log.append_rows([{"kind": "file_deleted", "at": 1, "v": 1, "path": "/a"}]) == 1
    with log.writer(), pytest.raises(RuntimeError, match="another writer"):
        log.append_rows([{"kind": "file_deleted", "at": 2, "v": 1, "path": "/a"}])
    assert not (tmp_path / "log.lock").exists()
    assert log.append_rows([{"kind": "file_deleted", "at": 3, "v": 1, "path": "/a"}]) == 2


def test_store_and_sweep(spark, tmp_path):
    import hashlib

    store = cas.ChunkStore(spark, str(tmp_path / "store"))
    bodies = [b"one", b"two", b"three", b"one"]
    chunks = spark.createDataFrame([(hashlib.sha256(b).digest(), b) for b in bodies], "hash binary, bytes binary")
    store.put(chunks)
    store.put(chunks)
    assert store.read().count() == 3
    miss = spark.createDataFrame([(hashlib.sha256(b"two").digest(),), (b"z" * 32,)], "hash binary")
    assert sorted((r.bytes and bytes(r.bytes)) or b"" for r in store.get(miss).collect()) == [b"", b"two"]
    counted = spark.createDataFrame([(hashlib.sha256(b).digest(), len(b), n) for b, n in ((b"one", 2), (b"two", 0), (b"three", 0))], "hash binary, length long, ref_count long")
    assert store.sweep(counted, dry_run=True) == {"scanned": 2, "removed": 0, "bytes_reclaimed": 8} and store.read().count() == 3
    assert store.sweep(counted) == {"scanned": 2, "removed": 2, "bytes_reclaimed": 8}
    assert [bytes(r.bytes) for r in store.read().collect()] == [b"one"]
