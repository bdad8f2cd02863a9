import os
import time

import pytest
from caslake import cli
from caslake.functions.hashing import blake3
from caslake.operators import reads
from caslake.operators.locations import Manager, NotFound, watched_change
from caslake.sources import cas, walk
from caslake.sources.log import EventLog
from pyspark.sql import functions as F


@pytest.fixture
def tree(tmp_path, spark):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    root = tmp_path / "tree"
    for p in ("top.txt", "a/mid.txt", "a/b/deep.txt", "a/b/c/deepest.txt", "node_modules/react/index.js", ".git/HEAD", "target/release/binary", "tmp/session.log", ".env"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(p * 10)
    return root


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


def test_walk(spark, tree):
    every = walk.scan(spark, str(tree))
    assert len(names(every, tree)) == 9 and ".env" in names(every, tree)
    row = {r.path: r for r in every.collect()}[str(tree / "top.txt")]
    assert row.size == 70 and row.mtime_us == int(os.stat(tree / "top.txt").st_mtime) * 1_000_000
    for parts in (1, 3, 64):
        kept = walk.scan(spark, str(tree), ["node_modules", ".git", "/a/b", "*.log"], partitions=parts)
        assert names(kept, tree) == [".env", "a/mid.txt", "target/release/binary", "top.txt"]
    assert names(walk.scan(spark, str(tree / "top.txt")), tree) == ["top.txt"] and walk.scan(spark, str(tree / "none")).collect() == []
    assert names(walk.scan(spark, str(tree), internal=[str(tree / "a")]), tree)[0] == ".env" and len(names(walk.scan(spark, str(tree), internal=[str(tree / "a")]), tree)) == 6
    (tree / "a" / "loop").symlink_to(tree)
    assert len(names(walk.scan(spark, str(tree)), tree)) < 60


def test_manager_lifecycle(spark, tmp_path, tree):
    log = EventLog(spark, str(tmp_path / "data" / "log"))
    m = Manager(spark, log, str(tmp_path / "data"))
    loc = m.add(str(tree))
    assert loc["last_scanned_at_us"] >= loc["scan_started_at_us"] and len(loc["ignore_patterns"]) == 30
    assert names(reads.live(m.files()), tree) == [".env", "a/b/c/deepest.txt", "a/b/deep.txt", "a/mid.txt", "top.txt"] or "tmp/session.log" not in names(m.files(), tree)
    head = log.head()
    r = m.rescan(str(tree))
    assert (r["new"], r["modified"], r["unchanged"], r["errors"]) == (0, 0, 5, 0) and log.head() == head + 2
    (tree / "top.txt").write_text("changed now")
    (tree / "new.txt").write_text("new")
    r = m.rescan(str(tree))
    assert (r["new"], r["modified"], r["unchanged"]) == (1, 1, 4)
    (tree / "new.txt").unlink()
    assert m.rescan(str(tree))["unchanged"] == 5 and m.forget_missing(str(tree)) == 1
    assert "new.txt" not in names(reads.live(m.files()), tree)
    m.set_ignore(str(tree), [" x ", "", "x", "# kept"])
    m.set_mode(str(tree), "content")
    assert (m.active(str(tree))["ignore_patterns"], m.active(str(tree))["index_mode"]) == (["x", "# kept"], "content")
    m.remove(str(tree))
    with pytest.raises(NotFound):
        m.set_mode(str(tree), "shallow")
    with pytest.raises(ValueError):
        m.add(str(tmp_path / "data" / "inside"))
    with pytest.raises(ValueError):
        m.add(str(tmp_path))
    with pytest.raises(ValueError):
        m.add(str(tree), mode="deep")
    assert reads.live(m.files()).count() == 5


def test_content_mode_chunks_and_counts(spark, tmp_path, tree):
    from caslake.operators import fold

    log = EventLog(spark, str(tmp_path / "data" / "log"))
    m = Manager(spark, log, str(tmp_path / "data"))
    m.index(str(tree / "a"), mode="content")
    states = fold.file_states(log.read())
    assert fold.file_chunks(states).count() == 3
    (tree / "a" / "mid.txt").write_text("other")
    m.index(str(tree / "a"), mode="content")
    counted = cas.reference_counts(fold.chunks_ever(log.read()), fold.file_chunks(fold.file_states(log.read())))
    assert sorted(r.ref_count for r in counted.collect()) == [0, 1, 1, 1]
    # each chunk is stored, once, under its hash; what is known is not stored again
    stored = m.store.read().collect()
    assert sorted(bytes(r.hash) for r in stored) == sorted(blake3(bytes(r.bytes)) for r in stored) and len(stored) == 4
    m.index(str(tree / "a"), mode="content")
    assert m.store.read().count() == 4
    assert m.collect_garbage(dry_run=True) == {"scanned": 1, "removed": 0, "bytes_reclaimed": 90}
    assert m.collect_garbage()["removed"] == 1 and m.store.read().count() == 3
    assert m.collect_garbage() == {"scanned": 0, "removed": 0, "bytes_reclaimed": 0}
    live = fold.file_chunks(fold.file_states(log.read())).select(F.col("chunk_hash").alias("hash"))
    assert all(r.bytes is not None for r in m.store.get(live).collect())


def test_watched_changes(spark, tree):
    known = spark.createDataFrame([(1, "/a", 1, 1, b"", None, 1)], "id long, path string, size long, mtime_us long, root_hash binary, deleted_at_us long, indexed_at_us long")
    rows = spark.createDataFrame([("/a", 1, 1), ("/b", 2, 2), ("/c", None, None)], walk.SCHEMA)
    assert sorted((r.kind, r.path) for r in watched_change(rows, known).collect()) == [("file_deleted", "/c"), ("file_indexed", "/b")]
    rows = spark.createDataFrame([("/a", 2, 1)], walk.SCHEMA)
    assert [(r.kind, r.path) for r in watched_change(rows, known).collect()] == [("file_modified", "/a")]


def test_stream_of_changes(spark, tmp_path, tree):
    spark.dataSource.register(walk.TreeSource)
    seen = []
    q = spark.readStream.format("caslake_tree").option("path", str(tree)).option("ignore", '[".git"]').load().writeStream.foreachBatch(lambda df, _: seen.append([(os.path.relpath(r.path, tree), r.size) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (tree / "late.txt").write_text("late")
        (tree / "top.txt").unlink()
        deadline = time.time() + 30
        while time.time() < deadline and not {("late.txt", 4), ("top.txt", None)} <= {x for b in seen for x in b}:
            time.sleep(0.2)
    finally:
        q.stop()
    flat = [x for b in seen for x in b]
    assert ("late.txt", 4) in flat and ("top.txt", None) in flat and ("top.txt", 70) in flat and not any(".git" in p for p, _ in flat)


def test_command_line(spark, tmp_path, tree, capsys):
    run = lambda *a: cli.main(["--data", str(tmp_path / "d"), *a], spark)
    assert run("watch", "--once", str(tree)) == 0 and run("locations") == 0 and run("ls") == 0 and run("find", "MID") == 0 and run("gc", "--dry-run") == 0 and run("rebuild-projection") == 0
    out = capsys.readouterr().out
    assert str(tree) in out and f"        70  {tree}/top.txt" in out and out.count("mid.txt") == 2 and "(dry run)" in out
    assert run("unwatch", str(tree)) == 0 and run("unwatch", str(tree)) == 1 and run("index", str(tree / "a")) == 0
    with pytest.raises(SystemExit):
        run("fly")


def test_watchers_log_changes(spark, tmp_path, tree):
    from caslake.streaming.watch import Watchers

    log = EventLog(spark, str(tmp_path / "data" / "log"))
    m = Manager(spark, log, str(tmp_path / "data"))
    m.add(str(tree))
    head = log.head()
    w = Watchers(m, str(tmp_path / "watch"), interval="0 seconds")
    try:
        assert w.boot() == [str(tree)] == w.boot()
        assert [r.watching for r in w.watched(m.locations()).collect()] == [True]
        q = w.start(str(tree))
        q.processAllAvailable()
        assert log.head() == head
        (tree / "fresh.txt").write_text("fresh")
        (tree / "a" / "mid.txt").unlink()
        (tree / "tmp" / "more.log").write_text("ignored")
        deadline = time.time() + 60
        while time.time() < deadline and log.head() < head + 2:
            time.sleep(0.5)
        rows = {(r.kind, os.path.relpath(r.path, tree)) for r in log.read().where(f"seq > {head}").collect()}
        assert rows == {("file_indexed", "fresh.txt"), ("file_deleted", "a/mid.txt")}
        run = w.start(str(tree)).runId
        m.set_ignore(str(tree), ["*.log"])
        assert w.watching() == [str(tree)] and w.start(str(tree)).runId != run
        m.remove(str(tree))
        assert w.watching() == []
        m.add(str(tree))
        assert w.watching() == [str(tree)]
    finally:
        w.close()
