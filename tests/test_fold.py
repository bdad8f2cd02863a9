import random

import pytest
from caslake.operators import fold, routing
from caslake.schemas import LOG
from caslake.sources import cas
from caslake.sources.log import EventLog, _fields
from caslake.streaming import live
from reference_model import Model, random_log


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))


def frame(spark, events):
    names = [x.split()[0] for x in _fields(LOG)]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in events], LOG)


def as_dicts(df, key="path"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def same(spark, log, model):
    states = fold.file_states(log).cache()
    assert as_dicts(states) == {p: f for p, f in model.files.items()}
    assert as_dicts(fold.locations(log)) == model.locations
    counted = cas.reference_counts(fold.chunks_ever(log), fold.file_chunks(states))
    assert {bytes(r.hash): (r.length, r.ref_count) for r in counted.collect()} == {h: (model.lengths[h], n) for h, n in model.references().items()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_and_feed_without_moves(spark, seed):
    events, model = random_log(random.Random(seed), 250, moves=False)
    log = frame(spark, events)
    same(spark, log, model)
    assert sent(routing.file_feed(log)) == sorted(model.feed, key=str)


def sent(feed):
    return sorted(((r.topic, r.kind, r.path, r.file_id, r.location_id, r.seq) for r in feed.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_fold_and_feed_with_moves(spark, seed):
    events, model = random_log(random.Random(100 + seed), 200, moves=True)
    log = frame(spark, events)
    same(spark, log, model)
    assert sent(routing.move_feed(log)) == sorted((x for x in model.feed if x[1].startswith("moved")), key=str)
    assert sent(routing.file_feed(log)) == sorted((x for x in model.feed if not x[1].startswith("moved")), key=str)


def test_ids_follow_moves(spark):
    moved = lambda seq, a, b: {"seq": seq, "kind": "file_moved", "at": seq, "v": 1, "from_path": a, "to_path": b}
    log = frame(spark, [{"seq": 1, "kind": "location_added", "at": 1, "v": 1, "path": "/l"}, content(2, "/l/a"), moved(3, "/l/a", "/l/b"), content(4, "/l/b") | {"kind": "file_modified"}, moved(5, "/l/b", "/l/c"), {"seq": 6, "kind": "file_deleted", "at": 6, "v": 1, "path": "/l/c"}])
    assert [x[3] for x in sent(routing.file_feed(log))] == [2, 2, 2] and [x[3] for x in sent(routing.move_feed(log))] == [2, 2]


def content(seq, path):
    return {"seq": seq, "kind": "file_indexed", "at": seq, "v": 1, "path": path, "size": 1, "mtime_us": 1, "root_hash": b"r" * 32, "chunks": []}


def test_golden_moves_and_conflict(spark):
    moved = lambda seq, a, b: {"seq": seq, "kind": "file_moved", "at": seq, "v": 1, "from_path": a, "to_path": b}
    log = frame(spark, [content(1, "/a"), moved(2, "/a", "/b"), content(3, "/a")])
    assert {p: f["id"] for p, f in as_dicts(fold.file_states(log)).items()} == {"/b": 1, "/a": 3}
    clash = frame(spark, [content(1, "/a"), content(2, "/b"), moved(3, "/a", "/b")])
    with pytest.raises(Exception, match="event 3 moves /a onto /b"):
        fold.file_states(clash).collect()
    assert set(as_dicts(fold.file_states(clash, on_conflict="skip"))) == {"/a", "/b"}


def test_readding_a_location_resets_it_unless_asked_not_to(spark):
    e = lambda seq, kind, **k: {"seq": seq, "kind": kind, "at": seq, "v": 1, "path": "/a", **k}
    log = frame(spark, [e(1, "location_added"), e(2, "location_ignore_set", patterns=["x"]), e(3, "location_mode_set", mode="content"), e(4, "location_added")])
    row = fold.locations(log).first()
    assert (row.id, row.ignore_patterns, row.index_mode) == (1, [], "shallow")
    kept = fold.locations(log, preserve=True).first()
    assert (kept.ignore_patterns, kept.index_mode) == (["x"], "content")


@pytest.mark.parametrize("moves", [False, True])
def test_incremental_batches_equal_a_rebuild(spark, tmp_path, moves):
    events, model = random_log(random.Random(7), 90, moves)
    log = EventLog(spark, str(tmp_path / "log"))
    snaps = live.Snapshots(spark, str(tmp_path / "snaps"))
    for a, b in ((0, 30), (30, 31), (31, 90)):
        log.append_rows([{k: v for k, v in e.items() if k != "seq"} for e in events[a:b]])
        assert live.catch_up(log, snaps) == b
    got = as_dicts(snaps.read("files").drop("last_seq"))
    assert got == model.files and as_dicts(snaps.read("locations")) == model.locations
    again = live.Snapshots(spark, str(tmp_path / "again"))
    assert live.rebuild(log, again) == 90 and as_dicts(again.read("files").drop("last_seq")) == got
    assert live.catch_up(log, snaps) == 90
    assert len([p for p in (tmp_path / "snaps").iterdir() if p.name.startswith("v=")]) == 2


def test_stream_keeps_snapshots_up_to_the_log(spark, tmp_path):
    events, model = random_log(random.Random(8), 40, moves=False)
    log = EventLog(spark, str(tmp_path / "log"))
    snaps = live.Snapshots(spark, str(tmp_path / "snaps"))
    seen = []
    for part in (events[:15], events[15:]):
        log.append_rows([{k: v for k, v in e.items() if k != "seq"} for e in part])
        live.start(log, snaps, str(tmp_path / "cp"), on_change=lambda b: seen.extend(r.seq for r in b.select("seq").collect()), once=True).awaitTermination()
    assert snaps.last() == 40 and sorted(seen) == list(range(1, 41))
    assert as_dicts(snaps.read("files").drop("last_seq")) == model.files


def test_a_gap_is_refused(spark, tmp_path):
    snaps = live.Snapshots(spark, str(tmp_path / "snaps"))
    log = frame(spark, [content(2, "/a")])
    with pytest.raises(live.GapError):
        live.apply_batch(snaps, log, log)


def test_model_itself():
    m = Model()
    for seq, kind in ((1, "file_deleted"), (2, "file_indexed"), (3, "file_deleted"), (4, "file_deleted")):
        m.apply({"seq": seq, "kind": kind, "at": seq * 10, "path": "/x", "size": 1, "mtime_us": 1, "root_hash": b"", "chunks": []})
    assert m.files["/x"]["deleted_at_us"] == 40 and m.files["/x"]["id"] == 2
