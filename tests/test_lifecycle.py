"""Stores that several writers share, restarts, streams, journals, spools and dictionaries."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.geometry import Box, morton_int
from palimpsest.operators import dictionary, fold, gaps, reports
from palimpsest.operators.rollback import Rollbacks
from palimpsest.plans.scan_plan import ScanPlan
from palimpsest.schema import MUTATION, StoreError
from palimpsest.sources import density, journal, store as stores
from palimpsest.sources.spool import FULL, TAKEN, TOO_LONG, Spool, to_journal
from palimpsest.sources.store import Store
from palimpsest.streaming import ingest
from palimpsest.streaming.maintenance import Budget, Config, Schedule

T0 = 1_800_000_000_000


def line(spark, n, t0=T0, actor=7):
    rows = [(1, morton_int(i >> 4, (3 * i) >> 4), t0 + i, i, i, 64, 3 * i, 10 + i, 0, actor, 1, 1) for i in range(n)]
    return spark.createDataFrame(rows, MUTATION)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exclusion_broadcasts_the_history(spark, tmp_path):
    rows = line(spark, 400)
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(rows, 0)
    s.seal()
    few = spark.createDataFrame([(7, T0, T0 + 3), (None, T0 + 10, T0 + 12), (None, T0 + 11, T0 + 20)], "actor int, from_ts bigint, to_ts bigint")
    many = spark.createDataFrame([(a, T0, T0 + 3) for a in range(200)], "actor int, from_ts bigint, to_ts bigint")
    for e, n, limits in ((few, 387, ()), (many, 397, ()), (many, 397, (0, 0)), (few, 387, (0, 9))):
        out = gaps.without_excluded(s.rows(), e, *limits)
        assert out.count() == n
        plan = executed(out)
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "BuildLeft" not in plan
    assert gaps.merged([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)]


def test_thousands_of_literal_exclusions(spark):
    rows = line(spark, 400).withColumn("actor", (F.col("seq") % 10).cast("int"))
    alike = [(a, T0, T0 + 300) for a in range(0, 20_000, 5)]
    own = [(a, T0 + a % 300, T0 + a % 300 + 9) for a in range(1, 900, 2)]
    every = [(None, T0 + 4 * i, T0 + 4 * i + 1) for i in range(50, 450)]
    for given in (alike, own, every):
        e = spark.createDataFrame(given, "actor int, from_ts bigint, to_ts bigint")
        literal, joined = gaps.without_excluded(rows, e, 10**6), gaps.without_excluded(rows, e, 0)
        want = [r["seq"] for r in rows.collect() if not any(a in (None, r["actor"]) and low <= r["ts"] < high for a, low, high in given)]
        assert sorted(r["seq"] for r in literal.collect()) == sorted(r["seq"] for r in joined.collect()) == want
        assert "Join" not in executed(literal)


def test_of_two_writers_one_publishes(spark, tmp_path):
    s, errors = Store(spark, f"file://{tmp_path}/s"), []

    def write():
        for _ in range(5):
            try:
                s.record_gap(1, 2, 1)
            except StoreError as e:
                errors.append(e)

    threads = [threading.Thread(target=write) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert s.version() + len(errors) == 15 and len(s.manifest()["gaps"]) == s.version()
    assert s.files.create("manifest/99.json", "{}") and not s.files.create("manifest/99.json", "[]") and s.files.read("manifest/99.json") == "{}"
    a = Store(spark, f"file://{tmp_path}/t", exclusive=True)
    with pytest.raises(StoreError, match="LOCKED"):
        Store(spark, f"file://{tmp_path}/t", exclusive=True)
    a.close()
    Store(spark, f"file://{tmp_path}/t", exclusive=True).close()


def test_streams_have_their_own_watermarks(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.append(line(spark, 3), 0, "a") and s.append(line(spark, 3, T0 + 50), 0, "b") and not s.append(line(spark, 3), 0, "a")
    before = s.version()
    assert not s.append(line(spark, 0), 1, "a") and s.version() == before and s.applied("a") == 0 and s.applied("c") == -1
    assert s.rows().count() == 6
    for k in range(2):  # another checkpoint of the same input is another stream
        line(spark, 4, T0 + 100).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in{k}")
        for _ in range(2):
            ingest.start(spark.readStream.schema(MUTATION).parquet(f"{tmp_path}/in{k}"), s, f"{tmp_path}/c{k}").awaitTermination()
    assert s.rows().count() == 14 and len(s.manifest()["streams"]) == 4


def test_long_lists_leave_the_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "TAIL", 4)
    s = Store(spark, f"file://{tmp_path}/s")
    for k in range(10):
        s.record_gap(100 * k, 100 * k + 9, 1)
    s.record_gap(100, 109, 1)
    s.record_gap(900, 909, 1)  # as one that is there
    ops = [s.begin_operation("run", {"k": k}) for k in range(7)]
    for k in ops:
        s.finish_operation(k, 2, {})
    m = s.manifest()
    assert len(m["gaps"]) <= 4 and len(m["operations"]) <= 5 and s.stats()["gaps"] == 12
    assert [g["from_ts"] for g in s.gaps_between(105, 320).collect()] == [100, 100, 200, 300]
    assert s.operation(ops[0])["plan"] == {"k": 0} and s.begin_operation("run", {}) == 8


def test_vacuum_spares_readers_writers_and_the_young(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(line(spark, 5), 0)
    s.seal()
    s._write(line(spark, 5), "hot/99-running", False)
    with s.open_reader() as m:
        s.append(line(spark, 5, T0 + 10), 1)
        s.seal()
        s.compact()
        assert not s.vacuum() and "hot/99-running" not in s.orphans()
        gone = s.vacuum(old_ms=0, most=3)
        assert len(gone) == 3
        s.vacuum(old_ms=0)
        assert s.rows(m).count() == 5
    s.vacuum(old_ms=0)
    with pytest.raises(StoreError):
        s.rows(m).count()
    assert s.rows().count() == 10 and {x["state"] for x in s.manifest()["shards"]} == {0, 3}


def test_a_merge_goes_on_after_a_restart_or_is_dropped(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    s = Store(spark, root)
    for k in range(3):
        s.append(line(spark, 5, T0 + 10 * k), k)
        s.seal()
    assert s.compact_step(most_shards=2) == ("STEP_CHOOSE", 10) and Store(spark, root).compact_step()[0] == "STEP_WRITE"
    assert s.expire_before(T0 + 2) == 2  # takes one of its shards
    assert Store(spark, root).compact_step()[0] == "STEP_CHOOSE" and s.compact() == 13 and s.manifest()["work"] is None
    assert [r["action"] for r in s.audit().collect()].count("REMOVE") == 1 and s.stats()["shards"] == 1


def test_removal_touches_what_it_must(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    for k in range(3):
        s.append(line(spark, 10, T0 + 100 * k, 7 + k), k)
        if k < 2:
            s.seal()
    names = {x["name"] for x in s.live(s.manifest())}
    assert s.purge_actor(9, T0, T0 + 204) == 4 and {x["name"] for x in s.live(s.manifest())} == names and s.stats()["hot_rows"] == 6
    assert s.purge_actor(7, T0, T0 + 1000) == 10 and s.stats()["shards"] == 1
    assert [tuple(r) for r in s.audit().filter("action = 'REMOVE'").collect()] == [("REMOVE", 0, 4), ("REMOVE", 0, 10)]


def test_blobs(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(line(spark, 3), 0)
    ids = sorted(r["id"] for r in s.put_blobs(spark.createDataFrame([(1, b"a"), (1, b"a"), (2, b"a")], "version int, payload binary")).collect())
    assert len(ids) == 2 and s.read_blob(ids[0]) == b"a"
    key = line(spark, 3).select("w", "c", "ts", "seq")
    assert s.attach(key.filter("seq = 1").withColumn("blob_id", F.lit(ids[0]))) == 1
    at = key.filter("seq = 1").first()
    assert s.blob_at(*at) == ids[0] and s.blob_at(at[0], at[1], at[2], 9) is None
    for bad in (key.filter("seq = 1").withColumn("blob_id", F.lit(ids[1])), key.filter("seq = 2").withColumn("blob_id", F.lit("no")), key.filter("seq = 2").withColumn("seq", F.lit(77)).withColumn("blob_id", F.lit(ids[1]))):
        with pytest.raises(StoreError):
            s.attach(bad)
    assert s.blobs_for(key).filter("blob_id is not null").count() == 1 and s.collect_blobs() == 1
    with pytest.raises(StoreError):
        s.read_blob(ids[1])
    with pytest.raises(StoreError):
        s.put_blobs(spark.createDataFrame([(-1, b"a")], "version int, payload binary"))


def captured(spark):
    base = dict(producer=1, ts=T0, seq=0, w=1, x=0, y=64, z=0, b=5, a=6, actor=20, cause=1, kind=1)
    changes = [{}, dict(x=1, a=5), dict(x=2, a=None), dict(x=3, y=9999), dict(x=4, cause=999), dict(x=5, actor=99), dict(x=6, seq=1), dict(x=6, seq=2, b=6, a=7, actor=21), dict(x=7, seq=3, w=8), dict(x=8, b=None), dict(x=9, a=1 << 24)]
    schema = "producer int, ts bigint, seq int, w int, x int, y int, z int, b int, a int, actor int, cause int, kind int"
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], schema)


def test_capture_counts_every_loss(spark, tmp_path):
    ids = lambda *n: spark.createDataFrame([(k,) for k in n], "id int")
    capture = ingest.Capture(50, 6, ids(20, 21), ids(1))
    counts = {r["outcome"]: r["observations"] for r in capture.counted(capture.outcomes(captured(spark))).collect()}
    assert counts == {"published": 1, "rejected": 1, "unreadable": 1, "out_of_range": 1, "invalid": 3, "unregistered": 2, "ambiguous": 2}
    s = Store(spark, f"file://{tmp_path}/s")
    seen = []
    consumer = ingest.Consumer(s, capture, seen.append, Schedule(s), lambda: T0)
    assert consumer.batch(captured(spark), 0, "x") and not consumer.batch(captured(spark), 0, "x")
    gap = s.gaps_between(0, 2 * T0).collect()
    assert len(gap) == 1 and gap[0]["dropped"] == 9 and gap[0]["reason"] == 1 and "unregistered=2" in gap[0]["detail"]
    assert s.rows().count() == 1 and consumer.counters["published"] == 1 and len(seen) == 1
    # all lost: no rows, but the gap is stored with the batch
    assert consumer.batch(captured(spark).filter("x = 5"), 1, "x") and s.applied("x") == 1 and s.stats()["gaps"] == 2
    few = ingest.Capture(50, 2)
    told = {r["outcome"]: r["observations"] for r in few.counted(few.outcomes(captured(spark).filter("x < 3"))).collect()}
    assert told == {"published": 1, "rejected": 1, "overflow": 1}


def test_flush_seals_what_came(spark, tmp_path):
    line(spark, 6).write.parquet(f"{tmp_path}/in")
    s = Store(spark, f"file://{tmp_path}/s")
    q = spark.readStream.schema(MUTATION).parquet(f"{tmp_path}/in").writeStream.foreachBatch(lambda rows, n: s.append(rows, n, "q") and None).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        assert ingest.flush(q, s) == 6 and s.stats()["hot_rows"] == 0
    finally:
        q.stop()


def test_slot_clock_goes_on_from_a_seed(spark):
    rows = spark.createDataFrame([(1, 0, 4), (1, 1, 9), (2, 0, 4)], "slot int, n bigint, now bigint")
    got = {(r["slot"], r["n"]): (r["ts"], r["counter"], r["ok"]) for r in ingest.stamp_slots(rows, 3, {1: 6}).collect()}
    assert got == {(1, 0): (7, 0, True), (1, 1): (9, 0, True), (2, 0): (4, 0, True)}


def test_checksums(spark):
    rng = random.Random(2)
    for n in (0, 1, 255, 256, 1023, 1024, 1025, 5000, 70_001):
        data = rng.randbytes(n)
        crc = 0xFFFFFFFF
        for b in data:
            crc = journal._TABLE[(crc ^ b) & 255] ^ (crc >> 8)
        assert journal.crc32c(data) == crc ^ 0xFFFFFFFF


def test_recovery_after_a_stop(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    w = journal.Writer(str(folder))
    event = lambda k: journal.Envelope(1, k, 64, 3, 10, 11, T0 + k, 16, k, 2, 1, 7, b"\x00\xff")
    w.append(journal.CAPTURED, event(1).encode())
    w.append(journal.EVENTS, journal.events_payload([], T0 - 5, T0 + 1))
    w.append(journal.GAP, journal.gap_payload(T0 - 9, T0 - 8, 1, 4))
    w.close()
    s = Store(spark, f"file://{tmp_path}/s")
    told = journal.recover(s, str(folder), newest_file=T0 + 3)
    assert (told["captured"], told["gaps"], told["clean"]) == (1, 2, False) and journal.recover(s, str(folder))["frames"] == 0
    assert [(g["from_ts"], g["to_ts"], g["reason"]) for g in s.gaps_between(0, 2 * T0).collect()] == [(T0 - 9, T0 - 8, 1), (T0 - 5, T0 + 1003, 2)]
    w = journal.Writer(str(folder))
    w.append(journal.CAPTURED, event(2).encode())
    w.append(journal.EVENTS, journal.events_payload([(0, 0, 0, 0)] * 2, T0, T0 + 2)[:-1])
    w.close()
    with pytest.raises(Exception, match="has not the events"):
        journal.recover(s, str(folder))
    assert gaps.crash_gap(0, 5, 9) == (5, 1009) and gaps.crash_gap(3, 5, 1) == (3, 1005)


def test_spool(tmp_path):
    q = Spool(str(tmp_path / "q"), records=3, most_bytes=8)
    assert [q.offer(t, b"x" * n) for t, n in ((5, 1), (6, 8), (7, 9), (8, 0), (9, 1), (3, 1))] == [TAKEN, TAKEN, TOO_LONG, TAKEN, FULL, FULL]
    assert q.losses() == (3, 3, 9) and len(q) == 3 and not q.acknowledge(1)
    q = Spool(str(tmp_path / "q"), records=3, most_bytes=8)
    assert q.peek() == (0, 5, b"x") and q.acknowledge(0) and q.offer(11, b"y") == TAKEN and q.losses()[0] == 3
    got = []
    assert q.drain(lambda t, d: got.append((t, d)), 2) == 2 and got == [(6, b"x" * 8), (8, b"")]
    (tmp_path / "q" / "00000000000000000003.rec").write_bytes(b"\0" * 13)
    with pytest.raises(ValueError):
        q.peek()
    q.reset()
    assert len(q) == 0 and q.losses() == (0, None, None) and q.offer(1, b"") == TAKEN and q.peek()[0] == 4


def test_what_waits_goes_through_the_journal(spark, tmp_path):
    (tmp_path / "j").mkdir()
    q, w, s = Spool(str(tmp_path / "q"), 2), journal.Writer(str(tmp_path / "j")), Store(spark, f"file://{tmp_path}/s")
    for k in range(3):
        q.offer(T0 + k, journal.Envelope(1, k, 64, 3, 10, 11, T0 + k, 16, k, 2, 1, 7, b"p").encode())
    assert to_journal(q, w) == 2 and len(q) == 0 and q.losses()[0] == 0 and to_journal(q, w) == 0
    w.append(journal.CLOSE, b"")
    w.close()
    told = journal.recover(s, str(tmp_path / "j"))
    assert (told["captured"], told["clean"]) == (2, True) and s.refs().count() == 2
    assert [(g["from_ts"], g["to_ts"], g["dropped"]) for g in s.gaps_between(0, 2 * T0).collect()] == [(T0 + 2, T0 + 2, 1)]


def test_configuration_files(tmp_path):
    path = str(tmp_path / "c")
    assert Config.load(path) == (Config(), {}) and Config.load(path) == (Config(), {})
    own = Config(interval=5400000, retention=86400000, budget=Budget(rows=7, shards=3, ms=2))
    own.save(path, {"colour": "red"})
    assert Config.load(path) == (own, {"colour": "red"}) and "interval: 90m" in own.render() and os.listdir(tmp_path) == ["c"]


def test_phases_and_their_outcomes(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    for k in range(2):
        s.append(line(spark, 5, T0 + 10 * k), k)
        s.seal()
    schedule = Schedule(s, Config(retention=1000, budget=Budget(ms=60000)))
    with s.open_reader():
        said = [schedule.tick(T0 + 1002) for _ in range(7)]
    assert said == [("COMPACT", "PROGRESSED"), ("COMPACT", "PROGRESSED"), ("COMPACT", "COMPLETED"), ("VERIFY", "COMPLETED"), ("RETAIN", "DEFERRED"), ("CHECKPOINT", "NO_WORK"), ("SEAL", "NO_WORK")]
    schedule.next = 0
    schedule.cancelled = True
    assert schedule.tick(T0 + 1002) == ("COMPACT", "CANCELLED")
    schedule.cancelled = False
    said = [schedule.tick(T0 + 1002) for _ in range(4)]
    assert said[2:] == [("RETAIN", "PROGRESSED"), ("RETAIN", "NO_WORK")] and s.rows().count() == 8
    slow = Schedule(s, Config(budget=Budget(ms=1)))
    slow.phase = 1
    s.append(line(spark, 5, T0 + 100), 2)
    s.seal()
    assert slow.tick(0) == ("VERIFY", "UNVERIFIED")


def test_dictionaries_are_replaced_whole_or_not(spark, tmp_path):
    path = f"{tmp_path}/names"
    rows = lambda *r: spark.createDataFrame(r, "id int, name string")
    assert dictionary.replace(spark, path, rows((1, "a"), (2, "b=c"))) == 2
    for bad in (rows((1, "a"), (1, "b")), rows((1, "a\tb")), rows((9999, "a"))):
        with pytest.raises(StoreError):
            dictionary.replace(spark, path, bad, last=4095)
    assert sorted(tuple(r) for r in dictionary.load(spark, path).collect()) == [(1, "a"), (2, "b=c")] and os.listdir(tmp_path) == ["names"]
    with pytest.raises(StoreError, match="don't fit"):
        dictionary.assign(rows((0, "x"), (0, "y")).select("name"), rows((4095, "z")), 0, 4096)
    known = spark.createDataFrame([(16, "u1", "ann")], "id int, uuid string, name string")
    seen = spark.createDataFrame([("u1", "anne", 1), ("u2", "bob", 1), ("u2", "rob", 2), ("u3", "", 1)], "uuid string, name string, at long")
    assert sorted(tuple(r) for r in dictionary.register(seen, known).collect()) == [(16, "u1", "anne"), (17, "u2", "rob")]
    with pytest.raises(Exception, match="no such id"):
        spark.range(1).select(dictionary.strictly({1: "A"}, F.col("id"))).collect()


def test_resumes_that_are_refused(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(line(spark, 40), 0)
    world = lambda: spark.createDataFrame([(1, i, 64, 3 * i, 0) for i in range(40)], "w int, x int, y int, z int, state int")
    tried = []

    def apply(rows):
        rows.collect()
        with pytest.raises(StoreError, match="running"):
            r.resume(1)
        tried.append(1)
        r.cancel(1)

    r = Rollbacks(s, world, apply, chunks=1, worlds={1})
    assert r.rollback(1, Box.everything(), T0, T0 + 100).state == 5 and tried
    s.append(line(spark, 3, T0 + 50), 1)
    r.worlds = {2}
    for f in (lambda: r.resume(1), lambda: r.rollback(1, Box.everything(), T0, T0 + 100)):
        with pytest.raises(StoreError, match="not loaded"):
            f()
    r.worlds, r.apply = None, lambda rows: rows.collect()
    assert r.resume(1).state == 2 and s.stats()["hot_rows"] == 0  # sealed before it went on


def test_reports_from_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"benchmark": "a", "score": 1.5}, {"benchmark": "b", "score": None}]))
    assert {r["benchmark"]: r["score"] for r in reports.read_json(spark, f"{tmp_path}/r.json").collect()} == {"a": 1.5, "b": None}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        reports.read_json(spark, f"{tmp_path}/bad.json").collect()
    (tmp_path / "x.xml").write_text('<r><testsuite name="p" tests="2" failures="0" errors="0" skipped="0"/><testsuite name="q" tests="2" failures="0" errors="1" skipped="0"/><testsuite name="e" tests="0" failures="0" errors="0" skipped="0"/></r>')
    got = reports.read_suites(spark, f"{tmp_path}/x.xml").select("name", reports.suite_passed().alias("ok")).collect()
    assert {r["name"]: r["ok"] for r in got} == {"p": True, "q": False, "e": False}


def test_density_says_what_is_unassigned(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(line(spark, 50), 0)
    s.seal()
    s.append(line(spark, 5, T0 + 100), 1)
    got = {r["kind"]: r for r in density.density(s).collect()}
    assert got["shards"]["rows"] == 50 and got["hot"]["rows"] == 5 and got["hot"]["unassigned"] > 0 == got["shards"]["unassigned"] and got["manifest"]["rows"] is None
    assert s.scan(ScanPlan(1, Box.everything(), T0, T0 + 200)).count() == 55 and fold.invalid() is not None
