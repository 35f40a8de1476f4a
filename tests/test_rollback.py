"""Rollbacks, maintenance, journal writing, envelopes and dictionary files."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.geometry import Box, morton_int
from palimpsest.operators import dictionary
from palimpsest.operators.rollback import Rollbacks, command
from palimpsest.schema import MUTATION, StoreError
from palimpsest.sources import journal
from palimpsest.sources.store import Store
from palimpsest.streaming.maintenance import Budget, Config, Schedule

T0 = 1_800_000_000_000


class World:
    """240 blocks, 40 in each of 6 chunks, all broken by actor 20."""

    def __init__(self, spark, path):
        self.spark, self.store = spark, Store(spark, f"file://{path}/s")
        self.at = [(16 * k + i % 16, 64, i // 16) for k in range(6) for i in range(40)]
        rows = [(1, morton_int(x >> 4, z >> 4), T0 + n, n, x, y, z, 5, 0, 20, 1, 1) for n, (x, y, z) in enumerate(self.at)]
        self.store.append(spark.createDataFrame(rows, MUTATION), 0)
        self.state, self.applied = {p: 0 for p in self.at}, []

    def read(self):
        return self.spark.createDataFrame([(1, *p, s) for p, s in self.state.items()], "w int, x int, y int, z int, state int")

    def apply(self, rows):
        got = rows.collect()
        assert all((r["actor"], r["cause"], r["b"], r["a"]) == (1, 3, 0, 5) for r in got)
        self.state |= {(r["x"], r["y"], r["z"]): r["a"] for r in got}
        self.applied.append(len(got))


BOX = Box(0, 0, 0, 200, 255, 100)


def test_rollback_classifies_and_finishes(spark, tmp_path):
    w = World(spark, tmp_path)
    w.state[w.at[0]], w.state[w.at[1]] = 5, 9
    done = Rollbacks(w.store, w.read, w.apply, chunks=4).rollback(1, BOX, T0, T0 + 1000, 20)
    assert done.line() == f"op={done.operation} state=2 scanned=240 chunks=6 applied=238 already=1 mismatched=1 contended=0"
    assert sum(w.applied) == 238 and w.store.stats()["hot_rows"] == 0 and not w.store.unfinished_operations()
    with pytest.raises(StoreError):
        Rollbacks(w.store, w.read, w.apply).resume(done.operation)


def test_cancelled_rollback_resumes(spark, tmp_path):
    w = World(spark, tmp_path)
    r = Rollbacks(w.store, w.read, lambda rows: (w.apply(rows), r.cancel(1)), chunks=1)
    assert r.rollback(1, BOX, T0, T0 + 1000).line() == "op=1 state=5 scanned=40 chunks=1 applied=40 already=0 mismatched=0 contended=0"
    r.apply = w.apply
    assert r.resume(1).progress["applied"] == 240 and w.applied == [40] * 6


def test_rollback_of_another_run_starts_again(spark, tmp_path):
    w = World(spark, tmp_path)
    r = Rollbacks(w.store, w.read, lambda rows: (w.apply(rows), r.cancel(1)), chunks=1)
    r.rollback(1, BOX, T0, T0 + 1000)
    assert {k: v for k, v in Rollbacks(w.store, w.read, w.apply).resume(1).progress.items() if v} == {"scanned": 240, "chunks": 6, "applied": 200, "already": 40}


def test_contended_chunks_are_left(spark, tmp_path):
    w = World(spark, tmp_path)
    stuck = spark.createDataFrame([(1, morton_int(3, 0))], "w int, c bigint")
    r = Rollbacks(w.store, w.read, w.apply, stuck, chunks=2)
    part = r.rollback(1, BOX, T0, T0 + 1000)
    assert part.state == 3 and part.progress["contended"] == 1 and 200 <= part.progress["applied"] < 240
    r.contended = None
    assert r.resume(part.operation).state == 2 and all(s == 5 for s in w.state.values())


def test_any_gap_refuses_a_rollback(spark, tmp_path):
    w = World(spark, tmp_path)
    w.store.record_gap(T0, T0 + 1, 1)
    with pytest.raises(StoreError):
        Rollbacks(w.store, w.read, w.apply).rollback(1, BOX, T0, T0 + 1000)
    assert not w.store.unfinished_operations()


def test_commands(spark, tmp_path):
    w = World(spark, tmp_path)
    r = Rollbacks(w.store, w.read, w.apply)
    assert command(r, "status", 1, (0, 0, 0), T0)["unfinished"] == []
    assert command(r, "rollback 100 10", 1, (0, 64, 0), T0 + 1000).state == 2
    for bad in ("rollback 513", "rollback 5 0", "resume x", "undo"):
        with pytest.raises(ValueError):
            command(r, bad, 1, (0, 0, 0), T0)


def test_maintenance_goes_through_its_phases(spark, tmp_path):
    w = World(spark, tmp_path)
    config, foreign = Config.parse("interval: 5m\nretention: 10d # days\nshards: 4\ncolour: red\n")
    assert (config.interval, config.retention, config.budget, foreign) == (300000, 864000000, Budget(shards=4), {"colour": "red"})
    with pytest.raises(ValueError, match="interval.*shards"):
        Config.parse("interval: 5\nshards: many")
    for ms in (0, 60001):
        with pytest.raises(ValueError):
            Budget(ms=ms)
    s = Schedule(w.store, config)
    assert s.tick(T0, backlogged=True) == ("COMPACT", "DEFERRED")
    steps = [s.tick(T0) for _ in range(8)]
    assert [x for x in steps if x and x[1] != "NO_WORK"] == [("SEAL", "PROGRESSED")] and w.store.stats()["sealed_rows"] == 240
    assert s.tick(T0 + 1000) is None
    before = w.store.rows().count()
    assert w.store.retain_shard(T0 + 10) == 10 and w.store.retain_shard(T0 + 10) == 0 and w.store.rows().count() == before - 10
    assert [(g["from_ts"], g["to_ts"], g["reason"]) for g in w.store.gaps_between(T0, T0 + 500).collect()] == [(T0, T0 + 9, 5)]


def test_journal_writer_goes_on_after_damage(spark, tmp_path):
    j = journal.Writer(str(tmp_path), segment_bytes=60)
    at = [j.append(journal.EVENTS, bytes([k]) * 20) for k in range(4)]
    j.close()
    assert len(os.listdir(tmp_path)) == 2 and journal.replay(spark, str(tmp_path)).count() == 4
    last = sorted(tmp_path.iterdir())[-1]
    last.write_bytes(last.read_bytes()[:-3])
    j = journal.Writer(str(tmp_path))
    assert j.append(journal.CLOSE, b"") == at[3]
    j.close()
    assert [r["type"] for r in journal.replay(spark, str(tmp_path)).orderBy("lsn").collect()] == [1, 1, 1, 7]
    assert journal.append_point(str(tmp_path), 10**6) == 10**6


def test_envelopes_round_trip():
    e = journal.Envelope(1, -2, 64, 3, 10, 11, T0, 16, 65535, 2, 1, 7, b"\x00\xff\x03")
    assert journal.Envelope.decode(e.encode()) == e and len(e.encode()) == 48 + 3
    for bad in (e.encode()[:-1], e.encode() + b"x", e.encode()[:20]):
        with pytest.raises(ValueError):
            journal.Envelope.decode(bad)


def test_dictionary_files(spark, tmp_path):
    u = "00000000-0000-0000-0000-00000000000"
    (tmp_path / "a").write_text(f"16\t{u}1\tann\n17\t{u}2\tann\n")
    assert sorted((r["id"], r["name"]) for r in dictionary.load(spark, f"{tmp_path}/a", True, 16).collect()) == [(16, "ann"), (17, "ann")]
    (tmp_path / "s").write_text("stone=1\ndoor[open=true]=2\n")
    assert sorted(r["name"] for r in dictionary.load(spark, f"{tmp_path}/s").collect()) == ["door[open=true]", "stone"]
    for k, text in enumerate(("stone=1\nstone=2\n", "a=1\nb=1\n", "a\n", "a=9999\n")):
        (tmp_path / f"bad{k}").write_text(text)
        with pytest.raises(StoreError):
            dictionary.load(spark, f"{tmp_path}/bad{k}", last=4095)
