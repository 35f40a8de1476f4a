import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import codec, digest
from palimpsest.functions.geometry import Box, cover, from_local, local, morton, morton_int, unmorton
from palimpsest.operators import dictionary, fold, reports
from palimpsest.plans.scan_plan import NEWEST, ScanPlan, page, scan
from palimpsest.schema import MUTATION, StoreError
from palimpsest.sources import journal
from palimpsest.sources.store import Store
from palimpsest.streaming import ingest

T0 = 1_800_000_000_000


def line(spark, n, t0=T0, actor=7):
    rows = [(1, morton_int(i >> 4, (3 * i) >> 4), t0 + i, i, i, 64, 3 * i, 10 + i, 0, actor, 1, 1) for i in range(n)]
    return spark.createDataFrame(rows, MUTATION)


def keys(df):
    return [(r["c"], r["ts"], r["seq"]) for r in df.collect()]


def everything(order="oldest", **more):
    return ScanPlan(1, Box.everything(), 0, T0 * 2, order, **more)


def test_positions_round_trip_with_negative_y(spark):
    rng = random.Random(3)
    edge = lambda lo, hi: rng.choice([lo, hi, lo + rng.randrange(9), rng.randrange(lo, hi + 1)])
    rows = [(5, -64, -40)] + [(edge(-(1 << 25), (1 << 25) - 1), edge(-2048, 2047), edge(-(1 << 25), (1 << 25) - 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "x int, y int, z int").select("*", codec.pack_position("x", "y", "z").alias("p"))
    back = codec.unpack_position("p")
    assert df.filter((back["x"] != F.col("x")) | (back["y"] != F.col("y")) | (back["z"] != F.col("z"))).count() == 0


def test_actor_of_32_bits(spark):
    df = spark.createDataFrame([(7,), (-1,), (-(1 << 31),), ((1 << 31) - 1,)], "actor int")
    meta = codec.unpack_metadata(codec.pack_metadata(F.lit(65535), F.lit(4095), F.lit(255), F.lit(15), "actor"))
    low = codec.unpack_actor_time(codec.pack_actor_time(F.lit(1).cast("bigint"), "actor"))["actor_low"]
    got = df.select("actor", codec.actor_id(meta["actor_high"], low).alias("back"), meta["seq"].alias("seq"), meta["w"].alias("w"))
    assert all(r["actor"] == r["back"] and r["seq"] == 65535 and r["w"] == 4095 for r in got.collect())


def test_morton_goldens(spark):
    assert morton_int(0, 0) == 13194139533312 and morton_int(128, 128) == 13194139582464
    df = spark.createDataFrame([(0, 0), (128, 128), (-5, 77), (-(1 << 21), (1 << 21) - 1)], "x int, z int").withColumn("c", morton(F.col("x"), F.col("z")))
    back = unmorton("c")
    for r in df.select("*", back["cx"].alias("cx"), back["cz"].alias("cz")).collect():
        assert r["c"] == morton_int(r["x"], r["z"]) and (r["cx"], r["cz"]) == (r["x"], r["z"])
    p = spark.createDataFrame([(-17, -2048, 33)], "x int, y int, z int").withColumn("c", morton(F.shiftright("x", 4), F.shiftright("z", 4))).withColumn("p", local("x", "y", "z"))
    assert tuple(p.select(*[v.alias(k) for k, v in from_local("c", "p").items()]).first()) == (-17, -2048, 33)


@settings(max_examples=60, deadline=None)
@given(st.integers(-400, 400), st.integers(-400, 400), st.integers(0, 40), st.integers(0, 40), st.integers(1, 64))
def test_cover_holds_every_chunk(x, z, dx, dz, most):
    ranges = cover((x, z, x + dx, z + dz), most)
    assert len(ranges) <= most and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    for cx in range(x, x + dx + 1):
        for cz in range(z, z + dz + 1):
            assert any(lo <= morton_int(cx, cz) <= hi for lo, hi, _ in ranges)


def test_cover_of_a_chunk_and_a_tunnel():
    assert cover((3, 4, 3, 4)) == [(morton_int(3, 4), morton_int(3, 4), True)]
    assert len(cover((0, 0, 500, 0), 64)) <= 64


@pytest.mark.parametrize("order", ["oldest", "newest"])
def test_pages_are_the_scan(spark, order):
    rows, plan, got = line(spark, 50).cache(), everything(order, batch=7), []
    want = keys(scan(rows, plan))
    assert want == sorted(want, reverse=order == NEWEST)
    while found := keys(page(rows, plan.resume_after(got[-1] if got else None))):
        got += found
    assert got == want


def test_scan_is_filter_and_sort(spark):
    rows = line(spark, 60)
    plan = ScanPlan(1, Box(5, 0, 0, 30, 100, 60), T0 + 2, T0 + 18).with_actors(7)
    assert [r["seq"] for r in scan(rows, plan).orderBy("seq").collect()] == list(range(5, 18))
    assert scan(rows, plan.with_actors()).count() == 0
    with pytest.raises(ValueError):
        ScanPlan(1, Box.everything(), 5, 4)
    with pytest.raises(ValueError):
        Box(1, 0, 0, 0, 0, 0)


def test_scan_is_pushed_to_parquet(spark, tmp_path):
    line(spark, 50).write.parquet(f"{tmp_path}/m")
    plan = ScanPlan(1, Box(0, 0, 0, 20, 100, 60), T0, T0 + 10).resume_after((morton_int(0, 0), T0 + 1, 1))
    text = scan(spark.read.parquet(f"{tmp_path}/m"), plan)._jdf.queryExecution().toString()
    pushed = next(x for x in text.splitlines() if "PushedFilters" in x)
    assert "(w,1)" in pushed and "(c," in pushed and "(ts," in pushed
    assert "SortAggregate" not in fold.fold(line(spark, 5))._jdf.queryExecution().toString()


def test_classify_says_already_first(spark):
    folded = spark.createDataFrame([(1, 0, 0, 0, 0, 5, 4, 1), (1, 1, 0, 0, 0, 5, 4, 1), (1, 2, 0, 0, 0, 5, 4, 1), (1, 3, 0, 0, 0, 5, 5, 2)], "w int, x int, y int, z int, c bigint, expected int, target int, n long")
    world = spark.createDataFrame([(1, 0, 0, 0, 4), (1, 1, 0, 0, 5), (1, 2, 0, 0, 9), (1, 3, 0, 0, 5)], "w int, x int, y int, z int, state int")
    out = {r["x"]: r["outcome"] for r in fold.classify(folded, world).collect()}
    assert out == {0: "already", 1: "applied", 2: "mismatched", 3: "already"}


def test_store_life(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.append(line(spark, 5), 0) and not s.append(line(spark, 5), 0)
    first = s.version()
    assert s.seal() == 5 and s.seal() == 0
    s.append(line(spark, 5, T0 + 100, 8), 1)
    assert s.scan(everything()).count() == 10 and s.scan(everything(), first).count() == 5
    before = digest.multiset_digest(s.rows())
    assert s.seal() == 5 and s.compact() == 10 and {k: v for k, v in s.stats().items() if k != "bytes"} == {"hot_rows": 0, "sealed_rows": 10, "shards": 1, "gaps": 0, "applied": 1} and s.stats()["bytes"] > 0
    assert digest.multiset_digest(s.rows()) == before and s.compact() == 0
    assert s.verify() == {"verified": 1, "unverified": 0, "quarantined": 0, "blobs": 0, "bad_blobs": 0}
    assert s.purge_actor(8, T0, T0 + 103) == 3 and s.purge_actor(8, T0, T0 + 103) == 0
    s.append(line(spark, 3, T0 + 100, 8), 2)
    assert s.rows().filter("actor = 8").count() == 2  # those of the purged window are dropped again
    with pytest.raises(StoreError):
        s.scan(everything())
    assert s.expire_before(T0 + 2) == 2 and [r["reason"] for r in s.gaps_between(T0, T0 + 500).collect()] == [5, 6]
    assert s.scan(ScanPlan(1, Box.everything(), T0 + 200, T0 + 300)).count() == 0
    assert not s.vacuum() and s.vacuum(old_ms=0) and s.rows().count() == 5 and s.scan(ScanPlan(1, Box.everything(), T0 + 200, T0 + 300)).count() == 0


def test_store_refuses_and_quarantines(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(line(spark, 5), 0)
    s.seal()
    s.append(line(spark, 5), 1)
    s.seal()
    with pytest.raises(StoreError, match="same identity"):
        s.compact()
    stale = s.manifest()
    s.record_gap(1, 2, 1)
    with pytest.raises(StoreError, match="LOCKED"):
        s._publish(stale)
    s.files.delete(s.live(s.manifest())[0]["name"])
    found = s.verify()
    assert (found["verified"], found["quarantined"]) == (1, 1)
    assert s.quarantine(99) is False
    with pytest.raises(StoreError):
        s.scan(everything())


def test_payloads(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    rows = line(spark, 4).withColumns({"version": F.lit(7), "payload": F.lit(b"\x00\xff\x03")})
    assert s.append_captured(rows, 0) and s.append_captured(rows, 1)
    assert s.rows().count() == 4 and s.blobs().count() == 1 and s.refs().count() == 4
    for other in (rows.withColumn("a", F.lit(1)), rows.withColumn("payload", F.lit(b"x")), rows.withColumn("version", F.lit(8))):
        with pytest.raises(StoreError):
            s.append_captured(other, 2)
    with pytest.raises(StoreError):
        fold.checked(s.rows(), s.refs())
    assert s.collect_blobs() == 0 and s.purge_actor(7, 0, T0 * 2) == 4 and s.collect_blobs() == 1


def test_operations(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    key = s.begin_operation("run", {"w": 1})
    s.checkpoint_operation(key, (1, 2, 3), {"applied": 4})
    s.checkpoint_operation(key, None, {"applied": 5})
    assert s.operation(key)["cursor"] == [1, 2, 3] and [o["id"] for o in s.unfinished_operations()] == [key]
    s.rewind_operation(key, "again")
    assert s.operation(key)["cursor"] is None
    s.finish_operation(key, 2, {})
    assert not s.unfinished_operations()
    with pytest.raises(StoreError):
        s.rewind_operation(key, "third")


def test_journal(spark, tmp_path):
    parts, lsn = [], 0
    for i in range(6):
        parts.append(journal.frame(lsn, journal.EVENTS if i % 2 else journal.GAP, bytes([i] * i)))
        lsn += len(parts[-1])
    assert journal.crc32c(b"123456789") == 0xE3069283
    cut = len(b"".join(parts[:3]))
    (tmp_path / f"{0:020}.log").write_bytes(b"".join(parts[:3]))
    (tmp_path / f"{cut:020}.log").write_bytes(b"".join(parts[3:]))
    assert [bytes(r["payload"])[:1] for r in journal.replay(spark, str(tmp_path)).orderBy("lsn").collect()] == [b"", b"\1", b"\2", b"\3", b"\4", b"\5"]
    bad = bytearray(b"".join(parts[:3]))
    bad[len(parts[0]) + 21] ^= 1
    (tmp_path / f"{0:020}.log").write_bytes(bytes(bad))
    assert journal.replay(spark, str(tmp_path)).count() == 1  # nothing after damage, in later segments either
    assert struct.calcsize("<IIIq") == 20


def test_slot_clock(spark):
    out = ingest.stamp_slots(spark.range(20000).selectExpr("1 as slot", "id as n", "5L as now"), 2).filter("ok")
    assert out.count() == 3072 and out.select("ts", "counter").distinct().count() == 3072
    assert out.agg(F.max("ts")).first()[0] == 7


def test_stream_is_idempotent(spark, tmp_path):
    for k in range(2):
        line(spark, 5, T0 + 100 * k).write.parquet(f"{tmp_path}/in/{k}")
    s = Store(spark, f"file://{tmp_path}/s")
    stream = lambda: spark.readStream.schema(MUTATION).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.start(stream(), s, f"{tmp_path}/c").awaitTermination()
    assert s.rows().count() == 10 and s.manifest()["applied"] >= 0


def test_digest_ignores_order_and_counts_copies(spark):
    rows = line(spark, 20)
    assert digest.multiset_digest(rows) == digest.multiset_digest(rows.orderBy(F.desc("seq")).repartition(3))
    assert digest.multiset_digest(rows.unionByName(rows)) != digest.multiset_digest(rows)
    assert digest.multiset_digest(rows.limit(0)) == "0" * 48


def test_names_and_reports(spark):
    known = spark.createDataFrame([(16, "b")], "id int, name string")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("",), ("x\ty",)], "name string")
    assert sorted((r["id"], r["name"]) for r in dictionary.assign(new, known).collect()) == [(16, "b"), (17, "a"), (18, "c")]
    t = spark.createDataFrame([("90s",), ("2h",), ("5",), ("7ms",)], "t string").select(reports.duration_ms(F.col("t")).alias("v"))
    assert [r["v"] for r in t.collect()] == [90000, 7200000, None, 7]
    s = spark.createDataFrame([("op=4 applied=35 mismatched=1",)], "s string")
    assert s.select(reports.counter(F.col("s"), "applied")).first()[0] == 35
    f = spark.createDataFrame([(2097152.0, "bytes"), (1.234, "ms"), (7.0, "count"), (0.5, "x")], "v double, u string").select(reports.formatted(F.col("v"), F.col("u")).alias("t"))
    assert [r["t"] for r in f.collect()] == ["2.0 MiB", "1.23 ms", "7", "0.500"]


def test_report_checks(spark):
    from palimpsest.operators import reports

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    found = lambda a, e: {r["what"]: r["n"] for r in reports.exact(a, e, ["k"]).collect()}
    assert found(rows, rows) == {"missing": 0, "unexpected": 0, "repeated": 1}
    assert found(rows.filter("k = 1"), rows) == {"missing": 1, "unexpected": 0, "repeated": 0}
    assert found(rows.filter("false"), rows.filter("false")) == {"missing": 0, "unexpected": 0, "repeated": 0}
    suites = spark.createDataFrame([(1, 0, 0, 0), (0, 0, 0, 0), (3, 1, 0, 0), (3, 0, 0, 1), (3, 0, None, 0)], "tests int, failures int, errors int, skipped int")
    assert [r[0] for r in suites.select(reports.suite_passed()).collect()] == [True, False, False, False, False]
    runs = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, False), (4, True, None)], "k int, lossy boolean, passed boolean")
    assert dict(reports.vacuity(runs, "k", 1).select("k", "verdict").collect()) == {1: "ok", 2: "vacuous", 3: "failed", 4: "failed"}
    shown = spark.createDataFrame([(None, "ms"), (1.5, None)], "v double, u string").select(reports.formatted(F.col("v"), F.col("u")))
    assert [r[0] for r in shown.collect()] == ["not measured", "1.500"]
    line = spark.createDataFrame([("seen=3",)], "s string").select(reports.counter(F.col("s"), "lost"))
    assert line.first()[0] is None
