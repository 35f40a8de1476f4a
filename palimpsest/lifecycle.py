"""Queries over what a store, a journal and a stream do, each with the SQL that says the same without them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import _BLOB, _CLASS, _COLS, _COUNTS, _EVENT, _L, _STATE, _WIN, DAY, FROM, PLAN, TICK, TO, _m, _scratch, query
from palimpsest.functions import codec
from palimpsest.functions.geometry import Box
from palimpsest.operators import dictionary, fold, gaps, reports
from palimpsest.operators.rollback import COUNTERS
from palimpsest.plans.scan_plan import ScanPlan, scan, select
from palimpsest.schema import CAUSES, MUTATION, REASONS, STATES, StoreError
from palimpsest.sources import density as bytes_of
from palimpsest.sources import journal, mutations
from palimpsest.sources.spool import FULL, TAKEN, Spool
from palimpsest.sources.store import Store
from palimpsest.streaming import ingest

HALF = 1767225600000 + 15 * DAY


def _facts(spark: SparkSession, **facts: int) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in facts.items()], "what string, n bigint")


def _says(**facts: str) -> str:
    return " " + " UNION ALL ".join(f"SELECT '{k}' AS what, CAST(({v}) AS BIGINT) AS n" for k, v in facts.items())


def _where(condition: str = "true") -> str:
    return f"SELECT count(*) FROM m WHERE {condition}"


def _halves(spark: SparkSession, d: str, store: Store, seal: bool = True) -> DataFrame:
    """Two appends of the history, the older half first, each sealed."""
    rows = _m(spark, d).select(*_EVENT)
    for batch, part in enumerate((rows.filter(F.col("ts") < HALF), rows.filter(F.col("ts") >= HALF))):
        store.append(part, batch)
        if seal:
            store.seal()
    return rows


SEALED = ScanPlan(1, Box(-2000, -64, -1500, 1999, 320, 900), 1_700_000_000_000, 1_900_000_000_000)


@query(f" SELECT {_COLS} FROM m WHERE w = 1 AND x BETWEEN -2000 AND 1999 AND z BETWEEN -1500 AND 900 AND y BETWEEN -64 AND 320 AND ts >= 1700000000000 AND ts < 1900000000000", start=_L)
def scan_sealed_wide(spark, d):
    """A wide box over a sealed store, by up to 64 ranges of the stored key."""
    store = Store(spark, _scratch(spark))
    name = "shards/0-all"
    store._write(mutations.from_lineitem(spark, d), name, True)  # its rows have no identity of their own
    return scan(store._read([name]), SEALED).select(*_EVENT)


@query(_says(purged=_where(f"actor = 20 AND {_WIN}"), again="0", left=_where(f"NOT (actor = 20 AND {_WIN})"), after_append=_where(f"NOT (actor = 20 AND {_WIN})"), gaps="1", untouched_shards=f"SELECT count(*) FROM (SELECT ts >= {HALF} AS h FROM m GROUP BY 1 HAVING count(*) FILTER (actor = 20 AND {_WIN}) = 0)"))
def store_purge(spark, d):
    """A purge rewrites shards that hold its rows, one for one; a second one finds none, and rows that come again are dropped."""
    store = Store(spark, _scratch(spark))
    rows = _halves(spark, d, store)
    before = {s["name"] for s in store.live(store.manifest())}
    purged, again = store.purge_actor(20, FROM, TO), store.purge_actor(20, FROM, TO)
    left, same = store.rows().count(), before & {s["name"] for s in store.live(store.manifest())}
    store.append(rows.filter(F.col("actor") == 20).filter((F.col("ts") >= FROM) & (F.col("ts") < TO)), 2)
    return _facts(spark, purged=purged, again=again, left=left, after_append=store.rows().count(), gaps=store.gaps_between(FROM, TO).count(), untouched_shards=len(same))


CUT = 1767225600000 + 5 * DAY


@query(_says(expired=_where(f"ts < {CUT}"), again="0", left=_where(f"ts >= {CUT}"), gap_to=str(CUT - 1), reason="5", refused="1", allowed="1", retained=_where(f"ts >= {CUT} AND ts < {CUT + DAY}")))
def store_expire(spark, d):
    """An expiry leaves a gap that refuses scans which touch it, and no others; retention then takes one shard."""
    store = Store(spark, _scratch(spark))
    _halves(spark, d, store)
    expired, again = store.expire_before(CUT), store.expire_before(CUT)
    left, gap = store.rows().count(), store.gaps_between(CUT - 1, CUT - 1).first()

    def refused(low: int) -> bool:
        try:
            store.scan(ScanPlan(1, Box.everything(), low, low + DAY))
            return False
        except StoreError:
            return True

    return _facts(spark, expired=expired, again=again, left=left, gap_to=gap["to_ts"], reason=gap["reason"], refused=refused(CUT - DAY), allowed=not refused(CUT), retained=store.retain_shard(CUT + DAY))


@query(_says(verified="2", unverified="1", quarantined="1", lost=_where(f"ts >= {HALF}"), gap_from=f"SELECT min(ts) FROM m WHERE ts >= {HALF}", gap_to=f"SELECT max(ts) FROM m WHERE ts >= {HALF}", left=_where(f"ts < {HALF}")))
def store_verify(spark, d):
    """Shards are verified by their digests; one whose file is gone is quarantined, with a gap over its bounds."""
    store = Store(spark, _scratch(spark))
    _halves(spark, d, store)
    good, some = store.verify(), store.verify(most_shards=1)
    store.files.delete(max(store.live(store.manifest()), key=lambda s: s["id"])["name"])
    bad, gap = store.verify(), store.gaps_between(0, 1 << 62).first()
    return _facts(spark, verified=good["verified"], unverified=some["unverified"], quarantined=bad["quarantined"], lost=gap["dropped"], gap_from=gap["from_ts"], gap_to=gap["to_ts"], left=store.rows().count())


@query(_BLOB + _says(events="SELECT count(*) FROM r", blobs="SELECT count(DISTINCT blob_id) FROM r", again="SELECT count(*) FROM r", refused="3", refs="SELECT count(*) FROM r", collected="0", unreferenced="SELECT count(*) FROM (SELECT blob_id FROM r GROUP BY 1 HAVING bool_and(actor = 20))"))
def append_captured(spark, d):
    """Events with payloads: stored once, accepted again if all is the same, refused if anything differs."""
    store = Store(spark, _scratch(spark))
    rows = _m(spark, d).filter("event_id % 10 = 0").select(*_EVENT, F.lit(7).alias("version"), F.col("props").cast("binary").alias("payload"))
    store.append_captured(rows, 0)
    events, blobs = store.rows().count(), store.blobs().count()
    store.append_captured(rows, 1)
    refused = 0
    for k, other in enumerate((rows.withColumn("a", F.lit(9)), rows.withColumn("payload", F.lit(b"other")), rows.withColumn("version", F.lit(8)))):
        try:
            store.append_captured(other, 2 + k)
        except StoreError:
            refused += 1
    refs, again, collected = store.refs().count(), store.rows().count(), store.collect_blobs()
    store.purge_actor(20, 0, 1 << 62)
    return _facts(spark, events=events, blobs=blobs, again=again, refused=refused, refs=refs, collected=collected, unreferenced=store.unreferenced_blobs().count())


@query(_BLOB + ", b AS (SELECT min(blob_id) AS bad FROM r), o AS (SELECT r.* FROM r, b WHERE blob_id = bad) SELECT bad AS blob_id, (SELECT min(ts) FROM o) AS from_ts, (SELECT max(ts) FROM o) AS to_ts, (SELECT count(*) FROM o) AS dropped, (SELECT count(*) FROM r) - (SELECT count(*) FROM o) AS refs_left, CAST(1 AS BIGINT) AS found FROM b")
def damaged_blob(spark, d):
    """A payload that differs from its id is found, hidden, and becomes a gap over the events that refer to it."""
    store = Store(spark, _scratch(spark))
    store.append_captured(_m(spark, d).filter("event_id % 10 = 0").select(*_EVENT, F.lit(7).alias("version"), F.col("props").cast("binary").alias("payload")), 0)
    m, name = store.manifest(), "blobs/0-damaged"
    bad = store.blobs().agg(F.min("id")).first()[0]
    store.blobs().withColumn("payload", F.when(F.col("id") == bad, F.lit(b"?")).otherwise(F.col("payload"))).write.parquet(f"{store.root}/{name}")
    store._publish(m | {"blobs": [name]})
    found, gap = store.verify(), store.gaps_between(0, 1 << 62).first()
    return spark.createDataFrame([(bad, gap["from_ts"], gap["to_ts"], gap["dropped"], store.refs().count(), found["bad_blobs"])], "blob_id string, from_ts bigint, to_ts bigint, dropped bigint, refs_left bigint, found bigint")


@query(f" SELECT 'CHOOSE' AS step, count(*) AS affected FROM m UNION ALL SELECT 'WRITE', count(*) FROM m UNION ALL SELECT 'COMPACT', count(*) FROM m UNION ALL SELECT 'SEAL 0', count(*) FROM m WHERE ts < {HALF} UNION ALL SELECT 'SEAL 1', count(*) FROM m WHERE ts >= {HALF}")
def compaction_steps(spark, d):
    """A merge in three steps, each by a store of its own, as after a restart; from the audit."""
    root = _scratch(spark)
    _halves(spark, d, Store(spark, root))
    while Store(spark, root).compact_step()[0] not in (None, "COMPACT"):
        pass
    seals, out = 0, []
    for r in Store(spark, root)._logged(Store(spark, root).manifest(), "audit"):
        name = r["action"].removeprefix("STEP_")
        if name == "SEAL":
            name, seals = f"SEAL {seals}", seals + 1
        out.append((name, r["affected"]))
    return spark.createDataFrame(out, "step string, affected bigint")


@query(_says(sealed=_where(), steps_enough="1", left="0", within="1", order="1"))
def seal_by_rows(spark, d):
    """A budget of rows parts an append by time; in the end all is sealed, in as many shards as it takes."""
    store = Store(spark, _scratch(spark))
    rows = _halves(spark, d, store, False)
    budget, sealed = rows.count() // 5, []
    while n := store.seal(most_rows=budget):
        sealed.append(n)
    tops = [(s["min_ts"], s["max_ts"]) for s in store.live(store.manifest())]
    rising = all(a[1] <= b[0] for a, b in zip(tops, tops[1:]))
    return _facts(spark, sealed=sum(sealed), steps_enough=len(sealed) >= 5, left=store.stats()["hot_rows"], within=max(sealed) <= budget * 1.1 + 1, order=rising)


@query(f" SELECT {_COLS} FROM m WHERE ts < {HALF}")
def snapshot_scan(spark, d):
    """What a reader sees that opened before more was appended, merged, purged and swept."""
    store, rows = Store(spark, _scratch(spark)), _m(spark, d).select(*_EVENT)
    store.append(rows.filter(F.col("ts") < HALF), 0)
    store.seal()
    with store.open_reader() as m:
        store.append(rows.filter(F.col("ts") >= HALF), 1)
        store.seal()
        store.compact()
        store.purge_actor(20, FROM, TO)
        store.vacuum(old_ms=0)
        seen = store.rows(m).select(*_EVENT)
        seen.count()
        return seen


@query(_says(copied=_where(), again="0", rows=_where(), kept=_where()))
def legacy_migration(spark, d):
    """Rows of an older layout are copied once, with the format, and its folder stays."""
    folder = _scratch(spark)
    _m(spark, d).select(*MUTATION.names).write.parquet(f"{folder}/old")
    store = Store(spark, f"{folder}/store")
    return _facts(spark, copied=store.migrate(f"{folder}/old"), again=store.migrate(f"{folder}/old"), rows=store.rows().count(), kept=spark.read.parquet(f"{folder}/old").count())


@query(f" SELECT 'shards' AS kind, count(*) FILTER (ts < {HALF}) AS rows FROM m UNION ALL SELECT 'hot', count(*) FILTER (ts >= {HALF}) FROM m")
def store_density(spark, d):
    store = Store(spark, _scratch(spark))
    _halves(spark, d, store, False)
    store.seal(1)
    return bytes_of.density(store).filter("rows is not null and bytes > unassigned and bytes_a_row > 0").select("kind", "rows")


def _journal(spark: SparkSession, rows: DataFrame, close: bool = True) -> str:
    """A journal of the rows, in order, 500 a frame, with a gap."""
    folder = _scratch(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(folder)
    packed = rows.orderBy("ts", "seq").select("ts", codec.pack_position("x", "y", "z").alias("p"), codec.pack_states("b", "a", F.lit(0)).alias("s"), codec.pack_actor_time(codec.relative("ts"), "actor").alias("u"), codec.pack_metadata("seq", "w", "cause", "kind", "actor").alias("m"))
    writer, batch, mark = journal.Writer(folder, 1 << 18), [], None
    for r in packed.toLocalIterator():  # a journal is written by one process, in order
        batch.append(r)
        if len(batch) == 500:
            mark = batch[0]["ts"]
            writer.append(journal.EVENTS, journal.events_payload([tuple(x)[1:] for x in batch], mark, batch[-1]["ts"]))
            batch = []
    writer.append(journal.GAP, journal.gap_payload(FROM, FROM + 9, 1, 3))
    if batch:
        writer.append(journal.EVENTS, journal.events_payload([tuple(x)[1:] for x in batch], batch[0]["ts"], batch[-1]["ts"]))
    if close:
        writer.append(journal.CLOSE, b"")
    writer.close()
    return folder


@query(f" SELECT {_COLS} FROM m")
def journal_replay(spark, d):
    """Mutations that went through a journal's frames of packed longs."""
    return journal.mutations(journal.replay(spark, _journal(spark, _m(spark, d)))).select(*_EVENT)


@query(_says(rows=_where(), events=_where(), again="0", gaps="2", crash_from=f"SELECT min(ts) FROM (SELECT ts, row_number() OVER (ORDER BY ts, seq) AS k FROM m) WHERE k > (SELECT (count(*) // 500) * 500 - CASE WHEN count(*) % 500 = 0 THEN 500 ELSE 0 END FROM m)", crash_to="SELECT max(ts) + 1000 FROM m"))
def journal_recovery(spark, d):
    """A store that lacks all of a journal that was not closed: rows and gaps once, and a gap from the last low-water mark."""
    folder, store = _journal(spark, _m(spark, d), close=False), Store(spark, _scratch(spark))
    told, again = journal.recover(store, folder), journal.recover(store, folder)
    crash = store.gaps_between(0, 1 << 62).filter("reason = 2").first()
    return _facts(spark, rows=store.rows().count(), events=told["events"], again=again["frames"], gaps=store.stats()["gaps"], crash_from=crash["from_ts"], crash_to=crash["to_ts"])


STAGED = 40
_CAPTURE = f""", q AS (SELECT user_id % 2 AS producer, ts, seq, w, x, CASE WHEN event_id % 31 = 0 THEN y + 5000 ELSE y END AS y, z, b, CASE WHEN event_id % 17 = 0 THEN NULL ELSE a END AS a, actor, CASE WHEN event_id % 41 = 0 THEN 300 ELSE cause END AS cause, kind, ts * 65536 + seq AS o FROM m),
t AS (SELECT *, CASE WHEN y NOT BETWEEN -2048 AND 2047 THEN 'out_of_range' WHEN cause > 255 THEN 'invalid' WHEN actor % 7 = 0 THEN 'unregistered' END AS lost FROM q),
g AS (SELECT producer, ts // {TICK} AS tick, w, x, y, z, arg_min(b, o) AS b, arg_max({{'a': a}}, o).a AS a, count(*) AS observations, count(DISTINCT (actor, cause, kind)) > 1 AS ambiguous, min(ts) AS from_ts, max(ts) AS to_ts, min(o) AS first FROM t WHERE lost IS NULL GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY producer, tick ORDER BY first, w, x, y, z) AS place FROM g),
u AS (SELECT CASE WHEN place > {STAGED} THEN 'overflow' WHEN a IS NULL THEN 'unreadable' WHEN a = b THEN 'rejected' WHEN ambiguous THEN 'ambiguous' ELSE 'published' END AS outcome, observations, from_ts, to_ts FROM p
  UNION ALL SELECT lost, 1, ts, ts FROM t WHERE lost IS NOT NULL),
l AS (SELECT * FROM u WHERE outcome NOT IN ('published', 'rejected'))"""


def _captured(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return _m(spark, d).select((F.col("user_id") % 2).alias("producer"), "ts", "seq", "w", "x", F.when(n % 31 == 0, F.col("y") + 5000).otherwise(F.col("y")).alias("y"), "z", "b", F.when(n % 17 != 0, F.col("a")).alias("a"), "actor", F.when(n % 41 == 0, 300).otherwise(F.col("cause")).alias("cause"), "kind")


def _capture(spark: SparkSession, d: str) -> ingest.Capture:
    known = _m(spark, d).filter("actor % 7 <> 0").select(F.col("actor").alias("id")).distinct()
    return ingest.Capture(TICK, STAGED, known, spark.createDataFrame([(0,), (1,), (2,)], "id int"))


@query(_CAPTURE + " SELECT outcome, CAST(sum(observations) AS BIGINT) AS observations, min(from_ts) AS from_ts, max(to_ts) AS to_ts FROM u GROUP BY 1")
def capture_losses(spark, d):
    """What becomes of captured rows: losses by cause, in observations."""
    capture = _capture(spark, d)
    return capture.counted(capture.outcomes(_captured(spark, d)))


@query(_CAPTURE + " SELECT (SELECT count(*) FROM u WHERE outcome = 'published') AS stored, CAST((SELECT sum(observations) FROM l) AS BIGINT) AS dropped, (SELECT min(from_ts) FROM l) AS from_ts, (SELECT max(to_ts) FROM l) AS to_ts, 1 AS reason, CAST(1 AS BIGINT) AS gaps")
def stream_losses(spark, d):
    """A stream through the consumer, twice from one checkpoint: rows, and one gap over all that was lost, in one snapshot."""
    folder, store = _scratch(spark), Store(spark, _scratch(spark))
    _captured(spark, d).coalesce(1).write.parquet(f"{folder}/in")
    schema, consumer = spark.read.parquet(f"{folder}/in").schema, ingest.Consumer(store, _capture(spark, d))
    for _ in range(2):
        consumer.start(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/checkpoint").awaitTermination()
    found = store.gaps_between(0, 1 << 62)
    gap = found.first()
    return spark.createDataFrame([(store.rows().count(), gap["dropped"], gap["from_ts"], gap["to_ts"], gap["reason"], found.count())], "stored bigint, dropped bigint, from_ts bigint, to_ts bigint, reason int, gaps bigint")


@query(", s AS (SELECT CAST(event_id % 2 AS INTEGER) AS slot, event_id AS n, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) - 1 AS k FROM m) SELECT slot, n, CAST(5 AS BIGINT) AS now, CAST(5 + least(k // 1024, 2) AS BIGINT) AS ts, CAST(CASE WHEN k < 3072 THEN k % 1024 ELSE 1023 END AS INTEGER) AS counter, k < 3072 AS ok FROM s")
def slot_clock_overflow(spark, d):
    """A clock that never moves: the count rises, the time runs ahead by two, then all is refused."""
    return ingest.stamp_slots(_m(spark, d).select((F.col("event_id") % 2).cast("int").alias("slot"), F.col("event_id").alias("n"), F.lit(5).cast("bigint").alias("now")), 2)


@query(_says(taken="16", refused="84", lost="84", lost_from="SELECT min(ts) FROM m WHERE event_id BETWEEN 16 AND 99", lost_to="SELECT max(ts) FROM m WHERE event_id BETWEEN 16 AND 99", in_order="1", after_restart="11", left="0"))
def bounded_spool(spark, d):
    """A hundred records offered to a spool of sixteen, of which five are taken before a restart."""
    folder = _scratch(spark).removeprefix("file://").removeprefix("file:")
    rows = [(r["ts"], r["event_id"]) for r in _m(spark, d).filter("event_id < 100").orderBy("event_id").select("ts", "event_id").collect()]
    spool, seen = Spool(folder), []
    said = [spool.offer(ts, b"%d" % n) for ts, n in rows]
    spool.drain(lambda ts, data: seen.append(int(data)), 5)
    spool = Spool(folder)
    waiting = len(spool)
    spool.drain(lambda ts, data: seen.append(int(data)))
    lost, low, high = spool.losses()
    return _facts(spark, taken=said.count(TAKEN), refused=said.count(FULL), lost=lost, lost_from=low, lost_to=high, in_order=seen == list(range(16)), after_restart=waiting, left=len(spool))


@query(" SELECT w, CASE WHEN w = 0 THEN min(ts) WHEN w = 1 THEN least(min(ts), max(ts) - 5000) ELSE max(ts) END AS from_ts, greatest(max(ts), CASE WHEN w = 2 THEN max(ts) + 7 ELSE 0 END) + 1000 AS to_ts FROM m GROUP BY w")
def crash_gap(spark, d):
    """By world: the window that a stop may have cost, from a low-water mark where there is one."""
    facts = _m(spark, d).groupBy("w").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    mark = F.when(F.col("w") == 0, F.col("lo")).when(F.col("w") == 1, F.least("lo", F.col("hi") - 5000)).otherwise(0)
    newest = F.when(F.col("w") == 2, F.col("hi") + 7).otherwise(0)
    return facts.select("w", *[v.alias(n) for n, v in gaps.crash_gaps(mark, F.col("hi"), newest).items()])


@query(" SELECT event_id, x * 2000000 BETWEEN -33554432 AND 33554431 AND y * 400 BETWEEN -2048 AND 2047 AND z BETWEEN -33554432 AND 33554431 AS ok FROM m")
def position_in_range(spark, d):
    return _m(spark, d).select("event_id", (F.col("x") * 2000000).alias("x"), (F.col("y") * 400).alias("y"), "z").select("event_id", codec.in_range("x", "y", "z").alias("ok"))


@query(" SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'out_of_range' WHEN event_id % 7 IN (0, 1, 2) OR event_id % 11 = 0 THEN 'invalid' END AS why FROM m")
def field_validity(spark, d):
    """Why rows are not recorded: positions first, then world, cause, kind and state; null is out of range."""
    n = F.col("event_id")
    put = lambda name, bad, value: F.when(bad, F.lit(value).cast("int")).otherwise(F.col(name)).alias(name)
    rows = _m(spark, d).select("event_id", put("x", n % 5 == 0, 40_000_000), "y", "z", put("w", n % 7 == 0, 4096), put("cause", n % 7 == 1, 256), put("kind", n % 7 == 2, 16), put("b", n % 11 == 0, None))
    return rows.select("event_id", fold.invalid().alias("why"))


@query(f"{_CLASS}, c AS (SELECT w, c, CAST(sum(n) AS BIGINT) AS scanned, CAST(1 AS BIGINT) AS chunks, {_COUNTS} FROM k GROUP BY w, c) SELECT w, CAST(sum(s * scanned) AS BIGINT) AS scanned, CAST(sum(s * chunks) AS BIGINT) AS chunks, CAST(sum(s * applied) AS BIGINT) AS applied, CAST(sum(s * already) AS BIGINT) AS already, CAST(sum(s * mismatched) AS BIGINT) AS mismatched FROM (SELECT *, CASE WHEN c % 3 = 0 THEN -1 ELSE 1 END AS s FROM c) GROUP BY w")
def rollback_progress(spark, d):
    """Counters of steps, some of them taken off again."""
    rows = _m(spark, d)
    steps = fold.by_chunk(fold.classify(fold.fold(select(rows, PLAN)), mutations.world_state(rows))).withColumns({"chunks": F.lit(1).cast("bigint"), "less": F.col("c") % 3 == 0})
    return fold.progress(steps, ["w"], [n for n in COUNTERS if n != "contended"])


@query(f"{_STATE}, f AS (SELECT w, x, y, z, arg_max(a, ts * 65536 + seq) AS expected, arg_min(b, ts * 65536 + seq) AS target, count(*) AS n FROM m WHERE w = 1 AND {_WIN} GROUP BY ALL) SELECT CASE WHEN st.state = target THEN 'already' WHEN st.state = expected AND target <> 3 THEN 'applied' ELSE 'mismatched' END AS outcome, count(*) AS n FROM f LEFT JOIN st USING (w, x, y, z) GROUP BY 1")
def classify_unknown_states(spark, d):
    """A target that the world can't be given is mismatched."""
    rows = _m(spark, d)
    states = rows.select(F.col("a").alias("state")).distinct().filter("state <> 3").unionByName(spark.createDataFrame([(0,)], "state int"))
    told = fold.classify(fold.fold(rows.filter((F.col("w") == 1) & (F.col("ts") >= FROM) & (F.col("ts") < TO))), mutations.world_state(rows), states)
    return told.groupBy("outcome").agg(F.count("*").alias("n"))


@query(" SELECT event_type AS name, count(*) AS value, max(value) AS most FROM events GROUP BY 1", start="")
def json_report(spark, d):
    """Metrics that went through JSON documents."""
    path = f"{_scratch(spark)}/json"
    e = spark.read.parquet(f"{d}/events.parquet")
    e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"), F.max("value").alias("most")).write.json(path)
    lines = spark.read.text(path)
    lines.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.text(f"{path}-list")
    return reports.read_json(spark, f"{path}-list").select("name", F.col("value").cast("bigint").alias("value"), F.col("most").cast("double").alias("most"))


@query(" SELECT 'suite ' || (event_id // 50) AS name, count(*) AS tests, count(*) FILTER (a = 0) AS failures, count(*) FILTER (a = 0) = 0 AS passed FROM m GROUP BY 1")
def xml_suites(spark, d):
    """Test suites that went through XML files, and whether each passed."""
    path = f"{_scratch(spark)}/xml"
    rows = _m(spark, d).groupBy(F.concat(F.lit("suite "), F.floor(F.col("event_id") / 50).cast("string")).alias("_name"))
    rows = rows.agg(F.count("*").cast("int").alias("_tests"), F.count_if(F.col("a") == 0).cast("int").alias("_failures"), F.lit(0).alias("_errors"), F.lit(0).alias("_skipped"))
    rows.write.format("xml").option("rowTag", "testsuite").option("rootTag", "testsuites").save(path)
    return reports.read_suites(spark, path).select("name", F.col("tests").cast("bigint").alias("tests"), F.col("failures").cast("bigint").alias("failures"), reports.suite_passed().alias("passed"))


@query(", t AS (SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS value FROM m GROUP BY 1) SELECT x.name, x.\"limit\", t.value, CASE WHEN x.control THEN CASE WHEN t.value IS NULL THEN 'missing' WHEN t.value < 16 THEN 'violation' ELSE 'ok' END WHEN t.value IS NULL THEN 'missing' WHEN t.value > x.\"limit\" THEN 'violation' ELSE 'ok' END AS verdict FROM (VALUES ('view', 0.01, false), ('none', 0.01, false), ('click', NULL, true), ('nothing', NULL, true)) AS x(name, \"limit\", control) LEFT JOIN t ON t.name = x.name")
def gate_controls(spark, d):
    """Limits, and controls that must show something."""
    measured = _m(spark, d).groupBy(F.col("event_type").alias("name")).agg(F.count("*").cast("double").alias("value"))
    out = reports.gate(spark.createDataFrame([("view", 0.01), ("none", 0.01)], "name string, limit double"), measured, spark.createDataFrame([("click",), ("nothing",)], "name string"))
    return out.withColumn("limit", F.col("limit").cast("decimal(3,2)"))


@query(" SELECT DISTINCT CAST(actor AS INTEGER) AS id, 'name ' || actor AS name FROM m WHERE actor % 2 = 0")
def dictionary_file(spark, d):
    """Names that a file was replaced by, read again."""
    path = f"{_scratch(spark)}/names"
    rows = _m(spark, d).select(F.col("actor").alias("id"), F.concat(F.lit("name "), F.col("actor").cast("string")).alias("name")).distinct()
    dictionary.replace(spark, path, rows)
    dictionary.replace(spark, path, rows.filter("id % 2 = 0"))
    return dictionary.load(spark, path).select("id", "name")


@query(", s AS (SELECT 'u' || (user_id % 50) AS uuid, 'n' || (event_id % 7) AS name, ts FROM m), l AS (SELECT uuid, arg_max(name, {'t': ts, 'n': name}) AS name FROM s GROUP BY 1), k AS (SELECT CAST(16 + i AS INTEGER) AS id, 'u' || i AS uuid FROM range(10) t(i)), f AS (SELECT uuid, name FROM l WHERE uuid NOT IN (SELECT uuid FROM k)) SELECT id, k.uuid, coalesce(l.name, 'old') AS name FROM k LEFT JOIN l USING (uuid) UNION ALL SELECT CAST(25 + row_number() OVER (ORDER BY uuid) AS INTEGER), uuid, name FROM f")
def register_actors(spark, d):
    """Players by their latest names: known ones keep their ids, new ones get the next."""
    seen = _m(spark, d).select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("uuid"), F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string")).alias("name"), F.col("ts").alias("at"))
    known = spark.range(10).select((F.col("id") + 16).cast("int").alias("id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("uuid"), F.lit("old").alias("name"))
    return dictionary.register(seen, known)


@query(" SELECT g, CASE g WHEN 1 THEN 'OVERFLOW' WHEN 2 THEN 'CRASH_WINDOW' WHEN 3 THEN 'QUARANTINE' WHEN 4 THEN 'NOT_CAPTURED' WHEN 5 THEN 'EXPIRED' ELSE 'PURGED' END AS reason, CASE LEAST(g, 5) WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'DONE' WHEN 3 THEN 'PARTIAL' WHEN 4 THEN 'FAILED' ELSE 'CANCELLED' END AS state, CASE WHEN g < 4 THEN CASE g WHEN 1 THEN 'BREAKING' WHEN 2 THEN 'PLACING' ELSE 'ROLLBACK' END ELSE 'UNKNOWN' END AS cause FROM (SELECT DISTINCT CAST(event_id % 6 + 1 AS INTEGER) AS g FROM m)")
def enum_decode(spark, d):
    """Names of reasons and states, of which an unknown id raises, and of causes, where it is UNKNOWN."""
    g = _m(spark, d).select((F.col("event_id") % 6 + 1).cast("int").alias("g")).distinct()
    return g.select("g", dictionary.strictly(REASONS, F.col("g")).alias("reason"), dictionary.strictly(STATES, F.least("g", F.lit(5))).alias("state"), dictionary.named(CAUSES, F.col("g"), F.lit("UNKNOWN")).alias("cause"))


@query(_says(refused="2", plan_first="1", exclusions_literal="1"))
def exclusion_strategies(spark, d):
    """The three ways of exclusions keep the same rows, and none meets the history in a nested loop."""
    rows = _m(spark, d).select(*_EVENT)
    own = rows.filter("actor % 5 = 0").select("actor").distinct().select("actor", F.lit(FROM).alias("from_ts"), F.lit(FROM + 3 * DAY).alias("to_ts"))
    ways = [gaps.without_excluded(rows, own, *limits) for limits in ((10**6, 0), (0, 10**6), (0, 0))]
    counts = {w.count() for w in ways}
    plans = [w._jdf.queryExecution().executedPlan().toString() for w in ways]
    return _facts(spark, refused=2 if len(counts) == 1 else 0, plan_first=not any("NestedLoop" in p for p in plans), exclusions_literal="Join" not in plans[0])
