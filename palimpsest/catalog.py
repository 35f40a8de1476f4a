"""All queries of the engine, each with the SQL that says the same without it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec, digest, geometry
from palimpsest.functions.geometry import Box
from palimpsest.operators import dictionary, fold, gaps, reports
from palimpsest.operators.rollback import COUNTERS, Rollbacks
from palimpsest.plans.scan_plan import NEWEST, ScanPlan, page, scan, select
from palimpsest.schema import CAUSES, KEY, KINDS, MUTATION, POSITION
from palimpsest.sources import mutations
from palimpsest.sources.store import Store
from palimpsest.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FROM, TO, DAY, TICK = 1768089600000, 1769385600000, 86400000, 432000000
PLAN = ScanPlan(1, Box(-20, -6, -18, 10, 3, 19), FROM, TO)
WIDE = ScanPlan(1, Box(-2000, -64, -1500, 1999, 320, 900), 1_700_000_000_000, 1_900_000_000_000, most_ranges=1)  # c is computed here: each range repeats its expression
_EVENT = ["w", "c", "ts", "seq", "x", "y", "z", "b", "a", "actor", "cause", "kind"]


def _morton_sql(x: str, z: str) -> str:
    return " + ".join(f"((({x} + 2097152) >> {i}) & 1) * {1 << 2 * i} + ((({z} + 2097152) >> {i}) & 1) * {1 << 2 * i + 1}" for i in range(22))


_C = f"CAST({_morton_sql('CAST(x >> 4 AS BIGINT)', 'CAST(z >> 4 AS BIGINT)')} AS BIGINT)"
M = f"""WITH e AS (SELECT event_id, event_type, user_id, props, CAST(epoch_us(ts) // 1000 + 63158400000 AS BIGINT) AS ts, CAST(event_id % 65536 AS INTEGER) AS seq,
  CAST(user_id + 16 AS INTEGER) AS actor, CAST(user_id % 3 AS INTEGER) AS w, CAST((event_id * 7) % 40 - 20 AS INTEGER) AS x, CAST((user_id * 5) % 12 - 6 AS INTEGER) AS y,
  CAST((event_id * 11) % 40 - 20 AS INTEGER) AS z, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS a FROM events),
m AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY w, x, y, z ORDER BY ts, seq), 0) AS b, 1 AS kind, CASE WHEN a = 0 THEN 1 ELSE 2 END AS cause, {_C} AS c FROM e)"""
_WIN = f"ts >= {FROM} AND ts < {TO}"
_BOX = f"w = 1 AND x BETWEEN -20 AND 10 AND y BETWEEN -6 AND 3 AND z BETWEEN -18 AND 19 AND {_WIN}"
_COLS = ", ".join(_EVENT)
_STATE = ", st AS (SELECT w, x, y, z, CASE WHEN event_id % 17 = 0 THEN 9 ELSE a END AS state FROM (SELECT *, row_number() OVER (PARTITION BY w, x, y, z ORDER BY ts DESC, seq DESC) AS rn FROM m) WHERE rn = 1)"
_FOLD = f", f AS (SELECT w, x, y, z, c, arg_max(a, ts * 65536 + seq) AS expected, arg_min(b, ts * 65536 + seq) AS target, count(*) AS n FROM m WHERE {_BOX} GROUP BY ALL)"
_CLASS = f"{_STATE}{_FOLD}, k AS (SELECT f.*, st.state, CASE WHEN st.state = target THEN 'already' WHEN st.state = expected THEN 'applied' ELSE 'mismatched' END AS outcome FROM f LEFT JOIN st USING (w, x, y, z))"
_GAPS = ", g AS (SELECT ts AS from_ts, ts + 300000 AS to_ts, CAST(event_id % 6 + 1 AS INTEGER) AS reason, CAST(1 AS BIGINT) AS dropped FROM m WHERE event_type = 'error')"
_COUNTS = "count(*) FILTER (outcome = 'applied') AS applied, count(*) FILTER (outcome = 'already') AS already, count(*) FILTER (outcome = 'mismatched') AS mismatched"


def query(sql: str | None = None, start: str | None = None):
    """Registers a query, and its SQL after the common tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (M if start is None else start) + sql
        return f

    return add


def _m(spark: SparkSession, d: str) -> DataFrame:
    return mutations.from_events(spark, d)


def _classified(spark: SparkSession, d: str) -> DataFrame:
    rows = _m(spark, d)
    return fold.classify(fold.fold(select(rows, PLAN)), mutations.world_state(rows))


@query(f" SELECT {_COLS} FROM m")
def mutation_log(spark, d):
    return _m(spark, d).select(*_EVENT)


def _packed(x, y, z):
    return f"(({x} * 274877906944) + (({z} & 67108863) * 4096) + ({y} & 4095))"


@query(f" SELECT w, ts, seq, CAST({_packed('CAST(x AS BIGINT)', 'CAST(y AS BIGINT)', 'CAST(z AS BIGINT)')} AS BIGINT) AS packed, x, y, z FROM m")
def codec_position_roundtrip(spark, d):
    rows = _m(spark, d).select("w", "ts", "seq", codec.pack_position("x", "y", "z").alias("packed"))
    return rows.select("*", *[c.alias(n) for n, c in codec.unpack_position("packed").items()])


@query(" SELECT w, ts, seq, CAST(b AS BIGINT) * 1099511627776 + CAST(a AS BIGINT) * 65536 + seq AS packed, b, a, seq AS aux FROM m")
def codec_states_roundtrip(spark, d):
    rows = _m(spark, d).select("w", "ts", "seq", codec.pack_states("b", "a", "seq").alias("packed"))
    return rows.select("*", *[c.alias(n) for n, c in codec.unpack_states("packed").items()])


@query(f" SELECT w, seq, (ts - {codec.EPOCH}) * 16777216 + actor AS packed, ts - {codec.EPOCH} AS relative, actor AS actor_low, true AS representable FROM m")
def codec_actor_time_roundtrip(spark, d):
    rows = _m(spark, d).select("w", "seq", codec.pack_actor_time(codec.relative("ts"), "actor").alias("packed"), codec.representable("ts").alias("representable"))
    return rows.select("*", *[c.alias(n) for n, c in codec.unpack_actor_time("packed").items()])


@query(" SELECT ts, CAST(seq - CASE WHEN seq >= 32768 THEN 65536 ELSE 0 END AS BIGINT) * 281474976710656 + CAST(w AS BIGINT) * 68719476736 + CAST(cause AS BIGINT) * 268435456 + kind * 16777216 AS packed, seq, w, cause, kind, 0 AS actor_high, actor FROM m")
def codec_metadata_roundtrip(spark, d):
    rows = _m(spark, d).select("ts", codec.pack_metadata("seq", "w", "cause", "kind", "actor").alias("packed"), "actor")
    parts = codec.unpack_metadata("packed")
    return rows.select("ts", "packed", *[c.alias(n) for n, c in parts.items()], codec.actor_id(parts["actor_high"], F.col("actor")).alias("actor"))


@query(f" SELECT DISTINCT x >> 4 AS cx, z >> 4 AS cz, c FROM m")
def morton_key(spark, d):
    return _m(spark, d).select(geometry.chunk("x").alias("cx"), geometry.chunk("z").alias("cz"), "c").distinct()


@query(" SELECT DISTINCT c, x >> 4 AS cx, z >> 4 AS cz FROM m")
def morton_inverse(spark, d):
    return _m(spark, d).select("c").distinct().select("c", *[v.alias(n) for n, v in geometry.unmorton("c").items()])


@query(" SELECT w, ts, seq, (x & 15) * 65536 + (z & 15) * 4096 + (y + 2048) AS p, x, y, z FROM m")
def local_position(spark, d):
    rows = _m(spark, d).select("w", "ts", "seq", "c", geometry.local("x", "y", "z").alias("p"))
    return rows.select("w", "ts", "seq", "p", *[v.alias(n) for n, v in geometry.from_local("c", "p").items()])


@query(" SELECT w, ts * 65536 + seq AS k, ts, seq, CAST(seq & 63 AS INTEGER) AS slot FROM m")
def time_key(spark, d):
    rows = _m(spark, d).select("w", codec.stamp("ts", "seq").alias("k"))
    return rows.select("*", *[v.alias(n) for n, v in codec.unstamp("k").items()])


@query(f" SELECT {_COLS} FROM m WHERE {_BOX}")
def scan_box_oldest(spark, d):
    return scan(_m(spark, d), PLAN).select(*_EVENT)


@query(f" SELECT {_COLS} FROM m WHERE {_BOX} ORDER BY c DESC, ts DESC, seq DESC LIMIT 50")
def scan_box_newest_page(spark, d):
    return page(_m(spark, d), ScanPlan(1, PLAN.box, FROM, TO, NEWEST, batch=50)).select(*_EVENT)


@query(f" SELECT {_COLS} FROM m WHERE {_BOX} AND actor IN (17, 20, 35, 71)")
def scan_actor_filter(spark, d):
    return scan(_m(spark, d), PLAN.with_actors(17, 20, 35, 71)).select(*_EVENT)


_RESUME = (geometry.morton_int(-1, 0), 1768700000000, 7)


@query(f" SELECT {_COLS} FROM m WHERE {_BOX} AND (c > {_RESUME[0]} OR (c = {_RESUME[0]} AND (ts > {_RESUME[1]} OR (ts = {_RESUME[1]} AND seq > {_RESUME[2]}))))")
def scan_resume_after(spark, d):
    return scan(_m(spark, d), PLAN.resume_after(_RESUME)).select(*_EVENT)


_L = f"""WITH r AS (SELECT CAST(l_suppkey % 3 AS INTEGER) AS w, CAST((l_partkey * 7919 + l_orderkey * 31) % 8192 - 4096 AS INTEGER) AS x, CAST((l_suppkey * 13 + l_linenumber) % 384 - 64 AS INTEGER) AS y,
  CAST((l_orderkey * 6151 + l_partkey * 17) % 8192 - 4096 AS INTEGER) AS z, CAST(epoch_us(l_shipdate) // 1000 + (l_orderkey * 8 + l_linenumber) % 86400000 + 1000000000000 AS BIGINT) AS ts,
  CAST((l_orderkey * 8 + l_linenumber) % 65536 AS INTEGER) AS seq, CAST(l_suppkey % 100 + 16 AS INTEGER) AS actor, CAST(trunc(l_quantity) AS INTEGER) AS b, CAST(trunc(l_quantity) + l_linenumber AS INTEGER) AS a, 2 AS cause, 1 AS kind FROM lineitem),
m AS (SELECT *, {_C} AS c FROM r)"""


@query(f" SELECT {_COLS} FROM m WHERE w = 1 AND x BETWEEN -2000 AND 1999 AND z BETWEEN -1500 AND 900 AND y BETWEEN -64 AND 320 AND ts >= 1700000000000 AND ts < 1900000000000", start=_L)
def scan_wide_coarse(spark, d):
    return scan(mutations.from_lineitem(spark, d), WIDE).select(*_EVENT)


@query(f" SELECT {_COLS}, ts < {1767225600000 + 20 * DAY} AS sealed FROM m")
def hot_sealed_union(spark, d):
    rows, cut = _m(spark, d).select(*_EVENT), 1767225600000 + 20 * DAY
    return rows.filter(F.col("ts") < cut).withColumn("sealed", F.lit(True)).unionByName(rows.filter(F.col("ts") >= cut).withColumn("sealed", F.lit(False))).orderBy("c", "ts", "seq")


@query(f"{_FOLD} SELECT * FROM f")
def rollback_plan(spark, d):
    return fold.fold(select(_m(spark, d), PLAN))


@query(f"{_CLASS} SELECT * FROM k")
def rollback_classify(spark, d):
    return _classified(spark, d)


@query(f"{_CLASS} SELECT CAST(sum(n) AS BIGINT) AS scanned, count(DISTINCT (w, c)) AS chunks, {_COUNTS} FROM k")
def rollback_summary(spark, d):
    return fold.summary(_classified(spark, d))


@query(f"{_CLASS} SELECT w, c, CAST(sum(n) AS BIGINT) AS scanned, {_COUNTS} FROM k GROUP BY w, c")
def rollback_by_chunk(spark, d):
    return fold.by_chunk(_classified(spark, d))


@query(f"{_CLASS} SELECT w, c, CAST({TO} AS BIGINT) AS ts, CAST(row_number() OVER (PARTITION BY w, c ORDER BY x, y, z) - 1 AS INTEGER) AS seq, x, y, z, expected AS b, target AS a, 1 AS actor, 3 AS cause, 1 AS kind FROM k WHERE outcome = 'applied'")
def rollback_writes(spark, d):
    return fold.writes(_classified(spark, d), TO)


def _refs(rows: DataFrame) -> DataFrame:
    own = rows.filter("event_id % 10 = 0")
    return own.select(*KEY, "actor", digest.blob_id(F.lit(7), F.col("props").cast("binary")).alias("blob_id"))


@query(" SELECT w, count(*) FILTER (kind <> 1) AS other_kind, count(*) FILTER (event_id % 10 = 0) AS with_payload, count(*) AS rows FROM m GROUP BY w")
def rollback_preflight(spark, d):
    rows = _m(spark, d)
    return fold.preflight(rows, _refs(rows))


@query(""", ch AS (SELECT w, c, min(ts * 65536 + seq) AS o, count(*) AS n, max(CASE WHEN event_id % 401 = 0 THEN 1 ELSE 0 END) AS bad FROM m GROUP BY w, c),
s AS (SELECT w, max(c) AS stop FROM ch WHERE bad = 1 GROUP BY w),
o AS (SELECT ch.* FROM ch LEFT JOIN s USING (w) WHERE stop IS NULL OR c > stop)
SELECT w, min(c) AS c, CAST(arg_min(o, c) // 65536 AS BIGINT) AS ts, CAST(arg_min(o, c) % 65536 AS INTEGER) AS seq, CAST(sum(n) AS BIGINT) AS scanned FROM o GROUP BY w""")
def rollback_checkpoint(spark, d):
    rows = _m(spark, d)
    return fold.checkpoint(rows, rows.filter("event_id % 401 = 0").select("w", "c").distinct())


@query(f" SELECT w, x, y, z, arg_max(a, ts * 65536 + seq) AS state FROM m WHERE ts <= {TO} GROUP BY ALL")
def state_as_of(spark, d):
    return fold.state_as_of(_m(spark, d), TO)


_NET = f", n AS (SELECT ts // {TICK} AS tick, w, x, y, z, arg_min(b, ts * 65536 + seq) AS b, arg_max(a, ts * 65536 + seq) AS a, count(*) AS observations, count(DISTINCT (actor, cause, kind)) > 1 AS ambiguous, arg_min(actor, ts * 65536 + seq) AS actor FROM m GROUP BY ALL)"


@query(f"{_NET} SELECT * FROM n")
def capture_net_change(spark, d):
    return fold.net_changes(_m(spark, d), TICK)


@query(f"{_NET} SELECT CASE WHEN a = b THEN 'rejected' WHEN ambiguous THEN 'lost' ELSE 'published' END AS outcome, CAST(sum(observations) AS BIGINT) AS observations, count(*) AS groups FROM n GROUP BY 1")
def capture_outcomes(spark, d):
    return fold.outcomes(fold.net_changes(_m(spark, d), TICK))


@query(f"{_GAPS} SELECT * FROM g WHERE from_ts <= {TO} AND to_ts >= {FROM}")
def gap_overlap(spark, d):
    return gaps.overlapping(mutations.gaps(_m(spark, d)), FROM, TO)


@query(f"{_GAPS}, v AS (SELECT DISTINCT (ts // {DAY}) * {DAY} AS from_ts FROM m) SELECT v.from_ts, v.from_ts + {DAY} AS to_ts, count(g.reason) AS gaps, count(g.reason) FILTER (g.reason IN (3, 5, 6)) > 0 AS refused FROM v LEFT JOIN g ON g.from_ts <= v.from_ts + {DAY} AND g.to_ts >= v.from_ts GROUP BY v.from_ts")
def gap_refused_windows(spark, d):
    rows = _m(spark, d)
    days = rows.select((F.floor(F.col("ts") / DAY) * DAY).alias("day")).distinct()
    # a gap touches the days from the one before its start, whose end is inclusive, to that of its end
    g = mutations.gaps(rows).withColumn("day", F.explode(F.sequence(F.ceil(F.col("from_ts") / DAY) - 1, F.floor(F.col("to_ts") / DAY)))).withColumn("day", F.col("day") * DAY)
    out = days.join(g, "day", "left").groupBy("day").agg(F.count("reason").alias("gaps"), (F.count_if(F.col("reason").isin(3, 5, 6)) > 0).alias("refused"))
    return out.select(F.col("day").alias("from_ts"), (F.col("day") + DAY).alias("to_ts"), "gaps", "refused")


@query(f"{_GAPS} SELECT event_id, ts FROM m WHERE event_id % 23 = 0 AND NOT EXISTS (SELECT 1 FROM g WHERE m.ts BETWEEN g.from_ts AND g.to_ts)")
def gap_uncovered_losses(spark, d):
    rows = _m(spark, d)
    stored = rows.filter("event_id % 23 <> 0").select("event_id")
    return gaps.uncovered(rows.join(stored, "event_id", "left_anti"), mutations.gaps(rows)).select("event_id", "ts")


_EXCLUDED = f"(actor % 5 = 0 AND ts >= {FROM} AND ts < {FROM + 3 * DAY}) OR (ts >= {TO} AND ts < {TO + 3600000})"


@query(f" SELECT {_COLS} FROM m WHERE NOT ({_EXCLUDED})")
def exclusion_filtered(spark, d):
    rows = _m(spark, d)
    own = rows.filter("actor % 5 = 0").select("actor").distinct().select("actor", F.lit(FROM).alias("from_ts"), F.lit(FROM + 3 * DAY).alias("to_ts"))
    every = spark.createDataFrame([(None, TO, TO + 3600000)], "actor int, from_ts bigint, to_ts bigint")
    return gaps.without_excluded(rows.select(*_EVENT), own.unionByName(every))


@query(f" SELECT {_COLS} FROM m WHERE NOT (actor = 20 AND {_WIN})")
def purge_actor(spark, d):
    return gaps.without_excluded(_m(spark, d).select(*_EVENT), spark.createDataFrame([(20, FROM, TO)], "actor int, from_ts bigint, to_ts bigint"))


@query(f" SELECT {_COLS} FROM m WHERE ts >= {FROM}")
def expire_before(spark, d):
    return gaps.without_excluded(_m(spark, d).select(*_EVENT), spark.createDataFrame([(None, -(1 << 62), FROM)], "actor int, from_ts bigint, to_ts bigint"))


def _shards(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.floor((F.col("ts") - 1767225600000) / DAY).cast("int").alias("id")).agg(F.count("*").alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min(F.expr(fold.ORDER)).alias("min_k"), F.max(F.expr(fold.ORDER)).alias("max_k"))


_SHARDS = f", s AS (SELECT CAST((ts - 1767225600000) // {DAY} AS INTEGER) AS id, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts, min(ts * 65536 + seq) AS min_k, max(ts * 65536 + seq) AS max_k FROM m GROUP BY 1)"


@query(f"{_SHARDS} SELECT * FROM s")
def shard_stats(spark, d):
    return _shards(_m(spark, d))


@query(f"{_SHARDS} SELECT id, n FROM s WHERE max_ts >= {FROM} AND min_ts < {TO}")
def shard_prune(spark, d):
    return _shards(_m(spark, d)).filter((F.col("max_ts") >= FROM) & (F.col("min_ts") < TO)).select("id", "n")


@query(f"{_SHARDS}, t AS (SELECT id, n, CAST(sum(n) OVER (ORDER BY id) AS BIGINT) AS total FROM s) SELECT * FROM t WHERE total <= (SELECT sum(n) / 3 FROM s)")
def compaction_admission(spark, d):
    rows = _m(spark, d)
    return reports.admitted(_shards(rows).select("id", "n"), rows.count() // 3)


_BLOB = ", r AS (SELECT w, c, ts, seq, actor, event_id, props, sha256(unhex('00000007') || encode(props)) AS blob_id FROM m WHERE event_id % 10 = 0)"


@query(f"{_BLOB} SELECT blob_id, count(*) AS refs, min(ts) AS from_ts, max(ts) AS to_ts FROM r GROUP BY blob_id")
def blob_dedup(spark, d):
    return _refs(_m(spark, d)).groupBy("blob_id").agg(F.count("*").alias("refs"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


@query(f"{_BLOB} SELECT w, c, ts, seq, a, blob_id FROM m LEFT JOIN (SELECT w, c, ts, seq, blob_id FROM r WHERE actor % 5 <> 0) USING (w, c, ts, seq)")
def blob_refs(spark, d):
    rows = _m(spark, d)
    return rows.select(*KEY, "a").join(_refs(rows).filter("actor % 5 <> 0").select(*KEY, "blob_id"), KEY, "left")


@query(f"{_BLOB} SELECT DISTINCT blob_id FROM r WHERE blob_id NOT IN (SELECT blob_id FROM r WHERE ts >= {TO + 2 * DAY})")
def blob_unreferenced(spark, d):
    refs = _refs(_m(spark, d))
    return refs.select("blob_id").distinct().join(refs.filter(F.col("ts") >= TO + 2 * DAY).select("blob_id"), "blob_id", "left_anti")


def _hex(n: str) -> str:
    return f"lpad(hex(CAST({n} AS BIGINT)), 16, '0')"


_P = "((x & 15) * 65536 + (z & 15) * 4096 + y + 2048)"
_DIGEST = f", h AS (SELECT *, sha256(unhex({' || '.join(_hex(_P if n == 'p' else n) for n in digest.ROW)})) AS d FROM m)"


def _limb(k: int) -> str:
    return f"CAST(sum(CAST(('0x' || substr(d, {1 + 8 * k}, 8))::BIGINT AS HUGEINT)) AS BIGINT) AS l{k}"


@query(f"{_DIGEST} SELECT w, count(*) AS n, {', '.join(_limb(k) for k in range(4))} FROM h GROUP BY w")
def row_digest_limbs(spark, d):
    return digest.limbs(_m(spark, d), ["w"]).select("w", "n", *[F.col(f"l{k}").cast("bigint").alias(f"l{k}") for k in range(4)])


@query(f", h AS (SELECT w, c, ts, seq, {' || '.join(_hex(_P if n == 'p' else n) for n in digest.ROW)} AS r FROM m) SELECT w, count(*) AS n, sha256(unhex(string_agg(r, '' ORDER BY c, ts, seq) || {_hex('count(*)')})) AS digest FROM h GROUP BY w")
def ordered_digest(spark, d):
    return digest.ordered_digest(_m(spark, d), "w")


@query(f" SELECT 'same' AS what, true AS equal UNION ALL SELECT 'one less', false")
def digest_compare(spark, d):
    rows = _m(spark, d).select(*_EVENT)
    whole, again, less = digest.limbs(rows), digest.limbs(rows.repartition(7, "x").orderBy("y")), digest.limbs(rows.filter("not (seq = 5 and w = 0)").filter("seq <> 6"))
    both = lambda other, name: whole.unionByName(other).distinct().agg(F.lit(name).alias("what"), (F.count("*") == 1).alias("equal"))
    return both(again, "same").unionByName(both(less, "one less"))


@query(" SELECT DISTINCT actor, CASE actor WHEN 0 THEN '#unknown' WHEN 1 THEN '#engine' WHEN 2 THEN '#tests' ELSE CASE WHEN actor % 3 = 0 THEN 'user_' || (actor - 16) ELSE '#' || actor END END AS name FROM (SELECT actor FROM m UNION ALL SELECT unnest([0, 1, 2]))")
def actor_names(spark, d):
    known = _m(spark, d).filter("actor % 3 = 0").select("actor", F.concat(F.lit("user_"), (F.col("actor") - 16).cast("string")).alias("known")).distinct()
    rows = _m(spark, d).select("actor").unionByName(spark.createDataFrame([(0,), (1,), (2,)], "actor int")).distinct()
    return rows.join(known, "actor", "left").select("actor", dictionary.actor_name(F.col("actor"), F.col("known")).alias("name"))


@query(" SELECT cause, kind, CASE cause WHEN 1 THEN 'BREAKING' WHEN 2 THEN 'PLACING' ELSE 'UNKNOWN' END AS cause_name, 'BLOCK' AS kind_name, count(*) AS n FROM m GROUP BY ALL")
def cause_kind_decode(spark, d):
    names = [dictionary.named(CAUSES, F.col("cause"), F.lit("UNKNOWN")).alias("cause_name"), dictionary.named(KINDS, F.col("kind")).alias("kind_name")]
    return _m(spark, d).groupBy("cause", "kind").count().select("cause", "kind", *names, F.col("count").alias("n"))


@query(" SELECT CAST(15 + row_number() OVER (ORDER BY event_type) AS INTEGER) AS id, event_type AS name FROM (SELECT DISTINCT event_type FROM m)")
def dictionary_assign(spark, d):
    return dictionary.assign(_m(spark, d).select(F.col("event_type").alias("name")), spark.createDataFrame([], "id int, name string"))


@query(" SELECT w, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS dropped FROM m WHERE event_id % 23 = 0 GROUP BY w")
def loss_bounds(spark, d):
    return gaps.loss_bounds(_m(spark, d).filter("event_id % 23 = 0"), "w")


@query(" SELECT least((SELECT min(ts) FROM m WHERE w = 1), (SELECT min(ts) FROM m WHERE event_type = 'error')) AS low_water")
def low_watermark(spark, d):
    rows = _m(spark, d)
    return gaps.low_watermark(rows.filter("w = 1"), rows.filter("event_type = 'error'"))


@query(" SELECT w, CAST(count(*) FILTER (before IS NOT NULL AND before <> actor % 4) AS BIGINT) AS changes FROM (SELECT w, actor, lag(actor % 4) OVER (PARTITION BY w ORDER BY ts, seq) AS before FROM m) GROUP BY w")
def runs_in_log(spark, d):
    from pyspark.sql import Window as W

    rows = _m(spark, d).withColumn("salt", F.col("actor") % 4)
    return rows.withColumn("before", F.lag("salt").over(W.partitionBy("w").orderBy("ts", "seq"))).groupBy("w").agg(F.count_if(F.col("before") != F.col("salt")).alias("changes"))


@query(" SELECT CAST(quantile_disc(v, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(v, 0.99) AS BIGINT) AS p99, max(v) AS max, count(*) AS n FROM (SELECT CAST(floor(value * 100) AS BIGINT) AS v FROM events)", start="")
def percentiles_nearest_rank(spark, d):
    return reports.nearest_rank(spark.read.parquet(f"{d}/events.parquet").select(F.floor(F.col("value") * 100).cast("bigint").alias("v")), "v")


@query(" SELECT w, coalesce(CAST(max(n) FILTER (event_type = 'click') AS VARCHAR), 'not measured') AS click, coalesce(CAST(max(n) FILTER (event_type = 'none') AS VARCHAR), 'not measured') AS none, coalesce(CAST(max(n) FILTER (event_type = 'view') AS VARCHAR), 'not measured') AS view FROM (SELECT w, event_type, count(*) AS n FROM m GROUP BY ALL) GROUP BY w")
def report_pivot(spark, d):
    metrics = _m(spark, d).groupBy("w", F.col("event_type").alias("name")).agg(F.count("*").cast("string").alias("value"))
    return reports.pivot(metrics, "w", ["view", "click", "none"])


@query(" SELECT w, ts, seq FROM (SELECT w, ts, seq, row_number() OVER (PARTITION BY w ORDER BY ts DESC, seq DESC) AS rn FROM m) WHERE rn = 1")
def report_latest(spark, d):
    rows = _m(spark, d).select("w", "ts", "seq", F.expr(fold.ORDER).alias("k"))
    return reports.latest(rows, "w", "k").drop("k")


@query(" , t AS (SELECT event_type AS name, count(*) AS value FROM m GROUP BY 1), x AS (SELECT * FROM (VALUES ('view', 100), ('click', 1000000000), ('none', 5)) AS v(name, \"limit\")) SELECT name, \"limit\", value, CASE WHEN value IS NULL THEN 'missing' WHEN value > \"limit\" THEN 'violation' ELSE 'ok' END AS verdict FROM x LEFT JOIN t USING (name)")
def report_gate(spark, d):
    expected = spark.createDataFrame([("view", 100), ("click", 1000000000), ("none", 5)], "name string, limit int")
    return reports.gate(expected, _m(spark, d).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value")))


@query(f" SELECT event_type AS name, count(*) - count(*) FILTER (ts < {FROM}) AS delta FROM m GROUP BY 1 HAVING count(*) FILTER (ts < {FROM}) > 0")
def counter_delta(spark, d):
    rows = _m(spark, d)
    count = lambda r: r.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return reports.deltas(count(rows.filter(F.col("ts") < FROM)), count(rows))


@query(f" SELECT w, ts, seq, concat_ws(':', x, y, z, b, a, actor, cause, kind, ts, seq, c) AS line FROM m WHERE {_BOX}")
def row_dump(spark, d):
    return select(_m(spark, d), PLAN).select("w", "ts", "seq", reports.dumped(["x", "y", "z", "b", "a", "actor", "cause", "kind", "ts", "seq", "c"]).alias("line"))


@query(" SELECT max(n) AS peak, count(*) AS collections FROM (SELECT sum(user_id) AS n FROM events GROUP BY event_id // 100)", start="")
def peak_after_gc(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return reports.peak_after_gc(e.select(F.floor(F.col("event_id") / 100).alias("gc"), F.col("user_id").alias("bytes")))


@query(" SELECT event_id, ts * 65536 + seq AS stamp, ts, seq, CAST(seq % 64 AS INTEGER) AS slot FROM m")
def stamp_decode(spark, d):
    rows = _m(spark, d).select("event_id", codec.stamp(F.col("ts"), F.col("seq")).alias("stamp"))
    return rows.select("event_id", "stamp", *[v.alias(k) for k, v in codec.unstamp(F.col("stamp")).items()])


@query(" SELECT event_id, event_id % 100 * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1000 WHEN 'purchase' THEN 60000 WHEN 'signup' THEN 3600000 END AS ms FROM m")
def duration_parse(spark, d):
    """Durations in four units; those of other events have a unit that is none, and are null."""
    unit = dictionary.named({1: "ms", 2: "s", 3: "m", 4: "h"}, F.col("a"), F.lit("w"))
    return _m(spark, d).select("event_id", reports.duration_ms(F.concat((F.col("event_id") % 100).cast("string"), unit)).alias("ms"))


@query(" SELECT event_id, CAST(user_id AS BIGINT) AS seen, CAST(x + 20 AS BIGINT) AS lost, CAST(NULL AS BIGINT) AS absent FROM m")
def counter_extraction(spark, d):
    line = F.format_string("op=%s unseen=7 seen=%s published=%s lost=%s", F.col("event_type"), F.col("user_id"), F.col("seq"), F.col("x") + 20)
    rows = _m(spark, d).select("event_id", line.alias("line"))
    return rows.select("event_id", *[reports.counter(F.col("line"), name).alias(name) for name in ("seen", "lost", "absent")])


@query(""" SELECT event_id, CASE event_type WHEN 'view' THEN printf('%.1f MiB', (event_id * 1000 + 1) / 1048576.0) WHEN 'click' THEN printf('%.2f ms', (event_id * 10 + 3) / 1000.0)
  WHEN 'purchase' THEN CAST(event_id AS VARCHAR) WHEN 'signup' THEN 'not measured' ELSE printf('%.3f', event_id + 0.0) END AS shown FROM m""")
def metric_formats(spark, d):
    n = F.col("event_id")
    value = F.when(F.col("a") == 1, (n * 1000 + 1).cast("double")).when(F.col("a") == 2, (n * 10 + 3) / 1000.0).when(F.col("a") != 4, n.cast("double"))
    unit = dictionary.named({1: "bytes", 2: "ms", 3: "count"}, F.col("a"), F.lit("B/op"))
    return _m(spark, d).select("event_id", reports.formatted(value, unit).alias("shown"))


@query(" SELECT event_id // 20 AS run, count(*) FILTER (a <> 0) AS verified, count(*) AS total, coalesce(string_agg(CAST(user_id AS VARCHAR), ', ' ORDER BY event_id) FILTER (a <> 4), '') AS delays FROM m GROUP BY 1")
def crash_summary(spark, d):
    """Reports of twenty restarts, of which some have no delay."""
    rows = _m(spark, d).select(F.floor(F.col("event_id") / 20).alias("run"), "event_id", (F.col("a") != 0).alias("verified"), F.when(F.col("a") != 4, F.col("user_id")).alias("delay"))
    return reports.crash_summary(rows, "run", "event_id")


@query(" SELECT event_id // 20 AS run, count(*) FILTER (a = 4) AS lossy, CASE WHEN count(*) FILTER (a = 0) > 0 THEN 'failed' WHEN count(*) FILTER (a = 4) < 3 THEN 'vacuous' ELSE 'ok' END AS verdict FROM m GROUP BY 1")
def vacuity_gate(spark, d):
    rows = _m(spark, d).select(F.floor(F.col("event_id") / 20).alias("run"), (F.col("a") == 4).alias("lossy"), (F.col("a") != 0).alias("passed"))
    return reports.vacuity(rows, "run", 3)


@query(" SELECT event_id // 5 AS suite, count(*) FILTER (a = 0) = 0 AND count(*) FILTER (a = 4) = 0 AS passed FROM m GROUP BY 1")
def suite_gate(spark, d):
    count = lambda k, name: F.count_if(F.col("a") == k).alias(name)
    suites = _m(spark, d).groupBy(F.floor(F.col("event_id") / 5).alias("suite")).agg(F.count("*").alias("tests"), count(0, "failures"), F.lit(0).alias("errors"), count(4, "skipped"))
    return suites.select("suite", reports.suite_passed().alias("passed"))


@query(f""", r AS (SELECT * FROM m WHERE ts < {TO}), x AS (SELECT {_COLS} FROM r), y AS (SELECT {_COLS} FROM m WHERE event_type <> 'error')
SELECT 'missing' AS what, (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) AS n
UNION ALL SELECT 'unexpected', (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y))
UNION ALL SELECT 'repeated', (SELECT count(*) FROM (SELECT w, c, ts, seq FROM r GROUP BY ALL HAVING count(*) > 1))""")
def exact_rows(spark, d):
    rows = _m(spark, d)
    return reports.exact(rows.filter(F.col("ts") < TO), rows.filter("event_type <> 'error'").select(*_EVENT), KEY)


@query(" SELECT w, count(*) AS n, CASE WHEN max(ts) > min(ts) THEN round(count(*) * 1000.0::DOUBLE / (max(ts) - min(ts)), 9) END AS per_second FROM m GROUP BY w")
def throughput(spark, d):
    return _m(spark, d).groupBy("w").agg(F.count("*").alias("n"), F.round(reports.per_second(F.count("*"), F.max("ts") - F.min("ts")), 9).alias("per_second"))


@query(""", s AS (SELECT CAST(event_id % 8 AS INTEGER) AS slot, event_id AS n, ts AS now FROM m)
SELECT slot, n, now, max(now) OVER w AS ts, CAST(0 AS INTEGER) AS counter, true AS ok FROM s WINDOW w AS (PARTITION BY slot ORDER BY n)
""")
def slot_clock_stamps(spark, d):
    from palimpsest.streaming.ingest import stamp_slots

    return stamp_slots(_m(spark, d).select((F.col("event_id") % 8).cast("int").alias("slot"), F.col("event_id").alias("n"), F.col("ts").alias("now")), 2)


def _scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; where none is configured and all runs in this process (tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
    return f"{base.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


@query(f" SELECT {_COLS} FROM m WHERE NOT (actor = 20 AND {_WIN}) AND ts >= {1767225600000 + 5 * DAY}")
def maintenance_cycle(spark, d):
    """What a store holds after appends, one of them twice, seals, a compaction, a purge and an expiry."""
    rows, store, half = _m(spark, d), Store(spark, _scratch(spark)), 1767225600000 + 15 * DAY
    for batch, part in enumerate((rows.filter(F.col("ts") < half), rows.filter(F.col("ts") >= half), rows)):
        store.append(part, min(batch, 1))
        store.seal()
    store.compact()
    store.purge_actor(20, FROM, TO)
    store.expire_before(1767225600000 + 5 * DAY)
    return store.rows().select(*_EVENT)


@query(f" SELECT {_COLS} FROM m")
def stream_append_idempotent(spark, d):
    """What a store holds after a stream has been taken in, and again from its checkpoint."""
    folder = _scratch(spark)
    _m(spark, d).select(*MUTATION.names).write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    for _ in range(2):
        ingest.start(spark.readStream.schema(MUTATION).parquet(f"{folder}/in"), store, f"{folder}/checkpoint").awaitTermination()
    return store.rows().select(*_EVENT)


@query(f"{_CLASS} SELECT 2 AS state, CAST(sum(n) AS BIGINT) AS scanned, count(DISTINCT (w, c)) AS chunks, {_COUNTS}, CAST(0 AS BIGINT) AS contended FROM k")
def rollback_operation(spark, d):
    """The counters of a whole rollback in steps of five chunks, over a store."""
    rows, store = _m(spark, d), Store(spark, _scratch(spark))
    store.append(rows, 0)
    world = mutations.world_state(rows)
    rollbacks = Rollbacks(store, lambda: world, lambda writes: writes.write.format("noop").mode("overwrite").save(), chunks=5)
    done = rollbacks.rollback(PLAN.world, PLAN.box, FROM, TO)
    return spark.createDataFrame([(done.state, *(done.progress[k] for k in COUNTERS))], f"state int, {', '.join(f'{k} bigint' for k in COUNTERS)}")
