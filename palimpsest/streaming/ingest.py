"""Ingestion of streams, what becomes of their losses, and the slot clock that stamps what comes."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.geometry import chunk, morton
from palimpsest.operators import fold
from palimpsest.schema import MUTATION, POSITION, StoreError
from palimpsest.sources.store import Store, _Files, _gap
from palimpsest.streaming.maintenance import Schedule

MOST = 1023
#: Fixed value: the reason of a gap that holds what capture lost.
OVERFLOW = 1
LOSSES = ("out_of_range", "invalid", "unregistered", "overflow", "unreadable", "ambiguous")


def stream_id(store: Store, checkpoint: str) -> str:
    """The id that a checkpoint gives its query: another checkpoint, even in the same place, is another stream."""
    files = _Files(store.spark, checkpoint)
    return json.loads(files.read("metadata"))["id"] if files.exists("metadata") else ""


def start(stream: DataFrame, store: Store, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
    """Appends each micro-batch once: the store knows the last batch of each stream, so one that comes again has no effect."""

    def batch(rows: DataFrame, number: int) -> None:
        store.append(prepare(rows), number, stream_id(store, checkpoint))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush(query: StreamingQuery, store: Store) -> int:
    """Takes in all that is there, then seals; losses are published with their batches. Raises if the stream has failed."""
    query.processAllAvailable()
    if query.exception() is not None:
        raise StoreError("INTERNAL", f"the stream has failed: {query.exception()}")
    return store.seal()


class Capture:
    """Captured rows (producer, ts, seq, w, x, y, z, b, a, actor, cause, kind; a is null where the state could not be read)
    to net changes, rejects and counted losses.

    A row goes, in this order, as out of range, invalid, or unregistered: of an actor or world that no dictionary has, as
    names must be stored before events that mean them. What stays is staged by producer, tick and position; positions
    beyond `most` of a producer's tick overflow. A staged net change is confirmed by its last state.
    """

    def __init__(self, tick_ms: int, most: int = 1024, actors: DataFrame | None = None, worlds: DataFrame | None = None):
        self.tick_ms, self.most, self.actors, self.worlds = tick_ms, most, actors, worlds

    def _registered(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        good = F.lit(True)
        for name, known in (("actor", self.actors), ("w", self.worlds)):
            if known is not None:
                rows = rows.join(known.select(F.col("id").cast("int").alias(name)).distinct().withColumn(f"__{name}", F.lit(True)), name, "left")
                good = good & F.col(f"__{name}").isNotNull()
        return rows, good

    def outcomes(self, rows: DataFrame) -> DataFrame:
        """A row for each net change or lost row: outcome, observations, from_ts, to_ts, and of net changes what to record."""
        rows, good = self._registered(rows)
        told = rows.withColumn("outcome", F.coalesce(fold.invalid(), F.when(~good, "unregistered")))
        o, tick = F.expr(fold.ORDER), F.floor(F.col("ts") / self.tick_ms).cast("bigint").alias("tick")
        lost = told.filter("outcome is not null").select("outcome", F.lit(1).cast("bigint").alias("observations"), F.col("ts").alias("from_ts"), F.col("ts").alias("to_ts"))
        newest = F.max_by(F.struct("ts", "seq", "a", "actor", "cause", "kind"), o)
        net = told.filter("outcome is null").groupBy("producer", tick, *POSITION).agg(
            F.min_by("b", o).alias("b"), newest.alias("last"), F.count("*").alias("observations"), (F.countDistinct(F.struct("actor", "cause", "kind")) > 1).alias("ambiguous"),
            F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.min(o).alias("first"),
        )
        # a tick of a producer holds what one thread saw in a twentieth of a second or so
        place = F.row_number().over(W.partitionBy("producer", "tick").orderBy("first", *POSITION))
        net = net.withColumn("place", place).select("*", *[F.col(f"last.{n}").alias(n) for n in ("ts", "seq", "a", "actor", "cause", "kind")])
        net = net.withColumn("outcome", F.when(F.col("place") > self.most, "overflow").otherwise(fold.confirmed()))
        net = net.withColumn("c", morton(chunk("x"), chunk("z"))).select("outcome", "observations", "from_ts", "to_ts", *MUTATION.names)
        return net.unionByName(lost, allowMissingColumns=True)

    def counted(self, told: DataFrame) -> DataFrame:
        """outcome, observations and bounds of each outcome."""
        return told.groupBy("outcome").agg(F.sum("observations").cast("bigint").alias("observations"), F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts"))


def losses(counts: list) -> list[dict]:
    """One gap over all that a batch lost, as wide as any of it; none if nothing was lost."""
    lost = sorted((r for r in counts if r["outcome"] in LOSSES), key=lambda r: r["outcome"])
    if not lost:
        return []
    detail = " ".join(f"{r['outcome']}={r['observations']}" for r in lost)
    return [_gap(min(r["from_ts"] for r in lost), max(r["to_ts"] for r in lost), OVERFLOW, sum(r["observations"] for r in lost), detail)]


class Consumer:
    """One loop for all that a stream's batch needs, in this order: names, captured rows with their losses, upkeep.

    register stores new names of a batch before its events, and gives the dictionaries to check against. Rows and the gap
    over the batch's losses are published in one snapshot; the stream's checkpoint is written after that, so a batch that
    comes again has no effect. counters adds up outcomes since the start.
    """

    def __init__(self, store: Store, capture: Capture, register: Callable[[DataFrame], None] | None = None, schedule: Schedule | None = None, clock: Callable[[], int] | None = None):
        self.store, self.capture, self.register, self.schedule, self.clock, self.counters = store, capture, register, schedule, clock, Counter()

    def batch(self, rows: DataFrame, number: int, stream: str = "") -> bool:
        if number <= self.store.applied(stream):
            return False
        if self.register is not None:
            self.register(rows)
        told = self.capture.outcomes(rows).persist()
        try:
            counts = self.capture.counted(told).collect()
            done = self.store.append(told.filter("outcome = 'published'").select(*MUTATION.names), number, stream, losses(counts))
        finally:
            told.unpersist()
        if done:
            self.counters.update({r["outcome"]: r["observations"] for r in counts})
        if self.schedule is not None and self.clock is not None:
            self.schedule.tick(self.clock())
        return done

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda rows, n: self.batch(rows, n, stream_id(self.store, checkpoint)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stamp_slots(rows: DataFrame, drift_ms: int, seed: dict[int, int] | None = None) -> DataFrame:
    """slot, n (order of arrival), now -> and ts, counter, ok: a clock for each slot that never goes back.

    A later millisecond starts a new count; within one, the count rises to 1023, then the clock runs ahead by up to
    drift_ms and refuses beyond. seed: the last ts of each slot, after which its clock goes on. What a slot refuses depends
    on all before it, so a slot is one ordered stream; a task reads it sorted and holds nothing of it but the clock.
    """
    start_of = dict(seed or {})

    def clock(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, logical, counter = None, 0, 0
        for batch in batches:
            out = []
            for slot, now in zip(batch.column("slot").to_pylist(), batch.column("now").to_pylist()):
                if slot != at:
                    at, logical, counter = slot, start_of.get(slot, -(1 << 62)), MOST if slot in start_of else 0
                ok = True
                if now > logical:
                    logical, counter = now, 0
                elif counter < MOST:
                    counter += 1
                elif logical + 1 - now <= drift_ms:
                    logical, counter = logical + 1, 0
                else:
                    ok = False
                out.append((logical, counter, ok))
            columns = {"slot": batch.column("slot"), "n": batch.column("n"), "now": batch.column("now")}
            more = {"ts": pa.array([x[0] for x in out], pa.int64()), "counter": pa.array([x[1] for x in out], pa.int32()), "ok": pa.array([x[2] for x in out], pa.bool_())}
            yield pa.record_batch(columns | more)

    own = rows.select(F.col("slot").cast("int").alias("slot"), F.col("n").cast("bigint").alias("n"), F.col("now").cast("bigint").alias("now"))
    return own.repartition("slot").sortWithinPartitions("slot", "n").mapInArrow(clock, "slot int, n bigint, now bigint, ts bigint, counter int, ok boolean")
