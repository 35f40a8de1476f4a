"""A journal of checksummed frames, read by Spark as binary files.

A frame is a header (magic, type, length, LSN; little endian), its payload and a CRC32C over both. The log ends, for
all segments, at the first frame that is damaged or whose LSN isn't its place. Segments are whole files, as many as
there are; each is parsed in a task in order, and the end is found by a minimum over segments.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.functions.geometry import chunk, morton
from palimpsest.operators.gaps import crash_gap
from palimpsest.schema import MUTATION

MAGIC = 0x504C4D50
EVENTS, GAP, CAPTURED, CLOSE = 1, 4, 6, 7
_HEAD = struct.Struct("<IIIq")
FRAMES = "lsn bigint, type int, payload binary, ok boolean"

_TABLE = []
for _n in range(256):
    for _ in range(8):
        _n = (_n >> 1) ^ (0x82F63B78 if _n & 1 else 0)
    _TABLE.append(_n)


_TABLES = np.array(_TABLE, np.uint32)
#: Bytes that numpy goes through side by side; shorter data are gone through one by one.
_WIDE = 256


def _past_zeros(n: int) -> np.ndarray:
    """For each of four bytes of a checksum, what n zero bytes make of it: checksums of joined data by exclusive or."""
    out = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(n):
        out = _TABLES[out & 255] ^ (out >> np.uint32(8))
    return out


_SHIFT = _past_zeros(_WIDE)


def crc32c(data: bytes) -> int:
    """CRC-32C. Rows of _WIDE bytes are checksummed side by side, then joined."""
    crc, head = 0xFFFFFFFF, len(data) % _WIDE if len(data) >= 4 * _WIDE else len(data)
    for b in data[:head]:
        crc = _TABLE[(crc ^ b) & 255] ^ (crc >> 8)
    if head < len(data):
        rows = np.frombuffer(data, np.uint8, offset=head).reshape(-1, _WIDE)
        own = np.zeros(len(rows), np.uint32)
        for j in range(_WIDE):
            own = _TABLES[(own ^ rows[:, j]) & 255] ^ (own >> np.uint32(8))
        for x in own.tolist():
            crc = int(_SHIFT[0][crc & 255] ^ _SHIFT[1][crc >> 8 & 255] ^ _SHIFT[2][crc >> 16 & 255] ^ _SHIFT[3][crc >> 24]) ^ x
    return crc ^ 0xFFFFFFFF


def frame(lsn: int, kind: int, payload: bytes) -> bytes:
    body = _HEAD.pack(MAGIC, kind, len(payload), lsn) + payload
    return body + struct.pack("<I", crc32c(body))


def parse(start: int, data: bytes):
    """(lsn, type, payload, ok); the first damaged frame, or the torn end, is the last, with ok false."""
    at = 0
    while at < len(data):
        if at + _HEAD.size > len(data):
            return (yield start + at, 0, b"", False)
        magic, kind, size, lsn = _HEAD.unpack_from(data, at)
        end = at + _HEAD.size + size
        good = magic == MAGIC and lsn == start + at and kind in (EVENTS, GAP, CAPTURED, CLOSE) and end + 4 <= len(data)
        if not good or struct.unpack_from("<I", data, end)[0] != crc32c(data[at:end]):
            return (yield start + at, 0, b"", False)
        yield lsn, kind, data[at + _HEAD.size : end], True
        at = end + 4


def append_point(folder: str, floor: int = 0) -> int:
    """The LSN to go on at: after the last good frame, or a floor above it. What is behind that frame is cut off."""
    names, at = sorted(n for n in os.listdir(folder) if n.endswith(".log")), floor
    for k, name in enumerate(names):
        path, start = os.path.join(folder, name), int(name.split(".")[0])
        with open(path, "rb") as f:
            end = start
            for lsn, _, payload, good in parse(start, f.read()):
                end = lsn + _HEAD.size + len(payload) + 4 if good else lsn
        if end < start + os.path.getsize(path):
            os.truncate(path, end - start)
            for later in names[k + 1 :]:
                os.remove(os.path.join(folder, later))
            return max(end, floor)
        at = max(at, end)
    return at


class Writer:
    """Appends frames to segments that a process of its own, not a task, keeps; a new one begins at so many bytes."""

    def __init__(self, folder: str, segment_bytes: int = 64 << 20, floor: int = 0):
        self.folder, self.most, self.lsn, self.file = folder, segment_bytes, append_point(folder, floor), None

    def append(self, kind: int, payload: bytes) -> int:
        """The LSN of the new frame, which is on disk when force() has returned."""
        if kind not in (EVENTS, GAP, CAPTURED, CLOSE):
            raise ValueError(f"no frame type {kind}")
        if self.file is None or self.lsn - self.start >= self.most:
            self.close()
            self.start, self.file = self.lsn, open(os.path.join(self.folder, f"{self.lsn:020}.log"), "xb")
        at, data = self.lsn, frame(self.lsn, kind, payload)
        self.file.write(data)
        self.lsn += len(data)
        return at

    def force(self) -> None:
        if self.file is not None:
            self.file.flush()
            os.fsync(self.file.fileno())

    def close(self) -> None:
        if self.file is not None:
            self.force()
            self.file.close()
            self.file = None


_ENVELOPE = struct.Struct("<iiiiiiqiHBBi")


@dataclass(frozen=True)
class Envelope:
    """An event with a payload of its own, as a frame carries it: 44 bytes, then its length and the payload."""

    world: int
    x: int
    y: int
    z: int
    before: int
    after: int
    ts: int
    actor: int
    seq: int
    cause: int
    kind: int
    version: int
    payload: bytes

    def encode(self) -> bytes:
        return _ENVELOPE.pack(self.world, self.x, self.y, self.z, self.before, self.after, self.ts, self.actor, self.seq, self.cause, self.kind, self.version) + struct.pack("<i", len(self.payload)) + self.payload

    @classmethod
    def decode(cls, data: bytes) -> Envelope:
        head = _ENVELOPE.size + 4
        if len(data) < head:
            raise ValueError("an envelope is cut short")
        *values, size = struct.unpack_from("<iiiiiiqiHBBii", data)
        if size != len(data) - head or not 0 <= values[0] < 4096 or min(values[4:6]) < 0 or max(values[4:6]) >= 1 << 24 or values[11] < 0:
            raise ValueError("an envelope's fields don't hold together")
        return cls(*values, data[head:])


_EVENTS, _GAP = struct.Struct("<iqq"), struct.Struct("<qqiq")


def events_payload(records: list[tuple[int, int, int, int]], low_water: int, last_capture: int) -> bytes:
    """Events as packed longs (position, states, actor and time, metadata), after their number, the low-water mark and the time of the last."""
    return _EVENTS.pack(len(records), low_water, last_capture) + b"".join(struct.pack("<4q", *(x - (1 << 64) if x >= 1 << 63 else x for x in r)) for r in records)


def gap_payload(from_ts: int, to_ts: int, reason: int, dropped: int) -> bytes:
    return _GAP.pack(from_ts, to_ts, reason, dropped)


def replay(spark: SparkSession, folder: str, from_lsn: int = 0) -> DataFrame:
    """lsn, type and payload of the frames from an LSN on; a segment's file name is the LSN of its first byte.

    Segments are parsed once for their ends, a number each, and once for the result; frames are handed on as they come.
    """

    def parsed(batch: pa.RecordBatch):
        for path, content in zip(batch.column("path"), batch.column("content")):
            yield from parse(int(path.as_py().rsplit("/", 1)[-1].split(".")[0]), content.as_buffer().to_pybytes())

    def ends(batches):
        for batch in batches:
            yield pa.record_batch({"lsn": pa.array([f[0] for f in parsed(batch) if not f[3]], pa.int64())})

    def frames(batches):
        names, types = ("lsn", "type", "payload", "ok"), (pa.int64(), pa.int32(), pa.binary(), pa.bool_())
        pack = lambda out: pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
        for batch in batches:
            out, size = [], 0
            for f in parsed(batch):
                out.append(f)
                size += len(f[2])
                if size > 8_000_000 or len(out) >= 10_000:
                    yield pack(out)
                    out, size = [], 0
            yield pack(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder).select("path", "content")
    end = files.mapInArrow(ends, "lsn bigint").agg(F.min("lsn")).first()[0]
    found = files.mapInArrow(frames, FRAMES)
    whole = F.col("ok") if end is None else F.col("ok") & (F.col("lsn") < end)
    return found.filter(whole & (F.col("lsn") >= from_lsn)).select("lsn", "type", "payload")


def _unpack_events(batches):
    for batch in batches:
        lsn, place, longs = [], [], []
        for at, payload in zip(batch.column("lsn").to_pylist(), batch.column("payload")):
            data = payload.as_buffer()
            n = _EVENTS.unpack_from(data)[0]
            if n < 0 or len(data) != _EVENTS.size + 32 * n:
                raise ValueError(f"frame {at} has not the events that it says")
            longs.append(np.frombuffer(data, "<i8", 4 * n, _EVENTS.size).reshape(-1, 4))
            lsn.append(np.full(n, at))
            place.append(np.arange(n))
        rows = np.concatenate([np.zeros((0, 4), np.int64), *longs])
        flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
        yield pa.record_batch({"lsn": flat(lsn), "place": flat(place)} | {n: pa.array(rows[:, k].copy(), pa.int64()) for k, n in enumerate("psum")})


def mutations(frames: DataFrame) -> DataFrame:
    """The mutations of frames with events, with their lsn and place in the frame. A frame whose number of events is wrong raises."""
    rows = frames.filter(F.col("type") == EVENTS).select("lsn", "payload").mapInArrow(_unpack_events, "lsn bigint, place bigint, p bigint, s bigint, u bigint, m bigint")
    at, states, time, meta = codec.unpack_position("p"), codec.unpack_states("s"), codec.unpack_actor_time("u"), codec.unpack_metadata("m")
    rows = rows.select("lsn", "place", *[at[n].alias(n) for n in "xyz"], states["b"].alias("b"), states["a"].alias("a"), (time["relative"] + codec.EPOCH).alias("ts"), codec.actor_id(meta["actor_high"], time["actor_low"]).alias("actor"), *[meta[n].alias(n) for n in ("seq", "w", "cause", "kind")])
    return rows.withColumn("c", morton(chunk("x"), chunk("z"))).select("lsn", "place", *MUTATION.names)


def _unpack_captured(batches):
    names = ("x", "y", "z", "b", "a", "ts", "actor", "seq", "w", "cause", "kind", "version")
    for batch in batches:
        lsn, got = batch.column("lsn"), [Envelope.decode(x.as_py()) for x in batch.column("payload")]
        values = [[e.x, e.y, e.z, e.before, e.after, e.ts, e.actor, e.seq, e.world, e.cause, e.kind, e.version] for e in got]
        columns = {n: pa.array([v[k] for v in values], pa.int64() if n == "ts" else pa.int32()) for k, n in enumerate(names)}
        yield pa.record_batch({"lsn": lsn} | columns | {"payload": pa.array([e.payload for e in got], pa.binary())})


def captured(frames: DataFrame) -> DataFrame:
    """The events with payloads of frames, with lsn, version and payload."""
    schema = "lsn bigint, x int, y int, z int, b int, a int, ts bigint, actor int, seq int, w int, cause int, kind int, version int, payload binary"
    rows = frames.filter(F.col("type") == CAPTURED).select("lsn", "payload").mapInArrow(_unpack_captured, schema)
    return rows.withColumn("c", morton(chunk("x"), chunk("z"))).select("lsn", *MUTATION.names, "version", "payload")


def _unpack_heads(batches):
    names = ("lsn", "type", "low_water", "last_capture", "from_ts", "to_ts", "reason", "dropped")
    types = [pa.int32() if n in ("type", "reason") else pa.int64() for n in names]
    for batch in batches:
        out = []
        for at, kind, payload in zip(*(batch.column(n).to_pylist() for n in ("lsn", "type", "payload"))):
            out.append((at, kind, *((*_EVENTS.unpack_from(payload)[1:], None, None, None, None) if kind == EVENTS else (None, None, *_GAP.unpack(payload)))))
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def heads(frames: DataFrame) -> DataFrame:
    """lsn, low_water and last_capture of frames with events, and the four fields of gaps (null for others)."""
    schema = "lsn bigint, type int, low_water bigint, last_capture bigint, from_ts bigint, to_ts bigint, reason int, dropped bigint"
    return frames.filter(F.col("type").isin(EVENTS, GAP)).mapInArrow(_unpack_heads, schema)


def recover(store, folder: str, newest_file: int = 0, stream: str = "journal") -> dict:
    """What a store lacks of a journal, after a stop: events and gaps of frames after the last applied, then events with
    payloads; and, if the journal was not closed, a gap over what was in memory. Doing it again has no effect.
    """
    spark = store.spark
    done = store.applied(stream)
    frames = replay(spark, folder, done + 1).persist()
    try:
        last = frames.agg(F.max("lsn").alias("lsn"), F.max_by("type", "lsn").alias("type"), F.count("*").alias("n")).first()
        if not last["n"]:
            return {"frames": 0, "events": 0, "captured": 0, "gaps": 0, "clean": True}
        told = heads(frames).persist()
        # gaps of a journal are rows of its losses, which a manifest's list takes
        gaps = [{"from_ts": r["from_ts"], "to_ts": r["to_ts"], "reason": r["reason"], "dropped": r["dropped"], "detail": "from the journal"} for r in told.filter(F.col("type") == GAP).orderBy("lsn").collect()]
        facts = told.agg(F.max("last_capture").alias("last"), F.max_by("low_water", F.when(F.col("type") == EVENTS, F.col("lsn"))).alias("mark")).first()
        told.unpersist()
        clean = last["type"] == CLOSE
        if not clean and (facts["last"] or newest_file):
            low, high = crash_gap(facts["mark"] or 0, facts["last"] or newest_file, newest_file)
            gaps.append({"from_ts": low, "to_ts": high, "reason": 2, "dropped": -1, "detail": "not closed; what was captured last may be missing"})
        rows, own = mutations(frames).select(*MUTATION.names), captured(frames).drop("lsn").persist()
        n = own.count()
        if n:
            store.append_captured(own, last["lsn"], f"{stream}-captured")
        own.unpersist()
        events = rows.count()
        store.append(rows, last["lsn"], stream, gaps)
        return {"frames": last["n"], "events": events, "captured": n, "gaps": len(gaps), "clean": clean}
    finally:
        frames.unpersist()
