"""A store of mutations: parquet shards under immutable snapshots.

A snapshot is one JSON file, manifest/<n>.json, that names the hot files and live shards with their bounds, the last batch
of each stream, recent gaps, exclusions, unfinished operations and the step that maintenance is at. Older gaps, audit rows
and finished operations go to files of their own, so a manifest stays small. Writers publish n + 1 by giving a finished file
that name, which fails if the name is taken: by a hard link on a local disk, elsewhere by a rename, which HDFS refuses for
names that exist. Who loses that race reads the new snapshot and tries again, or finds that its shards are gone and stops.

Readers keep the snapshot they opened. open_reader() leaves a lease, and vacuum() removes neither what a leased or recent
snapshot names nor files that are too young to be a dead writer's. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from copy import deepcopy
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.digest import blob_id, multiset_digest
from palimpsest.operators.gaps import without_excluded
from palimpsest.plans.scan_plan import ScanPlan, scan
from palimpsest.schema import AUDIT, BLOB, BLOB_REF, FORMAT_VERSION, GAP, KEY, MUTATION, REFUSING, StoreError

_EMPTY = {"format": FORMAT_VERSION, "applied": -1, "streams": {}, "hot": [], "shards": [], "gaps": [], "exclusions": [], "operations": [], "audit": [], "blobs": [], "refs": [], "bad_blobs": [], "files": [], "work": None, "migrated": False, "next": 1, "next_operation": 1}
EARLIEST = -(1 << 62)
STATE_RUNNING, STATE_DONE = 1, 2
EXPIRED, PURGED, QUARANTINED = 5, 6, 3
#: Rows of a list that stay in the manifest; tries to publish; how old a dead writer's file or lease is.
TAIL, TRIES, OLD_MS = 256, 8, 86_400_000
MOST_BLOB = 16 << 20
_EVENT = [f.name for f in MUTATION]


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def ages(self, folder: str) -> dict[str, int]:
        """When each file of a folder was last changed."""
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(self._path(folder))} if self.exists(folder) else {}

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if it exists; no reader finds half of it, and of two writers one gets the name."""
        folder = name.rsplit("/", 1)[0]
        temp = self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self.fs.create(temp, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if not self.local:
                return not self.exists(name) and self.fs.rename(temp, self._path(name))
            nio = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
            self.jvm.java.nio.file.Files.createLink(nio(self._path(name)), nio(temp))
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(temp, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Store:
    """exclusive: holds the writer's lock until close(); a second such store of the same root raises LOCKED."""

    def __init__(self, spark: SparkSession, root: str, exclusive: bool = False):
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root)
        self.locked = False
        if self.files.exists("manifest") and self.manifest()["format"] > FORMAT_VERSION:
            raise StoreError("CORRUPT", "the store has a newer format")
        if exclusive:
            if not self.files.create("locks/writer", uuid.uuid4().hex):
                raise StoreError("LOCKED", "another writer has the store")
            self.locked = True

    def close(self) -> None:
        if self.locked:
            self.files.delete("locks/writer")
            self.locked = False

    # snapshots

    def version(self) -> int:
        return max([0, *(int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json") and n[0] != ".")])

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return deepcopy(_EMPTY) | (json.loads(self.files.read(f"manifest/{v}.json")) if v else {}) | {"version": v}

    def _publish(self, m: dict) -> None:
        m = self._trimmed(m)
        v = m.pop("version")
        if not self.files.create(f"manifest/{v + 1}.json", json.dumps(m)):
            raise StoreError("LOCKED", "another writer has published")

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Publishes what change makes of the latest manifest, again where another writer was first; false if it makes none."""
        for k in range(TRIES):
            new = change(self.manifest())
            if new is None:
                return False
            try:
                self._publish(new)
                return True
            except StoreError as e:
                if e.code != "LOCKED" or k == TRIES - 1:
                    raise
                time.sleep(0.01 * 2**k)
        return False

    def _trimmed(self, m: dict) -> dict:
        """Long lists go to files, with the bounds of gaps."""
        for kind in ("audit", "gaps", "operations"):
            done = [kind != "operations" or o["state"] == STATE_DONE for o in m[kind]]
            if sum(done) <= TAIL:
                continue
            if kind != "operations":  # the last ones stay
                done = [k < len(done) - TAIL for k in range(len(done))]
            old = [o for o, x in zip(m[kind], done) if x]
            name = f"log/{kind}-{uuid.uuid4().hex}.json"
            self.files.create(name, "\n".join(json.dumps(o) for o in old))
            bounds = (min(o["from_ts"] for o in old), max(o["to_ts"] for o in old)) if kind == "gaps" else (0, 0)
            m = m | {kind: [o for o, x in zip(m[kind], done) if not x], "files": [*m["files"], {"kind": kind, "name": name, "min_ts": bounds[0], "max_ts": bounds[1]}]}
        return m

    def _logged(self, m: dict, kind: str, keep: Callable[[dict], bool] = lambda f: True) -> list[dict]:
        """Rows of a list, those in files too."""
        return [json.loads(x) for f in m["files"] if f["kind"] == kind and keep(f) for x in self.files.read(f["name"]).splitlines()] + m[kind]

    @contextmanager
    def open_reader(self, version: int | None = None) -> Iterator[dict]:
        """A snapshot's manifest; its files stay while the block runs."""
        m = self.manifest(version)
        name = f"leases/{uuid.uuid4().hex}.json"
        self.files.create(name, json.dumps({"version": m["version"], "at": int(time.time() * 1000)}))
        try:
            yield m
        finally:
            self.files.delete(name)

    def readers(self, old_ms: int = OLD_MS) -> set[int]:
        """The versions with a lease that is not too old to be a dead reader's."""
        found = [json.loads(self.files.read(f"leases/{n}")) for n in self.files.names("leases") if n[0] != "."]
        return {x["version"] for x in found if x["at"] > time.time() * 1000 - old_ms}

    def _new(self, m: dict, kind: str) -> str:
        return f"{kind}/{m['version'] + 1}-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, name: str, sort: bool) -> None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in MUTATION])
        if sort:
            rows = rows.repartitionByRange("w", "c", "ts").sortWithinPartitions(*KEY)
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")

    def _read(self, names: list[str]) -> DataFrame:
        if missing := [n for n in names if not self.files.exists(n)]:
            raise StoreError("CORRUPT", f"{missing[0]} is missing")
        return self.spark.read.schema(MUTATION).parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], MUTATION)

    def _bounds(self, name: str) -> dict:
        r = self._read([name]).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
        return {"name": name, "rows": r["n"], "min_ts": r["lo"], "max_ts": r["hi"]}

    def _describe(self, name: str, shard: int) -> dict:
        return {"id": shard, **self._bounds(name), "digest": multiset_digest(self._read([name])), "state": 0}

    @staticmethod
    def _touches(s: dict, plan: ScanPlan | None) -> bool:
        return plan is None or (s["max_ts"] >= plan.from_ts and s["min_ts"] < plan.to_ts)

    @classmethod
    def live(cls, m: dict, plan: ScanPlan | None = None) -> list[dict]:
        """Live shards, those whose bounds a plan's window misses left out."""
        return [s for s in m["shards"] if s["state"] == 0 and cls._touches(s, plan)]

    def rows(self, m: dict | None = None, plan: ScanPlan | None = None) -> DataFrame:
        m = m or self.manifest()
        return self._read([s["name"] for s in m["hot"] if self._touches(s, plan)] + [s["name"] for s in self.live(m, plan)])

    def scan(self, plan: ScanPlan, version: int | None = None) -> DataFrame:
        """Raises where the window touches removed or damaged history; a live shard that is missing becomes such."""
        m = self.manifest(version)
        if any(g["reason"] in REFUSING for g in self._gaps(m, plan.from_ts, plan.to_ts)):
            raise StoreError("CORRUPT", "history in this window is incomplete")
        if missing := [s for s in self.live(m, plan) if not self.files.exists(s["name"])]:
            for s in missing:
                self.quarantine(s["id"], "file is missing")
            raise StoreError("CORRUPT", f"shard {missing[0]['id']} is missing")
        return scan(self.rows(m, plan), plan)

    # writing

    def _excluded(self, rows: DataFrame, m: dict) -> DataFrame:
        if not m["exclusions"]:
            return rows
        e = self.spark.createDataFrame([(x["actor"], x["from_ts"], x["to_ts"]) for x in m["exclusions"]], "actor int, from_ts bigint, to_ts bigint")
        return without_excluded(rows, e)

    def applied(self, stream: str = "") -> int:
        """The last batch of a stream that has been taken in; -1 for none."""
        return self.manifest()["streams"].get(stream, -1)

    def append(self, rows: DataFrame, batch: int, stream: str = "", gaps: list[dict] | None = None) -> bool:
        """False, without effect, for a batch of the stream that was applied before, and for one without rows or gaps.

        gaps: what is known to be lost of the batch; they are published with its rows, or not at all.
        """
        m = self.manifest()
        if batch <= m["streams"].get(stream, -1) or (not gaps and rows.isEmpty()):
            return False
        hot = None

        def change(now: dict) -> dict | None:
            nonlocal hot, m
            if batch <= now["streams"].get(stream, -1):
                return None
            if hot is None or now["exclusions"] != m["exclusions"]:
                m, name = now, self._new(now, "hot")
                self._write(self._excluded(rows, now), name, False)
                hot = self._bounds(name)
            kept = [hot] if hot["rows"] else []
            return now | {"applied": batch, "streams": now["streams"] | {stream: batch}, "hot": [*now["hot"], *kept], "gaps": [*now["gaps"], *(gaps or [])]}

        return self._commit(change)

    def append_captured(self, rows: DataFrame, batch: int, stream: str = "") -> bool:
        """append() of rows with version and payload: events, their blobs and references in one snapshot.

        An event that is stored already is accepted without effect if content and payload are the same, else it raises.
        """
        m = self.manifest()
        if batch <= m["streams"].get(stream, -1) or rows.isEmpty():
            return False
        rows = self._excluded(rows, m).withColumn("blob_id", blob_id(F.col("version"), F.col("payload"))).persist()
        try:
            at = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("c", "ts") for n, f in (("min", F.min), ("max", F.max))]).first()
            near = self.rows(m) if at["min_c"] is None else self.rows(m).filter(F.col("c").between(at["min_c"], at["max_c"]) & F.col("ts").between(at["min_ts"], at["max_ts"]))
            known = near.join(self._references(m).select(*KEY, "blob_id"), KEY, "left").select(*KEY, F.struct(*_EVENT, "blob_id").alias("old"))
            met = rows.join(known, KEY, "left")
            if not met.filter(F.col("old").isNotNull() & ~F.struct(*_EVENT, "blob_id").eqNullSafe(F.col("old"))).isEmpty():
                raise StoreError("CORRUPT", "an event came again with other content")
            new = met.filter("old is null").drop("old")
            hot, blobs, refs = self._new(m, "hot"), self._new(m, "blobs"), self._new(m, "refs")
            self._write(new, hot, False)
            new.select(F.col("blob_id").alias("id"), "version", "payload").dropDuplicates(["id"]).write.parquet(f"{self.root}/{blobs}")
            new.select(*BLOB_REF.names).write.parquet(f"{self.root}/{refs}")
        finally:
            rows.unpersist()
        told = self._bounds(hot)
        more = {"hot": [*m["hot"], told], "blobs": [*m["blobs"], blobs], "refs": [*m["refs"], refs]} if told["rows"] else {}
        self._publish(m | {"applied": batch, "streams": m["streams"] | {stream: batch}} | more)
        return True

    def migrate(self, legacy: str) -> int:
        """Copies the rows of a folder of an older format, once, and sets the format in the same snapshot; the folder stays."""
        n = 0

        def change(m: dict) -> dict | None:
            nonlocal n
            if m["migrated"]:
                return None
            name = self._new(m, "hot")
            self._write(self.spark.read.schema(MUTATION).parquet(legacy), name, False)
            told = self._bounds(name)
            n = told["rows"]
            return m | {"migrated": True, "format": FORMAT_VERSION, "hot": [*m["hot"], *([told] if n else [])]}

        return n if self._commit(change) else 0

    # payloads

    def _table(self, names: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def blobs(self) -> DataFrame:
        return self._table(self.manifest()["blobs"], BLOB).dropDuplicates(["id"])

    def _references(self, m: dict) -> DataFrame:
        return self._table(m["refs"], BLOB_REF)

    def refs(self) -> DataFrame:
        """References, those of excluded events and of damaged blobs left out."""
        m = self.manifest()
        found = self._excluded(self._references(m), m)
        return found.filter(~F.col("blob_id").isin(*m["bad_blobs"])) if m["bad_blobs"] else found

    def put_blobs(self, payloads: DataFrame) -> DataFrame:
        """Stores payloads (version, payload) under what identifies them; gives id, version and payload of each different one."""
        rows = payloads.select(blob_id(F.col("version"), F.col("payload")).alias("id"), F.col("version").cast("int").alias("version"), "payload").dropDuplicates(["id"])
        if not rows.filter((F.col("version") < 0) | (F.octet_length("payload") > MOST_BLOB)).isEmpty():
            raise StoreError("INTERNAL", "a payload is too long, or its version below 0")
        name = self._new(self.manifest(), "blobs")
        rows.write.parquet(f"{self.root}/{name}")
        self._commit(lambda m: m | {"blobs": [*m["blobs"], name]})
        return self._table([name], BLOB)

    def read_blob(self, key: str) -> bytes:
        """A payload, checked against its id; one that differs is marked and raises."""
        row = self.blobs().filter(F.col("id") == key).first()
        if row is None or key in self.manifest()["bad_blobs"]:
            raise StoreError("CORRUPT", f"no good blob {key}")
        if hashlib.sha256(row["version"].to_bytes(4, "big") + bytes(row["payload"])).hexdigest() != key:
            self._condemn([key])
            raise StoreError("CORRUPT", f"blob {key} is damaged")
        return bytes(row["payload"])

    def attach(self, wanted: DataFrame) -> int:
        """References from events (w, c, ts, seq) to blobs (blob_id). Both must be there, and an event has one at most."""
        m = self.manifest()
        events = self.rows(m).select(*KEY, "actor")
        rows = wanted.select(*KEY, "blob_id").distinct().persist()
        try:
            met = rows.join(events, KEY, "left").join(self.blobs().select(F.col("id").alias("blob_id"), F.lit(True).alias("stored")), "blob_id", "left").join(self.refs().select(*KEY, F.col("blob_id").alias("old")), KEY, "left")
            if not met.filter(F.col("actor").isNull() | F.col("stored").isNull() | (F.col("old") != F.col("blob_id"))).isEmpty() or rows.count() != rows.select(*KEY).distinct().count():
                raise StoreError("INTERNAL", "a reference needs one stored event and blob, and an event has one blob")
            new = met.filter("old is null").select(*BLOB_REF.names)
            name = self._new(m, "refs")
            new.write.parquet(f"{self.root}/{name}")
        finally:
            rows.unpersist()
        self._publish(m | {"refs": [*m["refs"], name]})
        return self._table([name], BLOB_REF).count()

    def blob_at(self, w: int, c: int, ts: int, seq: int) -> str | None:
        row = self.refs().filter((F.col("w") == w) & (F.col("c") == c) & (F.col("ts") == ts) & (F.col("seq") == seq)).first()
        return row and row["blob_id"]

    def blobs_for(self, events: DataFrame) -> DataFrame:
        """events with blob_id, null where there is none."""
        return events.join(self.refs().select(*KEY, "blob_id"), KEY, "left")

    def unreferenced_blobs(self) -> DataFrame:
        return self.blobs().join(self.refs().select(F.col("blob_id").alias("id")), "id", "left_anti")

    def collect_blobs(self) -> int:
        """Removes blobs that nothing refers to, and references of events that are gone; how many blobs went."""
        m = self.manifest()
        gone, blobs, refs = self.unreferenced_blobs().count(), self._new(m, "blobs"), self._new(m, "refs")
        if gone:
            self.blobs().join(self.refs().select(F.col("blob_id").alias("id")), "id", "left_semi").write.parquet(f"{self.root}/{blobs}")
            self.refs().write.parquet(f"{self.root}/{refs}")
            self._publish(m | {"blobs": [blobs], "refs": [refs]})
        return gone

    def _condemn(self, keys: list[str]) -> None:
        """Marks blobs as damaged, with a gap over the events that refer to each."""
        m = self.manifest()
        found = self._excluded(self._references(m), m).filter(F.col("blob_id").isin(*keys)).groupBy("blob_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).collect()
        lost = [_gap(r["lo"], r["hi"], QUARANTINED, r["n"], f"blob {r['blob_id']} is damaged") for r in found]
        audit = [{"action": "BLOB_CORRUPT", "shard_id": 0, "affected": r["n"]} for r in found]
        self._commit(lambda m: m | {"bad_blobs": sorted({*m["bad_blobs"], *keys}), "gaps": [*m["gaps"], *lost], "audit": [*m["audit"], *audit]})

    # maintenance

    def _replace(self, m: dict, rows: DataFrame, old: list[int], action: str, expect: str | None = None, name: str | None = None, affected: int | None = None) -> dict:
        """A manifest with a new shard of rows in place of old ones; checks identities and, if given, the digest."""
        name, shard = name or self._new(m, "shards"), m["next"]
        self._write(rows, name, True)
        return self._place(m, self._describe(name, shard), old, action, expect, affected)

    def _place(self, m: dict, new: dict, old: list[int], action: str, expect: str | None, affected: int | None = None) -> dict:
        # a shard is sorted by ranges of its key, so rows with one identity are neighbours in a file, and summed there
        if self._read([new["name"]]).groupBy(*KEY).count().filter("count > 1").limit(1).count():
            self.files.delete(new["name"])
            raise StoreError("CORRUPT", "two rows have the same identity")
        if expect is not None and new["digest"] != expect:
            self.files.delete(new["name"])
            raise StoreError("INTERNAL", "what was written differs from what was read")
        shards = [s | {"state": 1} if s["id"] in old else s for s in m["shards"]]
        if new["rows"]:
            shards.append(new | {"id": m["next"]})
        told = {"action": action, "shard_id": m["next"] if new["rows"] else 0, "affected": new["rows"] if affected is None else affected}
        return m | {"shards": shards, "next": m["next"] + 1, "audit": [*m["audit"], told]}

    def seal(self, most_files: int | None = None, most_rows: int | None = None) -> int:
        """Moves hot rows into a shard, those of the first appends that both numbers admit; how many rows went.

        An append of more rows than are admitted is parted by time: the older part goes, the rest is written anew as hot.
        """
        m = self.manifest()
        some, n = [], 0
        for h in m["hot"][:most_files]:
            if most_rows is not None and n + h["rows"] > most_rows:
                break
            some, n = [*some, h], n + h["rows"]
        rest: list[dict] = m["hot"][len(some) :]
        rows = self._read([h["name"] for h in some])
        if not some and m["hot"]:
            order, part = F.expr("ts * 65536 + seq"), self._read([m["hot"][0]["name"]])
            cut = part.select(order.alias("o")).groupBy().agg(F.percentile_approx("o", most_rows / m["hot"][0]["rows"], 10_000)).first()[0]
            rows, name = part.filter(order <= cut), self._new(m, "hot")
            self._write(part.filter(order > cut), name, False)
            left = self._bounds(name)
            n, rest = m["hot"][0]["rows"] - left["rows"], [*([left] if left["rows"] else []), *m["hot"][1:]]
        if n:
            self._publish(self._replace(m, rows, [], "SEAL", multiset_digest(rows)) | {"hot": rest})
        return n

    def compact(self, most_rows: int | None = None, most_shards: int = 1024) -> int:
        """Merges the first live shards, by id, that the budget admits; how many rows went."""
        n = 0
        while True:
            step, rows = self.compact_step(most_rows, most_shards)
            if step is None:
                return n
            if step == "COMPACT":
                return rows

    def compact_step(self, most_rows: int | None = None, most_shards: int = 1024) -> tuple[str | None, int]:
        """One step of a merge: choose shards, write them as one, check and publish. What it was, and how many rows.

        Where a merge stands is in the manifest, so another process goes on with it; if one of its shards is gone by
        then, the merge is dropped and begins anew.
        """
        m = self.manifest()
        live, work = {s["id"]: s for s in self.live(m)}, m["work"]
        if work and not {*work["inputs"]} <= {*live}:
            self._publish(m | {"work": None})
            return self.compact_step(most_rows, most_shards)
        audit = lambda action, n: {"audit": [*m["audit"], {"action": action, "shard_id": 0, "affected": n}]}
        if work is None:
            some, total = [], 0
            for s in sorted(live.values(), key=lambda s: s["id"])[:most_shards]:
                if most_rows is not None and total + s["rows"] > most_rows:
                    break
                some, total = [*some, s["id"]], total + s["rows"]
            if len(some) < 2:
                return None, 0
            self._publish(m | {"work": {"inputs": some, "name": self._new(m, "shards"), "rows": total, "written": None}} | audit("STEP_CHOOSE", total))
            return "STEP_CHOOSE", total
        rows = self._read([live[i]["name"] for i in work["inputs"]])
        if work["written"] is None:
            self._write(rows, work["name"], True)
            self._publish(m | {"work": work | {"written": self._describe(work["name"], 0)}} | audit("STEP_WRITE", work["rows"]))
            return "STEP_WRITE", work["rows"]
        try:
            new = self._place(m, work["written"], work["inputs"], "COMPACT", multiset_digest(rows))
        except StoreError:
            self._commit(lambda now: now | {"work": None})
            raise
        self._publish(new | {"work": None})
        return "COMPACT", work["rows"]

    def _remove(self, gone: Column, exclusion: dict, gap: dict, only: list[int] | None = None) -> int:
        """Takes rows out of each shard and hot file that has some, one for one; the others stay as they are."""
        m = self.manifest()
        parts = [("shards", s) for s in self.live(m) if only is None or s["id"] in only] + [("hot", h) for h in m["hot"] if only is None]
        parts = [(kind, s) for kind, s in parts if s["max_ts"] >= exclusion["from_ts"] and s["min_ts"] < exclusion["to_ts"]]
        counts: dict[int, int] = {}
        if parts:
            tagged = [self._read([s["name"]]).filter(gone).select(F.lit(k).alias("part")) for k, (_, s) in enumerate(parts)]
            counts = {r["part"]: r["count"] for r in reduce(DataFrame.unionByName, tagged).groupBy("part").count().collect()}
        for k, n in sorted(counts.items()):
            kind, s = parts[k]
            left = self._read([s["name"]]).filter(~gone)
            if kind == "shards":
                m = self._replace(m, left, [s["id"]], "REMOVE", affected=n)
                continue
            name = self._new(m, "hot")
            self._write(left, name, False)
            told = self._bounds(name)
            m = m | {"hot": [x for h in m["hot"] for x in (([told] if told["rows"] else []) if h["name"] == s["name"] else [h])], "audit": [*m["audit"], {"action": "REMOVE", "shard_id": 0, "affected": n}]}
        if counts or exclusion not in m["exclusions"]:
            more = [] if exclusion in m["exclusions"] else [exclusion]
            self._publish(m | {"exclusions": [*m["exclusions"], *more], "gaps": [*m["gaps"], gap]})
        return sum(counts.values())

    def expire_before(self, cutoff: int) -> int:
        return self._remove(F.col("ts") < cutoff, {"actor": None, "from_ts": EARLIEST, "to_ts": cutoff}, _gap(EARLIEST, cutoff - 1, EXPIRED))

    def purge_actor(self, actor: int, from_ts: int, to_ts: int) -> int:
        return self._remove((F.col("actor") == actor) & (F.col("ts") >= from_ts) & (F.col("ts") < to_ts), {"actor": actor, "from_ts": from_ts, "to_ts": to_ts}, _gap(from_ts, to_ts - 1, PURGED))

    def retain_shard(self, cutoff: int) -> int:
        """expire_before() for the first live shard with older rows, and the gap from that shard's first row on."""
        old = next((s for s in sorted(self.live(self.manifest()), key=lambda s: s["id"]) if s["min_ts"] < cutoff), None)
        if old is None:
            return 0
        return self._remove(F.col("ts") < cutoff, {"actor": None, "from_ts": EARLIEST, "to_ts": cutoff}, _gap(old["min_ts"], cutoff - 1, EXPIRED), [old["id"]])

    def record_gap(self, from_ts: int, to_ts: int, reason: int, dropped: int = -1, detail: str = "") -> None:
        self._commit(lambda m: m | {"gaps": [*m["gaps"], _gap(from_ts, to_ts, reason, dropped, detail)]})

    def _gaps(self, m: dict, from_ts: int, to_ts: int) -> list[dict]:
        found = self._logged(m, "gaps", lambda f: f["min_ts"] <= to_ts and f["max_ts"] >= from_ts)
        return [g for g in found if g["from_ts"] <= to_ts and g["to_ts"] >= from_ts]

    def gaps_between(self, from_ts: int, to_ts: int) -> DataFrame:
        return self.spark.createDataFrame(sorted(tuple(g[f] for f in GAP.names) for g in self._gaps(self.manifest(), from_ts, to_ts)), GAP)

    def audit(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(a[f] for f in AUDIT.names) for a in self._logged(self.manifest(), "audit")], AUDIT)

    def quarantine(self, shard: int, detail: str = "") -> bool:
        def change(m: dict) -> dict | None:
            found = next((s for s in self.live(m) if s["id"] == shard), None)
            if found is None:
                return None
            shards = [s | {"state": 2} if s["id"] == shard else s for s in m["shards"]]
            return m | {"shards": shards, "gaps": [*m["gaps"], _gap(found["min_ts"], found["max_ts"], QUARANTINED, found["rows"], detail)], "audit": [*m["audit"], {"action": "QUARANTINE", "shard_id": shard, "affected": found["rows"]}]}

        return self._commit(change)

    def verify(self, most_shards: int | None = None, stop: Callable[[], bool] = lambda: False) -> dict[str, int]:
        """Recomputes the digests of live shards and blobs. What is missing or differs is quarantined; what a budget leaves is unverified."""
        out = {"verified": 0, "unverified": 0, "quarantined": 0, "blobs": 0, "bad_blobs": 0}
        for k, s in enumerate(self.live(self.manifest())):
            if (most_shards is not None and k >= most_shards) or stop():
                out["unverified"] += 1
                continue
            try:
                good = self._describe(s["name"], s["id"]) == s
            except StoreError:
                good = False
            out["verified" if good else "quarantined"] += 1
            if not good:
                self.quarantine(s["id"], "content differs")
        if not stop():
            m = self.manifest()
            told = self._table(m["blobs"], BLOB).select("id", (blob_id(F.col("version"), F.col("payload")) == F.col("id")).alias("good"))
            out["blobs"] = told.select("id").distinct().count()
            bad = [r["id"] for r in told.filter("not coalesce(good, false)").select("id").distinct().collect() if r["id"] not in m["bad_blobs"]]
            out["bad_blobs"] = len(bad)
            if bad:
                self._condemn(bad)
        return out

    def orphans(self, keep: int = 1, old_ms: int = OLD_MS) -> list[str]:
        """Files that neither the last snapshots nor a leased one name, and that are old enough to be no running writer's."""
        last, now = self.version(), int(time.time() * 1000)
        versions = {v for v in {*range(max(1, last - keep + 1), last + 1), *self.readers()} if v}
        named = {n for v in versions for m in [self.manifest(v)] for n in [*(h["name"] for h in m["hot"]), *m["blobs"], *m["refs"], *(f["name"] for f in m["files"]), *(s["name"] for s in m["shards"] if s["state"] in (0, 2)), *([m["work"]["name"]] if m["work"] else [])]}
        gone = [f"{kind}/{n}" for kind in ("hot", "shards", "blobs", "refs", "log") for n, at in self.files.ages(kind).items() if f"{kind}/{n}" not in named and at <= now - old_ms]
        return gone + [f"manifest/{n}" for n, at in self.files.ages("manifest").items() if n.endswith(".json") and n[0] != "." and int(n[:-5]) not in versions and int(n[:-5]) < last and at <= now - old_ms]

    def vacuum(self, keep: int = 1, old_ms: int = OLD_MS, most: int = 1024) -> list[str]:
        """Deletes orphans(), so many at most, and marks retired shards whose files went as swept."""
        gone = self.orphans(keep, old_ms)[:most]
        for n in gone:
            self.files.delete(n)
        swept = lambda m: [s | {"state": 3} if s["state"] == 1 and s["name"] in gone else s for s in m["shards"]]
        if any(s["state"] == 1 and s["name"] in gone for s in self.manifest()["shards"]):
            self._commit(lambda m: m | {"shards": swept(m)})
        return gone

    def stats(self) -> dict[str, int]:
        m = self.manifest()
        names = [h["name"] for h in m["hot"]] + [s["name"] for s in self.live(m)]
        return {
            "hot_rows": sum(h["rows"] for h in m["hot"]), "sealed_rows": sum(s["rows"] for s in self.live(m)), "shards": len(self.live(m)),
            "bytes": sum(self.files.size(n) for n in names if self.files.exists(n)), "gaps": len(self._logged(m, "gaps")), "applied": m["applied"],
        }

    # rollback operations

    def begin_operation(self, run: str, plan: dict) -> int:
        key = 0

        def change(m: dict) -> dict:
            nonlocal key
            key = m["next_operation"]
            op = {"id": key, "run": run, "plan": plan, "state": STATE_RUNNING, "cursor": None, "progress": {}}
            return m | {"operations": [*m["operations"], op], "next_operation": key + 1}

        self._commit(change)
        return key

    def _operation(self, key: int, change) -> None:
        def of(m: dict) -> dict:
            if not any(o["id"] == key for o in m["operations"]):
                raise StoreError("INTERNAL", f"no operation {key}, or it is done")
            return m | {"operations": [change(o) if o["id"] == key else o for o in m["operations"]]}

        self._commit(of)

    def checkpoint_operation(self, key: int, cursor, progress: dict) -> None:
        self._operation(key, lambda o: o | {"cursor": list(cursor) if cursor else o["cursor"], "progress": progress})

    def finish_operation(self, key: int, state: int, progress: dict) -> None:
        self._operation(key, lambda o: o | {"state": state, "progress": progress})

    def rewind_operation(self, key: int, run: str) -> None:
        def change(o: dict) -> dict:
            if o["state"] == STATE_DONE:
                raise StoreError("CONTENDED", "the operation is done")
            return o | {"run": run, "cursor": None, "progress": {}, "state": STATE_RUNNING}

        self._operation(key, change)

    def operation(self, key: int) -> dict | None:
        return next((o for o in self._logged(self.manifest(), "operations") if o["id"] == key), None)

    def unfinished_operations(self) -> list[dict]:
        return [o for o in self.manifest()["operations"] if o["state"] != STATE_DONE]


def _gap(from_ts: int, to_ts: int, reason: int, dropped: int = -1, detail: str = "") -> dict:
    return {"from_ts": from_ts, "to_ts": to_ts, "reason": reason, "dropped": dropped, "detail": detail}
