"""Rollbacks as a whole: refusal, record, fold, comparison, writes and checkpoints, and what goes on after a stop.

A rollback goes through chunks in scan order, newest key first, in steps of a bounded number of chunks. A step is one
distributed fold and join; the driver sees chunk keys of one step and counters. After a step, `apply` has its writes and
the operation its cursor, so that a stop costs at most one step, which applies again without effect: a position that
has its target already is counted as such.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.geometry import Box
from palimpsest.operators import fold
from palimpsest.operators.gaps import refuse
from palimpsest.plans.scan_plan import NEWEST, ScanPlan, select
from palimpsest.schema import KEY, StoreError
from palimpsest.sources.store import STATE_DONE, Store

STATE_PARTIAL, STATE_CANCELLED = 3, 5
COUNTERS = ("scanned", "chunks", "applied", "already", "mismatched", "contended")
#: Chunks in a step.
CHUNKS = 4096


@dataclass(frozen=True)
class Result:
    operation: int
    state: int
    progress: dict[str, int]

    def line(self) -> str:
        return " ".join([f"op={self.operation}", f"state={self.state}", *(f"{k}={self.progress.get(k, 0)}" for k in COUNTERS)])


class Rollbacks:
    """world: the current state by position (w, x, y, z, state), read again for each step.

    apply: takes the mutations of a step and makes them so. contended: chunks (w, c) that can't be written now; they are
    counted, the cursor stays before the first of them, and the operation ends as PARTIAL. states: the ids that the world
    can be given, all if none. worlds: the worlds that are loaded, all if none; those of others are refused.
    """

    def __init__(self, store: Store, world: Callable[[], DataFrame], apply: Callable[[DataFrame], None], contended: DataFrame | None = None, run: str | None = None, chunks: int = CHUNKS, states: DataFrame | None = None, worlds: set[int] | None = None):
        self.store, self.world, self.apply, self.contended = store, world, apply, contended
        self.run, self.chunks, self._cancelled, self._running = run or uuid.uuid4().hex, chunks, set(), set()
        self.states, self.worlds = states, worlds

    def cancel(self, key: int) -> None:
        """The operation stops before its next step."""
        self._cancelled.add(key)

    def rollback(self, world: int, box: Box, from_ts: int, to_ts: int, actor: int | None = None, now: int | None = None) -> Result:
        self._loaded(world)
        self.store.seal()
        self._refuse(from_ts, to_ts)
        stored = {"world": world, "box": [box.x0, box.y0, box.z0, box.x1, box.y1, box.z1], "from_ts": from_ts, "to_ts": to_ts, "actor": actor, "now": to_ts if now is None else now}
        return self._go(self.store.begin_operation(self.run, stored))

    def resume(self, key: int) -> Result:
        """From the cursor if this run began the operation, else its whole window again."""
        op = self.store.operation(key)
        if op is None or op["state"] == STATE_DONE:
            raise StoreError("CONTENDED", f"operation {key} can't be resumed")
        if key in self._running:
            raise StoreError("CONTENDED", f"operation {key} is running")
        self._loaded(op["plan"]["world"])
        self.store.seal()
        if op["run"] != self.run:
            self.store.rewind_operation(key, self.run)
        self._refuse(op["plan"]["from_ts"], op["plan"]["to_ts"])
        self._cancelled.discard(key)
        return self._go(key)

    def status(self) -> dict:
        return self.store.stats() | {"unfinished": [o["id"] for o in self.store.unfinished_operations()]}

    def _loaded(self, world: int) -> None:
        if self.worlds is not None and world not in self.worlds:
            raise StoreError("CONTENDED", f"world {world} is not loaded")

    def _refuse(self, from_ts: int, to_ts: int) -> None:
        refuse(self.store.gaps_between(from_ts, to_ts), from_ts, to_ts, rollback=True)

    def _go(self, key: int) -> Result:
        self._running.add(key)
        try:
            return self._steps(key)
        finally:
            self._running.discard(key)

    def _steps(self, key: int) -> Result:
        op = self.store.operation(key)
        p, cursor, progress = op["plan"], op["cursor"], {k: 0 for k in COUNTERS} | op["progress"] | {"contended": 0}
        plan = ScanPlan(p["world"], Box(*p["box"]), p["from_ts"], p["to_ts"], NEWEST, None if p["actor"] is None else (p["actor"],))
        pinned = self.store.manifest()
        rows = self.store.rows(pinned, plan)
        fold.checked(select(rows, plan), self.store.refs())
        below, frozen = (cursor[0] if cursor else None), False
        while True:
            if key in self._cancelled:
                return self._end(key, STATE_CANCELLED, progress)
            left = select(rows, plan) if below is None else select(rows, plan).filter(F.col("c") < below)
            keys = [r["c"] for r in left.select("c").distinct().orderBy(F.desc("c")).limit(self.chunks).collect()]
            if not keys:
                return self._end(key, STATE_PARTIAL if progress["contended"] else STATE_DONE, progress)
            below = keys[-1]
            step = left.filter(F.col("c") >= below)
            stuck = self._contended(step)
            free = step if stuck is None else step.join(stuck, ["w", "c"], "left_anti")
            told = fold.classify(fold.fold(free), self.world(), self.states).persist()
            try:
                counts = fold.summary(told).first().asDict()
                self.apply(fold.writes(told, p["now"]))
            finally:
                told.unpersist()
            n_stuck = 0 if stuck is None else stuck.count()
            progress = {k: progress[k] + counts.get(k, 0) for k in COUNTERS} | {"contended": progress["contended"] + n_stuck}
            # the cursor: the oldest row of the last chunk before the first contended one
            last = None
            if not frozen:
                of = fold.checkpoint(step, step.select("w", "c").limit(0) if stuck is None else stuck).first()
                last = of and (of["c"], of["ts"], of["seq"])
            frozen = frozen or n_stuck > 0
            self.store.checkpoint_operation(key, last, progress)

    def _contended(self, step: DataFrame) -> DataFrame | None:
        return None if self.contended is None else step.select("w", "c").distinct().join(self.contended.select("w", "c"), ["w", "c"], "left_semi")

    def _end(self, key: int, state: int, progress: dict[str, int]) -> Result:
        self.store.finish_operation(key, state, progress)
        return Result(key, state, progress)


def command(rollbacks: Rollbacks, line: str, world: int, at: tuple[int, int, int], now: int):
    """`status`, `rollback [radius 0..512] [seconds 1..86400]` or `resume <id>`, around a position."""
    words = line.split()
    if words == ["status"]:
        return rollbacks.status()
    if len(words) == 2 and words[0] == "resume" and words[1].isdigit():
        return rollbacks.resume(int(words[1]))
    if words and words[0] == "rollback" and len(words) <= 3 and all(w.isdigit() for w in words[1:]):
        radius, seconds = [*map(int, words[1:]), *[10, 600][len(words) - 1 :]]
        if radius <= 512 and 1 <= seconds <= 86400:
            return rollbacks.rollback(world, Box.around(*at, radius), now - 1000 * seconds, now, now=now)
    raise ValueError(f"not a command: {line}")
