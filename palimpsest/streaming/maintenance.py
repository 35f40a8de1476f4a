"""Maintenance between batches: a round of phases, one bounded step at a time, put off while there is a backlog."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields
from time import monotonic

from palimpsest.sources.store import Store

PHASES = ("COMPACT", "VERIFY", "RETAIN", "CHECKPOINT", "SEAL")
#: Outcomes of a step.
COMPLETED, PROGRESSED, QUARANTINED, UNVERIFIED = "COMPLETED", "PROGRESSED", "QUARANTINED", "UNVERIFIED"
NO_WORK, DEFERRED, CANCELLED = "NO_WORK", "DEFERRED", "CANCELLED"
UNITS = {"ms": 1, "s": 1000, "m": 60000, "h": 3600000, "d": 86400000}


def duration_ms(text: str) -> int:
    found = re.fullmatch("([0-9]+)(ms|s|m|h|d)", text)
    if not found:
        raise ValueError(f"not a duration: {text}")
    return int(found[1]) * UNITS[found[2]]


@dataclass(frozen=True)
class Budget:
    rows: int = 1_000_000
    shards: int = 2
    ms: int = 1000

    def __post_init__(self):
        if self.rows < 1 or not 2 <= self.shards <= 1024 or not 1 <= self.ms <= 60000:
            raise ValueError("a budget needs a row or more, 2 to 1024 shards and 1 to 60000 ms")


@dataclass(frozen=True)
class Config:
    """interval: between rounds; retention: age of what expires, none for nothing; others as in Budget."""

    interval: int = 60000
    retention: int | None = None
    budget: Budget = field(default_factory=Budget)

    @classmethod
    def parse(cls, text: str) -> tuple[Config, dict[str, str]]:
        """From lines `key: value` (# starts a comment). Also gives unknown keys; raises once, with all errors."""
        got, errors, foreign = {}, [], {}
        for raw in text.splitlines():
            line = raw.split("#")[0].strip()
            if not line:
                continue
            key, colon, value = (x.strip() for x in line.partition(":"))
            if not colon or key in got:
                errors.append(f"{line}: {'given twice' if colon else 'no value'}")
                continue
            try:
                if key in ("interval", "retention"):
                    got[key] = duration_ms(value)
                elif key in {f.name for f in fields(Budget)}:
                    got[key] = int(value)
                else:
                    foreign[key] = value
            except ValueError:
                errors.append(f"{key}: bad value {value}")
        if errors:
            raise ValueError("; ".join(errors))
        budget = Budget(**{k: v for k, v in got.items() if k not in ("interval", "retention")})
        return cls(budget=budget, **{k: v for k, v in got.items() if k in ("interval", "retention")}), foreign


    def render(self, foreign: dict[str, str] | None = None) -> str:
        """The text that parse() reads, keys of others after ours."""

        def duration(ms: int) -> str:
            unit = next(u for u in ("d", "h", "m", "s", "ms") if ms % UNITS[u] == 0)
            return f"{ms // UNITS[unit]}{unit}"

        lines = ["# between rounds of maintenance", f"interval: {duration(self.interval)}", "# age of rows that expire; leave out to keep all"]
        lines.append("# retention: 365d" if self.retention is None else f"retention: {duration(self.retention)}")
        lines += ["# of a step: rows, shards (2 to 1024) and milliseconds (1 to 60000)", *(f"{f.name}: {getattr(self.budget, f.name)}" for f in fields(Budget))]
        return "\n".join([*lines, *(f"{k}: {v}" for k, v in (foreign or {}).items())]) + "\n"

    @classmethod
    def load(cls, path: str) -> tuple[Config, dict[str, str]]:
        """From a file, which is made with the defaults if it is not there."""
        if not os.path.exists(path):
            cls().save(path)
        with open(path) as f:
            return cls.parse(f.read())

    def save(self, path: str, foreign: dict[str, str] | None = None) -> None:
        part = f"{path}.part"
        with open(part, "w") as f:
            f.write(self.render(foreign))
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)


class Schedule:
    """tick() makes at most one step, so that ingestion goes on between steps. A step that takes longer than its budget is
    the last of its phase in this round, and a verification stops within it; set cancelled to stop before the next one.
    """

    def __init__(self, store: Store, config: Config = Config()):
        self.store, self.config, self.phase, self.next, self.cancelled = store, config, 0, 0, False

    def tick(self, now: int, backlogged: bool = False) -> tuple[str, str] | None:
        """Phase and outcome of the step, or none if the next round isn't due."""
        if now < self.next:
            return None
        name = PHASES[self.phase]
        if self.cancelled:
            return name, CANCELLED
        if backlogged:
            return name, DEFERRED
        began = monotonic()
        outcome = self._step(name, now)
        over = (monotonic() - began) * 1000 > self.config.budget.ms
        if outcome != PROGRESSED or name in ("VERIFY", "CHECKPOINT") or over:
            self.phase += 1
            if self.phase == len(PHASES):
                self.phase, self.next = 0, now + self.config.interval
        return name, outcome

    def _step(self, name: str, now: int) -> str:
        b, began = self.config.budget, monotonic()
        if name == "COMPACT":
            step, _ = self.store.compact_step(b.rows, b.shards)
            return NO_WORK if step is None else COMPLETED if step == "COMPACT" else PROGRESSED
        if name == "VERIFY":
            out = self.store.verify(stop=lambda: self.cancelled or (monotonic() - began) * 1000 > b.ms)
            if out["quarantined"] or out["bad_blobs"]:
                return QUARANTINED
            return UNVERIFIED if out["unverified"] else COMPLETED if out["verified"] else NO_WORK
        if name == "RETAIN":
            if self.config.retention is None:
                return NO_WORK
            if self.store.readers():
                return DEFERRED
            return PROGRESSED if self.store.retain_shard(now - self.config.retention) else NO_WORK
        if name == "CHECKPOINT":  # old snapshots; there is no other log to cut
            return PROGRESSED if self.store.vacuum() else NO_WORK
        return PROGRESSED if self.store.seal(most_rows=b.rows) else NO_WORK
