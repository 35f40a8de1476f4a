"""What a scan asks for, and the predicates that say it. Key ranges and resumption are literals, so parquet prunes by them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.geometry import Box, cover

OLDEST, NEWEST = "oldest", "newest"


@dataclass(frozen=True)
class ScanPlan:
    world: int
    box: Box
    from_ts: int
    to_ts: int
    order: str = OLDEST
    actors: tuple[int, ...] | None = None
    batch: int = 4096
    resume: tuple[int, int, int] | None = None
    most_ranges: int = 64

    def __post_init__(self):
        if self.from_ts > self.to_ts:
            raise ValueError("a scan's time window ends before it starts")
        if self.batch < 1:
            raise ValueError("a page needs at least one row")

    def with_actors(self, *actors: int) -> ScanPlan:
        return replace(self, actors=actors)

    def with_batch(self, n: int) -> ScanPlan:
        return replace(self, batch=n)

    def resume_after(self, position: tuple[int, int, int] | None) -> ScanPlan:
        return replace(self, resume=position)

    @property
    def ranges(self) -> list[tuple[int, int, bool]]:
        return cover(self.box.chunks(), self.most_ranges)

    @property
    def empty(self) -> bool:
        return self.from_ts >= self.to_ts or self.actors == ()

    @property
    def coarse(self) -> bool:
        return not self.box.aligned or any(not exact for _, _, exact in self.ranges)

    def predicate(self) -> Column:
        if self.empty:
            return F.lit(False)
        keys = reduce(lambda p, q: p | q, [F.col("c").between(low, high) for low, high, _ in self.ranges])
        # where keys are computed, they are the dearest to test: last
        out = (F.col("w") == self.world) & (F.col("ts") >= self.from_ts) & (F.col("ts") < self.to_ts) & self.box.holds() & keys
        if self.actors is not None:
            out &= F.col("actor").isin(*self.actors)
        if self.resume is not None:
            c, ts, seq = self.resume
            past = (lambda n, v: F.col(n) > v) if self.order == OLDEST else (lambda n, v: F.col(n) < v)
            out &= past("c", c) | ((F.col("c") == c) & (past("ts", ts) | ((F.col("ts") == ts) & past("seq", seq))))
        return out

    def sort(self) -> list[Column]:
        return [F.col(n).asc() if self.order == OLDEST else F.col(n).desc() for n in ("c", "ts", "seq")]


def select(rows: DataFrame, plan: ScanPlan) -> DataFrame:
    return rows.filter(plan.predicate())


def scan(rows: DataFrame, plan: ScanPlan) -> DataFrame:
    return select(rows, plan).orderBy(*plan.sort())


def page(rows: DataFrame, plan: ScanPlan) -> DataFrame:
    """The next page; the position to resume after is that of its last row."""
    return scan(rows, plan).limit(plan.batch)
