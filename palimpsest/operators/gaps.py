"""Time windows whose history is known to be lost, and rows that must not be kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.schema import REFUSING, StoreError

#: Exclusions that are said as literals; more of them by actor are joined, and broadcast up to the second number.
MOST_LITERALS, MOST_BROADCAST = 64, 100_000


def overlapping(gaps: DataFrame, from_ts: int, to_ts: int) -> DataFrame:
    """Gaps that touch a window, both ends inclusive."""
    return gaps.filter((F.col("from_ts") <= to_ts) & (F.col("to_ts") >= from_ts)).orderBy("from_ts", "to_ts")


def refuse(gaps: DataFrame, from_ts: int, to_ts: int, rollback: bool = False) -> None:
    """Raises if a gap touches the window: any for a rollback, else those with removed or damaged history."""
    found = overlapping(gaps, from_ts, to_ts)
    if not (found if rollback else found.filter(F.col("reason").isin(*REFUSING))).isEmpty():
        raise StoreError("CORRUPT", "history in this window is incomplete")


def uncovered(lost: DataFrame, gaps: DataFrame, slot_ms: int = 3_600_000) -> DataFrame:
    """Lost rows in no gap. Both sides are cut into slots of time, so this is an equi join, not a nested loop."""
    slots = F.sequence(F.floor(F.col("from_ts") / slot_ms), F.floor(F.col("to_ts") / slot_ms))
    cut = gaps.select("from_ts", "to_ts", F.explode(slots).alias("slot"))
    rows = lost.withColumn("slot", F.floor(F.col("ts") / slot_ms))
    on = [rows["slot"] == cut["slot"], rows["ts"] >= cut["from_ts"], rows["ts"] <= cut["to_ts"]]
    return rows.join(cut, on, "left_anti").drop("slot")


def merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open windows, in order, those that touch joined."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(windows):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _any(conditions: list[Column]) -> Column:
    """One of them holds. They are joined in pairs: one after the other, thousands would be too deep a tree for the planner."""
    while len(conditions) > 1:
        conditions = [reduce(lambda p, q: p | q, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0] if conditions else F.lit(False)


def _inside(windows: list[tuple[int, int]]) -> Column:
    return _any([(F.col("ts") >= low) & (F.col("ts") < high) for low, high in windows])


def without_excluded(rows: DataFrame, exclusions: DataFrame, most_literals: int = MOST_LITERALS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Rows that no exclusion matches: its actor or, where it has none, any, and a half-open window.

    Exclusions are decisions of operators. Those of any actor are removals of all before some time: they are merged on
    the driver and said as literals, which parquet prunes by. Those of an actor are literals too if there are few, actors
    with the same windows as one list; else they are joined by actor, broadcast behind a check of their number. Rows are
    never broadcast, nor met by a nested loop.
    """
    e = exclusions.select(F.col("actor").cast("int").alias("e_actor"), F.col("from_ts").cast("bigint").alias("e_from"), F.col("to_ts").cast("bigint").alias("e_to")).filter("e_from < e_to")
    every = merged([(r["e_from"], r["e_to"]) for r in e.filter("e_actor is null").select("e_from", "e_to").distinct().collect()])
    if every:
        rows = rows.filter(~_inside(every))
    of_actor = e.filter("e_actor is not null").distinct()
    n = of_actor.count()
    if not n:
        return rows
    if n <= most_literals:
        by: dict[int, list[tuple[int, int]]] = {}
        for r in of_actor.collect():
            by.setdefault(r["e_actor"], []).append((r["e_from"], r["e_to"]))
        alike: dict[tuple[tuple[int, int], ...], list[int]] = {}
        for a, w in sorted(by.items()):
            alike.setdefault(tuple(merged(w)), []).append(a)
        own = _any([F.col("actor").isin(actors) & _inside(list(w)) for w, actors in alike.items()])
        return rows.filter(~F.coalesce(own, F.lit(False)))
    of_actor = F.broadcast(of_actor) if n <= most_broadcast else of_actor.hint("merge")
    return rows.join(of_actor, (F.col("actor") == F.col("e_actor")) & (F.col("ts") >= F.col("e_from")) & (F.col("ts") < F.col("e_to")), "left_anti")


def low_watermark(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """The earliest ts of what is being written and of what is staged."""
    least = [df.agg(F.min("ts").alias("ts")) for df in (rows, staged)]
    return least[0].unionByName(least[1]).agg(F.min("ts").alias("low_water"))


def loss_bounds(lost: DataFrame, by: str) -> DataFrame:
    return lost.groupBy(by).agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("dropped"))


def crash_gap(mark: int, last_capture: int, newest_file: int) -> tuple[int, int]:
    """The window that a crash may have lost; mark: the low-water mark, 0 for none."""
    return (min(mark, last_capture) if mark > 0 else last_capture), max(last_capture, newest_file) + 1000


def crash_gaps(mark: Column, last_capture: Column, newest_file: Column) -> dict[str, Column]:
    """crash_gap() in columns; a bound is null where nothing was captured, marked or written."""
    low = F.when((mark > 0) & (last_capture > 0), F.least(mark, last_capture)).when(mark > 0, mark).when(last_capture > 0, last_capture).otherwise(newest_file)
    known = F.greatest(last_capture, newest_file) > 0
    return {"from_ts": F.when(known & (low > 0), low), "to_ts": F.when(known & (low > 0), F.greatest(last_capture, newest_file) + 1000)}
