"""Folds over a scan: what to restore, what holds at a time, and what net changes a tick made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.codec import STATE, WORLD, in_range
from palimpsest.schema import POSITION, StoreError

#: One long in place of (ts, seq), which keeps max_by and min_by in hash aggregation.
ORDER = "ts * 65536 + seq"


def fold(rows: DataFrame) -> DataFrame:
    """By position: expected (after of the newest row), target (before of the oldest) and how many rows."""
    o = F.expr(ORDER)
    return rows.groupBy(*POSITION, "c").agg(F.max_by("a", o).alias("expected"), F.min_by("b", o).alias("target"), F.count("*").alias("n"))


def state_as_of(rows: DataFrame, ts: int) -> DataFrame:
    return rows.filter(F.col("ts") <= ts).groupBy(*POSITION).agg(F.max_by("a", F.expr(ORDER)).alias("state"))


def classify(folded: DataFrame, world: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """With outcome: already (before anything else), mismatched or applied.

    states: the ids (state) that can be put into the world; a target that is none of them is mismatched.
    """
    out = folded.join(world, POSITION, "left")
    known = F.lit(True)
    if states is not None:
        out = out.join(states.select(F.col("state").cast("int").alias("target")).distinct().withColumn("__known", F.lit(True)), "target", "left")
        known = F.col("__known").isNotNull()
    outcome = F.when(F.col("state") == F.col("target"), "already").when(F.col("state").eqNullSafe(F.col("expected")) & known, "applied").otherwise("mismatched")
    return out.withColumn("outcome", outcome).select(*folded.columns, "state", "outcome")


def summary(classified: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return classified.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("scanned"), F.countDistinct("w", "c").alias("chunks"), count("applied"), count("already"), count("mismatched"))


def by_chunk(classified: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return classified.groupBy("w", "c").agg(F.sum("n").cast("bigint").alias("scanned"), count("applied"), count("already"), count("mismatched"))


def writes(classified: DataFrame, ts: int) -> DataFrame:
    """The mutations that applying makes: actor 1, cause 3."""
    rows = classified.filter("outcome = 'applied'")
    seq = F.row_number().over(W.partitionBy("w", "c").orderBy("x", "y", "z")) - 1
    return rows.select("w", "c", F.lit(ts).cast("bigint").alias("ts"), seq.cast("int").alias("seq"), "x", "y", "z", F.col("expected").alias("b"), F.col("target").alias("a"), F.lit(1).alias("actor"), F.lit(3).alias("cause"), F.lit(1).alias("kind"))


def preflight(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """By world: rows that a rollback must refuse, for their kind or a payload."""
    own = refs.select("w", "c", "ts", "seq", F.lit(True).alias("payload"))
    out = rows.join(own, ["w", "c", "ts", "seq"], "left")
    return out.groupBy("w").agg(F.count_if(F.col("kind") != 1).alias("other_kind"), F.count_if(F.col("payload")).alias("with_payload"), F.count("*").alias("rows"))


def checked(rows: DataFrame, refs: DataFrame) -> DataFrame:
    bad = preflight(rows, refs).filter("other_kind + with_payload > 0")
    if not bad.isEmpty():
        raise StoreError("CONTENDED", "the selection has rows that can't be rolled back")
    return rows


def checkpoint(rows: DataFrame, contended: DataFrame) -> DataFrame:
    """By world: the last row, newest chunk first, of the chunks before the first contended one (w, c)."""
    chunks = rows.groupBy("w", "c").agg(F.min(F.expr(ORDER)).alias("o"), F.count("*").alias("n"))
    # rows go by chunk, newest first, so the last row of a chunk is its oldest
    stop = chunks.join(contended, ["w", "c"], "left_semi").groupBy("w").agg(F.max("c").alias("stop"))
    open_ = chunks.join(stop, "w", "left").filter("stop is null or c > stop")
    last = F.min_by(F.struct("c", "o"), "c")
    return open_.groupBy("w").agg(last.alias("r"), F.sum("n").cast("bigint").alias("scanned")).select("w", F.col("r.c").alias("c"), F.floor(F.col("r.o") / 65536).alias("ts"), (F.col("r.o") % 65536).cast("int").alias("seq"), "scanned")


def net_changes(rows: DataFrame, tick_ms: int) -> DataFrame:
    """By tick and position: first before, last after, observations, and whether their actors or causes differ."""
    o = F.expr(ORDER)
    tick = F.floor(F.col("ts") / tick_ms).cast("bigint").alias("tick")
    return rows.groupBy(tick, *POSITION).agg(
        F.min_by("b", o).alias("b"), F.max_by("a", o).alias("a"), F.count("*").alias("observations"), (F.countDistinct(F.struct("actor", "cause", "kind")) > 1).alias("ambiguous"), F.min_by("actor", o).alias("actor")
    )


def invalid(before: bool = True) -> Column:
    """Why a captured row can't be recorded, null where it can: its position, or another field, is out of range."""
    state = lambda n: F.coalesce(~F.col(n).between(0, STATE), F.lit(True))
    fields = F.coalesce(~F.col("w").between(0, WORLD) | ~F.col("cause").between(0, 255) | ~F.col("kind").between(0, 15), F.lit(True))
    fields = fields | state("b") if before else fields
    return F.when(~F.coalesce(in_range("x", "y", "z"), F.lit(False)), "out_of_range").when(fields, "invalid")


def confirmed() -> Column:
    """The outcome of a net change whose state now (a, null where it could not be read) is known."""
    a = F.col("a")
    return F.when(a.isNull(), "unreadable").when(~a.between(0, STATE), "invalid").when(a == F.col("b"), "rejected").when(F.col("ambiguous"), "ambiguous").otherwise("published")


def outcomes(net: DataFrame) -> DataFrame:
    """Observations by outcome: unchanged net states are rejected, ambiguous, unreadable and invalid ones lost, others published."""
    told = confirmed()
    outcome = F.when(told.isin("ambiguous", "unreadable"), "lost").otherwise(told)
    return net.groupBy(outcome.alias("outcome")).agg(F.sum("observations").cast("bigint").alias("observations"), F.count("*").alias("groups"))


def progress(rows: DataFrame, by: list[str], counters: list[str], less: str = "less") -> DataFrame:
    """Sums of counters by group, where rows flagged as less are taken off."""
    sign = F.when(F.col(less), -1).otherwise(1)
    return rows.groupBy(*by).agg(*[F.sum(sign * F.col(n)).cast("bigint").alias(n) for n in counters])
