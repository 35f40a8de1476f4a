"""Mutation histories from tables at hand: `events` (long histories) and `lineitem` (far apart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.geometry import chunk, morton

SHIFT = 63158400000
_STATE = {"view": 1, "click": 2, "purchase": 3, "signup": 4}


def _millis(ts: str):
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("bigint")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    state = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _STATE.items()], F.lit(0))
    rows = e.select(
        "event_id", "event_type", "user_id", "props",
        (_millis("ts") + SHIFT).alias("ts"), (F.col("event_id") % 65536).cast("int").alias("seq"), (F.col("user_id") + 16).cast("int").alias("actor"),
        (F.col("user_id") % 3).cast("int").alias("w"), ((F.col("event_id") * 7) % 40 - 20).cast("int").alias("x"), ((F.col("user_id") * 5) % 12 - 6).cast("int").alias("y"),
        ((F.col("event_id") * 11) % 40 - 20).cast("int").alias("z"), state.alias("a"),
    )
    before = F.lag("a").over(W.partitionBy("w", "x", "y", "z").orderBy("ts", "seq"))
    return rows.withColumns({"b": F.coalesce(before, F.lit(0)), "kind": F.lit(1), "cause": F.when(F.col("a") == 0, 1).otherwise(2), "c": morton(chunk("x"), chunk("z"))})


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = li.select(
        (F.col("l_suppkey") % 3).cast("int").alias("w"),
        ((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31) % 8192 - 4096).cast("int").alias("x"),
        ((F.col("l_suppkey") * 13 + F.col("l_linenumber")) % 384 - 64).cast("int").alias("y"),
        ((F.col("l_orderkey") * 6151 + F.col("l_partkey") * 17) % 8192 - 4096).cast("int").alias("z"),
        (_millis("l_shipdate") + k % 86400000 + 1000000000000).alias("ts"), (k % 65536).cast("int").alias("seq"), (F.col("l_suppkey") % 100 + 16).cast("int").alias("actor"),
        F.col("l_quantity").cast("int").alias("b"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).cast("int").alias("a"),
    )
    return rows.withColumns({"cause": F.lit(2), "kind": F.lit(1), "c": morton(chunk("x"), chunk("z"))})


def world_state(rows: DataFrame) -> DataFrame:
    """The state at each position, tampered with at some."""
    last = rows.groupBy("w", "x", "y", "z").agg(F.max_by(F.struct("a", "event_id"), F.col("ts") * 65536 + F.col("seq")).alias("r"))
    return last.select("w", "x", "y", "z", F.when(F.col("r.event_id") % 17 == 0, 9).otherwise(F.col("r.a")).alias("state"))


def gaps(rows: DataFrame) -> DataFrame:
    e = rows.filter("event_type = 'error'")
    return e.select(F.col("ts").alias("from_ts"), (F.col("ts") + 300000).alias("to_ts"), (F.col("event_id") % 6 + 1).cast("int").alias("reason"), F.lit(1).cast("bigint").alias("dropped"))
