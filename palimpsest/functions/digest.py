"""Digests of rows, and of sets of rows whatever their order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.geometry import local
from palimpsest.schema import KEY

ROW = ("w", "c", "ts", "seq", "p", "b", "a", "actor", "cause", "kind")


def row_bytes() -> Column:
    """Ten big-endian longs."""
    parts = [F.lpad(F.hex((local("x", "y", "z") if n == "p" else F.col(n)).cast("bigint")), 16, "0") for n in ROW]
    return F.unhex(F.concat(*parts))


def row_digest() -> Column:
    """SHA-256, in hexadecimal, of a row's bytes."""
    return F.sha2(row_bytes(), 256)


def limbs(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows' count and, as four sums of 32 bits each, the sum of the first 128 bits of their digests."""
    part = [F.conv(F.substring("d", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(4)]
    return rows.select(*(by or []), row_digest().alias("d")).groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.sum(p).cast("decimal(38,0)").alias(f"l{k}") for k, p in enumerate(part)])


def multiset_digest(rows: DataFrame) -> str:
    r = limbs(rows).first()
    total = sum(int(r[f"l{k}"] or 0) << 32 * (3 - k) for k in range(4)) % (1 << 128)
    return f"{r['n']:016x}{total:032x}"


def ordered_digest(rows: DataFrame, by: str) -> DataFrame:
    """By a column (a shard, whose rows the budget of compaction bounds): SHA-256 of its rows' bytes in key order, then their number.

    A shard is hashed by one task, as its digest depends on order, from a sorted stream: nothing of it is held.
    """
    kind = rows.schema[by].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, h, done = None, 0, None, []
        for batch in batches:
            for value, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h is None or value != at:
                    if h is not None:
                        done.append((at, n, h))
                    at, n, h = value, 0, hashlib.sha256()
                h.update(data)
                n += 1
        if h is not None:
            done.append((at, n, h))
        for _, count, hashing in done:
            hashing.update(count.to_bytes(8, "big"))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2].hexdigest() for d in done])], [by, "n", "digest"])

    sort = [by, *(k for k in KEY if k != by)]
    own = rows.withColumn("bytes", row_bytes()).repartition(by).sortWithinPartitions(*sort)
    return own.select(by, "bytes").mapInArrow(hashed, f"{by} {kind}, n bigint, digest string")


def blob_id(version, payload) -> Column:
    return F.sha2(F.concat(F.unhex(F.lpad(F.hex(version), 8, "0")), payload), 256)
