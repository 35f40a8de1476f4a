"""What the training-data operators share: the shared folder, deterministic batches of documents,
words and their hashes as numpy arrays, and compact sorted sets of hashes that batches send to buckets.

Batches: operators that must look up something for every word or window of a corpus send it as one
sorted set per (batch, bucket) and get back one bit or count per entry, in the same order. A key that
a third of all rows hold is one entry per batch, so no bucket gets a group that grows with its copies.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a batch, about; entries of a bucket, about.
BATCH_BYTES = 8_000_000
BUCKET_ENTRIES = 1_500_000
#: Rows that are equal in doc_id and text, at most, in one batch.
MOST_EQUAL = 1000
#: Words of 64 row numbers that are broadcast, at most: those of some 64 million rows.
MOST_WORDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    Where none is configured, one of our own if all runs in this process (tests); on a cluster that is an error, since
    each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again, which cuts its lineage."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def among(df: DataFrame, number: str, rows: DataFrame, inside: bool = True, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of df whose number, from 0 on, is one of column row of rows, or (inside=False) is none of them.

    Rows go as bits, 64 numbers a word, so up to most_words of them are broadcast, behind a count, and df, with its texts,
    stays where it is; beyond that, df is joined to them by a shuffle.
    """
    bit = F.expr("shiftleft(1L, cast(row & 63 as int))")
    words = saved(rows.select(F.shiftright("row", 6).alias("__word"), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits")))
    n = words.count()
    if not n:
        return df.filter(F.lit(False)) if inside else df
    words = F.broadcast(words) if n <= most_words else words.hint("merge")
    hit = F.coalesce(F.getbit("__bits", F.col(number).bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1, F.lit(False))
    return df.join(words, F.shiftright(number, 6) == F.col("__word"), "left").filter(hit if inside else ~hit).select(*df.columns)


def batched(docs: DataFrame, batch_bytes: int = BATCH_BYTES, also: tuple[str, ...] = (), most_equal: int = MOST_EQUAL) -> tuple[DataFrame, int, int]:
    """doc_id, text (null: empty), the columns of also, and batch, a number under the second result; the third is the bytes of all texts.

    The batch of a row depends on its doc_id and text alone, so a lost task makes the same batch again, and rows that
    repeat a doc_id, or have none, are dealt out. Where more than most_equal rows are equal in both, rows are written with
    a number each and dealt out by that.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *also)
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    equal = rows.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    most, total = equal.agg(F.max("n"), F.sum("size")).first()
    if (most or 0) > most_equal:
        rows, key = saved(rows.withColumn("__row", F.monotonically_increasing_id())), F.xxhash64("__row")
    n = max(1, -(-(total or 0) // batch_bytes))
    return rows.select("doc_id", "text", *also, F.pmod(key, F.lit(n)).cast("int").alias("batch")), n, total or 0


def count_words(text: Column) -> Column:
    """How many runs without ASCII white space a (non-null) text has, natively."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("bigint")


# --- arrays and texts in expressions -----------------------------------------------------------------


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once a row, also where f uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, join: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """For an array of numbers from 0 on, what join makes of those before each, and of all: one more than it has.

    Arrays grow by copies in expressions, so the array is cut into blocks: the work is nearly in proportion to its size.
    """
    zero, none = F.lit(0).cast("bigint"), F.expr("cast(array() as array<bigint>)")
    total = lambda cut: F.aggregate(cut, zero, lambda a, x: join(a, x).cast("bigint"))

    def each(cut: Column, start: Column, value: Callable[[Column], Column]) -> Column:
        """The values before each of cut's, then that after the last."""
        add = lambda acc, x: F.struct(join(acc["at"], value(x)).cast("bigint").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(cut, F.struct(start.alias("at"), none.alias("out")), add, lambda acc: F.concat(acc["out"], F.array(acc["at"])))

    def of(v: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int")), lambda k: F.slice(v, k * block + 1, F.lit(block)))
        whole = lambda cs: let(each(cs, zero, total), lambda starts: F.flatten(F.transform(cs, lambda cut, k: F.slice(each(cut, F.get(starts, k), lambda x: x), 1, F.size(cut)))))
        return let(cuts, lambda cs: F.concat(whole(cs), F.array(F.aggregate(cs, zero, lambda a, cut: join(a, total(cut)).cast("bigint")))))

    return let(values, of)


#: Code points in a piece of blocks().
PIECE = 512


def blocks(text: Column) -> Column:
    """A text in pieces of PIECE code points. They are cut in two levels, as substring() goes through all that is before."""

    def cut(t: Column, size: int) -> Column:
        last = F.greatest(F.ceil(F.length(t) / size) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(t, k * size + 1, F.lit(size)))

    return F.flatten(F.transform(let(text, lambda t: cut(t, 128 * PIECE)), lambda t: cut(t, PIECE)))


def between(pieces: Column, start: Column, stop: Column) -> Column:
    """The code points from start to stop of a text that is given in blocks()."""
    low = lambda k: F.greatest(start - k * PIECE, F.lit(0)).cast("int")
    part = lambda k: F.substring(F.get(pieces, k), low(k) + 1, F.least(stop - k * PIECE, F.lit(PIECE)).cast("int") - low(k))
    on = F.sequence(F.floor(start / PIECE).cast("int"), F.floor((stop - 1) / PIECE).cast("int"))
    return F.when(stop > start, F.array_join(F.transform(on, part), "")).otherwise("")


# --- words as arrays ------------------------------------------------------------------------------

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_FACTOR = np.random.default_rng(20260921).integers(0, 2**64, 256, np.uint64)
_FACTOR[_WHITE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15 - 2)  # 3 modulo 8: its powers don't soon come near 1
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64) * 2, _STEP))])
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, one after the other, and where each starts (and the last ends). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(at: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many bytes together, or one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, at: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, and the number of the first word of each text (and of the end).

    fold: a byte for each byte, put in its place before hashing.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    hashes, first = [], [np.zeros(1, np.int64)]
    total = 0
    for i, j in slices(at):
        part, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
        if fold is not None:
            part = fold[part]
        inside = ~_WHITE[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = bounds[:-1][bounds[:-1] < len(part)]
        begins[edge] = inside[edge]
        starts = np.flatnonzero(begins)
        if len(starts):
            own = np.zeros(len(part), np.int64)
            own[starts] = np.diff(starts, prepend=0)
            place = np.arange(len(part)) - np.cumsum(own)
            place[: starts[0]] = 0
            hashes.append(mix(np.add.reduceat(_FACTOR[part] * powers(int(place.max()) + 1)[place], starts)))
        first.append(np.searchsorted(starts, bounds[1:]) + total)
        total += len(starts)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(first)


def second_hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash, independent of window_hashes(), of the runs of so many words that start at some places."""
    other, out = mix(words ^ np.uint64(0x9FB21C651E98DF25)), np.zeros(len(at), np.uint64)
    for j in range(size):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += other[at + j]
    return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of so many words, runs over the ends of texts included."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, size):
        out *= _STEP
        out += words[j : j + n]
    return mix(out)


def inside_text(first: np.ndarray, size: int) -> np.ndarray:
    """Where runs of so many words start that don't cross the end of a text: one flag for each run."""
    n = max(0, int(first[-1]) - size + 1)
    flags = np.zeros(n + 1, np.int64)
    a, b = first[:-1], first[1:] - size + 1
    on = b > a
    np.add.at(flags, a[on], 1)
    np.add.at(flags, np.minimum(b[on], n), -1)
    return np.cumsum(flags[:-1]) > 0


# --- sorted sets of hashes ------------------------------------------------------------------------


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers, as differences of as few bytes as the largest needs, the first one whole."""
    if not len(values):
        return b""
    steps = np.diff(values)
    return values[:1].tobytes() + pack_small(steps)


def unpack_sorted(data: bytes) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), unpack_small(data[8:])]), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Numbers from 0 on, of as few bytes each as the largest needs."""
    if not len(values):
        return b"\x01"
    width = max(1, -(-int(values.max()).bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_small(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def bucket_bounds(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's values start (and the last end) among rising values under 2**bits."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def table(**columns) -> pa.Table:
    return pa.table(columns)


def runs(values: np.ndarray, also: np.ndarray | None = None) -> np.ndarray:
    """Where each run of equal values (and equal others) starts."""
    if not len(values):
        return np.zeros(0, np.int64)
    new = values[1:] != values[:-1]
    return np.flatnonzero(np.concatenate([[True], new if also is None else new | (also[1:] != also[:-1])]))
