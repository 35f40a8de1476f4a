"""Substring dedup (operator 4): fixed-block anchors.

The index holds the hashes of each document's non-overlapping blocks of half a window. Every rolling run of
that length probes it; a block that another run equals is an anchor. Each window of full length that holds an
anchor is a candidate, since any window that occurs twice holds a whole block of its first occurrence. Extending
an anchor to its maximal exact repeat is then the union of the candidate windows whose word sequence starts earlier
elsewhere. Sequences are compared by 128 bits, two independent hashes of their words, for candidates alone, never pair by
pair. (Words are told apart by 64 bits; two texts are mistaken only if their windows differ in nothing but such words.)

Scale: the texts are shuffled once, by batch. Index and probes travel as sorted sets of hashes, about three bytes
an entry, candidates at eighteen; answers are one bit an entry. A passage that a third of all documents hold is one
entry a batch. Hashes of blocks have 16 bits more than their number needs, and false anchors only make candidates.

Null or empty texts have no words and nothing to remove. Where a doc_id repeats or is null, rows are first sorted, by
ranges, to documents one after another: by doc_id, null last, then by a hash of the text; each gives a row, and equal rows
are dealt out like others. Texts of any length are whole. Extra columns are not read. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common as c

WINDOW = 20
_MESSAGE = "bucket int, batch int, kind int, entries binary, more binary"
_ANSWER = "batch int, bucket int, kind int, bits binary"
_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class _Batch:
    """One batch: its words, anchors and candidates, made anew in each pass."""

    def __init__(self, rows: pa.Table, window: int, bits: int):
        self.rows = rows.sort_by([("ord", "ascending")])
        self.window, self.block = window, window // 2
        words, self.first = c.word_hashes(*c.text_bytes(self.rows["text"]))
        self.words = words
        small = c.window_hashes(words, self.block) >> np.uint64(64 - bits)
        self.small_ok = c.inside_text(self.first, self.block)
        self.small = small
        own = np.repeat(self.first[:-1], np.maximum(0, np.diff(self.first)))[: len(small)]
        self.is_block = self.small_ok & ((np.arange(len(small)) - own) % self.block == 0)
        at = np.flatnonzero(self.small_ok)
        order = np.argsort(small[at], kind="stable")
        self.sorted_at = at[order]
        found = small[self.sorted_at]
        self.starts = c.runs(found)
        self.entries = found[self.starts]

    def flags(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry: is it a block here, does it occur here twice."""
        if not len(self.starts):
            return np.zeros(0, bool), np.zeros(0, bool)
        return np.logical_or.reduceat(self.is_block[self.sorted_at], self.starts), np.diff(self.starts, append=len(self.sorted_at)) > 1

    def candidates(self, anchors: np.ndarray) -> None:
        """Windows with an anchor; their distinct hashes, rising, and the first place of each here."""
        hit = np.zeros(len(self.small) + 1, np.int64)
        if len(self.starts):
            hit[self.sorted_at] = np.repeat(anchors, np.diff(self.starts, append=len(self.sorted_at)))
        before = np.concatenate([[0], np.cumsum(hit)])
        ok = c.inside_text(self.first, self.window)
        n = len(ok)
        ok &= before[np.minimum(np.arange(n) + self.window - self.block + 1, len(before) - 1)] > before[:n]
        at = np.flatnonzero(ok)
        gap = self.window - self.block
        low = c.window_hashes(self.words, self.block)
        large = c.mix(low[at] * np.uint64(0xD6E8FEB86659FD93) + low[at + gap]) if len(at) else np.zeros(0, np.uint64)
        other = c.second_hashes(self.words, at, self.window)
        order = np.lexsort((other, large))
        self.cand, found, other = at[order], large[order], other[order]
        self.cand_starts = c.runs(found, other)
        self.cand_entries, self.cand_others = found[self.cand_starts], other[self.cand_starts]

    def places(self) -> np.ndarray:
        """Of each entry, the document where it comes first here."""
        ids = self.rows["ord"].to_numpy()
        return ids[np.searchsorted(self.first, self.cand[self.cand_starts], "right") - 1]

    def removed(self, later: np.ndarray) -> np.ndarray:
        """Of each word, whether a window covers it that starts earlier too. later: of each entry, not first here."""
        repeat = np.ones(len(self.cand), bool)
        if len(self.cand):
            repeat[self.cand_starts] = later
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, self.cand[repeat], 1)
        np.add.at(cover, self.cand[repeat] + self.window, -1)
        return np.cumsum(cover[:-1]) > 0


def _send(batch: int, kind: int, entries: np.ndarray, bits: int, buckets: int, more) -> pa.Table:
    bounds = c.bucket_bounds(entries, bits, buckets)
    on = [b for b in range(buckets) if bounds[b + 1] > bounds[b]]
    cut = [(int(bounds[b]), int(bounds[b + 1])) for b in on]
    return pa.table(
        {
            "bucket": pa.array(on, pa.int32()),
            "batch": pa.array([batch] * len(on), pa.int32()),
            "kind": pa.array([kind] * len(on), pa.int32()),
            "entries": pa.array([c.pack_sorted(entries[i:j]) for i, j in cut], pa.binary()),
            "more": pa.array([more(i, j) for i, j in cut], pa.binary()),
        }
    )


def _receive(answers: pa.Table, kind: int, entries: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    out = np.zeros(len(entries), bool)
    bounds = c.bucket_bounds(entries, bits, buckets)
    for row in answers.to_pylist():
        if row["kind"] == kind:
            i, j = int(bounds[row["bucket"]]), int(bounds[row["bucket"] + 1])
            out[i:j] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=j - i).astype(bool)
    return out


def _answers(messages: pa.Table, kind: int, decide, others=None) -> pa.Table:
    """One bucket: decide says of each entry, in sorted order, what to answer. others: the second hashes of a message's entries."""
    rows = messages.select(["bucket", "batch", "entries", "more"]).to_pylist()
    sets = [c.unpack_sorted(r["entries"]) for r in rows]
    entries = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if others is None:
        order = np.argsort(entries, kind="stable")
        starts = c.runs(entries[order])
    else:
        more = np.concatenate([others(r, len(x)) for r, x in zip(rows, sets)]) if sets else np.zeros(0, np.uint64)
        order = np.lexsort((more, entries))
        starts = c.runs(entries[order], more[order])
    said = np.zeros(len(entries), bool)
    said[order] = decide(rows, [len(s) for s in sets], order, starts)
    ends = np.cumsum([len(s) for s in sets])
    return pa.table(
        {
            "batch": pa.array([r["batch"] for r in rows], pa.int32()),
            "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "kind": pa.array([kind] * len(rows), pa.int32()),
            "bits": pa.array([np.packbits(said[e - len(s) : e]).tobytes() for s, e in zip(sets, ends)], pa.binary()),
        }
    )


def _anchors(rows, sizes, order, starts):
    block = np.concatenate([np.unpackbits(np.frombuffer(r["more"][: -(-n // 8)], np.uint8), count=n) for r, n in zip(rows, sizes)]).astype(bool)[order]
    twice = np.concatenate([np.unpackbits(np.frombuffer(r["more"][-(-n // 8) :], np.uint8), count=n) for r, n in zip(rows, sizes)])[order].astype(np.int64)
    yes = np.logical_or.reduceat(block, starts) & (np.add.reduceat(1 + twice, starts) > 1)
    return np.repeat(yes, np.diff(starts, append=len(order)))


def _others(row: dict, n: int) -> np.ndarray:
    return np.frombuffer(row["more"][8 : 8 + 8 * n], np.uint64)


def _laters(rows, sizes, order, starts):
    ids = np.concatenate([c.unpack_small(r["more"][8 + 8 * n :]).astype(np.int64) + np.frombuffer(r["more"][:8], np.int64) for r, n in zip(rows, sizes)])[order]
    least = np.repeat(np.minimum.reduceat(ids, starts), np.diff(starts, append=len(order)))
    return ids > least


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text and ord, a number that says which document comes first: doc_id itself where none repeats or is null."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    most, ids, n = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("doc_id"), F.count("*")).first()
    if (most or 0) <= 1 and ids == n:
        return rows.withColumn("ord", F.col("doc_id"))
    # the last number parts rows that are equal in all
    sort = [F.col("doc_id").asc_nulls_last(), "__hash", "__part"]
    rows = rows.withColumns({"__hash": F.xxhash64("text"), "__part": F.xxhash64(F.monotonically_increasing_id())})
    return c.saved(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select("doc_id", "text", F.monotonically_increasing_id().alias("ord")))


def substring_dedup(docs: DataFrame, window: int = WINDOW, batch_bytes: int = c.BATCH_BYTES, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, the kept text of each document.

    window: an even number of words.
    """
    rows, n, total = c.batched(ordered(docs), batch_bytes, ("ord",))
    if window < 4 or window % 2:
        raise ValueError("window must be an even number from 4 on")
    bits = min(64, max(24, (total // 4 // (window // 2) + 1).bit_length() + 16))
    buckets = max(1, -(-total // 5 // c.BUCKET_ENTRIES))

    def probe(group: pa.Table) -> pa.Table:
        b = _Batch(group, window, bits)
        block, twice = b.flags()
        return _send(group["batch"][0].as_py(), 1, b.entries, bits, buckets, lambda i, j: np.packbits(block[i:j]).tobytes() + np.packbits(twice[i:j]).tobytes())

    def anchor(group: pa.Table) -> pa.Table:
        return _answers(group, 1, _anchors)

    def extend(group: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Batch(group, window, bits)
        b.candidates(_receive(answers, 1, b.entries, bits, buckets))
        ids, others = b.places(), b.cand_others

        def more(i: int, j: int) -> bytes:
            least = ids[i:j].min()
            return least.tobytes() + others[i:j].tobytes() + c.pack_small((ids[i:j] - least).astype(np.uint64))

        return _send(group["batch"][0].as_py(), 2, b.cand_entries, 64, buckets, more)

    def later(group: pa.Table) -> pa.Table:
        return _answers(group, 2, _laters, _others)

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Batch(group, window, bits)
        b.candidates(_receive(answers, 1, b.entries, bits, buckets))
        gone = b.removed(_receive(answers, 2, b.cand_entries, 64, buckets))
        n_removed, sha, kept = [], [], []
        for text, i, j in zip(b.rows["text"], b.first[:-1], b.first[1:]):
            mask = gone[i:j]
            words = text.as_buffer().to_pybytes().split()
            left = b" ".join(compress(words, (~mask).tolist()) if mask.any() else words)
            n_removed.append(int(mask.sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            if texts:
                kept.append(left.decode())
        columns = {"doc_id": b.rows["doc_id"], "n_words": pa.array(np.diff(b.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(columns | ({"text": pa.array(kept, pa.string())} if texts else {}))

    by_batch = rows.groupBy("batch")
    anchors = by_batch.applyInArrow(probe, _MESSAGE).groupBy("bucket").applyInArrow(anchor, _ANSWER)
    laters = by_batch.cogroup(anchors.groupBy("batch")).applyInArrow(extend, _MESSAGE).groupBy("bucket").applyInArrow(later, _ANSWER)
    return by_batch.cogroup(anchors.unionByName(laters).groupBy("batch")).applyInArrow(finish, _RESULT + (", text string" if texts else ""))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
SQL: dict[str, str] = {}
