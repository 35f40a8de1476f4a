"""LM scoring (operator 2): online logistic context mixing over bits.

Three predictors give each bit of a text's UTF-8 bytes (and of one closing zero byte) a probability from counts of
bits after hashed contexts of two, four and six bytes. Their logits are mixed with weights gated by the bit's place in
its byte; weights start as the constants below and are refined online,
within each document, after every STEP bytes. Bits are coded before they are learned from.

A word and the byte that ends it are one unit. Where a unit directly follows the byte that ended a word, its probability
is a mixture: of count(word before, unit) / count(word before), from all training documents, and of what the bits say.
The weight of the counts is the share of such units so far in the document whose pair had a count (from PRIOR), times
D / (D + DOUBT) for D counts of the word before: it depends on what stands before alone. A score is so the log10
probability of the whole text under one model, and score / log10(2) / bytes is minus its bits per byte.

Counts come from all training documents: a table of bounded size for each byte context, of whose cells each batch sends
those it saw, which are summed FAN batches at a time, level by level; and the counts of all words and of all pairs, which grow with the corpus and are never broadcast: a batch
sends its distinct words and pairs as sorted sets of hashes (64 and PAIR_BITS bits) to buckets and gets back their
counts. Only the quantised context tables (TABLES, 50 MB whatever the input) are broadcast; a worker keeps them only as
what it looks up (110 MB), and only while its tasks are of this query.

Null or empty texts have one token, the end. Repeated rows count as often as they stand. Without training documents
all counts are zero (N = V = 0). Texts of any length are scored whole. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common as c

#: Bytes of context, and bits of its hash.
TABLES = ((2, 13), (4, 16), (6, 17))
#: Weights of the three logits.
WEIGHTS = (0.2, 0.5, 0.3)
STEP, LANES, RATE = 128, 64, 0.4
#: Cells of a table in one bucket.
PIECE = 1 << 20
#: Bytes of text in a batch, and in what is counted or hashed at a time.
BATCH_BYTES, SLICE = 4_000_000, 1_000_000
QUANTUM = 16.0
#: Units before the first, with and without a count; counts of a word before that halve the weight of its pairs.
PRIOR, DOUBT = (2, 2), 4
PAIR_BITS = 48
#: The kind of messages with pairs; 0 are words, from 1 on tables.
PAIRS = -1
#: How many messages with cells of a piece of a table are summed in one task.
FAN = 16
#: Zero bytes before each text.
PAD = 6

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE, _PLACE = np.arange(256)[:, None], np.arange(8)[None, :]
_NODE = ((256 | _BYTE) >> (8 - _PLACE)).astype(np.int32)
#: By byte and place: minus the sign of the bit that is taken, in units of a quantised logit.
_TURN = ((1 - ((_BYTE >> (7 - _PLACE)) & 1) * 2) / QUANTUM).astype(np.float32)

_MESSAGE = "kind int, bucket int, part int, batch int, entries binary, counts binary"
_ANSWER = "kind int, bucket int, batch int, entries binary, counts binary, distinct bigint, total bigint"
_PIECES = "kind int, bucket int, counts binary"
_RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"


def contexts(prev: list[np.ndarray], order: int, bits: int) -> np.ndarray:
    """The hashed context of each byte; prev: the byte before, the one before that, and so on."""
    key = np.zeros(prev[0].shape, np.uint32)
    for j in range(order):
        key *= np.uint32(2654435761)
        key += prev[j]
    key *= np.uint32(2654435761)
    key ^= key >> np.uint32(15)
    key *= np.uint32(2246822519)
    return (key >> np.uint32(32 - bits)).astype(np.int32)


def count_cells(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table, the cells (context, next byte) that these texts fill, rising, and how often."""
    parts: list[list[np.ndarray]] = [[] for _ in TABLES]
    for i, j in c.slices(at, SLICE):
        size = np.diff(at[i : j + 1])
        n, k = int(size.sum()), j - i
        flat = np.zeros(n + (PAD + 1) * k, np.uint8)
        flat[np.arange(n) + np.repeat((PAD + 1) * np.arange(k) + PAD, size)] = data[at[i] : at[j]]
        ends = np.cumsum(size + PAD + 1)
        coded = np.ones(len(flat), bool)
        for d in range(PAD):
            coded[ends - size - PAD - 1 + d] = False
        where = np.flatnonzero(coded)
        prev, own = [flat[where - d - 1] for d in range(PAD)], flat[where]
        for (order, bits), into in zip(TABLES, parts):
            into.append((contexts(prev, order, bits) << 8) + own)
    out = []
    for part in parts:  # one table at a time
        seen = np.sort(np.concatenate(part)) if part else np.zeros(0, np.int32)
        starts = c.runs(seen)
        out.append((seen[starts], np.diff(starts, append=len(seen))))
        part.clear()
    return out


def logits(cells: np.ndarray) -> np.ndarray:
    """From counts of bytes (contexts, 256), the quantised logit that the next bit is one, at each of 255 nodes."""
    out = np.zeros(cells.shape, np.int8)
    for d in range(8):
        pair = cells.reshape(len(cells), 1 << d, 2, -1).sum(-1)
        out[:, 1 << d : 2 << d] = np.clip(np.rint(QUANTUM * np.log((pair[..., 1] + 0.4) / (pair[..., 0] + 0.4))), -127, 127)
    return out


def units(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: where it starts and stops, whether its unit directly follows another, and the hash of that pair.

    hashes, first: of folded words, as the word before is taken; the unit itself is taken with its case.
    """
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)
    white = np.concatenate([c._WHITE[data], [True]])
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before = np.concatenate([[True], white[:-1]])
    starts = np.flatnonzero(~white & (before | cut))
    stops = np.flatnonzero(~white[:-1] & (white[1:] | cut[1:])) + 1
    upper = np.flatnonzero((data >= 65) & (data <= 90))
    word = np.searchsorted(starts, upper, "right") - 1
    own = hashes.copy()
    np.add.at(own, word, c.mix((upper - starts[word] + 1).astype(np.uint64)))
    end = np.where(cut[stops], 0, np.concatenate([data, [0]])[stops].astype(np.uint64))
    follows = np.zeros(len(starts), bool)
    follows[1:] = starts[1:] == stops[:-1] + 1
    follows[first[:-1][np.diff(first) > 0]] = False
    key = c.mix(own + (end + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    key[1:] = c.mix(key[1:] ^ hashes[:-1] * np.uint64(0xD6E8FEB86659FD93))
    return starts, stops, follows, key >> np.uint64(64 - PAIR_BITS)


def mixed_lengths(costs: np.ndarray, at: np.ndarray, starts: np.ndarray, stops: np.ndarray, follows: np.ndarray, first: np.ndarray, pair: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """Minus the natural logarithm of the probability of each text.

    costs: of its bytes and its end, by the bits; pair, prev: for each word, the counts of its pair and of the word before.
    """
    out = np.add.reduceat(costs, at[:-1] + np.arange(len(at) - 1)) if len(at) > 1 else np.zeros(0)
    on = np.flatnonzero(follows & (prev > 0))
    if not len(on):
        return out
    text = np.searchsorted(first, on, "right") - 1
    edges = np.stack([starts[on] + text, stops[on] + text + 1], 1).ravel()
    bits = np.add.reduceat(costs, edges[:-1] if edges[-1] == len(costs) else edges)[::2]
    new = np.searchsorted(text, text)  # the first such unit of the same text
    hit = (pair[on] > 0).astype(np.int64)
    hits = np.cumsum(hit) - hit
    rate = (hits - hits[new] + PRIOR[0]) / (np.arange(len(on)) - new + sum(PRIOR))
    weight = rate * prev[on] / (prev[on] + DOUBT)
    with np.errstate(divide="ignore"):
        mixed = -np.logaddexp(np.log(weight * pair[on] / prev[on]), np.log1p(-weight) - bits)
    starts_of = c.runs(text)
    out[text[starts_of]] += np.add.reduceat(mixed - bits, starts_of)
    return out


def code_lengths(data: np.ndarray, at: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Minus the natural logarithm of the probability of each text, by the bits alone."""
    costs = byte_costs(data, at, paths(tables))
    return np.add.reduceat(costs, at[:-1] + np.arange(len(at) - 1)) if len(at) > 1 else np.zeros(0)


def paths(tables: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each table, the logits on the way to each half byte: four bytes as one number, so one look-up gives four bits' logits.

    The first is by (context, upper three bits), the second by (context, upper seven): which side the last bit of a half
    takes is not on the way to it, and signs are the same for all tables.
    """
    out = []
    for table in tables:
        rows = table.reshape(-1, 256)
        upper, lower = np.empty((len(rows), 8, 4), np.int8), np.empty((len(rows), 128, 4), np.int8)
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            upper[i : i + 4096] = part[:, _NODE[::32, :4]]
            lower[i : i + 4096] = part[:, _NODE[::2, 4:]]
        out.append((upper.reshape(-1).view(np.uint32), lower.reshape(-1).view(np.uint32)))
    return out


class Shared:
    """Tables to broadcast: what arrives are their paths() alone."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables

    def __reduce__(self):
        return paths, (self.tables,)


def byte_costs(data: np.ndarray, at: np.ndarray, ways: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the natural logarithm of the probability of each byte, and of the end after each text's. ways: of paths()."""
    size = np.diff(at) + 1
    out = np.zeros(len(data) + len(size))
    begin = at[:-1] + np.arange(len(size))
    order = np.argsort(-size, kind="stable")
    i = 0
    while i < len(order):
        longest = int(size[order[i]])
        lanes = order[i : i + max(1, min(LANES, 4_000_000 // longest))]
        i += len(lanes)
        own = np.zeros((len(lanes), PAD + -(-longest // STEP) * STEP), np.uint8)
        for row, k in zip(own, lanes):
            row[PAD : PAD - 1 + size[k]] = data[at[k] : at[k + 1]]
        weights = [np.full((len(lanes), 1, 8), w, np.float32) for w in WEIGHTS]
        for start in range(0, own.shape[1] - PAD, STEP):
            m, whole = (int(np.searchsorted(-size[lanes], -x)) for x in (start, start + STEP - 1))
            part = own[:m, PAD + start : PAD + start + STEP]
            prev = [own[:m, PAD - 1 - d + start : PAD - 1 - d + start + STEP] for d in range(PAD)]
            three, seven = part >> 5, part >> 1
            logit = []
            for (a, b), (o, bits) in zip(ways, TABLES):
                context = contexts(prev, o, bits)
                four = np.empty((*context.shape, 2), np.uint32)
                four[..., 0] = a.take((context << 3) + three)
                four[..., 1] = b.take((context << 7) + seven)
                logit.append(four.view(np.int8).astype(np.float32))
            x = logit[0] * weights[0][:m]
            for s, w in zip(logit[1:], weights[1:]):
                x += s * w[:m]
            turn = _TURN.take(part, axis=0)
            x *= turn
            np.clip(x, -40, 40, out=x)
            np.exp(x, out=x)
            one = 1 + x
            cost = np.log(one[..., 0::2] * one[..., 1::2])  # at most e**80
            cost = cost[..., 0].astype(np.float64) + cost[..., 1] + cost[..., 2] + cost[..., 3]
            valid = start + np.arange(STEP) < size[lanes[:m], None]
            out[(begin[lanes[:m], None] + np.arange(start, start + STEP))[valid]] = cost[valid]
            x /= one
            x *= turn
            x[whole:] *= valid[whole:, :, None]
            for s, w in zip(logit, weights):
                w[:m] -= np.float32(RATE / STEP) * np.einsum("lsb,lsb->lb", x, s)[:, None, :]
    return out


def _cells(group: pa.Table) -> np.ndarray:
    """The sums of messages with cells of one piece of a table."""
    kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
    out = np.zeros(min(PIECE, 1 << (TABLES[kind - 1][1] + 8)), np.int64)
    for entries, counts in zip(group["entries"], group["counts"]):
        out[c.unpack_sorted(entries.as_py()).astype(np.int64) - bucket * PIECE] += c.unpack_small(counts.as_py()).astype(np.int64)
    return out


def _sum_cells(group: pa.Table, part: int) -> tuple:
    cells, bucket = _cells(group), group["bucket"][0].as_py()
    on = np.flatnonzero(cells)
    return group["kind"][0].as_py(), bucket, part, c.pack_sorted((on + bucket * PIECE).astype(np.uint64)), c.pack_small(cells[on].astype(np.uint64)), 0, 0


def _finish_cells(group: pa.Table) -> pa.Table:
    """The logits of a piece of a table."""
    data = logits(_cells(group).reshape(-1, 256)).tobytes()
    return pa.table({"kind": group["kind"][:1], "bucket": group["bucket"][:1], "counts": pa.array([data], pa.binary())})


def _answer(rows: list[tuple]) -> pa.Table:
    fields = (("kind", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int32()), ("entries", pa.binary()), ("counts", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64()))
    return pa.table({f: pa.array([r[k] for r in rows], t) for k, (f, t) in enumerate(fields)})


def lm_scoring(docs: DataFrame, held_out: F.Column | None = None, batch_bytes: int = BATCH_BYTES, fan: int = FAN) -> DataFrame:
    """A row for each document: counts of its tokens, the unigram base score, and the model's score.

    held_out: true for documents that the model must not learn from; by default crc32(doc_id) mod 5 = 1.
    """
    spark = docs.sparkSession
    rows, n, total = c.batched(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), batch_bytes)
    rows = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)) if held_out is None else held_out)
    buckets, pair_buckets = max(1, -(-total // 20 // c.BUCKET_ENTRIES)), max(1, -(-total // 8 // c.BUCKET_ENTRIES))

    def words(group: pa.Table):
        data, at = c.text_bytes(group["text"])
        hashes, first = c.word_hashes(data, at, _FOLD)
        order = np.argsort(hashes)
        starts = c.runs(hashes[order])
        return data, at, hashes, first, order, starts

    def pairs(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, first: np.ndarray):
        begin, stop, follows, key = units(data, at, hashes, first)
        which = np.flatnonzero(follows)
        which = which[np.argsort(key[which])]
        return begin, stop, follows, key, which, c.runs(key[which])

    def gather(group: pa.Table) -> pa.Table:
        batch = group["batch"][0].as_py()
        data, at, hashes, first, order, starts = words(group)
        held = group["held_out"].to_numpy()
        train = np.repeat(~held, np.diff(first))[order]
        entries = hashes[order][starts]
        counts = np.add.reduceat(train.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        bounds = c.bucket_bounds(entries, 64, buckets)
        out = [(0, b, entries[i:j], counts[i:j]) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])) if j > i]
        *_, key, which, starts = pairs(data, at, hashes, first)
        entries, train = key[which][starts], np.repeat(~held, np.diff(first))[which]
        counts = np.add.reduceat(train.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        bounds = c.bucket_bounds(entries, PAIR_BITS, pair_buckets)
        out += [(PAIRS, b, entries[i:j], counts[i:j]) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])) if j > i]
        kept = group.filter(pa.array(~held))
        for kind, (cells, seen) in enumerate(count_cells(*c.text_bytes(kept["text"])), 1):
            edges = np.searchsorted(cells, np.arange(0, (1 << (TABLES[kind - 1][1] + 8)) + PIECE, PIECE))
            out += [(kind, b, cells[i:j].astype(np.uint64), seen[i:j]) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
        return pa.table(
            {
                "kind": pa.array([x[0] for x in out], pa.int32()),
                "bucket": pa.array([x[1] for x in out], pa.int32()),
                "part": pa.array([batch // fan if x[0] > 0 else 0 for x in out], pa.int32()),
                "batch": pa.array([batch] * len(out), pa.int32()),
                "entries": pa.array([c.pack_sorted(x[2]) for x in out], pa.binary()),
                "counts": pa.array([c.pack_small(x[3].astype(np.uint64)) for x in out], pa.binary()),
            }
        )

    def merge(group: pa.Table) -> pa.Table:
        kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
        if kind > 0:
            return _answer([_sum_cells(group, group["part"][0].as_py())])
        got = list(zip(group["batch"].to_pylist(), group["entries"].to_pylist(), group["counts"].to_pylist()))
        sets = [c.unpack_sorted(e) for _, e, _ in got]
        entries, counts = np.concatenate(sets), np.concatenate([c.unpack_small(x) for _, _, x in got])
        order = np.argsort(entries, kind="stable")
        starts = c.runs(entries[order])
        sums = np.add.reduceat(counts[order], starts)
        back = np.zeros(len(entries), np.uint64)
        back[order] = np.repeat(sums, np.diff(starts, append=len(entries)))
        ends = np.cumsum([len(s) for s in sets])
        facts = [(0, 0) if kind == PAIRS else (int((sums > 0).sum()), int(sums.sum()))] + [(0, 0)] * len(got)
        return _answer([(kind, bucket, b, None, c.pack_small(back[e - len(s) : e]), *f) for (b, _, _), s, e, f in zip(got, sets, ends, facts)])

    answers = c.saved(rows.groupBy("batch").applyInArrow(gather, _MESSAGE).groupBy("kind", "bucket", "part").applyInArrow(merge, _ANSWER))
    distinct, running = answers.agg(F.sum("distinct"), F.sum("total")).first()
    ends = rows.filter(~F.col("held_out")).count()
    n_all, n_distinct = (running or 0) + ends, (distinct or 0) + (ends > 0)
    tables = [np.zeros((1 << b) * 256, np.int8) for _, b in TABLES]
    parts, cells = -(-n // fan), answers.filter("kind > 0")
    while parts > fan:
        up = cells.withColumn("batch", F.floor(F.col("batch") / fan).cast("int"))
        cells = c.saved(up.groupBy("kind", "bucket", "batch").applyInArrow(lambda group: _answer([_sum_cells(group, group["batch"][0].as_py())]), _ANSWER))
        parts = -(-parts // fan)
    for row in cells.groupBy("kind", "bucket").applyInArrow(_finish_cells, _PIECES).toLocalIterator():
        part = np.frombuffer(row["counts"], np.int8)
        tables[row["kind"] - 1][row["bucket"] * PIECE :][: len(part)] = part
    shared = spark.sparkContext.broadcast(Shared(tables))

    def score(group: pa.Table, told: pa.Table) -> pa.Table:
        data, at, hashes, first, order, starts = words(group)
        entries = hashes[order][starts]
        bounds = c.bucket_bounds(entries, 64, buckets)
        counts = np.zeros(len(entries), np.int64)
        begin, stop, follows, key, which, pair_starts = pairs(data, at, hashes, first)
        pair_bounds = c.bucket_bounds(key[which][pair_starts], PAIR_BITS, pair_buckets)
        pair_counts = np.zeros(len(pair_starts), np.int64)
        for row in told.select(["kind", "bucket", "counts"]).to_pylist():
            into, edge = (pair_counts, pair_bounds) if row["kind"] == PAIRS else (counts, bounds)
            into[edge[row["bucket"]] : edge[row["bucket"] + 1]] = c.unpack_small(row["counts"])
        by_pair = np.zeros(len(hashes), np.int64)
        by_pair[which] = np.repeat(pair_counts, np.diff(pair_starts, append=len(which)))
        by_word = np.zeros(len(hashes), np.int64)
        by_word[order] = np.repeat(counts, np.diff(starts, append=len(hashes)))
        prev = np.concatenate([[0], by_word[:-1]])[: len(by_word)]
        lengths = mixed_lengths(byte_costs(data, at, shared.value), at, begin, stop, follows, first, by_pair, prev)
        logs = np.concatenate([[0.0], np.cumsum(np.log10(by_word + 0.5))])
        known = np.concatenate([[0], np.cumsum(by_word > 0)])
        n_tokens = np.diff(first) + 1
        base = logs[first[1:]] - logs[first[:-1]] + np.log10(ends + 0.5) - n_tokens * np.log10(n_all + 0.5 * (n_distinct + 1))
        return pa.table(
            {
                "doc_id": group["doc_id"],
                "held_out": group["held_out"],
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(known[first[1:]] - known[first[:-1]] + (ends > 0), pa.int64()),
                "train_tokens": pa.array(np.full(len(base), n_all), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(lengths / -np.log(10.0), pa.float64()),
                "n_bytes": pa.array(np.diff(at), pa.int64()),
            }
        )

    return rows.groupBy("batch").cogroup(answers.filter("kind <= 0").groupBy("batch")).applyInArrow(score, _RESULT)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
SQL: dict[str, str] = {}
