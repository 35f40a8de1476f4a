"""N-gram Jaccard join (operator 3): near duplicates by shingles of five words, Jaccard 0.8 or more.

1. Equal texts, by the 128 bits of their MD5, are one class; the number of one of its rows stands for it.
2. Each class gets MinHash values in BANDS bands. Classes that share a band with another go, through the smallest
   class of that band, into one candidate cluster (connected components by contraction, written between rounds).
3. Clusters are cut into blocks of bounded bytes and rows (up to MOST_PARTS smaller ones, so that a cluster of some
   thousands is many tasks), and each pair of blocks is one task. Its pairs are compared MinHash
   value by value in steps; after each step a pair is dropped when the posterior probability that its similarity
   reaches the threshold, given the values that agree so far and a uniform prior, is below TOLERANCE.
4. Pairs that stay are verified exactly on their sets of 64-bit shingle hashes. A task returns a number of links for
   each document and a spanning forest of its links, never the pairs themselves, so a group of copies costs rows in
   proportion to its members.

A pair at the threshold misses every band with probability (1 - 0.8**5)**40, about 1e-7; there is no cap on buckets,
candidates or partners.

Words are runs without ASCII white space, unchanged. A text of one to four words is a single shingle. Null or empty
texts, and those of white space alone, have no shingle and link to nothing, equal texts included. Rows that repeat a
doc_id, or have none, count as separate copies, each with the links of its own text; a class of null ids alone has a null
class_id. Extra columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from palimpsest.llm import common as c

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
STEP, TOLERANCE = 20, 1e-6
#: Bytes of shingles in a block of a cluster.
BLOCK_BYTES = 8_000_000
#: Texts in a block: a flag is held for each pair of two blocks, and STRIPE pairs at a time are counted and compared.
BLOCK_ROWS, STRIPE = 10_000, 2_000_000
#: A cluster of more than PART_ROWS texts has at least so many blocks as parts of that size, or MOST_PARTS.
PART_ROWS, MOST_PARTS = 1000, 4
_SIGNED = "row bigint, doc_id bigint, same binary, n_shingles int, minhash binary, bands array<bigint>, text string"
_LINKED = "id bigint, links bigint, root bigint"

_N = BANDS * ROWS
_RNG = np.random.default_rng(5)
_MUL = (_RNG.integers(0, 2**31, _N, np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, _N, np.uint32)


def shingles(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, rising, and where each text's start (and the last end)."""
    words, first = c.word_hashes(*c.text_bytes(text))
    out, bounds = [], [0]
    for i, j in zip(first[:-1], first[1:]):
        own = words[i:j]
        if 0 < len(own) < SHINGLE:
            own = c.window_hashes(own, len(own))
        elif len(own):
            own = c.window_hashes(own, SHINGLE)
        own = np.unique(own)
        out.append(own)
        bounds.append(bounds[-1] + len(own))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(bounds)


def minhashes(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, values); a row of the largest value for a text without shingles."""
    out = np.full((len(bounds) - 1, _N), 0xFFFFFFFF, np.uint32)
    i = 0
    while i < len(out):  # parts that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + 100_000, "right")) - 1)
        on = i + np.flatnonzero(np.diff(bounds[i : j + 1]))
        if len(on):
            part, starts = (sets[bounds[i] : bounds[j]] >> np.uint64(32)).astype(np.uint32), bounds[on] - bounds[i]
            for k in range(_N):
                out[on, k] = np.minimum.reduceat(part * _MUL[k] + _ADD[k], starts)
        i = j
    return out


def least_agreeing(threshold: float, tolerance: float) -> dict[int, int]:
    """After n values, how many must agree at least: with fewer, P(similarity >= threshold) is below tolerance."""
    found = {}
    for n in range(STEP, _N + 1, STEP):
        # with m of n agreeing, the posterior is Beta(m + 1, n - m + 1): its tail is P(Binomial(n + 1, threshold) <= m)
        tail, m = 0.0, 0
        while (tail := tail + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        found[n] = m
    return found


class _Block:
    def __init__(self, rows: pa.Table):
        self.ids = rows["id"].to_numpy()
        self.copies = rows["copies"].to_numpy()
        self.minhash = np.frombuffer(b"".join(rows["minhash"].to_pylist()), np.uint16).reshape(-1, _N)
        self.sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        self.size = np.array([len(x) for x in self.sets], np.int64)

    def __len__(self) -> int:
        return len(self.ids)


def _columns(a: _Block, b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Shingles that more than one text has, numbered: (row, number) of each side's."""
    both = [x for block in (a, b) for x in block.sets]
    rows = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, number, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    on = count[number] > 1
    rows, number = rows[on], new[number[on]]
    left = rows < len(a)
    return rows[left], number[left], rows[~left] - len(a), number[~left], int(new[-1] + 1) if len(new) else 0


def links_between(a: _Block, b: _Block, same: bool, least: dict[int, int], threshold: float) -> np.ndarray:
    """A matrix of flags: which texts of a and b are similar enough. same: a is b."""
    out = np.zeros((len(a), len(b)), bool)
    ratio = max(1, 1_000_000 // max(1, len(b)))
    for i in range(0, len(a), ratio):
        part = a.minhash[i : i + ratio]
        size = a.size[i : i + ratio]
        small, large = np.minimum(size[:, None], b.size), np.maximum(size[:, None], b.size)
        alive = (small >= threshold * large - 1e-9) & (small > 0)
        if same:
            alive &= np.arange(i, i + len(part))[:, None] < np.arange(len(b))
        p, q = np.nonzero(alive)
        agree = np.zeros(len(p), np.int64)
        for n, m in least.items():
            for s in range(0, len(p), 200_000):
                x, y = p[s : s + 200_000], q[s : s + 200_000]
                agree[s : s + 200_000] += (part[x, n - STEP : n] == b.minhash[y, n - STEP : n]).sum(1)
            stay = agree >= m
            p, q, agree = p[stay], q[stay], agree[stay]
        out[i + p, q] = True
    todo = int(out.sum())
    if todo <= 20 * (len(a) + len(b)):
        for x, y in zip(*np.nonzero(out)):
            both = len(np.intersect1d(a.sets[x], b.sets[y], assume_unique=True))
            out[x, y] = both >= threshold * (a.size[x] + b.size[y] - both) - 1e-9
        return out
    # many pairs: count what they share by products of 0/1 matrices, so many texts and shingles at a time
    ra, na, rb, nb, width = _columns(a, b)
    order_a, order_b = np.argsort(na, kind="stable"), np.argsort(nb, kind="stable")
    ra, na, rb, nb = ra[order_a], na[order_a], rb[order_b], nb[order_b]
    height = max(1, STRIPE // len(b))
    for i in range(0, len(a), height):
        shared = np.zeros((min(height, len(a) - i), len(b)), np.float32)
        on = (ra >= i) & (ra < i + height)
        rs, ns = ra[on] - i, na[on]
        for k in range(0, width, 2048):
            ia, ja = np.searchsorted(ns, [k, k + 2048])
            ib, jb = np.searchsorted(nb, [k, k + 2048])
            if ia < ja and ib < jb:
                rows_a, at_a = np.unique(rs[ia:ja], return_inverse=True)
                rows_b, at_b = np.unique(rb[ib:jb], return_inverse=True)
                left, right = np.zeros((len(rows_a), 2048), np.float32), np.zeros((len(rows_b), 2048), np.float32)
                left[at_a, ns[ia:ja] - k] = 1
                right[at_b, nb[ib:jb] - k] = 1
                shared[np.ix_(rows_a, rows_b)] += left @ right.T
        both = shared.astype(np.float64)
        out[i : i + height] &= both >= threshold * (a.size[i : i + height, None] + b.size - both) - 1e-9
    return out


def _sums(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """link @ right and left @ link, some rows at a time: numpy makes 64-bit numbers of the flags it multiplies."""
    across, down = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for i in range(0, len(left), 512):
        part = link[i : i + 512].astype(np.int64)
        across[i : i + 512] = part @ right
        down += left[i : i + 512] @ part
    return across, down


def _task(a: _Block, b: _Block, same: bool, least: dict[int, int], threshold: float) -> list[tuple[np.ndarray, ...]]:
    """(ids, links to other classes' documents, smallest id that links lead to within the task), each side once."""
    link = links_between(a, b, same, least, threshold)
    if same:
        link |= link.T
        ids, sums, adjacent = a.ids, _sums(link, a.copies, a.copies)[0], link
        label = ids.copy()
    else:
        ids, sums = np.concatenate([a.ids, b.ids]), np.concatenate(_sums(link, a.copies, b.copies))
        label, adjacent = ids.copy(), None
    while True:
        before = label.copy()
        if adjacent is not None:
            for i in range(0, len(label), 512):
                label[i : i + 512] = np.minimum(before[i : i + 512], np.where(adjacent[i : i + 512], before, np.iinfo(np.int64).max).min(1))
        else:
            m = len(a)
            for i in range(0, m, 512):
                part, end = link[i : i + 512], min(i + 512, m)
                label[i:end] = np.minimum(label[i:end], np.where(part, label[m:], np.iinfo(np.int64).max).min(1))
                label[m:] = np.minimum(label[m:], np.where(part, label[i:end, None], np.iinfo(np.int64).max).min(0))
        if (label == before).all():
            break
    on = sums > 0
    return [(ids[on], sums[on], label[on])]


def components(edges: DataFrame) -> DataFrame:
    """id, root: the smallest id of each id's connected component, for edges (u, v). Ids without edges are absent.

    Each round points every id at the smallest of its neighbours and itself, and contracts; a round's edges and
    pointers are written tables. Minima are summed before they are shuffled, so a hub costs a row a task.
    """
    rounds = []
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = c.saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")))
        if to.isEmpty():
            break
        rounds.append(to)
        pv = to.select(F.col("u").alias("v"), F.col("p").alias("q"))
        edges = c.saved(edges.join(to, "u").join(pv, "v").filter("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
    if not rounds:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    out = rounds[0].select(F.col("u").alias("id"), F.col("p").alias("root"))
    for to in rounds[1:]:
        out = out.join(to, out["root"] == to["u"], "left").select("id", F.coalesce("p", "root").alias("root"))
    return c.saved(out)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that links lead to, or its own) and n_links (documents similar to it)."""
    return linked(docs, threshold, tolerance, block_bytes, block_rows, part_rows).select("doc_id", "class_id", "n_links")


def linked(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """jaccard_join() with row, a number, same, the MD5 of the text, and head, a number that all rows of a group have in common; null for rows that link to nothing."""
    return _linked(_signed(docs), threshold, tolerance, block_bytes, block_rows, part_rows)


def _signed(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """A table of row, a number that it fixes, doc_id, same, n_shingles, minhash, bands, text, and own: the columns of also."""
    own = [F.struct(*also).alias("own")] if also else []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)
    same = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("same")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", same, "text", *(["own"] if also else []))

    def sign(batches):
        for batch in batches:
            data, at = c.text_bytes(batch.column("text"))
            for i, j in c.slices(at, 2_000_000):
                part = batch.slice(i, j - i)
                sets, bounds = shingles(part.column("text"))
                values = minhashes(sets, bounds)
                size = np.diff(bounds)
                keys = np.zeros((len(values), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = c.mix(keys ^ values[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
                keys = c.mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                keep = [k if n else None for k, n in zip(keys.tolist(), size)]
                yield pa.record_batch(
                    {
                        "row": part.column("row"),
                        "doc_id": part.column("doc_id"),
                        "same": part.column("same"),
                        "n_shingles": pa.array(size, pa.int32()),
                        "minhash": pa.array([v.tobytes() for v in (values >> np.uint32(16)).astype(np.uint16)], pa.binary()),
                        "bands": pa.array(keep, pa.list_(pa.int64())),
                        "text": part.column("text"),
                    }
                    | ({"own": part.column("own")} if also else {})
                )

    fields = [StructField("own", StructType([StructField(f.name, f.dataType) for f in rows.schema["own"].dataType]))] if also else []
    return c.saved(rows.mapInArrow(sign, StructType([*StructType.fromDDL(_SIGNED), *fields])))


def _linked(signed: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """linked() of what _signed() made."""
    least = least_agreeing(threshold, tolerance)
    classes = c.saved(signed.filter("n_shingles > 0").groupBy("same").agg(F.min("row").alias("id"), F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    # rows are picked by bits, so neither signatures nor texts are shuffled to find them
    heads = c.among(signed.select("row", "bands"), "row", classes.select(F.col("id").alias("row")))
    members = c.saved(heads.select(F.col("row").alias("id"), F.explode("bands").alias("band")))
    hubs = members.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = members.join(hubs, "band").filter("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    clusters = components(c.saved(stars)).withColumnRenamed("root", "cluster")

    bytes_of = 8 * F.col("n_shingles").cast("bigint") + 2 * _N
    clustered = clusters.select(F.col("id").alias("row"))
    blocks_of = c.among(signed.select("row", "minhash", "n_shingles"), "row", clustered).withColumnRenamed("row", "id")
    blocks_of = blocks_of.join(c.saved(clusters.join(classes.select("id", "copies"), "id")), "id")
    parts = F.greatest(F.sum(bytes_of) / block_bytes, F.count("*") / block_rows, F.least(F.count("*") / part_rows, F.lit(MOST_PARTS)))
    sizes = blocks_of.groupBy("cluster").agg(F.ceil(parts).cast("int").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    placed = c.saved(
        blocks_of.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        # a cluster of one block shares its task with others; a pair of blocks has its own
        .select("id", "copies", "minhash", "cluster", "block", F.least("block", "part").alias("i"), F.greatest("block", "part").alias("j"), (F.col("n") == 1).alias("small"))
    )
    packs = max(1, total // 4)
    task = F.when(F.col("small"), F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(F.xxhash64("cluster", "i", "j"))

    def shingle(batches):
        for batch in batches:
            sets, bounds = shingles(batch.column("text"))
            yield pa.record_batch({"id": batch.column("row"), "shingles": pa.array([sets[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())})

    sets = c.among(signed.select("row", "text"), "row", clustered).mapInArrow(shingle, "id bigint, shingles binary")

    def compare(group: pa.Table) -> pa.Table:
        found = []
        group = group.sort_by([("cluster", "ascending"), ("i", "ascending"), ("j", "ascending"), ("block", "ascending"), ("id", "ascending")])
        key = [group[k].to_numpy() for k in ("cluster", "i", "j")]
        new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])]))
        for start, end in zip(new, [*new[1:], group.num_rows]):
            part = group.slice(start, end - start)
            i, j, block = key[1][start], key[2][start], part["block"].to_numpy()
            if i == j:
                a = _Block(part)
                found += _task(a, a, True, least, threshold)
            else:
                cut = int((block == i).sum())
                if 0 < cut < len(block):
                    found += _task(_Block(part.slice(0, cut)), _Block(part.slice(cut)), False, least, threshold)
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return pa.table({n: pa.array(x.astype(np.int64), pa.int64()) for n, x in zip(("id", "links", "root"), columns)})

    found = c.saved(placed.withColumn("task", task).join(sets, "id").groupBy("task").applyInArrow(compare, _LINKED))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.filter("id <> root").select(F.col("root").alias("u"), F.col("id").alias("v")).distinct())
    facts = classes.join(links, "id", "left").join(roots, "id", "left").select("same", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "id").alias("head"))
    facts = c.saved(facts)
    # the smallest doc_id of a group of several classes
    least_of = facts.groupBy("head").agg(F.min("first").alias("class_id"))
    facts = facts.join(least_of, "head").select("same", "links", "head", "class_id")
    return (
        signed.select("row", "doc_id", F.when(F.col("n_shingles") > 0, F.col("same")).alias("same"))
        .join(facts, "same", "left")
        .select("row", "doc_id", F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), "same", "head")
    )


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, of equal texts too; rows that link to nothing all stay.

    The row that stays has the smallest doc_id of its group (nulls last) and, of equal ones, the text whose MD5 is smallest;
    of rows that are equal in both, one stays. Rows are written once, with numbers, and go by bits: texts are not shuffled.
    """
    plain = docs.schema["text"].dataType == StringType() if "text" in docs.columns else False
    signed = _signed(docs, tuple(x for x in docs.columns if not (plain and x == "text")))
    groups = c.saved(_linked(signed).filter("n_links > 0").select("row", "doc_id", "same", "head"))
    best = groups.groupBy("head").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", "row")).alias("best"))
    gone = groups.select("row").join(best.select("best.row"), "row", "left_anti")
    kept = c.among(signed.select("row", "text", "own"), "row", gone, inside=False)
    return kept.select(*[F.col("text") if plain and x == "text" else F.col("own")[x].alias(x) for x in docs.columns])


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
SQL: dict[str, str] = {}
