"""Benchmark decontamination (operator 8), in DataFrame operations only.

Words are runs of digits, letters a to z (A to Z lower-cased) and characters beyond ASCII. A benchmark item gives all
its windows of WINDOW words; one of fewer words, but not none, is one window. The windows are a broadcast hash set: their
number is counted first, and beyond MOST_BROADCAST they are joined by a shuffle instead.

Each document's words are hashed once, and its windows, as hashes of those, are tested in place against a bitmap of the
set's hashes (at most BITS bits, a literal of the plan). Only windows that pass leave the document's row, each with its
words, which the join with the set compares whole. So the work is in proportion to the text, no text is shuffled, and what
is grouped by row are windows that passed, beside one small row for each document.

Rows are told apart by a number of their own, so rows that repeat a doc_id, or have none, each have their own words and
hits. Null or empty texts have no words and no hit. Repeated items count once for each item_id. Extra columns are not
read, but decontaminated() keeps them; it removes rows by doc_id and the hash of the text, which equal rows share.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common as c

WINDOW = 13
MOST_BROADCAST = 1_000_000
#: Bits of the bitmap, at most; eight for each window below that.
BITS = 1 << 24
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What is between lower-cased words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = "cast(array() as array<struct<size:int,pos:int,key:bigint,gram:string>>)"


def words(text: Column) -> Column:
    """The words of a text, each as its UTF-8 bytes read as Latin-1: equal just if the words are.

    Lower-casing then changes A to Z and first bytes of characters beyond ASCII; those stay told apart, as the number
    of bytes that follow (which it leaves alone) says which first byte it was. It and split() are several times faster
    than translate() and the extraction of matches.
    """
    lower = F.lower(F.decode(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), "ISO-8859-1"))
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _windows(own: Column, hashes: Column, size: Column, keep=None) -> Column:
    """size, pos (from 1), key and gram (the words, joined by spaces) of the windows of so many words, if keep says so of their key."""
    at = F.transform(F.sequence(F.lit(1), F.size(own) - size + 1), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(hashes, i, size)).alias("key")))
    at = at if keep is None else F.filter(at, lambda s: keep(s["key"]))
    gram = lambda s: F.concat_ws(" ", F.slice(own, s["pos"], size))
    found = F.transform(at, lambda s: F.struct(size.alias("size"), s["pos"].alias("pos"), s["key"].alias("key"), gram(s).alias("gram")))
    return F.when(F.size(own) >= size, found).otherwise(F.expr(_HITS))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """size, key (the hash of its words' hashes), gram (its words) and items of each different window."""
    size = lambda own: F.least(F.size(own), F.lit(window))
    found = c.let(words(F.col("text")), lambda own: c.let(F.transform(own, lambda w: F.xxhash64(w)), lambda h: _windows(own, h, size(own))))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.explode(F.when(F.length("text") > 0, found).otherwise(F.expr(_HITS))).alias("w"))
    return rows.filter("w.gram <> ''").groupBy("w.size", "w.key", "w.gram").agg(F.collect_set("item").alias("items"))


def _bitmap(grams: DataFrame, n: int) -> tuple[Column, int]:
    """An array of 64 bits each, in which those of the windows' keys are set, and how many bits there are."""
    bits = min(BITS, max(1 << 12, 1 << (8 * n).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(bits - 1).cast("bigint"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    found = grams.select(at.alias("at")).distinct().select(F.shiftright("at", 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = ["0"] * (bits // 64)
    for r in found:
        out[r["word"]] = str(r["bits"])
    # one literal, which the optimizer parses once
    return F.split(F.lit(",".join(out)), ",").cast("array<bigint>"), bits


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """For each row of docs, with its number: doc_id, text_key, n_words, spans (pos from 1 and size, rising) and items (sorted) of the windows in it."""
    grams = c.saved(benchmark_windows(benchmark, window))
    # window lengths, at most `window` of them; the count decides how to join
    facts = grams.groupBy("size").count().collect()
    sizes, n = sorted(r["size"] for r in facts), sum(r["count"] for r in facts)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    if not sizes:
        none = [F.expr("cast(array() as array<struct<pos:int,size:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items")]
        return rows.select("row", "doc_id", text_key(F.col("text")).alias("text_key"), F.size(words(F.col("text"))).alias("n_words"), *none)
    bitmap, bits = _bitmap(grams, n)

    def keep(key: Column) -> Column:
        at = key.bitwiseAND(F.lit(bits - 1).cast("bigint"))
        return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1

    def found(own: Column) -> Column:
        every = c.let(F.transform(own, lambda w: F.xxhash64(w)), lambda h: F.concat(*[_windows(own, h, F.lit(s), keep) for s in sizes], F.expr(_HITS)))
        return F.struct(F.size(own).alias("n"), every.alias("w"))

    at = rows.select("row", "doc_id", text_key(F.col("text")).alias("text_key"), c.let(words(F.col("text")), found).alias("f"))
    # what is exploded is a column of its own, so that no row of a window carries the others
    at = at.select("row", "doc_id", "text_key", F.col("f.n").alias("n_words"), F.col("f.w").alias("ws")).select("row", "doc_id", "text_key", "n_words", F.explode_outer("ws").alias("w"))
    # a row without windows has a key of its own: were it null, all such rows would go to one task
    key = F.coalesce("w.key", F.xxhash64("row"))
    at = at.select("row", "doc_id", "text_key", "n_words", key.alias("key"), F.col("w.gram").alias("gram"), F.struct("w.pos", "w.size").alias("span"))
    joined = at.join(F.broadcast(grams.drop("size")) if n <= most_broadcast else grams.drop("size").hint("merge"), ["key", "gram"], "left")
    hit = F.col("items").isNotNull()
    spans = F.sort_array(F.collect_set(F.when(hit, F.col("span"))))
    items = F.sort_array(F.array_distinct(F.flatten(F.collect_set("items"))))
    return joined.groupBy("row").agg(*[F.first(x).alias(x) for x in ("doc_id", "text_key", "n_words")], spans.alias("spans"), items.alias("items"))


def _merged(spans: Column) -> Column:
    """How many words rising spans cover together."""

    def add(acc: Column, s: Column) -> Column:
        stop = s["pos"] + s["size"]
        new = F.greatest(F.lit(0), stop - F.greatest(s["pos"], acc["to"]))
        return F.struct(F.greatest(acc["to"], stop).alias("to"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), add, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, items and contaminated (at least a twentieth of its words, and one, hit) of each row, and its text_key."""
    found = hits(docs, benchmark, window, most_broadcast)
    n_hit, n_words = F.col("n_hit"), F.col("n_words").cast("bigint")
    found = found.withColumn("n_hit", _merged(F.col("spans")).cast("bigint"))
    return found.select("doc_id", "text_key", n_words.alias("n_words"), "n_hit", "items", ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"))


def _without(text: Column, spans: Column) -> Column:
    """A text without the words of rising spans; what is between words stays."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    stop = lambda s: s["pos"] + s["size"]

    def of(pairs: Column) -> Column:
        plain = lambda a, b: F.array_join(F.transform(F.slice(pairs, a, b - a), lambda p: F.concat(p["b"], p["w"])), "")
        bare = lambda a, b: F.array_join(F.transform(F.slice(pairs, a, b - a), lambda p: p["b"]), "")

        def part(tops: Column) -> Column:
            """tops: the end of all spans before each, and of all."""
            one = lambda s, i: F.concat(plain(F.greatest(F.get(tops, i), F.lit(1)), F.greatest(s["pos"], F.get(tops, i))), bare(F.greatest(s["pos"], F.get(tops, i)), F.greatest(stop(s), F.get(tops, i))))
            return F.concat(F.array_join(F.transform(spans, one), ""), plain(F.greatest(F.element_at(tops, -1), F.lit(1)), F.size(pairs)), F.element_at(pairs, -1)["b"])

        return c.let(c.running(F.transform(spans, stop), lambda a, x: F.greatest(a, x)), lambda tops: part(F.transform(tops, lambda t: t.cast("int"))))

    zipped = F.arrays_zip(F.split(text, word).alias("b"), F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("w"))
    return c.let(zipped, of)


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the words that windows cover taken out of texts.

    Keys of contaminated documents are broadcast, so texts stay where they are, if a count says there are few enough.
    """
    key = [F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")), text_key(F.col("text")) == F.col("__key")]
    if remove == "spans":
        found = hits(docs, benchmark, window).filter(F.size("spans") > 0)
        gone = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.first("spans").alias("__spans"))
        text = _without(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("__spans"))
        return docs.join(gone, key, "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)
    bad = c.saved(report(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    return docs.join(F.broadcast(bad) if bad.count() <= most_broadcast else bad.hint("merge"), key, "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op8_decontaminate": op8_decontaminate}
SQL = {
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), {WINDOW}) AS size, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS pos FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, size, array_to_string(w[pos : pos + size - 1], ' ') AS gram FROM bw),
s AS (SELECT DISTINCT size FROM g),
dw AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, s WHERE len(w) >= size),
h AS (SELECT doc_id, dw.size, pos, item FROM dw JOIN g ON g.size = dw.size AND g.gram = array_to_string(w[pos : pos + dw.size - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
