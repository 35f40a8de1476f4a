"""Document fingerprints (operator 9): SpotSigs, in DataFrame operations only.

A spot is a common word (ANCHORS); its signature is the anchor with the CHAIN content words that follow it within
REACH words. The fingerprint of a text is its sorted set of signatures, as 40-bit hashes in hexadecimal. A text
without any spot has one signature, the hash of the whole text, so that different texts differ.

Sets are put into partitions by their length, whose bounds rise by 1 / THRESHOLD: sets two partitions apart can't reach
the threshold, nor can those whose lengths are further apart than it, and only the others are intersected by similar().
likeness() is the Jaccard similarity itself, whatever the lengths.

neighbours() finds the next document in descending doc_id without a global sort: rows are cut into ranges at bounds taken
from a sample of their keys, each range is sorted in a task, and the first row of each range is copied to the end of the
range before, whose last row needs it (that of the first range to the last: after the last comes the first). Keys are of
doc_id, a hash of the text and, where more than c.MOST_EQUAL rows are equal in both, a number, so that any group of rows is
cut. There are up to MOST_RANGES ranges of about RANGE_ROWS rows, and of more beyond that; their sorts spill.

Null texts are empty; an empty text has the signature of the empty string. Rows without doc_id come after all others.
Rows that repeat a doc_id follow each other by the hash of their texts. Extra columns are not read. A table without
documents gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import common as c

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the and of to in is that for with as on by it this be are was "
    "le la les de des du et un une que qui dans pour avec sur "
    "der die das und zu von den mit ist für im ein eine sich auf "
    "el los las del y una por con para se es"
).split()
CHAIN, REACH, THRESHOLD = 2, 8, 0.8
MOST_RANGES, RANGE_ROWS, SAMPLES = 1 << 15, 5000, 16
_MASK = (1 << 40) - 1


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures, an array of bigint."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    common = lambda w: w.isin(ANCHORS)

    def spot(w: Column, i: Column) -> Column:
        return F.when(common(w), F.slice(F.filter(F.slice(F.col("__words"), i + 2, F.lit(REACH)), lambda x: ~common(x)), 1, CHAIN))

    chains = F.transform(F.col("__words"), lambda w, i: F.struct(w.alias("w"), spot(w, i).alias("c")))
    hashes = F.transform(F.filter(chains, lambda s: F.size(s["c"]) == CHAIN), lambda s: F.xxhash64(s["w"], s["c"]).bitwiseAND(F.lit(_MASK)))
    whole = F.array(F.xxhash64(F.lit("whole"), text).bitwiseAND(F.lit(_MASK)))
    found = F.sort_array(F.array_distinct(hashes))
    return words, F.when(F.size(found) > 0, found).otherwise(whole)


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with a column of the signatures of a (non-null) text column."""
    words, found = signatures(F.col(text))
    return rows.withColumn("__words", words).withColumn(name, found).drop("__words")


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def length_partition(found: Column, threshold: float = THRESHOLD) -> Column:
    return F.floor(F.log(F.size(found)) / F.lit(-1.0) / F.log(F.lit(threshold))).cast("int")


def similar(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Whether two sets' similarity reaches the threshold; lengths that rule it out spare the intersection."""
    near = F.abs(length_partition(a, threshold) - length_partition(b, threshold)) <= 1
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(near & (short >= threshold * long), likeness(a, b) >= threshold).otherwise(False)


def _rising(number: Column) -> Column:
    """A long as 16 digits that sort as it does."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _next(level: Column, key: Column):
    return lambda i: i * 32 + F.size(F.filter(F.slice(level, i * 32 + 1, F.lit(32)), lambda b: b <= key))


def _rank(key: Column, bounds: list[str]) -> Column:
    """How many of rising bounds are at most key: at three levels, of which each looks at 32."""
    literal = lambda x: F.split(F.lit(",".join(x)), ",")  # noqa: E731 - one literal, which the optimizer parses once
    levels = [bounds, bounds[31::32], bounds[31::32][31::32]]
    found = F.lit(0)
    for level in reversed([x for x in levels if x]):
        found = c.let(found, _next(literal(level), key))
    return found


def neighbours(rows: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows (doc_id, text and more) with next_<column> from the next row in descending doc_id, the first after the last."""
    hashed = F.xxhash64("text")
    n, most = rows.groupBy("doc_id", hashed.alias("h")).count().agg(F.sum("count"), F.max("count")).first()
    part = F.lit("")
    if (most or 0) > c.MOST_EQUAL:
        rows = c.saved(rows.withColumn("__row", F.monotonically_increasing_id()))
        part = _rising(F.xxhash64("__row"))
    key = F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise("0"), _rising(F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("bigint")))), _rising(hashed), part)
    rows = rows.withColumn("__key", key)
    k = min(MOST_RANGES, max(1, -(-(n or 0) // range_rows)))
    bounds = []
    if k > 1:
        drawn = F.pmod(F.xxhash64(F.lit("range"), "__key"), F.lit(1 << 30)) < min(1.0, SAMPLES * k / n) * (1 << 30)
        sample = sorted(r[0] for r in rows.select("__key").filter(drawn).collect())
        bounds = sorted({sample[len(sample) * i // k] for i in range(1, k)}) if sample else []
    rows = rows.withColumn("__range", _rank(F.col("__key"), bounds) if bounds else F.lit(0))
    # the first key of each range, and the range that its row is copied to
    firsts = sorted((r["__range"], r["first"]) for r in rows.select("__range", "__key").groupBy("__range").agg(F.min("__key").alias("first")).collect())
    first, to = [""] * (len(bounds) + 1), ["0"] * (len(bounds) + 1)
    for (at, own), (before, _) in zip(firsts, firsts[-1:] + firsts[:-1]):
        first[at], to[at] = own, str(before)
    literal = lambda x: F.split(F.lit(",".join(x)), ",")
    copy = F.when(F.get(literal(first), F.col("__range")) == F.col("__key"), F.get(literal(to), F.col("__range")).cast("int"))
    places = F.array(F.struct(F.col("__range").alias("range"), F.lit(False).alias("copy")), F.struct(copy.alias("range"), F.lit(True).alias("copy")))
    dealt = rows.withColumn("__to", F.explode(F.filter(places, lambda x: x["range"].isNotNull()))).drop("__range")
    order = W.partitionBy("__to.range").orderBy(F.col("__to.copy"), "__key")
    out = dealt.select("*", *[F.lead(x).over(order).alias(f"next_{x}") for x in columns])
    return out.filter("not __to.copy").drop("__to", "__key", "__row")


def spotsigs(docs: DataFrame) -> DataFrame:
    """doc_id, text, signatures, and those of each document's edited text and of the next document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = neighbours(with_signatures(rows, "text", "found"), ["text", "found"]).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    return with_signatures(rows.withColumn("edited", edited).drop("text", "next_text"), "edited", "edited_found")


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("found")).alias("fingerprint"), fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"), likeness(F.col("found"), F.col("next_found")).alias("near_next"),
        length_partition(F.col("found")).alias("length_partition"), similar(F.col("found"), F.col("next_found")).alias("similar_next"),
    )


QUERIES = {"op9_spotsigs": op9_spotsigs}
SQL: dict[str, str] = {}
