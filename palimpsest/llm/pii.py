"""PII (operator 1): bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the spans of the fixed patterns of PATTERNS, and of SECRET: keys in some well-known forms. Candidates are other
words with a digit. The lexical patterns of a span are the last word before it, the last two, the first word after it, the
first two, and the last before with the first after; punctuation that touches the span is no word. What stands more than
two matches away is not looked at. Spans and candidates make a graph of patterns and values, which is scored in rounds until
nothing new is found: a pattern is scored for a kind by the share of its distinct values that are known to be of that kind;
patterns with SUPPORT such values and a share of CONFIDENCE are trusted, and candidate values that trusted patterns hold
become known, of the kind of the one with the highest share. A value known to be of another kind counts against a pattern
in full; one of which nothing is known is what there is to discover, and counts UNKNOWN. Wherever a value that became
known stands, its span is added, with its kind. Base spans always stay. Distinct values count, so copies of a document add
no confidence.

Offsets are in code points: a pattern's matches and the pieces between them alternate, so their lengths are summed.
Patterns are possessive, or anchored where a run starts, so that none goes back over a long text, and arrays are never
grown one by one: the work is nearly in proportion to a text's length and matches. The texts are read once, nothing of them
but spans and patterns is shuffled, and a frequent pattern or value is summed before it is; where values that became known
are looked up, each is dealt out SALT times.

Null or empty texts have no span. Each row has its own spans, also where rows repeat a doc_id or have none. Extra columns
are not read by find(); by redacted() they are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common as c

_RUN = "[A-Za-z0-9._%+-]"
#: By kind, in the order of results: what to look for. Those of the contract, without going back over what was read.
PATTERNS = {
    "email": rf"(?:(?<!{_RUN})|\G){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms of keys that services give out, and hexadecimal digests of 128, 160 and 256 bits in small letters.
SECRET = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}))(?![0-9A-Za-z])"
KINDS = (*PATTERNS, "secret")
#: Words with a digit.
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
SUPPORT, CONFIDENCE = 5, 0.9
#: What a value of no known kind counts in a pattern, where one of another kind counts 1.
UNKNOWN = 0.1
SALT = 16
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPANS = "cast(array() as array<struct<start:bigint,stop:bigint,value:string,patterns:array<string>>>)"
_MARK = r"[^\s\p{L}\p{N}]"


def _lexical(left: Column, right: Column) -> Column:
    """The lexical patterns of a span, from what stands before and after it."""
    tail = F.regexp_extract(left, r"(?<!\S)(?:\S++\s++){0,2}\S*+\z", 0)
    tail = F.regexp_replace(tail, rf"(?<!{_MARK}){_MARK}++\z", "")
    head = F.regexp_replace(F.regexp_extract(right, r"\A\S*+(?:\s++\S++){0,2}", 0), rf"\A{_MARK}++", "")
    words = lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        before, after = w["before"], w["after"]
        last, first = F.get(before, F.size(before) - 1), F.get(after, F.lit(0))
        found = [
            F.concat(F.lit("<"), last), F.concat(F.lit("<<"), F.get(before, F.size(before) - 2), F.lit(" "), last),
            F.concat(F.lit(">"), first), F.concat(F.lit(">>"), first, F.lit(" "), F.get(after, F.lit(1))), F.concat(F.lit("<>"), last, F.lit(" "), first),
        ]
        return F.filter(F.array(*found), lambda p: p.isNotNull())

    return c.let(F.struct(words(tail).alias("before"), words(head).alias("after")), of)


def _matches(pattern: str, needs: Column) -> Column:
    """start, stop, value and lexical patterns of the matches of a pattern in column text, in order."""
    zipped = F.arrays_zip(F.split("text", pattern).alias("b"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("f"))

    def of(z: Column) -> Column:
        part = lambda i, n: F.get(z, i)[n]

        def span(p: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(p["b"])
            left = F.concat_ws("", part(i - 2, "f"), part(i - 1, "b"), part(i - 1, "f"), p["b"])
            right = F.concat_ws("", part(i + 1, "b"), part(i + 1, "f"), part(i + 2, "b"), part(i + 2, "f"))
            return F.struct(start.alias("start"), (start + F.length(p["f"])).alias("stop"), p["f"].alias("value"), _lexical(left, right).alias("patterns"))

        sizes = F.transform(z, lambda p: (F.length(p["b"]) + F.coalesce(F.length(p["f"]), F.lit(0))).cast("bigint"))
        return c.let(c.running(sizes, lambda a, x: a + x), lambda at: F.filter(F.transform(z, lambda p, i: span(p, i, at)), lambda s: s["value"].isNotNull()))

    return F.when(needs, c.let(zipped, of)).otherwise(F.expr(_SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _free(found: Column, taken: Column) -> Column:
    """Those spans of found, in order, that overlap none of taken: up to where a span stops, the latest stop of what starts before."""
    mine = F.transform(found, lambda s, i: F.struct(s["stop"].alias("at"), F.lit(0).alias("side"), s["start"].alias("v"), i.alias("i")))
    others = F.transform(taken, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("side"), s["stop"].alias("v"), F.lit(-1).alias("i")))

    def of(events: Column) -> Column:
        tops = c.running(F.transform(events, lambda e: e["side"] * e["v"]), lambda a, x: F.greatest(a, x))
        good = lambda top: F.filter(F.transform(events, lambda e, j: F.when((e["side"] == 0) & (F.get(top, j) <= e["v"]), e["i"])), lambda i: i.isNotNull())
        return c.let(tops, good)

    kept = lambda fs: F.transform(c.let(F.sort_array(F.concat(mine, others)), of), lambda i: F.get(fs, i))
    return F.when(F.size(taken) == 0, found).otherwise(c.let(found, kept))


def mentions(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, text_hash, base and secrets (kind number, start, stop, value, patterns; in the order of results) and candidates of each row; whole: and own, all its columns."""
    own_columns = [F.struct(*docs.columns).alias("own")] if whole else []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *own_columns).withColumn("text_hash", F.xxhash64("text"))
    facts = ["doc_id", "text_hash", *(["own"] if whole else [])]
    needs = {"email": F.instr("text", "@") > 0, "phone": F.instr("text", "+") > 0}
    digit = F.col("text").rlike("[0-9]")
    every = {**PATTERNS, "secret": SECRET, "candidate": CANDIDATE}
    rows = rows.select(*facts, *[_matches(p, needs.get(name, digit)).alias(name) for name, p in every.items()])

    def own(k: int, name: str) -> Column:
        good = F.filter(name, lambda s: _valid(name, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(k).alias("kind"), *[s[x].alias(x) for x in ("start", "stop", "value", "patterns")]))

    rows = rows.select(*facts, F.concat(*[own(k, name) for k, name in enumerate(PATTERNS)]).alias("base"), "secret", "candidate")
    rows = rows.withColumn("secrets", own(len(PATTERNS), "secret")).withColumn("secrets", _free(F.col("secrets"), F.col("base")))

    def trimmed(s: Column) -> Column:
        front = F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[^\p{L}\p{N}]++", ""))
        value = F.regexp_replace(s["value"], r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        return F.struct((s["start"] + front).alias("start"), (s["start"] + front + F.length(value)).alias("stop"), value.alias("value"), s["patterns"].alias("patterns"))

    free = _free(F.transform("candidate", trimmed), F.concat("base", "secrets"))
    return rows.select(*facts, "base", "secrets", free.alias("candidates"))


def _edges(found: DataFrame) -> DataFrame:
    """value, kind (null for candidates) and pattern, a row for each different one."""
    side = lambda name, kind: F.transform(name, lambda s: F.struct(s["value"].alias("value"), kind(s).alias("kind"), s["patterns"].alias("patterns")))
    every = F.concat(side("base", lambda s: s["kind"]), side("secrets", lambda s: s["kind"]), side("candidates", lambda s: F.lit(None).cast("int")))
    rows = found.select(F.explode(every).alias("m"))
    return rows.select("m.value", "m.kind", F.explode("m.patterns").alias("pattern")).distinct()


def scored(pairs: DataFrame, known: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern, kind, share and trusted of each pattern of a known value. pairs: value, pattern; known: value, kinds (a bit each)."""
    has = lambda k: F.count_if(F.coalesce(F.col("kinds").bitwiseAND(F.lit(1 << k)) != 0, F.lit(False))).alias(f"k{k}")
    shares = pairs.join(known, "value", "left").groupBy("pattern").agg(F.count("*").alias("all"), F.count("kinds").alias("known"), *[has(k) for k in range(len(KINDS))])
    best = F.greatest(*[F.struct(F.col(f"k{k}").alias("n"), F.lit(-k).alias("k")) for k in range(len(KINDS))])
    weight = F.col("known") + UNKNOWN * (F.col("all") - F.col("known"))
    shares = shares.filter("known > 0").select("pattern", best.alias("best"), weight.alias("weight"))
    return shares.select("pattern", (-F.col("best.k")).alias("kind"), (F.col("best.n") / F.col("weight")).alias("share"), ((F.col("best.n") >= support) & (F.col("best.n") >= confidence * F.col("weight"))).alias("trusted"))


def discovered(edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int | None = None) -> DataFrame:
    """value and kind of candidates that trusted patterns say to be identifiers. edges: as saved; rounds: none for all there are."""
    pairs = edges.select("value", "pattern").distinct()
    known = c.saved(edges.filter("kind is not null").groupBy("value").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds")))
    out = None
    while rounds is None or rounds > 0:
        trusted = scored(pairs, known, support, confidence).filter("trusted")
        fresh = edges.filter("kind is null").select("value", "pattern").join(trusted, "pattern").groupBy("value").agg(F.max(F.struct("share", "kind")).alias("best"))
        new = c.saved(fresh.select("value", F.col("best.kind").alias("kind")).join(known, "value", "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new.select("value", F.expr("shiftleft(1, kind)").alias("kinds")))
        out, rounds = new if out is None else out.unionByName(new), rounds and rounds - 1
    return edges.sparkSession.createDataFrame([], "value string, kind int") if out is None else out


def _span(s: Column, kind: Column) -> Column:
    return F.struct(kind.alias("kind"), *[s[x].alias(x) for x in ("start", "stop", "value")])


def _spans(name: str) -> Column:
    return F.transform(name, lambda s: _span(s, s["kind"]))


def _added(found: DataFrame, support: int, confidence: float, rounds: int | None) -> DataFrame:
    """row and added, the spans of values that became known, of the rows of found (mentions() with a number each, as saved) that have some."""
    new = discovered(c.saved(_edges(found)), support, confidence, rounds)
    salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("salt")
    rows = found.select("row", (F.col("row") % SALT).alias("salt"), F.explode("candidates").alias("s"))
    rows = rows.withColumn("value", F.col("s.value")).join(new.select("value", "kind", salt), ["value", "salt"])
    return rows.groupBy("row").agg(F.collect_list(_span(F.col("s"), F.col("kind"))).alias("added"))


def find(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int | None = None) -> DataFrame:
    """doc_id, text_hash, base (spans of the fixed patterns) and added (secrets, and those discovered): kind number, start, stop, value, in order."""
    found = c.saved(mentions(docs).withColumn("row", F.monotonically_increasing_id()))
    added = _added(found, support, confidence, rounds)
    none = F.filter(_spans("base"), lambda s: F.lit(False))
    return found.join(added, "row", "left").select("doc_id", "text_hash", _spans("base").alias("base"), F.sort_array(F.concat(_spans("secrets"), F.coalesce("added", none))).alias("added"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _redacted(text: Column, spans: Column) -> Column:
    """A text with each span in turn replaced by its kind in capitals and brackets; spans that overlap become one, of the first one's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))

    def of(ss: Column, tops: Column, pieces: Column) -> Column:
        """tops: the latest stop before each span, and of all."""
        heads = F.filter(F.transform(ss, lambda s, i: F.when(s["start"] >= F.get(tops, i), i)), lambda i: i.isNotNull())
        part = lambda i: F.concat(c.between(pieces, F.get(tops, i), F.get(ss, i)["start"]), F.get(names, F.get(ss, i)["kind"]))
        return F.concat(F.array_join(F.transform(heads, part), ""), c.between(pieces, F.element_at(tops, -1), F.length(text).cast("bigint")))

    stops = lambda ss: c.running(F.transform(ss, lambda s: -s["back"]), lambda a, x: F.greatest(a, x))
    return c.let(order, lambda ss: c.let(stops(ss), lambda tops: c.let(c.blocks(text), lambda pieces: of(ss, tops, pieces))))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of a text replaced by its kind in capitals and brackets; spans that overlap become one.

    Each row gets the spans of its own text. Rows are written once, beside their spans; only those in which a value that
    became known stands are shuffled, to meet it.
    """
    found = c.saved(mentions(docs, whole=True).withColumn("row", F.monotonically_increasing_id()))
    more = c.saved(_added(found, SUPPORT, CONFIDENCE, None))
    rows = found.select("row", "own", F.concat(_spans("base"), _spans("secrets")).alias("spans"))
    met = c.among(rows, "row", more).join(more, "row").select("own", F.concat("spans", "added").alias("spans"))
    rows = c.among(rows, "row", more, inside=False).select("own", "spans").unionByName(met)
    text = F.col("own")["text"]
    text = F.when(F.size("spans") == 0, text).otherwise(_redacted(text.cast("string"), F.col("spans")))
    return rows.select(*[(text if x.lower() == "text" else F.col("own")[x]).alias(x) for x in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(k: int, name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{name}")

    counts = [count(k, name) for k, name in enumerate(PATTERNS)]
    every = F.sort_array(F.concat("base", "added"))
    n = [F.size("added").cast("bigint").alias("n_added"), F.size(every).cast("bigint").alias("n_spans")]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"), *n)


QUERIES = {"op1_pii": op1_pii}
SQL: dict[str, str] = {}
