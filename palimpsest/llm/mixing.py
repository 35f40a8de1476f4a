"""Mixing sources to target weights (operator 7), in DataFrame operations only.

Documents are summed to cells (source, language, topic) by words. Iterative proportional fitting rakes the cells' weights
to the target shares of the three marginals in turn. After every SWEEPS sweeps the residual is measured, the largest
distance of a marginal's share from its target; the fitting goes on until that is at most TOLERANCE, or no longer falls, as
where targets contradict each other (log() tells). A cell's expected number of copies is KEEP times its fitted share over
its own. A document comes as many times as the whole part of that says, and once more with the rest's probability, drawn
from the MD5 of its id (of its text, where it has none), so the same documents come back whatever the partitions.

Targets are a share by value, or, by default, the own shares to the power POWER, which lifts small sources, languages
and topics. Values without a target get none; targets of values that don't occur are left out, and the rest is scaled
to one. Topic is, by default, what most words of a text of TOPICS are about (of as many, the first; words after a space
or line feed count), or else its form:
table, code, list, short or prose.

Scale: documents are read once for the sums and once for the draw; a source that holds a third of all rows is one row
a task and cell before the shuffle. Cells are never collected, nor sorted: each marginal is a grouping with partial sums
that is joined back, and cells are a written table after each sweep.

Null or empty texts have no word: their cells' words count, and as such documents weigh nothing, they are never drawn
alone (a cell without words gets nothing). Null sources and languages are the value '' . Rows that repeat a doc_id are
drawn alike. Extra columns are kept by mixed(); a result whose name a column has gets underscores after it.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common as c

POWER, KEEP, SWEEPS, TOLERANCE, SEED = 0.5, 0.5, 12, 1e-3, "mix"
DIMENSIONS = ("source", "lang", "topic")
#: Beginnings of words that tell what a text is about, in English, German, French and Spanish.
TOPICS = {
    "law": "licens lizenz licence licencia copyright warrant gesetz gericht tribunal juzgado legal attorney abogad",
    "software": "software version apache source-code python javascript server api token linux quelltext logiciel programa",
    "science": "research forsch recherche investigaci theorem molecul molekül experiment hypothes physi",
    "health": "health gesundheit santé salud patient doctor disease krankheit maladie enfermedad hospital",
    "business": "market markt marché mercado invest company unternehmen entreprise empresa price preis prix precio",
    "sports": "football fußball fútbol match olymp league champion tournament spieler joueur jugador",
}


def form(text: Column) -> Column:
    """The form of a text."""
    return (
        F.when(text.like("%|%|%|%"), "table").when(text.rlike(r"[{};]\s*\n"), "code").when(text.rlike(r"(?m)^\s*[-*•] "), "list").when(F.length(text) < 400, "short").otherwise("prose")
    )


def _begin(words: str) -> str:
    """Any of these beginnings of words, the first letter small or large; by first letters, as each place is tried."""
    by: dict[str, list[str]] = {}
    for w in sorted(words.split()):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"[{k.upper()}{k}](?:{'|'.join(v)})" for k, v in by.items()) + ")"


#: Before a word that tells a topic: a space, which the start of a text gets too, or a line feed. Other classes cost twice as much.
_BEFORE = r"[\x20\n]"


def topic_of(text: Column) -> Column:
    """The default topic of a text."""
    own = F.concat(F.lit(" "), text)
    count = [F.struct(F.regexp_count(own, F.lit(_BEFORE + _begin(words))).alias("n"), F.lit(-k).alias("k")) for k, words in enumerate(TOPICS.values())]
    names = F.array(*[F.lit(n) for n in TOPICS])
    about = F.when(own.rlike(_BEFORE + _begin(" ".join(TOPICS.values()))), F.get(names, -F.greatest(*count)["k"]))
    return F.coalesce(about, form(text))


def _placed(docs: DataFrame, topic: Column | None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    return docs.withColumns({"__source": blank("source"), "__lang": blank("lang"), "__topic": topic_of(text) if topic is None else topic, "__words": c.count_words(text)})


def _number(total: DataFrame) -> Column:
    """The one number of a total, null if there is nothing to sum."""
    return F.lit(total.first()[0]).cast("double")


def fitted(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """From source, lang, topic and words: these and ratio, the fitted over the own share of each cell."""
    cells = c.saved(cells.filter("words > 0"))
    now = cells.withColumn("share", F.col("words").cast("double"))
    for d in DIMENSIONS:
        own = cells.groupBy(d).agg(F.sum("words").cast("double").alias("own"))
        if targets and d in targets:
            given = F.create_map(*[F.lit(x) for k, v in targets[d].items() for x in (k, float(v))])
            want = own.withColumn("want", F.coalesce(F.element_at(given, F.col(d)), F.lit(0.0)))
        else:
            want = own.withColumn("want", F.pow("own", F.lit(power)))
        want = c.saved(want.select(d, "want"))
        now = now.join(want.select(d, (F.col("want") / _number(want.agg(F.sum("want")))).alias(f"__{d}")), d)
    now, before, done = c.saved(now), None, 0
    while True:
        for _ in range(sweeps):
            for d in DIMENSIONS:
                total = now.groupBy(d).agg(F.sum("share").alias("__total"))
                now = now.join(total, d).withColumn("share", F.when(F.col("__total") > 0, F.col("share") * F.col(f"__{d}") / F.col("__total")).otherwise(0.0)).drop("__total")
            now, done = c.saved(now), done + 1
        residual = 0.0
        whole = _number(now.agg(F.sum("share")))
        for d in DIMENSIONS:
            off = now.groupBy(d).agg(F.abs(F.sum("share") / whole - F.max(f"__{d}")).alias("off"))
            residual = max(residual, off.agg(F.max("off")).first()[0] or 0.0)
        if residual <= tolerance or (before is not None and residual > 0.9 * before):
            break
        before = residual
    log().log(logging.INFO if residual <= tolerance else logging.WARNING, "mixing: residual %.3g after %d sweeps", residual, done)
    every, fit = _number(now.agg(F.sum("words"))), _number(now.agg(F.sum("share")))
    return now.select(*DIMENSIONS, "words", (F.col("share") / fit * every / F.col("words")).alias("ratio"))


def log() -> logging.Logger:
    return logging.getLogger(__name__)


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topic: Column | None = None, power: float = POWER, sweeps: int = SWEEPS, seed: str = SEED) -> DataFrame:
    """The documents drawn, with topic, expected (copies) and copies."""
    rows = _placed(docs, topic)
    cells = rows.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__words").alias("words"))
    fit = fitted(cells, targets, power, sweeps).select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], (F.lit(keep) * F.col("ratio")).alias("__expected"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    draw = F.conv(F.substring(F.md5(F.concat(own, F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out = rows.join(c.saved(fit), [f"__{d}" for d in DIMENSIONS])
    copies = (F.floor("__expected") + F.when(draw < F.col("__expected") - F.floor("__expected"), 1).otherwise(0)).cast("bigint")
    taken = {x.lower() for x in docs.columns}

    def free(name: str) -> str:
        return name if name not in taken else free(f"{name}_")

    out = out.withColumn("__copies", copies).filter("__copies > 0")
    return out.select(*docs.columns, F.col("__topic").alias(free("topic")), F.col("__expected").alias(free("expected")), F.col("__copies").alias(free("copies")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mixed(docs).select("doc_id", "source", "lang", "topic", F.round("expected", 6).alias("expected"), "copies")


def _sql() -> str:
    steps, now = [], "s0"
    for d in DIMENSIONS:
        steps.append(f"w_{d} AS MATERIALIZED (SELECT {d}, pow(sum(words), {POWER}) / sum(pow(sum(words), {POWER})) OVER () AS want FROM s0 GROUP BY {d})")
    for k in range(SWEEPS):
        for d in DIMENSIONS:
            new = f"s{k}_{d}"
            steps.append(f"{new} AS MATERIALIZED (SELECT source, lang, topic, words, share * want / sum(share) OVER (PARTITION BY {d}) AS share FROM {now} JOIN w_{d} USING ({d}))")
            now = new
    counts = ", ".join(f"len(regexp_extract_all(' ' || coalesce(text, ''), '{_BEFORE}{_begin(words)}')) AS t{k}" for k, words in enumerate(TOPICS.values()))
    most = f"greatest({', '.join(f't{k}' for k in range(len(TOPICS)))})"
    about = " ".join(f"WHEN {most} > 0 AND t{k} = {most} THEN '{name}'" for k, name in enumerate(TOPICS))
    return rf"""
WITH t AS MATERIALIZED (SELECT doc_id, source, lang, text, {counts} FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, lang, text, coalesce(source, '') AS cs, coalesce(lang, '') AS cl, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  CASE {about} WHEN coalesce(text, '') LIKE '%|%|%|%' THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[{{}};]\s*\n') THEN 'code'
    WHEN regexp_matches(coalesce(text, ''), '(?m)^\s*[-*•] ') THEN 'list' WHEN length(coalesce(text, '')) < 400 THEN 'short' ELSE 'prose' END AS topic FROM t),
s0 AS MATERIALIZED (SELECT cs AS source, cl AS lang, topic, sum(words) AS words, CAST(sum(words) AS DOUBLE) AS share FROM d GROUP BY ALL HAVING sum(words) > 0),
{', '.join(steps)},
f AS (SELECT source AS cs, lang AS cl, topic, {KEEP} * share / sum(share) OVER () * sum(words) OVER () / words AS expected FROM {now}),
o AS (SELECT doc_id, source, lang, topic, expected, CAST(floor(expected) + CASE WHEN ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || '{SEED}'), 1, 8))::BIGINT / 4294967296.0 < expected - floor(expected) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM d JOIN f USING (cs, cl, topic))
SELECT doc_id, source, lang, topic, round(expected, 6) AS expected, copies FROM o WHERE copies > 0"""


QUERIES = {"op7_mix_sources": op7_mix_sources}
SQL = {"op7_mix_sources": _sql()}
