"""Language ID (operator 5): sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of one to three characters of the lower-cased text, hashed to BUCKETS numbers; the weight of one is
(1 + ln count) * idf, scaled to length one. Document frequencies come from all training documents. The weights are
trained on the driver by follow-the-regularised-leader with elastic-net penalties, on a sample of about PER_LANGUAGE
labelled documents of each language, whole texts, chosen by a hash of their ids (all where a language has fewer);
every fifth of them sets the temperature by which the logits are divided. What is broadcast is BUCKETS numbers and
BUCKETS weights a language.

lang_pred is `und`, with score 0, if a text is null, empty or without a letter, or if there is nothing to learn from.
Otherwise score is the calibrated probability of lang_pred; of equal ones, the language that sorts first. Repeated
rows are predicted alike. Texts of any length are read whole. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common as c

BUCKETS = 1 << 15
PER_LANGUAGE = 800
#: Bytes of rows that are scored at a time, about.
SLICE = 4_000_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.0005, 3


def counted(text: pa.Array):
    """For each text, the numbers of its n-grams and how often each occurs."""
    data, at = c.text_bytes(pc.utf8_lower(text.cast(pa.string())))
    for i, j in c.slices(at):
        part = data[at[i] : at[j]]
        points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[at[i : j + 1] - at[i]]
        grams, key = [], np.zeros(len(points), np.uint32)
        for n in range(3):
            key = key[: len(points) - n] * np.uint32(0x01000193) + points[n:] + np.uint32(n + 1)
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(2654435761)
            grams.append((mixed >> np.uint32(17)).astype(np.int32))
        for a, b in zip(starts[:-1], starts[1:]):
            own = np.concatenate([g[a : max(a, b - n)] for n, g in enumerate(grams)])
            count = np.bincount(own, minlength=BUCKETS)
            on = np.flatnonzero(count)
            yield on, count[on]


def weighted(on: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[on]
    return x / max(1e-12, np.sqrt((x * x).sum()))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """FTRL-proximal; rows: (class, feature numbers, values)."""
    z, n, w = (np.zeros((BUCKETS, classes)) for _ in range(3))
    for _ in range(EPOCHS):
        for label, on, x in rows:
            logit = x @ w[on]
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            before = n[on]
            after = before + g * g
            zed = z[on] + g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w[on]
            z[on], n[on] = zed, after
            w[on] = np.where(np.abs(zed) > L1, -(zed - np.sign(zed) * L1) / ((BETA + np.sqrt(after)) / ALPHA + L2), 0)
    return w


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What to divide logits by for the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), labels]).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    while b - a > 1e-3:
        p, q = b - g * (b - a), a + g * (b - a)
        a, b = (a, q) if loss(p) <= loss(q) else (p, b)
    return float(np.exp((a + b) / 2))


def default_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, float] | None:
    """From doc_id, text and lang: languages, idf, weights and temperature; None if there is nothing to learn from."""
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    total, languages = sum(sizes.values()), sorted(sizes)

    def frequencies(batches):
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for on, _ in counted(batch.column("text")):
                seen[on] += 1
        on = np.flatnonzero(seen)
        yield pa.record_batch({"gram": pa.array(on, pa.int32()), "docs": pa.array(seen[on], pa.int64())})

    idf = np.full(BUCKETS, np.log((1 + total) / 1) + 1)
    for r in rows.select("text").mapInArrow(frequencies, "gram int, docs bigint").groupBy("gram").agg(F.sum("docs").alias("docs")).collect():
        idf[r["gram"]] = np.log((1 + total) / (1 + r["docs"])) + 1

    def features(batches):
        for batch in batches:
            found = list(counted(batch.column("text")))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "grams": pa.array([f[0] for f in found], pa.list_(pa.int32())), "counts": pa.array([f[1] for f in found], pa.list_(pa.int32()))})

    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, per_language / v))])[F.col("lang")]
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    got = sample.mapInArrow(features, "doc_id bigint, lang string, grams array<int>, counts array<int>").orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id").toArrow()
    number = {x: k for k, x in enumerate(languages)}
    data = [(number[lang], on, weighted(on, count, idf)) for lang, on, count in zip(got["lang"].to_pylist(), (np.array(x.values) for x in got["grams"]), (np.array(x.values) for x in got["counts"])) if len(on)]
    learn, tune = [d for k, d in enumerate(data) if k % 5 or len(data) < 10], [d for k, d in enumerate(data) if k % 5 == 0 and len(data) >= 10]
    w = train(learn, len(languages))
    t = temperature(np.array([x @ w[on] for _, on, x in tune]).reshape(-1, len(languages)), np.array([label for label, _, _ in tune], int))
    return languages, idf, w, t


def predict(docs: DataFrame, model, also: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of also, and the prediction and its score under the names given; docs has text and those columns."""
    results, shared = names, docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*also, *(["text"] if "text" not in also else []), letter.alias("__letter"))
    schema = rows.select(*also).schema.simpleString()[7:-1]

    def score(batches):
        for whole in batches:
            size = max(1, whole.num_rows * SLICE // max(1, whole.nbytes))
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                letter = batch.column("__letter")
                names, scores = ["und"] * len(letter), np.zeros(len(letter))
                if shared.value is not None:
                    languages, idf, w, t = shared.value
                    on_rows = np.flatnonzero(letter.to_numpy(zero_copy_only=False))
                    for k, (on, count) in zip(on_rows, counted(batch.column("text").filter(letter))):
                        logit = weighted(on, count, idf) @ w[on] / t
                        p = np.exp(logit - logit.max())
                        best = int(p.argmax())
                        names[k], scores[k] = languages[best], p[best] / p.sum()
                columns = {n: batch.column(n) for n in also}
                yield pa.record_batch(columns | {"__lang_pred": pa.array(names, pa.string()), "__score": pa.array(scores, pa.float64())})

    return rows.mapInArrow(score, f"{schema}, __lang_pred string, __score double").withColumnsRenamed(dict(zip(("__lang_pred", "__score"), results)))


def language_id(docs: DataFrame, held_out: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; held_out ones are not learned from."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").withColumn("held_out", default_held_out() if held_out is None else held_out)
    return predict(docs, fit(docs.filter(~F.col("held_out")), per_language), ["doc_id", "held_out"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
