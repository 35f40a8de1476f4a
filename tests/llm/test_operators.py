"""Each operator against a brute-force version, on rows with every awkward case."""

import base64
import bisect
import hashlib
import math
import pickle
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import chat_format, common, decontaminate, jaccard_join, language_id, lm_scoring, mixing, pii, registry, spotsigs, substring_dedup, warc

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
#: Names that operators use inside, too.
EXTRA = ["batch", "words", "hashes", "class_id", "kind", "spans", "row", "topic", "expected", "copies", "cluster", "own", "task", "key", "items", "ord", "place"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(1)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(300)]
    out = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 120)))) for k in range(40)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out += [(100 + k, f"{out[k][1]} {passage}\t{k}") for k in range(6)]
    base = rng.choices(vocabulary, k=150)
    for k in range(12):
        near = list(base)
        near[k * 11 % 150] = f"edit{k}"
        out.append((200 + k, " ".join(near)))
    out += [(300, out[3][1]), (301, out[3][1]), (302, None), (303, ""), (304, " \n\t "), (305, "x" * 30000), (306, " ".join(vocabulary * 40)), (307, "😀 é ü One"), (308, "one two"), (309, "one two"), (310, "\x00 \x1f a")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], f"s{k % 4}" if k % 5 else None, len(t or "")) for k, t in texts()]
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(n) for n in EXTRA}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


BY_ID = dict(texts())
WORDS = {k: re.findall(WORD, t or "") for k, t in texts()}


def test_words_and_sets():
    data, at = common.text_bytes(pa.array([t for _, t in texts()]))
    hashes, first = common.word_hashes(data, at)
    assert np.diff(first).tolist() == [len(w) for w in WORDS.values()]
    every = [w for ws in WORDS.values() for w in ws]
    assert len({*zip(every, hashes.tolist())}) == len({*every}) == len({*hashes.tolist()})
    v = np.sort(np.random.default_rng(0).integers(0, 2**63, 999, np.uint64))
    assert (common.unpack_sorted(common.pack_sorted(v)) == v).all() and len(common.unpack_sorted(common.pack_sorted(v[:0]))) == 0
    assert common.unpack_small(common.pack_small(np.array([0, 5, 70000], np.uint64))).tolist() == [0, 5, 70000]


@pytest.mark.parametrize("batch_bytes", [2000, 8_000_000])
def test_substring_dedup(docs, empty, batch_bytes):
    first = {}
    for k in sorted(WORDS):
        for i in range(len(WORDS[k]) - 19):
            first.setdefault(tuple(WORDS[k][i : i + 20]), (k, i))
    want = {}
    for k, w in WORDS.items():
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (k, i) for j in range(i, i + 20)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) for r in substring_dedup.substring_dedup(docs, batch_bytes=batch_bytes, texts=True).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 300
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_of_repeated_rows(docs):
    row = docs.filter("doc_id = 7").select("doc_id", F.lit(" ".join(f"a{i}" for i in range(30))).alias("text"))
    assert sorted(r["n_removed"] for r in substring_dedup.substring_dedup(row.unionByName(row)).collect()) == [0, 30]


def brute_dedup(rows):
    """(doc_id, n_words, n_removed) of rows that come one after another."""
    first, out = {}, []
    words = [re.findall(WORD, t or "") for _, t in rows]
    for k, w in enumerate(words):
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (k, i))
    for k, w in enumerate(words):
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (k, i) for j in range(i, i + 20)}
        out.append((rows[k][0], len(w), len(gone)))
    return sorted(out, key=str)


def test_substring_dedup_of_null_and_equal_rows(spark, monkeypatch):
    rng = random.Random(9)
    base = [" ".join(rng.choices("abcdefghij", k=50)) for _ in range(3)]
    rows = [(None, base[0])] * 7 + [(4, base[0])] * 5 + [(9, f"x {base[0]} {base[1]}"), (None, base[1]), (2, base[2]), (-3, f"{base[2]} tail"), (None, None), (None, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(n) for n in EXTRA}).repartition(3)
    # of equal doc_ids, which text comes first is by a hash, but not how much of all of them goes
    want = brute_dedup(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
    monkeypatch.setattr(common.batched, "__defaults__", (common.BATCH_BYTES, (), 3))
    for size in (100, 8_000_000):
        got = sorted([tuple(r)[:3] for r in substring_dedup.substring_dedup(df, batch_bytes=size).collect()], key=str)
        assert got == want


def test_windows_are_told_apart_by_both_hashes(spark, monkeypatch):
    """With a first hash of few bits, equal in many windows, results stay the same."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices("abcdefghijklmnopqrst", k=70))) for k in range(12)]
    rows += [(20 + k, f"{rows[k][1]} end") for k in range(5)]
    words, first = common.word_hashes(*common.text_bytes(pa.array([t for _, t in rows])))
    batch = substring_dedup._Batch(pa.table({"ord": pa.array([k for k, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])}), 20, 64)
    batch.candidates(np.ones(len(batch.entries), bool))
    monkeypatch.setattr(common, "mix", lambda x: x & np.uint64(3))
    large = common.second_hashes(words, batch.cand, 20)
    assert len(np.unique(large)) <= 4 < len(np.unique(batch.cand_others)) and len(batch.cand_starts) == len({*zip(batch.cand_entries.tolist(), batch.cand_others.tolist())})


def test_lm_scoring(docs, empty):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = {k: re.findall(WORD, (t or "").translate(lower)) + [None] for k, t in texts()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    count = Counter(t for k in tokens if not held[k] for t in tokens[k])
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in lm_scoring.lm_scoring(docs, batch_bytes=5000).collect()}
    assert set(got) == set(tokens)
    for k, ts in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ts), sum(count[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
        assert r["score"] < 0
    for df in (lm_scoring.lm_scoring(docs), lm_scoring.lm_scoring(docs, batch_bytes=1500, fan=2)):
        again = {r["doc_id"]: r["score"] for r in df.collect()}
        assert all(again[k] == got[k]["score"] for k in got)  # whatever the batches, and the levels of sums
    assert got[302]["score"] == got[303]["score"] and lm_scoring.lm_scoring(empty).count() == 0


def slow_mixer(text: bytes, train: list[bytes]) -> list[float]:
    """Minus the natural logarithm of the probability of each byte and of the end, bit by bit, with dictionaries of counts."""

    def places(data):
        data = bytes(lm_scoring.PAD) + data + b"\0"
        for i in range(lm_scoring.PAD, len(data)):
            prev = [np.array([data[i - 1 - d]], np.uint8) for d in range(lm_scoring.PAD)]
            yield data[i], [int(lm_scoring.contexts(prev, o, b)[0]) for o, b in lm_scoring.TABLES]

    counts = Counter()
    for t in train:
        for byte, found in places(t):
            for k, ctx in enumerate(found):
                counts[k, ctx, byte] += 1
    by_context = {}
    for (k, ctx, byte), n in counts.items():
        by_context.setdefault((k, ctx), []).append((byte, n))

    def logit(k, ctx, start, bit_place):
        n = [0, 0]
        for byte, m in by_context.get((k, ctx), []):
            if byte >> (8 - bit_place) == start:
                n[byte >> (7 - bit_place) & 1] += m
        return float(np.clip(np.rint(lm_scoring.QUANTUM * math.log((n[1] + 0.4) / (n[0] + 0.4))), -127, 127)) / lm_scoring.QUANTUM

    weights = [[w] * 8 for w in lm_scoring.WEIGHTS]
    steps, out = [[0.0] * 8 for _ in weights], []
    for i, (byte, found) in enumerate(places(text)):
        cost = 0.0
        for b in range(8):
            sign = 1 if byte >> (7 - b) & 1 else -1
            x = [logit(k, ctx, byte >> (8 - b), b) for k, ctx in enumerate(found)]
            p = 1 / (1 + math.exp(-min(40.0, max(-40.0, sign * sum(w[b] * v for w, v in zip(weights, x))))))
            cost -= math.log(p)
            for s, v in zip(steps, x):
                s[b] += lm_scoring.RATE / lm_scoring.STEP * (1 - p) * sign * v
        out.append(cost)
        if i % lm_scoring.STEP == lm_scoring.STEP - 1:
            for w, s in zip(weights, steps):
                for b in range(8):
                    w[b] += s[b]
                    s[b] = 0.0
    return out


def test_lm_bits_against_a_slow_mixer():
    rng = random.Random(6)
    train = [" ".join(rng.choices(["alpha", "beta", "Gamma", "é", "delta,"], k=80)).encode() for _ in range(6)]
    texts_ = [" ".join(rng.choices(["alpha", "beta", "Gamma", "zeta"], k=70)).encode(), b"", "é\n\tq".encode(), train[0]]
    tables = [np.zeros(1 << (b + 8), np.int64) for _, b in lm_scoring.TABLES]
    for t, (cells, n) in zip(tables, lm_scoring.count_cells(*common.text_bytes(pa.array([x.decode() for x in train])))):
        t[cells] = n
    tables = [lm_scoring.logits(t.reshape(-1, 256)).ravel() for t in tables]
    data, at = common.text_bytes(pa.array([x.decode() for x in texts_]))
    got = lm_scoring.byte_costs(data, at, lm_scoring.paths(tables))
    want = [x for t in texts_ for x in slow_mixer(t, train)]
    assert got == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_lm_tables_in_a_worker():
    """Of the broadcast tables, a worker keeps 544 bytes a context, and not the tables themselves beside them."""
    tables = [np.random.default_rng(b).integers(-127, 128, 1 << (b + 8), np.int8) for _, b in lm_scoring.TABLES]
    sent = pickle.dumps(lm_scoring.Shared(tables))
    tracemalloc.start()
    got = pickle.loads(sent)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 545 * sum(1 << b for _, b in lm_scoring.TABLES)
    for table, way, want in zip(tables, got, lm_scoring.paths(tables)):
        assert all(np.array_equal(x, y) for x, y in zip(way, want))
        for context, byte in ((0, 0), (5, 255), (len(table) // 256 - 1, 0b10110010)):
            logits = way[0][context * 8 + (byte >> 5) :][:1].view(np.int8).tolist() + way[1][context * 128 + (byte >> 1) :][:1].view(np.int8).tolist()
            assert logits == [table[context * 256 + ((256 | byte) >> (8 - d))] for d in range(8)]


def test_lm_is_a_distribution():
    """Probabilities of different texts don't sum to more than one, and counts make what was seen likely."""
    data, at = common.text_bytes(pa.array(["abracadabra " * 50]))
    tables = [np.zeros((1 << (b + 8)), np.int64) for _, b in lm_scoring.TABLES]
    for t, (cells, n) in zip(tables, lm_scoring.count_cells(data, at)):
        t[cells] = n
    tables = [lm_scoring.logits(t.reshape(-1, 256)).ravel() for t in tables]
    many = [b"", *(b"abra" + bytes([x]) for x in range(1, 256)), *(bytes([x]) for x in range(1, 256))]
    data, at = np.frombuffer(b"".join(many), np.uint8), np.cumsum([0, *map(len, many)])
    costs = lm_scoring.code_lengths(data, at, tables)
    assert (costs > 0).all() and np.exp(-costs).sum() <= 1 and costs[ord(" ")] == costs[1:256].min() and costs[ord("c")] < costs[ord("q")]
    assert lm_scoring.code_lengths(*common.text_bytes(pa.array(["abracadabra " * 9])), tables)[0] < 60


def test_lm_units_and_their_mixture():
    """Counts of pairs of words, with case and ending, against a loop; and all that can follow sums to one at most."""
    parts = ["a b A b", "", " a b", "a  b\tB", "É b\nb", "b", "a b"]
    data, at = common.text_bytes(pa.array(parts))
    hashes, first = common.word_hashes(data, at, lm_scoring._FOLD)
    starts, stops, follows, key = lm_scoring.units(data, at, hashes, first)
    raw, seen, told = data.tobytes(), {}, []
    for t, (i, j) in enumerate(zip(at[:-1], at[1:])):
        found = [(m.start() + i, m.end() + i) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw[i:j])]
        for k, (x, y) in enumerate(found):
            ok = k > 0 and found[k - 1][1] + 1 == x
            told.append((x, y, ok))
            if ok:
                seen.setdefault((raw[slice(*found[k - 1])].lower(), raw[x:y], raw[y : y + 1] if y < j else b""), set()).add(int(key[len(told) - 1]))
    assert told == list(zip(starts.tolist(), stops.tolist(), follows.tolist()))
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen) > 5
    # bits give 1/4 to each of four units, counts 3/4 and 1/4 to two of them
    costs, one = np.array([0.0, 0.0, np.log(4), 0.0]), np.array([0, 2])
    p = [np.exp(-lm_scoring.mixed_lengths(costs, np.array([0, 3]), one, one + 1, np.array([False, True]), one, np.array([0, n]), np.array([0, 4])))[0] for n in (3, 1, 0, 0)]
    weight = 0.5 * 4 / 8
    assert p == pytest.approx([weight * n / 4 + (1 - weight) / 4 for n in (3, 1, 0, 0)]) and sum(p) == pytest.approx(1)


def test_lm_learns_from_pairs_beyond_its_tables(spark):
    """Where six bytes don't tell which word stands before, a held-out text of pairs that were seen is still told from others."""
    rng = random.Random(4)
    names = ["".join(rng.choices("abcdefgh", k=5)) + "xxxxxxx" for _ in range(200)]
    seen = [" ".join(names[(k + j) % 200] for j in range(12)) for k in range(200)]
    other = [" ".join(rng.sample(names, 12)) for _ in range(40)]
    rows = [(k, t, False) for k, t in enumerate(seen)] + [(1000 + k, t, True) for k, t in enumerate(seen[:40] + other)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, own boolean").repartition(3)
    held = F.col("doc_id") >= 1000
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scoring(df, held, batch_bytes=4000).collect()}
    assert min(got[1000 + k] for k in range(40)) > 0.6 * max(got[1040 + k] for k in range(40))


def similar_groups():
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for k, w in WORDS.items()}
    links, root = Counter(), {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (find(k), links[k]) for k in sets}


@pytest.mark.parametrize("block_bytes", [3000, 8_000_000])
def test_jaccard_join(docs, empty, block_bytes):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs, block_bytes=block_bytes).collect()}
    want = similar_groups()
    assert got == want and max(n for _, n in want.values()) >= 8
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_jaccard_join_in_blocks_of_few_rows(docs):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs, block_rows=3).collect()}
    assert got == similar_groups()


def brute_groups(rows):
    """(doc_id, class_id, n_links) of each row, and the rows that stay, by loops."""
    sets = []
    for _, t in rows:
        w = re.findall(WORD, t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    close = lambda a, b: bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    n = range(len(rows))
    near = {a: {b for b in n if a != b and close(a, b)} for a in n}
    out, stay, done = [], [], set()
    for a in n:
        group, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - group:
                group.add(b)
                todo.append(b)
        ids = [rows[b][0] for b in group if rows[b][0] is not None]
        out.append((rows[a][0], min(ids, default=None) if near[a] else rows[a][0], len(near[a])))
        if not near[a]:
            stay.append(rows[a])
        elif not group & done:
            done |= group
            stay.append(min((rows[b] for b in group), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())))
    return sorted(out, key=str), sorted(stay, key=str)


def test_jaccard_join_of_repeated_and_null_ids(spark):
    rng = random.Random(8)
    a, b, d, e = (" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(4))
    rows = [(5, a), (5, b), (6, f"{a} x"), (7, f"{b} y"), (5, a), (5, a), (None, d), (None, f"{d} z"), (None, d), (None, e), (3, f"{e} q"), (None, None), (None, None), (9, ""), (1, b), (1, b), (2, "alone here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(n) for n in EXTRA}).repartition(3)
    want, stay = brute_groups(rows)
    for part_rows in (2, 384):
        got = [tuple(r) for r in jaccard_join.jaccard_join(df, part_rows=part_rows).collect()]
        assert sorted(got, key=str) == want
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns and sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == stay


def test_stages_shuffle_no_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (3, f"{text} x"), (4, None), (None, "mail to a@b.org"), (6, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"a b": F.lit(1), "row": F.array(F.lit("r")), "own": F.current_timestamp()})
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        stages = [(jaccard_join.representatives(docs), {1, 4, None, 6}), (decontaminate.decontaminated(docs, bench), {1, 2, 3, 4, None}), (pii.redacted(docs), {1, 2, 3, 4, None, 6})]
        for out, want in stages:
            assert {r["doc_id"] for r in out.collect()} == want and out.schema.simpleString() == docs.schema.simpleString()
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        n = spark.range(1000)
        for picked in ([], list(range(0, 1000, 7)), list(range(1000))):
            some = spark.createDataFrame([(k,) for k in picked], "row bigint")
            for most in (100, 0):
                assert sorted(r["id"] for r in common.among(n, "id", some, True, most).collect()) == picked
                assert sorted(r["id"] for r in common.among(n, "id", some, False, most).collect()) == sorted(set(range(1000)) - set(picked))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def near_copies(rows: int, words: int, edits: int) -> jaccard_join._Block:
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for k in range(rows):
        own = list(base)
        for x in rng.choice(words, rng.integers(0, edits + 1), replace=False):
            own[x] = f"e{k}"
        texts.append(" ".join(own))
    sets, at = jaccard_join.shingles(pa.chunked_array([pa.array(texts)]))
    values = (jaccard_join.minhashes(sets, at) >> np.uint32(16)).astype(np.uint16)
    parts = [sets[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
    return jaccard_join._Block(pa.table({"id": np.arange(rows), "copies": np.ones(rows, np.int64) + np.arange(rows) % 3, "minhash": pa.array([v.tobytes() for v in values], pa.binary()), "shingles": pa.array(parts, pa.binary())}))


@pytest.mark.parametrize("stripe", [1000, 2_000_000])
def test_many_near_copies_are_verified_exactly(monkeypatch, stripe):
    monkeypatch.setattr(jaccard_join, "STRIPE", stripe)
    a, least = near_copies(300, 60, 2), jaccard_join.least_agreeing(0.8, 1e-6)
    sets = [set(x.tolist()) for x in a.sets]
    want = np.array([[len(x & y) >= 0.8 * len(x | y) - 1e-9 for y in sets] for x in sets])
    upper = np.triu(want, 1)
    assert upper.sum() > 20 * 600 and (jaccard_join.links_between(a, a, True, least, 0.8) == upper).all() and not want.all()
    ids, links, _ = jaccard_join._task(a, a, True, least, 0.8)[0]
    assert dict(zip(ids.tolist(), links.tolist())) == {k: int(n) for k, n in enumerate((want & ~np.eye(300, dtype=bool)) @ a.copies) if n}
    _, links, _ = jaccard_join._task(a, a, False, least, 0.8)[0]
    assert links.tolist() == [int(n) for n in want @ a.copies] * 2


def test_memory_of_many_near_copies():
    a, least = near_copies(3000, 60, 1), jaccard_join.least_agreeing(0.8, 1e-6)
    tracemalloc.start()
    jaccard_join._task(a, a, True, least, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # whole matrices of 64-bit numbers take 261 MB


def test_bayesian_bounds():
    least = jaccard_join.least_agreeing(0.8, 1e-6)
    assert list(least) == list(range(20, 201, 20)) and sorted(least.values()) == list(least.values())
    # the posterior's tail by quadrature
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, m in least.items():
        for k, below in ((m - 1, True), (m, False)):
            if k >= 0:
                f = k * np.log(x) + (n - k) * np.log1p(-x)
                f = np.exp(f - f.max())
                assert (f[x >= 0.8].sum() / f.sum() < 1e-6) == below


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101)] + [(200, k) for k in range(201, 260)]
    random.Random(2).shuffle(edges)
    got = {r["id"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100, **{k: 200 for k in range(200, 260)}}


def test_language_id(spark, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_id(real).join(real.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    # calibrated: the mean score is about the accuracy
    assert abs(np.mean([r["score"] for r in out]) - np.mean([r["lang"] == r["lang_pred"] for r in out])) < 0.05
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 % 7", "de"), (4, "the", None), (5, "é" * 5000, None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.language_id(real.select("doc_id", "text", "lang").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10**6))).filter("doc_id > 1000000").collect()}
    assert [got[10**6 + k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[10**6 + 4]["lang_pred"] != "und" and got[10**6 + 1]["score"] == 0
    assert language_id.language_id(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def slow_grams(text: str) -> dict[int, int]:
    out, points = Counter(), [ord(x) for x in text.lower()]
    for n in range(3):
        for i in range(len(points) - n):
            key = 0
            for j in range(n + 1):
                key = (key * 0x01000193 + points[i + j] + j + 1) % 2**32
            out[((key ^ key >> 15) * 2654435761 % 2**32) >> 17] += 1
    return out


def slow_language_id(rows, held):
    """Prediction and score of each text by dictionaries: TF-IDF of n-grams, follow-the-regularised-leader, temperature from the same search."""
    seen = [(k, t, g) for k, t, g in rows if k not in held and t is not None and g is not None]
    grams = {k: slow_grams(t) for k, t, _ in rows if t}
    languages, total = sorted({g for *_, g in seen}), len(seen)
    docs = Counter(x for k, t, _ in seen for x in grams.get(k, ()))
    idf = lambda x: math.log((1 + total) / (1 + docs[x])) + 1

    def features(k):
        v = {x: (1 + math.log(n)) * idf(x) for x, n in grams[k].items()}
        size = math.sqrt(sum(a * a for a in v.values()))
        return {x: a / size for x, a in v.items()}

    def place(k):
        seed = xxhash.xxh64(b"order", seed=42).intdigest()
        h = xxhash.xxh64(int(k).to_bytes(8, "little", signed=True), seed=seed).intdigest()
        return h - 2**64 if h >= 2**63 else h, k

    order = [(languages.index(g), features(k)) for k, t, g in sorted(seen, key=lambda r: place(r[0])) if t]
    learn, tune = [d for i, d in enumerate(order) if i % 5 or len(order) < 10], [d for i, d in enumerate(order) if i % 5 == 0 and len(order) >= 10]
    z, n, w = Counter(), Counter(), Counter()
    logits = lambda f: [sum(a * w[x, c] for x, a in f.items()) for c in range(len(languages))]

    def shares(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    for _ in range(language_id.EPOCHS):
        for label, f in learn:
            p = shares(logits(f))
            for c in range(len(languages)):
                for x, a in f.items():
                    g = a * (p[c] - (c == label))
                    step = (math.sqrt(n[x, c] + g * g) - math.sqrt(n[x, c])) / language_id.ALPHA
                    z[x, c] += g - step * w[x, c]
                    n[x, c] += g * g
            for c in range(len(languages)):
                for x in f:
                    v = z[x, c]
                    w[x, c] = 0 if abs(v) <= language_id.L1 else -(v - math.copysign(language_id.L1, v)) / ((language_id.BETA + math.sqrt(n[x, c])) / language_id.ALPHA + language_id.L2)
    best, least = 1.0, None
    if tune:
        for i in range(6001):
            t = math.exp(-3 + i / 1000)
            loss = -sum(math.log(shares([v / t for v in logits(f)])[label]) for label, f in tune)
            if least is None or loss < least:
                best, least = t, loss
    out = {}
    for k, t, _ in rows:
        if not t or not any(x.isalpha() for x in t):
            out[k] = ("und", 0.0)
        else:
            p = shares([v / best for v in logits(features(k))])
            out[k] = (languages[p.index(max(p))], max(p))
    return out


def test_language_id_against_a_slow_one(spark):
    rng = random.Random(12)
    words = {"en": ["the", "house", "and", "with", "night"], "de": ["das", "Haus", "und", "mit", "nächt"], "fr": ["la", "maison", "avec", "été", "nuit"]}
    rows = [(k, " ".join(rng.choices(words[g], k=rng.randrange(1, 5))), g if rng.random() < 0.9 else rng.choice("xy")) for k, g in enumerate(rng.choices(list(words), k=36))]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 %", None), (103, "maison night", None), (104, "Haus", "en")]
    held = {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    got = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(2)).collect()}
    want = slow_language_id(rows, held)
    assert {k: r["held_out"] for k, r in got.items()} == {k: k in held for k in got} and set(got) == set(want)
    for k, (name, score) in want.items():
        assert got[k]["lang_pred"] == name and got[k]["score"] == pytest.approx(score, abs=0.01), k


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert language_id.temperature(logits * 5, labels) == pytest.approx(5, rel=0.15)


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_warc(spark, chunk):
    pages = [(1, "u", "<p>é</p>" * 9), (2, None, "<p>é</p>" * 9), (3, "a b\r\nc", None), (4, "v", ""), (5, "w", "x" * 3000), (6, "w", "<p>é</p>" * 9)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({n: F.lit(1) for n in EXTRA}).repartition(2)
    table = common.saved(warc.records(df, chunk=chunk))
    got = {r["page_id"]: r for r in warc.read_records(table).collect()}
    first = {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: 1}
    for k, _, html in pages:
        payload = (html or "").encode()
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"], r["record_type"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), first[k], "revisit" if first[k] else "response")
    assert got[3]["url"] == "a%20b%0D%0Ac" and max(len(r["data"]) for r in table.collect()) < 2000
    assert warc.read_records(common.saved(warc.records(df.limit(0)))).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.read_records(common.saved(warc.records(df, min_bytes=1))).collect()}
    assert small[4] == "response" and small[2] == "revisit"


def test_warc_finds_damage(spark):
    df = spark.createDataFrame([(1, "u", "abc" * 40)], "page_id bigint, url string, html string")
    rows = warc.records(df, chunk=10).collect()
    good = spark.createDataFrame(rows, warc.TABLE)
    assert warc.read_records(good).count() == 1
    for bad in (good.filter("chunk_no <> 3"), good.filter("chunk_no < 11"), good.withColumn("running_sha1", F.when(F.col("chunk_no") == 2, "00").otherwise(F.col("running_sha1")))):
        with pytest.raises(Exception, match="missing|cut short|damaged"):
            warc.read_records(bad).collect()


def test_warc_of_repeated_pages(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (1, "u", "abc"), (1, "u", "d"), (2, "u", "abc")], "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_records(common.saved(warc.records(df))).collect() if r["record_type"] == "revisit")
    assert got == [(1, 3, "revisit", 1), (2, 3, "revisit", 1)]


def test_warc_of_repeated_and_null_pages(spark):
    pages = [(1, "u", "abc"), (1, "u", "abc"), (1, "t", "abc"), (1, "u", "d"), (2, "u", "abc"), (None, "u", "abc"), (None, "u", "abc"), (None, "v", "only"), (None, "w", "only"), (None, None, None), (3, "u", ""), (4, "u", "x" * 25), (4, "u", "x" * 25)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({n: F.lit(1) for n in EXTRA}).repartition(3)
    for least in (0, 4):
        table = common.saved(warc.records(df, min_bytes=least, chunk=10))
        got = [(r["page_id"], r["payload_bytes"], r["url"], r["record_type"], r["refers_to"]) for r in warc.read_records(table).collect()]
        want, first = [], {}
        for p, u, h in sorted(pages, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            h = h or ""
            revisit = len(h) >= least and h in first
            want.append((p, len(h), u or "", "revisit" if revisit else "response", first[h] if revisit else None))
            first.setdefault(h, p)
        assert sorted(got, key=str) == sorted(want, key=str)
        heads = [zlib.decompressobj(31).decompress(r["data"]).decode() for r in table.filter("chunk_no = 0").collect()]
        ids = [re.search("WARC-Record-ID: (.*)\r", x)[1] for x in heads]
        assert len({*ids}) == len(pages) and {re.search("WARC-Refers-To: (.*)\r", x)[1] for x in heads if "Refers-To:" in x} < {*ids}


def test_decontaminate(spark, docs, empty):
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(x.lower() if "A" <= x <= "Z" else x for x in t or ""))
    items = [(1, BY_ID[100][-300:]), (2, BY_ID[5].upper()), (3, "One two!"), (4, None), (5, "..."), (6, BY_ID[5].upper()), (7, " ".join(f"Word{i}" for i in range(11, 40)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("size", F.lit(1))
    windows = {}
    for k, t in items:
        w = alnum(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    want = {}
    for k, t in texts():
        w, hit, found = alnum(t), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        want[k] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    for most in (10**6, 0):  # broadcast, and by a shuffle
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.report(docs, bench, most_broadcast=most).collect()}
        assert got == want
    assert sum(x[3] for x in want.values()) >= 5
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, x in want.items() if not x[3]}
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs, bench, "spans").collect()}
    for k, t in texts():
        assert spans[k] == t if not want[k][1] else len(alnum(spans[k])) == want[k][0] - want[k][1]
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_of_repeated_and_null_ids(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, "a b c")], "item_id bigint, text string")
    rows = [(1, "one two"), (1, "x one two y"), (1, "x one two y"), (None, "one two"), (None, "none of it"), (None, None), (2, "A b c " * 3), (2, "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = [(1, 2, 2, True), (1, 4, 2, True), (1, 4, 2, True), (2, 1, 0, False), (2, 9, 9, True), (None, 0, 0, False), (None, 2, 2, True), (None, 3, 0, False)]
    for most in (10**6, 0):
        got = [tuple(r) for r in decontaminate.report(df, bench, most_broadcast=most).select("doc_id", "n_words", "n_hit", "contaminated").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(str(r["text"]) for r in decontaminate.decontaminated(df, bench).collect()) == ["None", "none of it", "q"]
    spans = [str(r["text"]) for r in decontaminate.decontaminated(df, bench, "spans").collect()]
    assert sorted(spans) == sorted([" ", "x   y", "x   y", " ", "none of it", "None", " " * 9, "q"])


def timed(f):
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


def test_decontamination_of_long_texts_is_linear(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id bigint, text string")
    long = lambda n: spark.createDataFrame([(1, " ".join(f"w{i % 5000}" for i in range(n)))], "doc_id bigint, text string")
    run = lambda n: timed(lambda: decontaminate.report(long(n), bench).collect())
    run(1000)
    assert decontaminate.report(long(120_000), bench).first()["n_hit"] == 24 * 40
    assert run(240_000) < 6 * run(60_000) + 5
    gone = decontaminate.decontaminated(long(120_000), bench, "spans").first()["text"]
    assert len(gone.split()) == 120_000 - 24 * 40 and "w39 " not in gone


def test_case_of_words_beyond_ascii(spark):
    bench = spark.createDataFrame([(1, "É ÀB ß")], "item_id bigint, text string")
    rows = spark.createDataFrame([(1, "x É àb ß"), (2, "É Àb ß y"), (3, "é Àb ß")], "doc_id bigint, text string")
    assert [r["n_hit"] for r in decontaminate.report(rows, bench).orderBy("doc_id").collect()] == [0, 3, 0]


def test_spotsigs(docs, empty, monkeypatch):
    anchors = set(spotsigs.ANCHORS)
    rows = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.regexp_replace("text", "Word(.)", "the fox$1 runs ")).alias("text")).cache()
    t = {r["doc_id"]: r["text"] or "" for r in rows.collect()}

    def signatures(x):
        w, out = regex.findall(r"[\p{L}\p{N}]+", x.lower()), set()
        for i, a in enumerate(w):
            chain = [y for y in w[i + 1 : i + 1 + spotsigs.REACH] if y not in anchors][: spotsigs.CHAIN]
            if a in anchors and len(chain) == spotsigs.CHAIN:
                out.add((a, *chain))
        return out or {x}

    near = lambda a, b: len(a & b) / len(a | b)
    ids = sorted(t, reverse=True)
    monkeypatch.setattr(spotsigs.neighbours, "__defaults__", (9,))
    got = {r["doc_id"]: r for r in spotsigs.spotsigs(rows).withColumns({"near_edited": spotsigs.likeness(F.col("found"), F.col("edited_found")), "near_next": spotsigs.likeness(F.col("found"), F.col("next_found")), "similar_next": spotsigs.similar(F.col("found"), F.col("next_found"))}).collect()}
    assert set(got) == set(ids)
    for i, k in enumerate(ids):
        x, after = t[k], t[ids[(i + 1) % len(ids)]]
        half = len(x) // 2
        edited = x[: len(x) - half] + after[:half]
        assert (got[k]["n_chars"], got[k]["edited"]) == (len(x), edited)
        assert got[k]["near_edited"] == pytest.approx(near(signatures(x), signatures(edited)))
        assert got[k]["near_next"] == pytest.approx(near(signatures(x), signatures(after)))
        assert got[k]["similar_next"] == (near(signatures(x), signatures(after)) >= spotsigs.THRESHOLD)
    assert got[300]["found"] == got[3]["found"] and spotsigs.spotsigs(empty).count() == 0


@pytest.mark.parametrize("most_equal", [1000, 3])
def test_spotsigs_of_null_and_repeated_ids(spark, monkeypatch, most_equal):
    monkeypatch.setattr(common, "MOST_EQUAL", most_equal)
    rows = [(None, f"t{k}") for k in range(9)] + [(None, None)] * 5 + [(7, f"s{k % 5}") for k in range(20)] + [(-(1 << 63), "low"), ((1 << 63) - 1, "high"), (0, ""), (3, "😀é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(n) for n in EXTRA}).repartition(3)
    hashed = lambda t: (xxhash.xxh64((t or "").encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1])))
    want = [(r[0], r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)]
    for size in (4, 5000):
        prepared = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        got = [(r["doc_id"], r["text"], r["next_text"]) for r in spotsigs.neighbours(prepared, ["text"], size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert spotsigs.spotsigs(df.filter("doc_id is null")).count() == 14 and spotsigs.spotsigs(df.limit(1)).first()["edited"] is not None


def test_ranks_of_many_bounds(spark):
    bounds = sorted({f"{x:06}" for x in random.Random(1).sample(range(10**6), 5000)})
    keys = [f"{x:06}" for x in random.Random(2).sample(range(10**6), 300)] + bounds[:3] + bounds[-3:]
    got = {r["k"]: r["n"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", spotsigs._rank(F.col("k"), bounds).alias("n")).collect()}
    assert got == {k: bisect.bisect_right(bounds, k) for k in keys}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(n - 9 * (n > 9) for i, x in enumerate(reversed(digits)) for n in [int(x) * (1 + i % 2)]) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_pii_base(spark, docs, empty):
    rng = random.Random(5)
    odd = ["a+b@x c_d@e.f@g.h.i", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", "é😀 4111 1111-1111 1111 +1 (017) 555-7713.", "9" * 20000, "a" * 20000 + "@", "a." * 9000 + "@b.c", "x@" + "a." * 9000 + "b", None, "", "4111111111111111@a.b 1-1 1  1"]
    odd += ["".join(rng.choices("ab@.-+ 0123456789()%_é", k=60)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["b"] for r in pii.find(rows).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()}
    for k, t in enumerate(odd):
        assert got[k] == ",".join(f"{n}:{m.start()}:{m.end()}" for n, p in BASE.items() for m in re.finditer(p, t or "") if valid(n, m.group())), t
    assert pii.find(empty).count() == 0 and pii.find(docs).count() == docs.count()


def test_pii_bootstrapping(spark):
    emails = [(k, f"hello, write to user{k}@mail.example soon") for k in range(8)]
    unseen = [(50, "hello, write to member_4711 soon"), (51, "later member_4711, alone"), (52, "nothing 4711 here")]
    noise = [(100 + k, f"we saw number {k}77 of {k}") for k in range(9)]
    rows = pii.find(spark.createDataFrame(emails + unseen + noise, "doc_id bigint, text string"), confidence=0.8)
    got = {r["doc_id"]: [(s["kind"], s["value"], s["start"]) for s in r["added"]] for r in rows.collect()}
    assert got[50] == [(0, "member_4711", 16)] and got[51] == [(0, "member_4711", 6)]
    assert not any(v for k, v in got.items() if k not in (50, 51))
    out = pii.redacted(spark.createDataFrame(emails[:1] + [(9, "+1 (017) 555-7713x 1.2.3.4 1.2.3.4"), (10, None)], "doc_id bigint, text string").withColumn("base", F.lit(1)))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "hello, write to [EMAIL] soon", 9: "[PHONE]x [IP] [IP]", 10: None}


@pytest.mark.parametrize("seeds,unseen", [(8, 1), (100, 12), (20, 20)])
def test_pii_bootstrapping_with_its_defaults(spark, seeds, unseen):
    rows = [f"hello, write to user{k}@mail.example soon" for k in range(seeds)] + [f"hello, write to member_{k} soon" for k in range(unseen)]
    want = {seeds + k: [(0, f"member_{k}", 16)] for k in range(unseen)}
    # no pattern: values of two kinds, and a few seeds among many other values
    rows += [f"see under name{k}@mail.example" for k in range(8)] + [f"see under 10.0.0.{k}" for k in range(8)] + ["see under code_9"]
    rows += [f"about the box{k}@mail.example" for k in range(6)] + [f"about the {k}th" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["kind"], s["value"], s["start"]) for s in r["added"]] for r in pii.find(df).filter("size(added) > 0").collect()}
    assert got == want
    assert {r["text"] for r in pii.redacted(df).filter(F.col("doc_id").isin(list(want))).collect()} == {"hello, write to [EMAIL] soon"}


def bootstrapped(rows, support=5, confidence=0.9):
    """Added (kind, start, value) of each text, slowly: lists and loops over patterns made of the words around each mention."""
    every = {**BASE, "secret": pii.SECRET.replace("*+", "*")}
    mentions = []  # row, kind or None, start, stop, value, patterns
    for r, t in enumerate(rows):
        spans = [(k, m.start(), m.end()) for k, (n, p) in enumerate(every.items()) for m in re.finditer(p, t) if valid(n, m.group())]
        spans = [s for s in spans if s[0] < 4 or not any(b[0] < 4 and b[1] < s[2] and s[1] < b[2] for b in spans)]
        for m in re.finditer(r"(?<!\S)[^\s0-9]*[0-9]\S*", t):
            i, j = m.span()
            while not t[i].isalnum():
                i += 1
            while not t[j - 1].isalnum():
                j -= 1
            if not any(b[1] < j and i < b[2] for b in spans):
                spans.append((None, i, j))
        for k, i, j in spans:
            left = re.sub(r"[^\s\w]+$|_+$", "", t[:i]).lower().split()
            right = re.sub(r"^[^\s\w]+", "", t[j:]).lower().split()
            every_p = [("<", *left[-1:]), ("<<", *left[-2:]), (">", *right[:1]), (">>", *right[:2]), ("<>", *left[-1:], *right[:1])]
            p = [x for x in every_p if len(x) == 1 + (x[0] in ("<<", ">>", "<>")) + 1]
            mentions.append((r, k, i, j, t[i:j], p))
    known, out = {}, {}
    for m in mentions:
        if m[1] is not None:
            known.setdefault(m[4], set()).add(m[1])
    seeds = set(known)
    while True:
        values = {}
        for m in mentions:
            for p in m[5]:
                values.setdefault(p, set()).add(m[4])
        trusted = {}
        for p, vs in values.items():
            n, k = max((sum(j in known.get(v, ()) for v in vs), -j) for j in range(5))
            weight = sum(v in known for v in vs) + 0.1 * sum(v not in known for v in vs)
            if n >= support and n >= confidence * weight:
                trusted[p] = (n / weight, -k)
        new = {}
        for m in mentions:
            if m[4] not in known:
                for p in m[5]:
                    if p in trusted:
                        new[m[4]] = max(new.get(m[4], (0, 0)), trusted[p])
        if not new:
            break
        known |= {v: {k} for v, (_, k) in new.items()}
    for m in mentions:
        if m[1] == 4 or (m[1] is None and m[4] in known and m[4] not in seeds):
            out.setdefault(m[0], []).append((4 if m[1] == 4 else min(known[m[4]]), m[2], m[4]))
    return {r: sorted(v) for r, v in out.items()}


def test_pii_against_brute_force(spark):
    rng = random.Random(11)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(9)]
    rows = [f'set token = "{h}" then go on' for h in hexes] + [f'set TOKEN = "{h.upper()}!" then x{k}' for k, h in enumerate(hexes[:3])]
    rows += [f"mail me at u{k}@a.example today please" for k in range(8)] + [f"mail me at id{k}4 today please" for k in range(3)]
    # a chain: values that the second round knows are the seeds of a pattern that only the third trusts
    rows += [f"reach id{k % 3}4 via desk{k}7 of it" for k in range(4)] + [f"mail me at q{k}9 today" for k in range(6)] + [f"from q{k}9 onwards yes" for k in range(6)]
    rows += ["from zz5 onwards yes", "from zz6 onwards yes", "by zz5 alone", "1.2.3.4, 5.6.7.8; +1 (017) 555-7713 a1 b2 c3", ""]
    rows += [" ".join(rng.choices(["at", "token", "=", "7x", "u1@a.example", "10.0.0.1", "(8)", "id04", "x", "\n"], k=30)) for _ in range(30)]
    got = {}
    for r in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).filter("size(added) > 0").collect():
        got[r["doc_id"]] = [(s["kind"], s["start"], s["value"]) for s in r["added"]]
    want = bootstrapped(rows)
    assert got == want and {v for x in want.values() for _, _, v in x} >= {hexes[0].upper(), "id04", "q09", "zz5"}


def test_pii_of_many_matches_is_linear(spark):
    long = lambda n: spark.createDataFrame([(1, " ".join(f"u{k}@mail.example id {k}" for k in range(n)))], "doc_id bigint, text string")
    found = pii.find(long(20_000)).first()
    assert len(found["base"]) == 20_000 and found["added"] == []
    assert [s["start"] for s in found["base"][:3]] == [0, 21, 42]
    run = lambda n: timed(lambda: pii.redacted(long(n)).collect())
    run(100)
    assert pii.redacted(long(20_000)).first()["text"] == " ".join(f"[EMAIL] id {k}" for k in range(20_000))
    assert run(40_000) < 6 * run(10_000) + 5


def test_mixing(spark, docs, empty):
    cells = spark.createDataFrame([(s, g, t, w) for s, g, t, w in (("a", "en", "p", 600), ("a", "de", "p", 100), ("b", "en", "q", 50), ("b", "de", "p", 250), ("c", "en", "p", 0))], "source string, lang string, topic string, words bigint")
    targets = {"source": {"a": 0.5, "b": 0.5, "none": 9}, "lang": {"en": 0.4, "de": 0.6}, "topic": {"p": 0.8, "q": 0.2}}
    targets["source"].pop("none")
    out = mixing.fitted(cells, targets, sweeps=60).collect()
    share = lambda d, v: sum(r["ratio"] * r["words"] for r in out if r[d] == v) / 1000
    for d, want in targets.items():
        for v, x in want.items():
            assert share(d, v) == pytest.approx(x, abs=1e-3)
    got = mixing.mixed(docs, keep=0.7)
    # docs has columns of the same names
    assert got.columns == [*docs.columns, "topic_", "expected_", "copies_"] and all(r["copies_"] >= 1 and abs(r["copies_"] - r["expected_"]) < 1 and r["topic"] == "topic" for r in got.collect())
    got = common.saved(got)
    assert got.count() and mixing.mixed(empty).count() == 0


def test_mixing_goes_on_until_it_fits(spark, caplog):
    """Against a loop; targets that can't all be met end with a warning."""
    rng = random.Random(7)
    cells = [(s, g, t, rng.randrange(1, 10 ** rng.randrange(1, 6))) for s in "abcd" for g in "xyz" for t in "pq" if rng.random() < 0.7]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, words bigint")
    share = {x[:3]: float(x[3]) for x in cells}
    for _ in range(400):
        for d in range(3):
            want, total = Counter(), Counter()
            for x in cells:
                want[x[d]] += x[3]
                total[x[d]] += share[x[:3]]
            norm = sum(v**0.5 for v in want.values())
            share = {k: v * want[k[d]] ** 0.5 / norm / total[k[d]] for k, v in share.items()}
    words = sum(x[3] for x in cells)
    got = {(r["source"], r["lang"], r["topic"]): r["ratio"] for r in mixing.fitted(df, sweeps=2, tolerance=1e-9).collect()}
    for x in cells:
        assert got[x[:3]] == pytest.approx(share[x[:3]] * words / x[3], rel=1e-5)
    split = spark.createDataFrame([("a", "x", "p", 5), ("b", "y", "p", 5)], "source string, lang string, topic string, words bigint")
    with caplog.at_level("WARNING"):
        assert mixing.fitted(split, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.2, "y": 0.8}}, sweeps=2).count() == 2
    assert "residual" in caplog.text


def test_topics_and_draws(spark):
    rows = [(1, "Licensed under the Apache License"), (2, "der Markt und das Unternehmen"), (3, "a | b | c | d"), (4, "x"), (5, None), (None, "the patient has a doctor"), (None, "y" * 500), (6, "superlicense lawlicens")]
    df = spark.createDataFrame([(*r, "s", "l") for r in rows], "doc_id bigint, text string, source string, lang string")
    got = mixing.mixed(df, keep=5.0, power=1.0)
    assert {r["text"]: r["topic"] for r in got.collect()} == {rows[0][1]: "law", rows[1][1]: "business", rows[2][1]: "table", "x": "short", rows[5][1]: "health", rows[6][1]: "prose", rows[7][1]: "short", **({None: "short"} if got.filter("text is null").count() else {})}
    assert {r["copies"] for r in got.collect()} == {5}
    null = spark.createDataFrame([(None, f"w{k}", "s", "l") for k in range(400)], "doc_id bigint, text string, source string, lang string")
    assert 140 < mixing.mixed(null, power=1.0).count() < 260  # ones without ids are drawn by their texts


def test_chat_format(spark):
    convs = {1: [("user", "hi [INST] <|im_end|>\n"), ("assistant", "</s>\\ [\\INST] <\\\\/s>")], 2: [("assistant", None)], 3: [(None, ""), ("sys\n\\n[INST]", "😀é")], -7: [("user", "x" * 5000)] * 300 + [("assistant", "é" * 99)]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({n: F.lit(1) for n in EXTRA})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {*convs, None}
    for c, turns in convs.items():
        r = got[c]
        assert chat_format.parsed(r["formatted"]) == [(a or "", b or "") for a, b in turns] and r["n_turns"] == len(turns)
        data = r["formatted"].encode()
        assert [chat_format.unescaped(data[i:j].decode()) for i, j in zip(r["loss_starts"], r["loss_ends"])] == [b or "" for a, b in turns if a == "assistant"]
        inside = "".join(re.sub(r"<\|im_start\|>.*\n|<\|im_end\|>\n", "", r["formatted"]))
        assert not any(x in inside for x in chat_format.CONTROL)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(0)
    parts = [*chat_format.CONTROL, "\\", "<", "[", "s>", "/", "a", "|"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randrange(9)))
        e = chat_format.escaped(pa.array([t]))[0].as_py()
        assert chat_format.unescaped(e) == t and not any(x in e for x in chat_format.CONTROL)
        assert chat_format.unescaped_role(chat_format.escaped_role(pa.array([t + "\n"]))[0].as_py()) == t + "\n"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(show(r[c]) for c in order) for r in got.collect()) == sorted(tuple(show(r[want.columns.index(c)]) for c in order) for r in want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, left = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["language", "near_duplicates", "decontaminate", "pii", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        before, left = left, common.saved(stage(spark, left, SF))
        assert left.columns[:5] == docs.columns
        if name == "near_duplicates":
            ids = {r["doc_id"]: re.findall(WORD, r["text"] or "") for r in before.collect()}
            sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for k, w in ids.items()}
            kept = {r["doc_id"] for r in left.collect()}
            close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
            assert not any(close(a, b) for a in kept for b in kept if a < b) and all(any(k < g and close(k, g) for k in ids) for g in set(ids) - kept)
        if name == "pii":
            assert not any(re.search(BASE["email"], r["text"]) for r in left.collect())
    assert corpus_pipeline.run(spark, SF).count() == left.count()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Planted cases, with repeated and null ids: what each stage keeps and changes is what loops over its input say."""
    rng = random.Random(21)
    vocabulary = {"en": "the house and with night over rivers small green".split(), "de": "das haus und mit nacht über fluss klein grün".split()}
    text = lambda g, n: " ".join(rng.choices(vocabulary[g], k=n)) + f" {rng.randrange(10**6)}x"
    rows = [(k, text(g, rng.randrange(20, 60)), g, f"s{k % 3}") for k, g in enumerate(rng.choices(["en", "de"], k=60))]
    rows += [(200, f"{rows[0][1]} tail", "en", "s0"), (5, rows[1][1], "en", "s1"), (None, rows[2][1], "de", "s1"), (None, text("en", 30), "en", None), (7, text("de", 30), None, "s2")]
    item = text("en", 20)
    rows += [(300, f"{item} and more", "en", "s0"), (301, f"write to a{1}@b.example or 10.0.0.1 {text('en', 25)}", "en", "s1"), (302, None, "en", "s1"), (303, "", "de", "s1"), (304, "99 %", "en", "s2")]
    rows += [(400 + k, f"mail me at u{k}@a.example today {text('en', 30)}", "en", "s0") for k in range(7)] + [(410, f"mail me at id77 today {text('en', 30)}", "en", "s0")]
    folder = f"{tmp_path}/sf"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    left, names = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in left.collect()]
        left = common.saved(stage(spark, left, folder))
        after = sorted([tuple(r) for r in left.collect()], key=str)
        names.append(name)
        if name == "language":
            # of rows with ids of their own, all that a slow model tells apart stay; the others are those without a letter
            assert sorted(before, key=str) == sorted([*after, *(r for r in before if r[1] in (None, "", "99 %"))], key=str)
        elif name == "near_duplicates":
            assert sorted([(r[0], r[1]) for r in after], key=str) == brute_groups([(r[0], r[1]) for r in before])[1]
        elif name == "decontaminate":
            grams = {tuple(alnum(item)[i : i + 13]) for i in range(len(alnum(item)) - 12)}

            def bad(t):
                w, hit = alnum(t), set()
                for i in range(len(w) - 12):
                    hit |= set(range(i, i + 13)) if tuple(w[i : i + 13]) in grams else set()
                return hit and 20 * len(hit) >= len(w)

            assert after == sorted([r for r in before if not bad(r[1])], key=str) and len(after) < len(before)
        elif name == "pii":
            texts_ = [r[1] for r in before]
            added, want = bootstrapped(texts_), []
            for i, r in enumerate(before):
                spans = [(m.start(), m.end(), n) for n, p in BASE.items() for m in re.finditer(p, r[1]) if valid(n, m.group())]
                spans = sorted(spans + [(a, a + len(v), pii.KINDS[k]) for k, a, v in added.get(i, [])], key=lambda x: (x[0], -x[1]))
                out, at = "", 0
                for a, b, n in spans:
                    out += f"{r[1][at:a]}[{n.upper()}]" if a >= at else ""
                    at = max(at, b)
                out += r[1][at:]
                want.append((r[0], out, r[2], r[3], len(out)))
            assert after == sorted(want, key=str) and any("at [EMAIL] today" in r[1] and r[0] == 410 for r in after)
        else:
            duck = duckdb.connect()
            spark.createDataFrame(before, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/last")
            duck.sql(f"create view documents as select * from '{tmp_path}/last/*.parquet'")
            want = duck.sql(mixing.SQL["op7_mix_sources"]).fetchall()
            got = left.select("doc_id", "source", "lang", "topic", F.round("expected", 4), "copies").collect()
            assert sorted(map(str, map(tuple, got))) == sorted(str((*w[:4], round(w[4], 4), w[5])) for w in want)
    assert names == ["language", "near_duplicates", "decontaminate", "pii", "mix"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == 0


def test_redaction_of_repeated_and_null_ids(spark):
    rows = [(1, "a@b.cd is here"), (1, "nothing"), (1, "ring +49 30 1234567 now"), (None, "at x@y.zz"), (None, None), (None, "10.0.0.1 up")]
    got = [r["text"] for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(["[EMAIL] is here", "nothing", "ring [PHONE] now", "at [EMAIL]", "None", "[IP] up"])
