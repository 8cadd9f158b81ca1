"""Ranked search, whitening and mixing on odd rows and empty tables, against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.llm import mixing, ranked, whitening

# ---------------------------------------------------------------------------- 11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(CAPITALS))


def best_documents(docs, items, k):
    """item_id: [(score, doc_id)], every document scored in plain Python."""
    words = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(words), sum(sum(c.values()) for _, c in words)
    df = collections.Counter(t for _, c in words for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = {}
    for item, want in asked.items():
        scored = []
        for i, c in words:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in want if t in c)
            if score > 0:
                scored.append((score, i))
        out[item] = sorted(scored, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:k]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        out[r["item_id"]].append((r["score"], r["doc_id"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@pytest.mark.parametrize("s", [ranked.Settings(), ranked.Settings(k=3, postings_a_shard=40, terms_a_block=12, frontier=50, merges=2)])
def test_ranked_search(spark, odd_docs, no_docs, s):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    some = docs[6][1].split()
    items = [(1, " ".join(some[:30])), (2, docs[0][1]), (3, None), (4, "!?"), (5, "notaword"), (None, "One, TWO"), (6, "three"), (6, "two"), (7, "A b c é " + docs[9][1][:2000])]
    asked = spark.createDataFrame([(*x, "extra", "extra") for x in items], "item_id long, text string, term string, item string")
    got = found(ranked.rank(odd_docs, asked, s))
    want = {i: x for i, x in best_documents(docs, items, s.k).items() if x}
    assert got == want and len(want) == 5
    assert ranked.rank(no_docs, asked, s).count() == 0 and ranked.rank(odd_docs, asked.where("false"), s).count() == 0


def test_ranked_search_with_ties_and_common_terms(spark):
    rng = random.Random(4)
    vocab = [f"t{k}" for k in range(80)]
    docs = [(rng.randrange(300), " ".join(rng.choice(vocab[: rng.choice([3, 20, 80])]) for _ in range(rng.randint(0, 30)))) for _ in range(500)]
    docs += [(k, "t1 t2 T3 copy") for k in range(400, 600)] + [(-5, "copy"), (None, "copy")]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for k in range(30)] + [(99, "copy t2")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for s in (ranked.Settings(), ranked.Settings(k=7, postings_a_shard=300, frontier=500)):
        assert found(ranked.rank(df, asked, s)) == {i: x for i, x in best_documents(docs, items, s.k).items() if x}


def test_treaps_are_in_order_and_heaps():
    rng = np.random.default_rng(2)
    sizes = [1, 2, 7, 100, 1, 3]
    end = np.cumsum(sizes)
    first = end - sizes
    priority = (rng.integers(0, 5, end[-1]) << 32) | ranked.scrambled(int(end[-1])).astype(np.int64)
    roots, lower, higher = ranked.links(priority, first, end)

    def walk(node, above):
        if node < 0:
            return []
        assert priority[node] <= above
        return [*walk(lower[node], priority[node]), node, *walk(higher[node], priority[node])]

    for r, a, b in zip(roots, first, end, strict=True):
        assert walk(r, np.iinfo(np.int64).max) == list(range(a, b))


def test_traversal_prunes_what_cannot_enter():
    n = 20_000
    rng = np.random.default_rng(3)
    impact = rng.integers(1, 1000, n)
    impact[[5, 700]] = 50_000
    first, end = np.array([0]), np.array([n])
    roots, lower, higher = ranked.links((impact << 32) | ranked.scrambled(n).astype(np.int64), first, end)
    looked = []
    plain = ranked.topmost
    try:
        ranked.topmost = lambda node, *rest: (looked.append(len(node)), plain(node, *rest))[1]
        item, doc, score = ranked.traverse((np.array([0]), roots, np.array([2])), (np.arange(n, dtype=np.int32), impact, lower, higher), 1, 2)
    finally:
        ranked.topmost = plain
    assert doc.tolist() == [5, 700] and score.tolist() == [100_000, 100_000] and sum(looked) < 100


# ---------------------------------------------------------------------------- 12


def whitened_by_numpy(vectors, m=8):
    """(usable rows, n, deviations, whitened, explained) with numpy's own decomposition."""
    good = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = collections.Counter(map(len, good))
    d = max(lengths, key=lambda k: (lengths[k], k))
    good = [[int(math.floor(1024 * c)) + 100_000 for c in v] for v in good if len(v) == d]
    n, sums = len(good), [sum(col) for col in zip(*good, strict=True)]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)) for v in good]
    c = np.array([[x - s / n for x, s in zip(v, sums, strict=True)] for v in good])
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:m]
    return n, deviation, c @ vectors_[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check_whitening(rows, got, m=8):
    ids = [i for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v) == 12]
    n, deviation, w, explained = whitened_by_numpy([v for _, v in rows], m)
    by = collections.defaultdict(dict)
    for r in got:
        by[r["vec_id"], r["deviation"]].setdefault(r["component"], []).append(r)
    assert len(got) == n * m and n == len(ids)
    sign = {}
    for i, dev, row in zip(ids, deviation, w, strict=True):
        for k in range(m):
            r = by[i, dev][k + 1][0]
            sign.setdefault(k, math.copysign(1, r["whitened"] * row[k]))
            assert abs(r["whitened"] * sign[k] - row[k]) < 1e-8 and abs(r["explained"] / explained[k] - 1) < 1e-9 and r["n"] == n
    assert got[0]["identity_error"] < 1e-10


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(700, 12)) @ np.diag(np.linspace(1, 0.05, 12)) + 3).astype(np.float32)
    rows = [*enumerate(base.tolist()), (3, base[3].tolist()), (None, base[4].tolist())]
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [1.0] * 11 + [float("inf")]), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "extra") for i, v in rows + odd], "vec_id long, embedding array<float>, component string")
    check_whitening(rows, whitening.whiten(df).collect())
    small = whitening.Settings(block_bytes=1, fan=2)
    check_whitening(rows, whitening.whiten(df.repartition(7), small).collect())
    assert whitening.whiten(df.where("false")).count() == 0 and whitening.whiten(df.where("vec_id = 904")).count() == 0


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(k, [1.0, float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 and r["identity_error"] < 1e-12 for r in got)
    alone = whitening.whiten(df.where("vec_id = 4")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, None, None)] * 3


def test_whitening_of_large_entries(spark):
    rows = [(k, [1e12 * (k % 3), 1e300 * (k % 2), float(k)]) for k in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 18 and all(r["deviation"] is None for r in got)
    few = [(k, [3e6 * k, 1.0 * k]) for k in range(5)]
    n, deviation, *_ = whitened_by_numpy([v for _, v in few], 2)
    got = whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {k: x if x < 1 << 63 else None for k, x in enumerate(deviation)}


def test_rotations_against_numpy():
    rng = np.random.default_rng(6)
    for d in (1, 2, 3, 8, 33):
        a = rng.normal(size=(3 * d, d)) @ np.diag(10.0 ** -rng.integers(0, 6, d))
        size, v = whitening.jacobi(whitening.folded(None, a))
        assert np.allclose(size, np.linalg.svd(a)[1], rtol=1e-11, atol=0) and np.abs(v.T @ v - np.eye(d)).max() < 1e-13
        pairs = [(int(p), int(q)) for ps, qs in whitening.rounds(d) for p, q in zip(ps, qs, strict=True)]
        assert sorted(pairs) == [(p, q) for p in range(d) for q in range(p + 1, d)]
        assert all(len({*ps.tolist(), *qs.tolist()}) == 2 * len(ps) for ps, qs in whitening.rounds(d))


# ---------------------------------------------------------------------------- 13


def mixed(rows):
    """Counter of (doc_id, size, source_size, target, taken) in plain Python: water level by trial, cuts by sorting."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = collections.Counter()
    for _, t, source in rows:
        words[source] += size(t)
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        left, open_ = 1.5 * sum(words.values()) - 2 * sum(words[s] for s in full), sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * left > 2 * words[s] * open_}
        if not more:
            break
        full |= more
    target = {s: 2.0 * words[s] if s in full or not words[s] else left * weight[s] / open_ for s in order}
    out = collections.Counter()
    for s in order:
        name = lambda i, t: f"{'' if i is None else i}|{t or ''}".encode()
        docs = sorted(((int(hashlib.md5(name(i, t)).hexdigest()[:15], 16), size(t), i) for i, t, x in rows if x == s), key=lambda d: d[:2])
        copies = int(target[s] // words[s]) if words[s] else 0
        rest, run = target[s] - copies * words[s], 0
        for _, n, i in docs:
            extra = words[s] > 0 and 2 * run + n < 2 * rest
            run += n
            out[i, n, words[s], target[s], n * (copies + extra)] += 1
    return out


def plan(df, s=mixing.Settings()):
    return collections.Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(df, s).collect())


def test_mixing(spark, odd_docs, no_docs):
    rng = random.Random(7)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "b", "b", "B", "", "ä", None])) for k in range(600)]
    rows += [(None, "x y z", "hot")] * 900 + [(7, "x y z", "hot"), (8, " \n\t ", "blank"), (9, None, "blank"), (10, "one " * 5000, "b"), (11, "no break\x1cand space", "one")]
    df = spark.createDataFrame([(*r, "extra", "extra") for r in rows], "doc_id long, text string, source string, row string, hash string")
    want = mixed(rows)
    for s in (mixing.Settings(), mixing.Settings(digit_bits=5, few_sources=0)):
        assert plan(df, s) == want
    assert plan(df.repartition(5)) == want
    words = collections.Counter()
    for (_, _, source, target, taken), n in want.items():
        words[source, target] += n * taken
    assert all(abs(taken - target) <= max(0.02 * target, 2500) for (_, target), taken in words.items())
    assert mixing.mix(no_docs).count() == 0
    odd = mixing.mix(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("taken > 2 * size").count() == 0
    whole = mixing.mixture(df)
    assert whole.columns == df.columns
    told = {r["doc_id"]: r["n"] for r in whole.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    taken = collections.Counter()
    for (i, _, _, _, x), n in want.items():
        taken[i] += n * x
    assert {i: n for i, n in told.items() if n} == {i: n for i, n in taken.items() if n}


def test_equal_sources_and_none(spark):
    rows = [(k, "a b", None) for k in range(10)]
    assert plan(spark.createDataFrame(rows, "doc_id long, text string, source string")) == mixed(rows)
    rows = [(k, "", str(k % 2)) for k in range(4)]
    assert plan(spark.createDataFrame(rows, "doc_id long, text string, source string")) == mixed(rows)
