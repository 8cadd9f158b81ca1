"""Each operator on odd rows and empty tables, against brute force or an exact round trip."""

import base64
import collections
import hashlib
import zlib
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reportlake.llm import bpe, decontaminate, frames, lines, near_vectors, ngram_join, sharding, suffixes, tokens, toxicity, warc, word_arrays
from reportlake.llm.common import components

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.read_vocabulary(spark, PATH)


def documents(df):
    """(doc_id, text) in the order of the operators: null first, ties by a hash of the text."""
    rows = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()
    return sorted(((r["doc_id"], r["text"], r["t"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


# ---------------------------------------------------------------------------- 1


def without_repeats(df):
    """What op1 returns, by a set of all strings of 100 in order."""
    seen, done, want = set(), {}, collections.Counter()
    for doc, text, t in documents(df):
        data = (text or "").encode()
        if (doc, t) not in done:
            gone = np.zeros(len(data), bool)
            for p in range(len(data) - 99):
                w = data[p : p + 100]
                if w in seen:
                    gone[p : p + 100] = True
                seen.add(w)
            rest = bytes(np.frombuffer(data, np.uint8)[~gone])
            done[doc, t] = (doc, len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest())
        want[done[doc, t]] += 1
    return want


def test_suffix_dedup(odd_docs):
    got = collections.Counter(tuple(r) for r in suffixes.dedup(odd_docs, digest=True).collect())
    want = without_repeats(odd_docs)
    assert got == want and sum(k[2] for k in want) > 500
    full = {r["doc_id"]: r for r in suffixes.dedup(odd_docs.where("doc_id < 9")).collect()}
    assert sum(x["end"] - x["start"] for x in full[2]["removed"]) + len(full[2]["kept"]) == full[2]["n_bytes"]


def test_rows_without_an_id_are_spread(spark, vocabulary, tmp_path):
    df = spark.range(2000).select(F.when(F.col("id") % 20 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sizes = [r["count"] for r in suffixes.by_part(df, 8).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 400
    empty = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    for k, rows in enumerate((df, empty)):
        files = tokens.write_tokens(rows, vocabulary, f"file://{tmp_path}/{k}")
        assert sum(f["docs"] for f in files) == 2000 and max(f["docs"] for f in files) < 800


@pytest.mark.parametrize("overfull", [suffixes.OVERFULL, 3])
def test_suffix_dedup_of_passages_in_unlike_surroundings(spark, monkeypatch, overfull):
    """Passages of 60 to 240 bytes, whole or cut, once and again in a document; buckets refined, and named where overfull."""
    monkeypatch.setattr(suffixes, "OVERFULL", overfull)
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 5, n))
    passages = [letters(n) for n in (60, 75, 99, 100, 101, 110, 134, 135, 170, 240)]
    texts = []
    for _ in range(150):
        pieces = []
        for _ in range(rng.integers(1, 6)):
            x = passages[rng.integers(len(passages))]
            lo = rng.integers(0, 15)
            pieces += [letters(rng.integers(0, 90)), x[lo : len(x) - rng.integers(0, 15)]]
        texts.append("".join(pieces) + letters(rng.integers(0, 40)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert collections.Counter(tuple(r) for r in suffixes.dedup(df, digest=True).collect()) == without_repeats(df)


def test_refinement_numbers_equal_strings_alike():
    rng = np.random.default_rng(9)
    base = rng.integers(97, 99, 134, np.uint8)
    rows = np.stack([base] * 6)
    rows[1, :34] = rows[2, 100:] = rows[3, 60] = 120
    many = np.array([35, 35, 35, 35, 10, 1])
    rows[4, 109:] = rows[5, 100:] = 0
    row, place, number = suffixes.refine(rows.view("V134")[:, 0], many)
    got = {}
    for r, p, n in zip(row, place, number, strict=True):
        got.setdefault(n, []).append((int(r), int(p)))
    want = {}
    for r in range(6):
        for p in range(many[r]):
            want.setdefault(rows[r, p : p + 100].tobytes(), []).append((r, p))
    assert sorted(got.values()) == sorted(x for x in want.values() if len(x) > 1)


def test_suffix_dedup_of_nothing(no_docs):
    assert suffixes.dedup(no_docs, digest=True).count() == 0


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    piece = rng.integers(97, 101, 150, np.uint8)
    data = np.concatenate([rng.integers(97, 101, 300, np.uint8), piece, rng.integers(97, 101, 100, np.uint8), piece])
    a = suffixes.Grams(data).anchors()
    assert all(a[300 + k] - 300 == a[550 + k] - 550 for k in range(51))


# ---------------------------------------------------------------------------- 2


def test_sharding(odd_docs, no_docs):
    rows = sharding.shard(odd_docs).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in documents(odd_docs))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for k in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert sharding.shard(no_docs).count() == 0


def test_shards_are_near_equal_with_a_hot_text(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x" * 80)).otherwise(F.repeat(F.col("id").cast("string"), 20)).alias("text"))
    sizes = [r["b"] for r in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.02 * min(sizes)


def test_equal_texts_stay_together_and_shards_near_equal(spark):
    import random

    rng = random.Random(16)
    texts = [f"{k} " * int(rng.paretovariate(0.8) * 10) for k in range(900)]
    texts = [t[:40_000] for t in texts] + ["y" * 300_000]
    rows = [(i, t) for i, t in enumerate(t for t in texts for _ in range(rng.choice([1, 1, 1, 2, 5])))] + [(None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (sharding.Settings(), sharding.Settings(ranges_a_shard=4, keys_a_range=2)):
        got = sharding.shard(df, s).collect()
        size, where, of = collections.Counter(), collections.defaultdict(set), collections.Counter()
        for r in got:
            size[r["shard"]] += r["size"]
            where[r["text_crc32"], r["size"]].add(r["shard"])
            of[r["text_crc32"], r["size"]] += r["size"]
        room = sum(size.values()) / 16
        assert all(len(x) == 1 for k, x in where.items() if of[k] <= room / 4)
        assert max(size.values()) <= max(room * (1.01 if s.ranges_a_shard > 4 else 1.15), max(r["size"] for r in got))
        for k in range(16):
            assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_ranges_are_dealt_by_room():
    out = sharding.dealt({0: (10, 2), 1: (6, 1), 2: (5, 3), 3: (1, 4)}, 2)
    assert out == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 2)]


def test_a_group_is_divided_only_where_no_shard_can_hold_it(spark):
    """Two thirds of all rows without an id or text, one text of a third of a shard: whole, in ranges of bounded rows."""
    from reportlake.llm.common import written

    s = sharding.Settings(rows_a_range=500)
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.when(F.col("id") < 900, F.lit("z" * 50)).otherwise(F.repeat(F.col("id").cast("string"), 30))).alias("text"))
    got = sharding.shard(df, s).collect()
    where = collections.defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert len(got) == 9000 and all(len(x) == 1 for x in where.values())
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) <= 1.02 * min(size.values())
    for k in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    rows = written(df.select("doc_id", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("number")), "keys")
    _, sums, groups = sharding.ranges(rows, 9000, 9000, s)
    assert max(n for _, n in sums.values()) <= 1000 and len(groups) >= 12
    parted = {rid: k for rid, k, _ in sharding.dealt({0: (4, 1), 1: (4, 1), 2: (4, 1), 3: (3, 1)}, 2, {0: 7, 1: 7, 2: 7})}
    assert len({parted[0], parted[1], parted[2]}) == 2  # 12 of a room of 8
    kept = {rid: k for rid, k, _ in sharding.dealt({0: (4, 1), 1: (4, 1), 3: (3, 1), 4: (3, 1)}, 2, {0: 7, 1: 7})}
    assert kept[0] != kept[1] and kept[3] != kept[4]  # 8 of a room of 7
    assert len({k for rid, k, _ in sharding.dealt({0: (3, 1), 1: (4, 1), 3: (7, 1)}, 2, {0: 7, 1: 7}) if rid < 2}) == 1


# ---------------------------------------------------------------------------- 3, 9


def test_bpe_round_trip(odd_docs, no_docs, vocabulary):
    library = Tokenizer.from_file(PATH)
    got = collections.Counter(tuple(r) for r in bpe.round_trip(odd_docs, vocabulary).collect())
    want = collections.Counter()
    for doc, text, _ in documents(odd_docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), True] += 1
    assert got == want
    assert bpe.round_trip(no_docs, vocabulary).count() == 0
    encoded = bpe.encode_column(odd_docs.where("doc_id = 15"), vocabulary)
    assert bpe.decode_column(encoded, vocabulary).first()["text"] == "A b c d e f g h i j <|endoftext|> x"


@pytest.mark.parametrize("kind", ["trie", "library"])
def test_encoders_equal_the_library(vocabulary, kind):
    import random

    rng = random.Random(2)
    library = Tokenizer.from_file(PATH)
    letters = "ab  \n\t.,'st1é中\x85\xa0\x1c ​²_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["x" * 2000, " a", "a ", "  ", "it's we'll\n\n b"]
    _, chunks = bpe.held(kind, vocabulary)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in chunks.encode(texts)] == want


def test_token_files(spark, odd_docs, no_docs, vocabulary, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = sorted(tokens.token_files(odd_docs, vocabulary).collect(), key=lambda r: r["start"])
    start = 0
    for r, (doc, text, _) in zip(rows, sorted(documents(odd_docs), key=lambda d: (d[0] is not None, d[0] or 0)), strict=True):
        assert (r["doc_id"], r["start"]) == (doc, start)
        start += r["n_tokens"]
    want = collections.Counter(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t, _ in documents(odd_docs))
    assert collections.Counter(r["ids_crc32"] for r in rows) == want
    assert tokens.token_files(no_docs, vocabulary).count() == 0
    files = tokens.write_tokens(odd_docs, vocabulary, f"file://{tmp_path}/tok")
    some = tokens.read_tokens(spark, files, [7, 12]).orderBy("start").collect()
    assert [r["doc_id"] for r in some] == [7, 12, 12] and some[0]["ids"][-1] == 2


def test_frames(tmp_path):
    uri = f"file://{tmp_path}/x.zst"
    w = frames.Writer(uri, frame_bytes=100)
    for k in range(50):
        w.add(k, bytes([k]) * k)
    w.close()
    r = frames.Reader(uri)
    assert dict(r.pieces()) == {k: bytes([k]) * k for k in range(50)} and dict(r.pieces([7, 49])) == {7: b"\7" * 7, 49: b"1" * 49}
    data = bytearray(open(f"{tmp_path}/x.zst", "rb").read())
    data[14] ^= 255
    open(f"{tmp_path}/x.zst", "wb").write(bytes(data))
    with pytest.raises(Exception):  # noqa: B017
        frames.Reader(uri).frame(0)


# ---------------------------------------------------------------------------- 4


def word_edits(a, b):
    """Edit distance of two word lists, by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines_left(rows):
    """Brute force of line dedup over (doc_id, text, hash of the text): the text left, by (doc_id, hash)."""
    seen: list[list[str]] = []
    done = {}
    for doc, text, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        if (doc, t) not in done:
            kept = []
            for line in (text or "").split("\n"):
                w = line.split()
                gone = bool(w) and any(w == o or (min(len(w), len(o)) >= 5 and abs(len(w) - len(o)) <= 1 and len(w) < 1000 and word_edits(w, o) <= 1) for o in seen)
                seen += [w] if w else []
                if not gone:
                    kept.append(line)
            done[doc, t] = None if text is None else "\n".join(kept)
    return done


def test_line_dedup(odd_docs, no_docs):
    got = collections.Counter((r["doc_id"], r["text"]) for r in lines.dedup(odd_docs).collect())
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text", F.xxhash64("text").alias("t")).collect()]
    done = lines_left(rows)
    assert got == collections.Counter((doc, done[doc, t]) for doc, _, t in rows)
    assert lines.dedup(no_docs).count() == 0 and lines.keep_new(odd_docs).columns == odd_docs.columns


def test_line_dedup_of_many_lines(spark):
    import random

    rng = random.Random(12)
    pool = [[rng.choice(["alpha", "b\u00e9ta", "c", "d\u2003e", "f\x85g", "h"]) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    texts = []
    for _ in range(150):
        out = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(pool))
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [rng.choice(["x", "y", "z"])] * rng.randint(0, 1)
            out.append(rng.choice([" ", "", "\t"]) + rng.choice([" ", "  ", "\u00a0"]).join(w))
        texts.append("\n".join(out))
    rows = [tuple(r) for r in spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("t")).collect()]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    done = lines_left(rows)
    assert {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()} == {i: done[i, t] for i, _, t in rows}


def test_lines_of_hidden_names(spark):
    own = ["row", "id", "th", "packed", "line_nos", "n_lines", "n_removed", "o", "e", "line", "doc_id ", "a.b", "_th", "_packed"]
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f\nnew")], "doc_id long, text string").withColumns({c: F.lit(c) for c in own})
    left = lines.keep_new(df)
    assert left.columns == df.columns and {r["doc_id"]: (r["text"], r["n_lines"], r["a.b"]) for r in left.collect()} == {1: ("a b c d e f", "n_lines", "a.b"), 2: ("new", "n_lines", "a.b")}
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup(df).collect()} == {1: (1, 0), 2: (2, 1)}


def test_words_as_python_has_them(monkeypatch):
    import random

    rng = random.Random(13)
    letters = "ab\u00e9\u4e2d \n\t\x0b\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\u2019"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["x" * 5000, "", "y" * 90]
    data = [t.encode() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    flat = np.frombuffer(b"".join(data), np.uint8)
    start, one, two = word_arrays.words(flat, edges)
    every = [w for t in texts for w in t.split()]
    assert len(start) == len(every) and [flat[k : k + len(w.encode())].tobytes().decode() for k, w in zip(start, every)] == every
    assert len({(w, a, b) for w, a, b in zip(every, one.tolist(), two.tolist())}) == len(set(every)) == len(set(one.tolist())) == len(set(two.tolist()))
    for size in (7, 64, 1000):
        monkeypatch.setattr(word_arrays, "SEGMENT", size)
        assert all((x == y).all() for x, y in zip(word_arrays.words(flat, edges), (start, one, two)))


def test_equal_short_lines_go_and_near_short_lines_stay(spark):
    text = "All rights reserved.\n\nthe quick brown fox jumps over it\nYes"
    rows = [(1, text), (2, text), (3, "Yes\n All  rights reserved.\nAll rights kept.\nNo"), (4, "Yes\nYes"), (5, "\n"), (5, "\n"), (6, "new words\n\nnew words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup(docs).collect())
    assert got == [(1, text, 0), (2, "", 3), (3, "All rights kept.\nNo", 2), (4, "", 2), (5, "\n", 0), (5, "\n", 0), (6, "new words\n", 1)]
    assert sorted(r["doc_id"] for r in lines.keep_new(docs).collect()) == [1, 3, 5, 5, 6]


def test_partner_keys_and_variants_cover_one_edit():
    import random

    rng = random.Random(3)

    def hashes(*lists):
        data = [" ".join(w).encode() for w in lists]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in data])])
        start, one, _ = word_arrays.words(np.frombuffer(b"".join(data), np.uint8), edges)
        return one, np.searchsorted(start, edges)

    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(5, 9))]
        b, k = list(a), rng.randrange(len(a))
        kind = rng.randrange(3)
        b[k : k + (kind != 1)] = [] if kind == 0 else [rng.choice("abcd")]
        one, at = hashes(a, b)
        keys = lines.partner_keys(word_arrays.Runs(one), at[:-1], at[1:])
        assert lines.within_one(a, b) and word_edits(a, b) <= 1 and set(keys[0]) & set(keys[1])
        line, key, kind = lines.variants(one, np.diff(at))
        of = lambda k, v: set(key[(line == k) & (kind == v)].tolist())  # noqa: B023, E731
        if len(a) == len(b):
            assert of(0, 0) & of(1, 0)
        else:
            long, short = (0, 1) if len(a) > len(b) else (1, 0)
            assert of(short, 2) <= of(long, 1)


# ---------------------------------------------------------------------------- 5


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (None, "u", "null id"), (5, "u", "z" * 300_000), (6, "u", "a\r\n\r\nb"), (4, "u", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, sha1 string")
    got = collections.Counter(tuple(r) for r in warc.archive(df).collect())
    least: dict = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = collections.Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        first = least.get(h or "")
        revisit = i is not None and first != i
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want
    assert warc.archive(df.where("false")).count() == 0
    made = warc.write_bundles(df, f"file://{tmp_path}/w")
    assert {r["page_id"] for r in warc.read_bundles(made, [3, 5]).collect()} == {3, 5}


# ---------------------------------------------------------------------------- 6


def test_ngram_join(odd_docs, no_docs):
    rows = ngram_join.join(odd_docs).collect()
    sets = []
    for r in odd_docs.select("doc_id", "text").collect():
        w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (r["text"] or "").lower()) if x]
        sets.append((r["doc_id"], frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    want = collections.Counter()
    for i, (doc, s) in enumerate(sets):
        n = sum(1 for j, (_, o) in enumerate(sets) if i != j and s and o and len(s & o) >= 0.8 * len(s | o))
        want[doc, n] += 1
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in rows) == want
    of = {r["doc_id"]: r["class_id"] for r in rows}
    assert of[7] == of[8] == of[9] == 7 and of[10] == 10
    assert ngram_join.join(no_docs).count() == 0
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (8, 9)").count() == 0 and kept.where("doc_id = 7").count() == 1


def gram_links(rows):
    """Brute force over (doc_id, text): links of each row, and the least doc_id that links reach from each doc_id."""
    sets = []
    for doc, text in rows:
        w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
        sets.append((doc, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    near = [[j for j, (_, o) in enumerate(sets) if i != j and s and o and len(s & o) >= 0.8 * len(s | o)] for i, (_, s) in enumerate(sets)]
    head: dict = {}
    for i in range(len(sets)):
        if i not in head:
            reach, queue = {i}, [i]
            while queue:
                for j in near[queue.pop()]:
                    if j not in reach:
                        reach.add(j)
                        queue.append(j)
            least = min((sets[j][0] for j in reach if sets[j][0] is not None), default=None)
            head |= dict.fromkeys(reach, least)
    return [(doc, len(near[i]), head[i]) for i, (doc, _) in enumerate(sets)]


def test_large_groups_go_in_blocks(spark):
    import random

    rng = random.Random(14)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(150):
        w = list(base[i % 3] if i % 10 else [f"x{rng.randrange(5000)}" for _ in range(50)])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    rows += [(200 + k, rows[k][1]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(gram_links(rows))
    assert max(n for _, n, _ in want) > 25
    for s in (ngram_join.Settings(), ngram_join.Settings(bucket=8, block=4), ngram_join.Settings(block_grams=500)):
        assert sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in ngram_join.join(df, s).collect()) == want
    own = ["row", "th", "cls", "gone_id", "words", "unit", "d", "t", "a.b"]
    kept = ngram_join.keep_one(df.withColumns({c: F.lit(c) for c in own}))
    assert kept.columns == [*df.columns, *own] and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, h in want if d == h)


def test_pruning_keeps_what_could_reach_the_threshold():
    need = ngram_join.least_matches(ngram_join.Settings())
    assert list(need) == list(range(16, 129, 16)) and need[128] < 0.8 * 128 and all(need[k] <= need[k + 16] for k in list(need)[:-1])


# ---------------------------------------------------------------------------- 7


def vector_links(rows, least=0.9):
    """Brute force over (vec_id, vector): links and least vec_id that links reach, by row."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in rows]
    link = [[j for j, y in enumerate(units) if j != i and x is not None and y is not None and len(x) == len(y) and (x @ y >= least or (x == y).all())] for i, x in enumerate(units)]
    head = {}
    for i in range(len(rows)):
        if i not in head:
            reach, queue = {i}, [i]
            while queue:
                for j in link[queue.pop()]:
                    if j not in reach:
                        reach.add(j)
                        queue.append(j)
            head |= dict.fromkeys(reach, min(rows[j][0] for j in reach))
    return [(len(x), head[i]) for i, x in enumerate(link)]


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[:60] + 0.15 * rng.normal(size=(60, 16))
    short = rng.normal(size=(4, 3))
    vectors = [*base.tolist(), *near.tolist(), *base[:5].tolist(), (base[0] * 3).tolist(), [0.0] * 16, None, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16, [], [1.0, 2.0], [2.0, 4.0], *short.tolist(), *(short * 1.0001 + 0.001).tolist(), [1e38, 1e38], [1e-38, 2e-38]]
    rows = [*enumerate(vectors), (5, vectors[5]), (5, vectors[6])]
    df = spark.createDataFrame([(k, v, "extra") for k, v in rows], "vec_id long, embedding array<float>, cls string")
    for s in (near_vectors.Settings(shard=100), near_vectors.Settings(shard=40, most_shards=2)):
        got = near_vectors.near(df, s).collect()
        want = collections.Counter((k, n, h, k == h) for (k, _), (n, h) in zip(rows, vector_links(rows), strict=True))
        have = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
        missed = sum((want - have).values())
        assert missed <= 0.03 * len(rows) and sum(r["n_links"] for r in got) <= sum(n for n, _ in vector_links(rows))
        assert all(r["audited_recall"] >= 0.9 for r in got)
    assert near_vectors.near(df.where("false")).count() == 0


def test_few_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [1.0, 0.0, 0.1]), (4, [0.0, 1.0, 0.0]), (5, [3.0, 4.0]), (6, [6.0, 8.0]), (7, [4.0, -3.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_low_recall_widens_the_search_or_is_an_error(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 24))
    rows = [*enumerate(np.concatenate([base, base + 0.1 * rng.normal(size=base.shape)]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    poor = near_vectors.Settings(shard=20, overlap=1, beam=2, hops=2, degree=3, medoids=1)
    with pytest.raises(ValueError, match="below"):
        near_vectors.near(df, replace(poor, widenings=0))
    got = near_vectors.near(df, poor).collect()
    assert got[0]["audited_recall"] >= 0.9 and sum(r["n_links"] for r in got) >= 0.85 * sum(n for n, _ in vector_links(rows))


def test_large_shards_are_dealt_in_blocks(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=8)
    rows = [(k, (centre + 0.05 * rng.normal(size=8)).tolist()) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near(df, near_vectors.Settings(most=40)).collect()}
    assert [got[k] for k, _ in rows] == vector_links(rows)


def test_graph_search_finds_neighbours():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(500, 24))
    v = np.concatenate([base, base + 0.1 * rng.normal(size=base.shape)])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    s = near_vectors.Settings()
    i, j = near_vectors.found_in_range(v, near_vectors.graph(v, s), s)
    true = set(zip(*np.nonzero(np.triu(v @ v.T >= 0.9, 1)), strict=True))
    met = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert len(true) > 300 and len(true & met) >= 0.99 * len(true)


# ---------------------------------------------------------------------------- 8


def test_toxicity(spark, odd_docs, no_docs):
    bad = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("plain words go here "), F.col("id").cast("string"), F.when(F.col("id") % 4 == 0, F.lit(" vile scum ")).otherwise(" kind folk "), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
    )
    labels = bad.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(0, 1), (None, 1), (5, None)], "doc_id long, toxic int"))
    rows = toxicity.toxicity(bad, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([(r["doc_id"] % 4 == 0) == (r["predicted"] == 1) for r in held]) > 0.95
    odd = toxicity.toxicity(odd_docs, labels.where("false")).collect()
    assert len(odd) == odd_docs.count() and all(r["score"] == 0.0 for r in odd)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    kept = toxicity.keep_clean(bad, labels)
    assert kept.where("doc_id % 4 = 0").count() < 10 and kept.where("doc_id % 4 <> 0").count() > 440
    own = ["row", "words", "_words", "a.b"]
    named = toxicity.keep_clean(bad.withColumns({c: F.lit(c) for c in own}), labels)
    assert named.columns == [*bad.columns, *own] and named.count() == kept.count() and named.where("`a.b` <> 'a.b'").count() == 0
    assert toxicity.toxicity(odd_docs, labels).where("score between 0 and 1").count() == odd_docs.count()


def plain_features(text, bits, word_hash):
    """Distinct feature ids of a text, in plain Python integers: words, and pairs nought to two words apart."""
    mask = (1 << 64) - 1
    w = [word_hash(x) & mask for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    out = {(x * 0x9E3779B97F4A7C15 & mask) >> (64 - bits) for x in w}
    for gap, left, right in ((1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (2, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F), (3, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)):
        for a, b in zip(w, w[gap:], strict=False):
            x = ((a ^ (a >> 31)) * left + b * right) & mask
            x ^= x >> 29
            out.add((x * 0x9E3779B97F4A7C15 & mask) >> (64 - bits))
    return sorted(out)


def plain_ftrl(rows, s):
    """FTRL-proximal, one coordinate at a time, in plain Python."""
    import math

    z, n = collections.defaultdict(float), collections.defaultdict(float)
    zb = nb = bias = 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            y, ids = rows[k]
            w = {i: weight(i) for i in ids}
            g = 1 / (1 + math.exp(-sum(w.values()) - bias)) - y
            for i in ids:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / s.alpha * bias
            nb += g * g
            bias = -zb / ((s.beta + math.sqrt(nb)) / s.alpha)
    return {i: weight(i) for i in z if weight(i)}, bias


def test_toxicity_against_plain_python(spark):
    import math
    import random

    rng = random.Random(17)
    vocab = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) + (" vile thing" if k % 3 == 0 else "") for k in range(150)] + ["", None, " ".join(vocab) * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)], "doc_id long, toxic int")
    s = toxicity.Settings(bits=14, l1=0.5, epochs=3)
    model = toxicity.train(df, labels, s)
    words = sorted({w for t in texts if t for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w})
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    ids = {k: plain_features(t, s.bits, hashes.__getitem__) for k, t in enumerate(texts)}
    order = [r["id"] for r in labels.select(F.col("doc_id").alias("id")).orderBy(F.xxhash64("id", F.lit(s.seed)), "id").collect() if zlib.crc32(str(r["id"]).encode()) % 5]
    weights, bias = plain_ftrl([(int(k % 3 == 0), ids[k]) for k in order], s)
    assert model["at"].tolist() == sorted(weights) and np.allclose(model["w"], [weights[k] for k in sorted(weights)], atol=1e-9) and abs(model["bias"] - bias) < 1e-9
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all(abs(got[k] - 1 / (1 + math.exp(-bias - sum(weights.get(i, 0.0) for i in x)))) < 1e-9 for k, x in ids.items())
    few = toxicity.train(df, labels, toxicity.Settings(bits=14, l1=0.5, max_features=500))
    assert few["bias"] is not None and len(few["at"]) < len(model["at"])


# ---------------------------------------------------------------------------- 10


def test_decontamination(spark, odd_docs, no_docs):
    item = "The quick brown fox, having jumped over the lazy dog, went home to sleep under the old oak tree by the river."
    edited = item.replace("lazy", "lasy").replace("river", "rivver").upper()
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (5, "x " * 60), (None, "none")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"aaa {edited} bbb"), (3, item[:40] + " something else entirely follows here"), (4, None), (5, ""), (6, "y" * 100_000 + item)], "doc_id long, text string")
    got = {r["doc_id"]: (r["items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: ([1], True), 2: ([1], True), 3: ([], False), 4: ([], False), 5: ([], False), 6: ([1], True)}
    small = decontaminate.Settings(block_bytes=200)
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate.decontaminate(docs, bench, small).collect()} == {k: v[1] for k, v in got.items()}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.decontaminate(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.decontaminate(no_docs, bench).count() == 0 and decontaminate.keep_clean(odd_docs, bench.where("false")).count() == odd_docs.count()


def test_excerpts_of_short_items():
    import random

    rng = random.Random(9)
    s = decontaminate.Settings()
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    found = lambda item, part: bool(decontaminate.Index([(1, item)], s).search(decontaminate.normal(f"{text(60)} {part} {text(60)}")))
    for n in (125, 150, 190, 199, 200, 260):
        item = text(n)
        assert found(item, item[:100]) and found(item, item[-100:]) and found(item, f"{item[-100:-60]}xyz{item[-57:]}")
        assert n < 150 or found(item, item[n // 2 - 75 : n // 2 + 75])
        assert not found(item, item[:60])
    for n in (101, 117, 124):
        item = text(n)
        assert found(item, item[:100]) and found(item, item[-100:]) and not found(item, item[:90])
    item = text(190)
    assert found(item, item[:90] + "123456789" + item[99:])  # nine edits in all three pieces, within the budget of the whole


def least_edits(piece, text):
    """Least edit distance of a piece and any stretch of a text, by the whole table in plain Python."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(piece, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_lemma_against_all_alignments():
    import random

    rng = random.Random(8)
    s = decontaminate.Settings()
    base = "".join(rng.choice("abcdefgh ") for _ in range(120)).strip()
    index = decontaminate.Index([(1, base)], s)
    whole = decontaminate.normal(base)
    seen = set()
    for edits in range(0, 12):
        for _ in range(4):
            t = list(base)
            for _ in range(edits):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = [rng.choice("xyz")] * rng.randint(0, 1)
            text = decontaminate.normal(rng.choice(["", "q" * 50]) + "".join(t) + rng.choice(["", "r" * 50]))
            least = least_edits(whole, text)
            piece = any(text.find(p) >= 0 for p in index.parts)
            found = index.search(text)
            assert bool(found) == (least <= int(s.rate * len(whole)) or piece)
            assert not found or piece or found[1][0] == least
            seen.add(bool(found))
    assert seen == {True, False}


def test_short_items_and_several_blocks(spark):
    bench = spark.createDataFrame([(1, "What is 2 + 2?"), (2, "x"), (3, "The capital of Elbonia is known to very few people."), (4, "?!"), (None, "never"), (3, "Another text of the third item, long enough to count.")], "item_id long, text string")
    rows = [(1, "so, what IS 2+2 ?"), (1, "so, what IS 2+2 ?"), (1, "what is 2 24"), (None, "x"), (None, "an x, then"), (2, "xx"), (3, None), (4, "the capital of elbonia is knwon to very few people another text of the third item long enough to count"), (5, "never")]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, found string")
    want = collections.Counter([(1, (1,)), (1, (1,)), (1, ()), (None, (2,)), (None, (2,)), (2, ()), (3, ()), (4, (3,)), (5, ())])
    for size in (16 << 20, 160, 1):
        s = decontaminate.Settings(block_bytes=size)
        got = decontaminate.decontaminate(docs, bench, s).collect()
        assert collections.Counter((r["doc_id"], tuple(r["items"])) for r in got) == want
        assert all(r["n_items"] == len(r["spans"]) and r["contaminated"] == (r["n_items"] > 0) for r in got)
        kept = decontaminate.keep_clean(docs, bench, s)
        assert kept.columns == docs.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(d for (d, x), n in want.items() for _ in range(n) if not x)


def test_frequent_phrases_in_slices(tmp_path):
    """Items that share phrases, in texts that repeat them: counted in small slices, from a file, as all at once."""
    import random

    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    phrase = " ".join(word() for _ in range(12))
    items = [(k, " ".join([word() for _ in range(rng.randint(0, 6))] + [phrase] + [word() for _ in range(rng.randint(2, 25))])) for k in range(60)]
    items += [(100 + k, items[0][1]) for k in range(5)] + [(200, None), (201, "two words")]
    texts = [" ".join(rng.choice([phrase, word(), *(rng.choice(items[:60])[1] for _ in range(1))]) for _ in range(25)) for _ in range(4)] + [phrase, "", "two words", items[3][1][5:]]
    plain = [decontaminate.Index(items, decontaminate.Settings()).search(decontaminate.normal(t)) for t in texts]
    decontaminate.save(decontaminate.laid_out(items, decontaminate.Settings()), f"file://{tmp_path}/grams")
    for hits in (1 << 20, 3000):
        index = decontaminate.Index(decontaminate.load(f"file://{tmp_path}/grams"), decontaminate.Settings(hits=hits))
        got = [index.search(decontaminate.normal(t)) for t in texts]
        assert [{i: x[0] for i, x in g.items()} for g in got] == [{i: x[0] for i, x in g.items()} for g in plain]
    assert sum(map(len, plain)) > 30 and {0, 100, 104} <= set().union(*plain)
    for text, found in zip(texts, plain, strict=True):
        whole = decontaminate.normal(text)
        assert all(i in found and found[i][0] == 0 for i, t in items[:65] if decontaminate.normal(t) and decontaminate.normal(t) in whole)


def test_a_benchmark_of_three_blocks(spark):
    """Blocks of a larger benchmark find what one block finds, in one worker a task."""
    bench = spark.createDataFrame([(k, " ".join(f"{w}{(k * w) % 97}" for w in range(1, 40))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"so {' '.join(f'{w}{(k * w) % 97}' for w in range(1, 40))} there") for k in range(0, 60, 2)] + [(k, "none of it " * k) for k in range(1, 60, 2)], "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect()))
    s = decontaminate.Settings(block_bytes=6000, round_bytes=500)
    assert len(decontaminate.indexes(bench, s)) >= 3 and len(decontaminate.indexes(bench)) == 1
    more = decontaminate.decontaminate(docs, bench, s)
    assert sorted(map(tuple, more.collect())) == one and sum(r[4] for r in one) >= 15
    assert more._jdf.queryExecution().toString().count("MapInArrow") == decontaminate.decontaminate(docs, bench)._jdf.queryExecution().toString().count("MapInArrow")


# ---------------------------------------------------------------------------- shared


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 200)] + [(300, 300 + k) for k in range(1, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)} | {k: 300 for k in range(300, 350)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
