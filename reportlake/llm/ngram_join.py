"""Jaccard join on word n-grams with Bayesian candidate pruning.

Texts are sets of word n-grams (five words, lower case, split at anything but letters and digits; a text of fewer
words is one n-gram). Equal sets form a class and go on as one. A class has 128 MinHash values; classes that
agree on one of 32 bands of four are candidates (at similarity 0.8 one pair in 20 million is missed). In each
bucket, values are compared in steps of 16 and a pair is dropped once the posterior probability that its
similarity reaches the threshold, under a uniform prior, falls below the tolerance. A bucket is worked off by
pivots: each compares itself with those not yet joined, so a tight bucket costs its size and not its square, and
only joining pairs leave it. A bucket of more than ``bucket`` classes is dealt in blocks, each pair of blocks a unit.
What hangs together is a group of candidates; all its pairs are verified exactly. A group of more than ``block``
classes or ``block_grams`` n-grams is dealt in blocks too: each block's sets are written once, to a file in the shared
folder, and a unit reads its two blocks there, so that a group of any size is spread over tasks, copies no set for
each block it meets, and leaves a row for each class and unit, not for each pair.

Result: a row for each document with its text class, its link class (smallest doc_id of what links reach) and its
links. Links: n_links counts other documents (copies included), n_text_links other distinct n-gram sets.

Classes go by a number that is given when their table is written (64 bits, unique); a set's digest has 128 bits.

Defined cases: a text without words (null, empty, punctuation) has no n-grams, links with nothing and is its own
class; rows that repeat id and text are one member counted twice; a null doc_id takes part but names no class
unless nothing else is there; very long texts are sets like others, whole; an empty table gives no rows; extra
columns are ignored by ``join`` and kept by ``keep_one``, whatever their names. In ``keep_one``, rows that tie for the
smallest doc_id of a class all stay, and so do documents without an id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, scratch, trimmed, written
from .frames import Reader, Writer
from .toxicity import word_hashes

VALUES, BANDS = 128, 32


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    tolerance: float = 1e-6
    step: int = 16
    bucket: int = 4096
    block: int = 256
    block_grams: int = 4_000_000
    seed: int = 1


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; all words as one where there are fewer."""
    w = words.view(np.uint64)
    if len(w) == 0:
        return w
    n = min(n, len(w))
    last = len(w) - n + 1
    s = w[:last].copy()
    for k in range(1, n):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[k : last + k]
    return np.unique(s)


def minhash(grams: np.ndarray, seed: int) -> np.ndarray:
    """128 32-bit MinHash values of a set."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    x = ((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(out, (a[:, None] * x[None, k : k + 2048] + b[:, None]).min(1), out=out)
    return out


def least_matches(s: Settings) -> dict[int, int]:
    """Matches needed after each number of compared values: below, P(similarity >= threshold) < tolerance.

    With a uniform prior the posterior is Beta(k + 1, n - k + 1), whose upper tail is P(Bin(n + 1, t) <= k).
    """
    out = {}
    for n in range(s.step, VALUES + 1, s.step):
        tail = 0.0
        for k in range(n + 2):
            tail += comb(n + 1, k) * s.threshold**k * (1 - s.threshold) ** (n + 1 - k)
            if tail >= s.tolerance:
                out[n] = k
                break
    return out


def _lists(column: pa.ListArray, empty: int) -> Iterator[np.ndarray]:
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)
    for k in range(len(column)):
        w = values[offsets[k] : offsets[k + 1]]
        yield w[w != empty]


def sketch(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, th (hash of the text), cls (digest of the set, null for none), n (size), sig (values), one pass."""
    empty = docs.sparkSession.range(1).select(F.xxhash64(F.lit(""))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                piece = b.slice(at, 500)
                cls, n, sig = [], [], []
                for w in _lists(piece.column(2), empty):
                    g = ngrams(np.ascontiguousarray(w), s.words)
                    cls.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                    n.append(len(g))
                    sig.append(minhash(g, s.seed).tobytes() if len(g) else None)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(cls, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], ["doc_id", "th", "cls", "n", "sig"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), word_hashes(F.col("text")).alias("words"))
    return rows.mapInArrow(trimmed(run), "doc_id long, th long, cls binary, n int, sig binary")


def bands(classes: DataFrame) -> DataFrame:
    """bkey (hash of band number and its four values), cid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                piece = b.slice(at, 2000)
                sig = np.frombuffer(b"".join(piece.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, 2, 2).copy().view(np.uint64).reshape(-1, BANDS, 2)
                x = (sig[:, :, 0] + mark) * np.uint64(0xC2B2AE3D27D4EB4F)
                x = ((x ^ (x >> np.uint64(31))) + sig[:, :, 1]) * np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(x.reshape(-1).view(np.int64)), piece.column(0).take(pa.array(np.repeat(np.arange(len(piece)), BANDS)))], ["bkey", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "bkey long, cid long")


def joined_pairs(sig: np.ndarray, need: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Pairs that join the members of a bucket which survive pruning; sig: a row of 8-bit values for each."""
    rest = np.arange(len(sig))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            pivot = queue.pop()
            alive, matches = np.arange(len(rest)), np.zeros(len(rest), np.int32)
            done = 0
            for n, least in need.items():
                matches = matches + (sig[rest[alive], done:n] == sig[pivot, done:n]).sum(1, dtype=np.int32)
                keep = matches >= least
                alive, matches, done = alive[keep], matches[keep], n
                if not len(alive):
                    break
            for k in rest[alive]:
                yield int(pivot), int(k)
            queue += list(rest[alive])
            rest = np.delete(rest, alive)


def candidates(members: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) between classes that some bucket joins after pruning. members: unit, cid, sig8."""
    need = least_matches(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in arrow_units(batches):
            ids = np.asarray(unit.column(1))
            sig = np.frombuffer(b"".join(unit.column(2).to_pylist()), np.uint8).reshape(-1, VALUES)
            pairs = np.array(list(joined_pairs(sig, need)), np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

    dealt = members.repartition("unit").sortWithinPartitions("unit", "cid")
    return dealt.mapInArrow(trimmed(run), "a long, b long").distinct()


def dealt_in_blocks(rows: DataFrame, blocks: Column, *key: str) -> DataFrame:
    """rows (cid, ...) with unit, block and side: for each pair of blocks of a key, the rows of both; side 1: the second block."""
    return (
        rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("unit", F.xxhash64(*key, F.least("block", "with"), F.greatest("block", "with")))
        .withColumn("side", F.when(F.col("block") > F.col("with"), 1).otherwise(0))
    )


def arrow_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows that share the first column, as Arrow: the arrays of words are never made Python objects."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        unit = np.asarray(b.column(0))
        edges = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            piece = b.slice(lo, hi - lo)
            if held and held[0].column(0)[0].as_py() != unit[lo]:
                yield whole(held)
                held = []
            held.append(piece)
    if held:
        yield whole(held)


def whole(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pieces[0] if len(pieces) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(k) for p in pieces]) for k in range(pieces[0].num_columns)], pieces[0].schema.names)


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, exactly."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.flatnonzero(np.diff(values, prepend=values[0] - np.uint64(1)))
    size = np.diff(np.append(edge, len(values)))
    common = np.repeat(size > 1, size)
    column = np.repeat(np.cumsum(size > 1) - 1, size)[common]
    owner, columns = owner[common], int((size > 1).sum())
    out = np.zeros((m, m), np.float64)
    for lo in range(0, columns, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((m, min(4096, columns - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def links_of(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], second: np.ndarray | None, s: Settings) -> pa.RecordBatch | None:
    """Rows (cid, copies_linked, texts_linked, other) of a unit: links by class, and one linked class as an edge.

    second: which sets are of the second block; with it, only pairs across the two blocks count.
    """
    shared, n = similar(sets), np.array([len(x) for x in sets], np.float64)
    link = shared >= s.threshold * (n[:, None] + n[None, :] - shared) - 1e-9
    np.fill_diagonal(link, False)
    if second is not None:
        link &= second[:, None] != second[None, :]
    texts = link.sum(1)
    hit = np.flatnonzero(texts)
    if not len(hit):
        return None
    # Edges that span what is linked here: no more rows than members.
    edges, rest = [], set(hit.tolist())
    while rest:
        queue = [rest.pop()]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(link[i]).tolist():
                if j in rest:
                    rest.discard(j)
                    queue.append(j)
                    edges.append((j, i))
    other = dict(edges)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[hit], pa.int64()), pa.array((link @ copies)[hit].astype(np.int64)), pa.array(texts[hit].astype(np.int64)),
            pa.array([int(ids[other[i]]) if i in other else None for i in hit.tolist()], pa.int64()),
        ],
        ["cid", "copies_linked", "texts_linked", "other"],
    )


LINKS = "cid long, copies_linked long, texts_linked long, other long"


def verify_small(words: DataFrame, s: Settings) -> DataFrame:
    """Links in groups of one block. words: component, cid, copies, words."""
    empty = words.sparkSession.range(1).select(F.xxhash64(F.lit(""))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in arrow_units(batches):
            sets = [ngrams(np.ascontiguousarray(w), s.words) for w in _lists(unit.column(3), empty)]
            found = links_of(np.asarray(unit.column(1)), np.asarray(unit.column(2)), sets, None, s)
            if found is not None:
                yield found

    dealt = words.repartition("component").sortWithinPartitions("component", "cid")
    return dealt.select("component", "cid", "copies", "words").mapInArrow(trimmed(run), LINKS)


def verify_large(words: DataFrame, s: Settings) -> DataFrame:
    """Links in groups of several blocks. words: component, blocks, block, cid, copies, words."""
    spark = words.sparkSession
    empty = spark.range(1).select(F.xxhash64(F.lit(""))).first()[0]
    folder = scratch(spark, "ngram-blocks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A file of blocks for each task; a block is the ids, copies and sizes of its sets, then the sets."""
        out, uri, rows = None, f"{folder}/blocks-{uuid.uuid4().hex}.zst", []
        for unit in arrow_units(batches):
            out = out or Writer(uri)
            sets = [ngrams(np.ascontiguousarray(w), s.words) for w in _lists(unit.column(5), empty)]
            head = np.stack([np.asarray(unit.column(3)), np.asarray(unit.column(4)), np.array([len(x) for x in sets], np.int64)])
            out.add(unit.column(0)[0].as_py(), b"".join([np.array([len(sets)], "<i8").tobytes(), head.astype("<i8").tobytes(), *(x.tobytes() for x in sets)]))
            rows.append((unit.column(0)[0].as_py(), unit.column(1)[0].as_py(), unit.column(2)[0].as_py(), uri))
        if out:
            out.close()
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d)], ["bid", "component", "block", "uri"])

    def read(uri: str, bid: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        reader = Reader(uri)
        data = next(reader.pieces([bid]))[1]
        reader.close()
        n = int(np.frombuffer(data, "<i8", 1)[0])
        ids, copies, size = np.frombuffer(data, "<i8", 3 * n, 8).reshape(3, n)
        return ids, copies, np.split(np.frombuffer(data, np.uint64, int(size.sum()), 8 + 24 * n), np.cumsum(size)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, bid, uri2, bid2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, copies, sets = read(uri, bid)
                second = None
                if bid2 != bid:
                    more, copies2, sets2 = read(uri2, bid2)
                    second = np.arange(len(ids) + len(more)) >= len(ids)
                    ids, copies, sets = np.concatenate([ids, more]), np.concatenate([copies, copies2]), sets + sets2
                found = links_of(ids, copies, sets, second, s)
                if found is not None:
                    yield found

    keyed = words.select(F.xxhash64("component", "block").alias("bid"), "component", "block", "cid", "copies", "words")
    made = written(keyed.repartition("bid").sortWithinPartitions("bid", "component", "block", "cid").mapInArrow(trimmed(write), "bid long, component long, block int, uri string"), "ngram-blocks-list")
    left, right = (made.select("component", F.col("block").alias(f"k{i}"), F.col("uri").alias(f"uri{i}"), F.col("bid").alias(f"bid{i}")) for i in (1, 2))
    # A block names the later ones of its group by number and finds each by a key of its own: no key holds all pairs of a group.
    last = made.groupBy("component").agg(F.max("block").alias("last"))
    named = left.join(last, "component").withColumn("k2", F.explode(F.sequence("k1", "last")))
    units = named.join(right, ["component", "k2"]).select("uri1", "bid1", "uri2", "bid2")
    return units.repartition(F.xxhash64("bid1", "bid2")).mapInArrow(trimmed(run), LINKS)


def join(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, th, text_class, class_id, n_links, n_text_links."""
    sk = written(sketch(docs, s), "sketch")
    at = F.min(F.struct(F.col("doc_id"), F.col("th"))).alias("at")
    classes = sk.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), at, F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    narrow = bands(classes)
    busy = narrow.groupBy("bkey").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # The low byte of each value is enough for the comparison; the whole values stay with the class.
    low = classes.select("cid", "sig").mapInArrow(trimmed(_low_bytes), "cid long, sig8 binary")
    placed = dealt_in_blocks(narrow.join(busy, "bkey"), F.ceil(F.col("m") / s.bucket).cast("int"), "bkey").select("unit", "cid")
    edges = written(candidates(placed.join(low, "cid").select("unit", "cid", "sig8"), s), "candidates")
    groups = components(edges).select(F.col("id").alias("cid"), "component")
    sized = groups.join(classes.select("cid", "n"), "cid")
    heavy = sized.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / s.block), F.ceil(F.sum("n") / s.block_grams)).cast("int").alias("blocks"))
    dealt = groups.join(heavy, "component").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    wanted = dealt.join(classes.select("cid", "copies", F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th")), "cid")
    texts = docs.select(F.col("doc_id").alias("d"), "text", F.xxhash64("text").alias("t"))
    words = written(
        texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & F.col("t").eqNullSafe(F.col("th"))).dropDuplicates(["cid"])
        .select("component", "blocks", "block", "cid", "copies", word_hashes(F.col("text")).alias("words")),
        "ngram-words",
    )
    found = written(verify_small(words.where("blocks = 1"), s).unionByName(verify_large(words.where("blocks > 1"), s)), "links")
    links = found.groupBy("cid").agg(F.sum("copies_linked").alias("copies_linked"), F.sum("texts_linked").alias("texts_linked"))
    linked = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    reps = classes.select("cls", "cid", "rep", "copies")
    # Written, so that the join by component has an exchange at either side, which is split where one component has most.
    heads = written(linked.join(reps, F.col("id") == F.col("cid")).groupBy("component").agg(F.min("rep").alias("head")), "ngram-heads")
    facts = (
        reps.join(links, "cid", "left").join(linked.select(F.col("id").alias("cid"), "component"), "cid", "left").join(heads, "component", "left")
        .select("cls", "rep", F.coalesce("head", "rep").alias("head"), (F.coalesce("copies_linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts_linked", F.lit(0)).alias("n_text_links"))
    )
    return sk.select("doc_id", "th", "cls").join(facts, "cls", "left").select(
        "doc_id", "th", F.coalesce("rep", "doc_id").alias("text_class"), F.coalesce("head", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
    )


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        low = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.binary())], ["cid", "sig8"])


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents without those that link with an earlier one of their class: the smallest doc_id of each stays."""
    gone = join(docs.select("doc_id", "text"), s).where("doc_id <> class_id").select("doc_id", "th").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("th"))
    return whole.join(gone, ["doc_id", "th"], "left_anti").select("row.*")
