"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are hashed in the JVM; unigrams, bigrams and two skip-grams are mixed from the word hashes in numpy.
Training takes a bounded sample of labelled rows through one task: in order of a hash, ``max_rows`` of each label
at most and ``max_features`` distinct features of documents in all (both documented parameters; four bytes each, so
the task's memory is bounded whatever the texts' lengths, and the document that crosses the bound is the last).
What it returns is a sparse weight vector of at most ``2**bits`` entries, which is the only thing broadcast. Scoring
is one narrow pass over the corpus: no shuffle.

Defined cases: a null or empty text has no features and gets the model's base score; without labelled rows the
score is 0.0; repeated documents get equal scores; a label row that repeats counts once (largest label), one without
id or label not at all; a document with a null doc_id is scored and never learned from; very long texts are scored
whole, a piece of a batch at a time; ties of the sample's hash go by id; an empty table gives no rows; extra columns
are ignored by ``toxicity`` and kept by ``keep_clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import trimmed

SPLIT = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    epochs: int = 8
    max_rows: int = 10_000  # of each label
    max_features: int = 40_000_000  # of all documents learned from
    seed: int = 7


def word_hashes(text):
    """Array of 64-bit hashes of the lower-cased words of a text column."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: F.xxhash64(w))


def features(words: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids and the document of each: words, adjacent pairs, and pairs one and two words apart."""
    w = words.view(np.uint64)
    shift = np.uint64(64 - bits)
    ids, docs = [(w * np.uint64(0x9E3779B97F4A7C15)) >> shift], [doc]
    for gap, left, right in ((1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (2, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F), (3, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)):
        if len(w) <= gap:
            continue
        x = (w[:-gap] ^ (w[:-gap] >> np.uint64(31))) * np.uint64(left) + w[gap:] * np.uint64(right)
        x ^= x >> np.uint64(29)
        same = doc[:-gap] == doc[gap:]
        ids.append(((x * np.uint64(0x9E3779B97F4A7C15)) >> shift)[same])
        docs.append(doc[:-gap][same])
    return np.concatenate(ids).astype(np.int64), np.concatenate(docs)


def _flat(column: pa.ListArray, empty: int) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    words = np.asarray(column.values)[offsets[0] : offsets[-1]]
    doc = np.repeat(np.arange(len(column)), np.diff(offsets))
    real = words != empty
    return np.ascontiguousarray(words[real]), doc[real]


def _pieces(column: pa.ListArray, most: int = 200_000) -> Iterator[tuple[int, pa.ListArray]]:
    """A few documents at a time, so that memory follows the longest text and not the batch."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    start, n = 0, len(column)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, column.slice(start, min(stop, n) - start)
        start = stop


def fit(rows: list[tuple[int, np.ndarray]], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (label, distinct feature ids) rows: indices and values of non-zero weights, and the bias."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bias = 0.0
    zb = nb = 0.0
    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            y, x = rows[k]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= s.l1, 0.0, (np.sign(zx) * s.l1 - zx) / ((s.beta + root) / s.alpha + s.l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            if g == 0.0:
                continue
            sigma = (np.sqrt(nx + g * g) - root) / s.alpha
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / s.alpha
            zb += g - sb * bias
            nb += g * g
            bias = -zb / ((s.beta + np.sqrt(nb)) / s.alpha)
    w = np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    at = np.flatnonzero(w)
    return at, w[at], float(bias)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> dict:
    """Learn from labelled rows outside the held-out fifth. docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    lab = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y"))
        .where(F.crc32(F.col("id").cast("string")) % 5 != 0)
        .withColumn("h", F.xxhash64("id", F.lit(s.seed)))
    )
    # A bounded, deterministic sample: the max_rows smallest hashes of either label.
    take = [lab.where(f"y = {y}").orderBy("h", "id").limit(s.max_rows) for y in (0, 1)]
    sample = take[0].unionByName(take[1])
    empty = spark.range(1).select(F.xxhash64(F.lit(""))).first()[0]
    found = (
        docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), "id")
        .select("h", "id", "y", word_hashes(F.col("text")).alias("words"))
        .repartition(1).sortWithinPartitions("h", "id", "words").drop("h", "id")
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray]] = []
        room = s.max_features
        for b in batches:
            for start, piece in _pieces(b.column(1)) if room > 0 else ():
                y = b.column(0).slice(start, len(piece)).to_pylist()
                ids, of = features(*_flat(piece, empty), s.bits)
                key = np.unique((of.astype(np.int64) << s.bits) | ids)
                ids, of = (key & ((1 << s.bits) - 1)).astype(np.int32), key >> s.bits
                edge = np.searchsorted(of, np.arange(len(y) + 1))
                rows += [(y[k], ids[edge[k] : edge[k + 1]].copy()) for k in range(len(y)) if edge[k] < room]
                room -= len(ids)
        at, w, bias = fit(rows, s) if rows else (np.zeros(0, np.int64), np.zeros(0), -35.0)
        yield pa.RecordBatch.from_pydict({"at": [at.astype(np.int32).tobytes()], "w": [w.tobytes()], "bias": [bias], "n": [len(rows)]})

    got = found.mapInArrow(trimmed(learn), "at binary, w binary, bias double, n long").collect()
    best = max(got, key=lambda r: r["n"], default=None)
    if best is None or best["n"] == 0:
        return {"at": np.zeros(0, np.int32), "w": np.zeros(0), "bias": None, "empty": empty, "bits": s.bits}
    return {"at": np.frombuffer(best["at"], np.int32), "w": np.frombuffer(best["w"]), "bias": best["bias"], "empty": empty, "bits": s.bits}


def scores(words: pa.ListArray, model: dict) -> np.ndarray:
    """Scores of texts given as arrays of word hashes."""
    if model["bias"] is None:
        return np.zeros(len(words))
    weight = np.zeros(1 << model["bits"])
    weight[model["at"]] = model["w"]
    total = np.full(len(words), model["bias"])
    for start, piece in _pieces(words):
        ids, of = features(*_flat(piece, model["empty"]), model["bits"])
        hit = weight[ids] != 0
        key = np.unique((of[hit].astype(np.int64) << model["bits"]) | ids[hit])
        np.add.at(total, start + (key >> model["bits"]), weight[key & ((1 << model["bits"]) - 1)])
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score: probability that a text is toxic. Narrow; nothing but the text enters the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scores(b.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", word_hashes(F.col("text")).alias("words")).mapInArrow(trimmed(run), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= 0.5)."""
    scored = score(docs, train(docs, labels, s))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), limit: float = 0.5) -> DataFrame:
    """The documents scored below the limit, all columns and rows as they are; one narrow pass after training."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(scores(b.column(1), sent.value) < limit)
            yield b.select([0]).filter(keep)

    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_hashes(F.col("text")).alias("words"))
    return both.mapInArrow(trimmed(run), both.select("row").schema).select("row.*")
