"""Line dedup by a deletion-neighbourhood join: of lines within one word edit, the earliest stays.

A line is what stands between newlines; its words are its runs of non-spaces. Two lines match when they are equal
or one inserted, deleted or substituted word apart. A line goes if an earlier line matches it - earlier by doc_id,
then place in the document - whether or not that one stays itself: lines are judged on the input.

Lines of fewer than ``least_words`` words match equal lines alone, since one edit may change all that they say.

1. Lines with words become narrow rows with a 128-bit digest, in array operations over many lines (word_arrays.py).
   Equal lines of any length: one aggregate by digest, combined before the shuffle; all but the first go.
2. First occurrences of at least ``least_words`` words within one edit of another share, for some n, the first
   n // 2 or the last n - n // 2 words (n: words of the shorter). Lines without such a partner need no neighbourhood.
3. The others get an ordinal in the order of lines and emit the hashed variants of their deletion neighbourhood:
   each word left out with its place marked (substitutions meet there), each word left out (the longer line) and the
   line itself (the shorter). Equal variants join through their earliest line alone, so that a variant that a third
   of all lines share yields a row for each line and never a pair for each two.
4. The word edit distance of each line and the earliest line found is verified on the texts. A line that is the
   earliest of very many is sent once for each of up to ``salts`` shares of them.

Joins by digest and by variant are of a large side that adaptive execution splits, with one row a key at the other.

Defined cases: null and empty texts have no lines to lose; blank lines stay; an empty table gives no rows; rows that
repeat id and text are one document and lose the same lines; of rows with one id and different texts the smaller
hash of the text is earlier; a null doc_id comes first; very long lines are treated whole; extra columns are kept,
whatever their names, but that ``dedup`` puts its own n_lines and n_removed in the place of columns called so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import trimmed, utf8, written
from .word_arrays import Runs, mixed, words

#: Bytes of text worked on at a time (or one document of any length).
CHUNK = 1 << 19
NEWLINE = ord("\n")


@dataclass(frozen=True)
class Settings:
    least_words: int = 5
    salts: int = 64


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, len(offsets) - 1)
        start = stop


def partner_keys(runs: Runs, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Four keys for each line: of two lines within one edit, some key of the one is a key of the other."""
    out = []
    for n in (hi - lo, hi - lo - 1):
        half = n // 2
        out += [runs.of(lo, lo + half, 1) + n.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), runs.of(hi - (n - half), hi, 2) + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)]
    return np.stack(out, 1)


def lines_of(data: np.ndarray, edges: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(document, line number, digest halves, number of words, partner keys) of the lines with words of some texts."""
    start, hash1, hash2 = words(data, edges)
    feeds = np.flatnonzero(data == NEWLINE) + 1
    begins = np.sort(np.concatenate([edges[:-1], feeds]), kind="stable")
    # A feed that ends a text begins a line of that text, which is empty: nothing is lost in saying it is the next one's.
    first = np.searchsorted(start, begins)
    last = np.append(first[1:], len(start))
    full = last > first
    lo, hi = first[full], last[full]
    doc = np.searchsorted(edges, start[lo], "right") - 1
    number = np.searchsorted(feeds, start[lo], "right") - np.searchsorted(feeds, edges[doc], "right")
    one = Runs(hash1)
    long_enough = hi - lo >= s.least_words
    keys = partner_keys(one, lo[long_enough], hi[long_enough]).view(np.int64)
    return doc, number, one.of(lo, hi).view(np.int64), Runs(hash2).of(lo, hi).view(np.int64), np.where(long_enough, 4, 0), keys


def line_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, th, line_no, h1, h2, keys (short lines: none) of the lines with words; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(2))
            for lo, hi in chunks(offsets):
                doc, number, h1, h2, many, keys = lines_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], s)
                who = b.select([0, 1]).take(pa.array(doc + lo))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*who.columns, pa.array(number, pa.int32()), pa.array(h1), pa.array(h2), listed], ["doc_id", "th", "line_no", "h1", "h2", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(trimmed(run), "doc_id long, th long, line_no int, h1 long, h2 long, keys array<long>")


def variants(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, kind) of the deletion neighbourhoods of lines, given their words' hashes end to end and how many each has.

    Kinds: 0 one word substituted, 1 the longer line, 2 the shorter.
    """
    line = np.repeat(np.arange(len(many)), many)
    begin = np.concatenate([[0], np.cumsum(many)])
    place = (np.arange(len(hashes)) - begin[line] + 1).astype(np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    at = mixed(hashes + place * step)  # a word in its place
    before = mixed(hashes + (place - np.uint64(1)) * step)  # in its place once an earlier one is gone
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (at, before)]
    whole = sums[0][begin[1:]] - sums[0][begin[:-1]]
    here = np.arange(len(hashes))
    longer = sums[0][here] - sums[0][begin[line]] + sums[1][begin[line + 1]] - sums[1][here + 1]
    parts = []
    for kind, own, size, keys in (
        (0, line, many[line], whole[line] - at + mixed(place * np.uint64(0xD6E8FEB86659FD93))),
        (1, line, many[line] - 1, longer),
        (2, np.arange(len(many)), many, whole),
    ):
        tag = (size.astype(np.uint64) * np.uint64(2) + np.uint64(kind > 0)) * step
        parts.append((own, mixed(keys + tag).view(np.int64), np.full(len(own), kind, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether two word lists are at most one insertion, deletion or substitution apart."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def _compressed(text: pd.Series) -> pd.Series:
    z = zstandard.ZstdCompressor(level=1)
    return text.map(lambda x: None if x is None else z.compress(x.encode()))


def packed(column: str) -> Column:
    """Texts as Zstandard frames, so that less moves."""
    return F.pandas_udf(_compressed, "binary")(column)


def _with_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """docs (row, id, th, packed) with the array of their line numbers (null: none). lines: doc_id, th, line_no."""
    listed = lines.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set("line_no").alias("line_nos"))
    return docs.join(listed, F.col("id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")), "left").drop("d", "t")


def removed_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, th, line_no of the lines that go."""
    lines = written(line_rows(docs, s), "lines")
    here = F.struct("doc_id", "th", "line_no")
    # Written, so that it is made once, and so that the join by digest has an exchange at either side: it is then split
    # where a third of all lines are equal.
    seen = written(lines.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")), "first-lines")
    equal = lines.join(seen.where("n > 1").select("h1", "h2", "first"), ["h1", "h2"]).where(here > F.col("first")).select("doc_id", "th", "line_no")
    firsts = seen.where(F.size("keys") > 0).select("first.*", "keys")
    keyed = firsts.select(F.xxhash64("doc_id", "th", "line_no").alias("lid"), F.explode("keys").alias("k")).distinct()
    busy = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    wanted = keyed.join(busy, "k").select("lid").distinct()
    near = firsts.drop("keys").withColumn("lid", F.xxhash64("doc_id", "th", "line_no")).join(wanted, "lid", "left_semi").drop("lid")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), packed("text").alias("packed"))
    chosen = _with_lines(texts, near).where("line_nos is not null").dropDuplicates(["id", "th"]).select("id", "th", "packed", "line_nos").mapInArrow(trimmed(_chosen), "doc_id long, th long, line_no int, line string")
    # Ordinals follow the order of lines: partitions in order of range, rows sorted in each; fixed once they are written.
    ordered = chosen.repartitionByRange(F.col("doc_id").asc_nulls_first(), "th", "line_no").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th", "line_no")
    held = written(ordered.withColumn("o", F.monotonically_increasing_id()), "near-lines")
    around = held.select("o", "line").mapInArrow(trimmed(_variants), "o long, key long, kind byte")
    earliest = around.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.col("o"))).alias(f"e{k}") for k in range(3)], F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    other = F.when(F.col("kind") == 0, F.col("e0")).when(F.col("kind") == 1, F.col("e2")).otherwise(F.col("e1"))
    pairs = written(around.join(earliest, "key").withColumn("e", other).where("e < o").groupBy("o").agg(F.min("e").alias("e")).withColumn("salt", F.pmod(F.xxhash64("o"), F.lit(s.salts))), "line-pairs")
    asked = pairs.select("e", "salt").distinct().join(held.select(F.col("o").alias("e"), F.col("line").alias("e_line")), "e")
    both = pairs.join(asked, ["e", "salt"]).select("o", "e_line").join(held, "o")
    checked = both.select("doc_id", "th", "line_no", "line", "e_line").mapInArrow(_verified, "doc_id long, th long, line_no int")
    return equal.unionByName(checked)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        out: list[tuple] = []
        size = 0
        for doc_id, th, data, nos in zip(*(b.column(i) for i in range(4)), strict=True):
            lines = z.decompress(data.as_py()).decode().split("\n")
            out += [(doc_id.as_py(), th.as_py(), k, lines[k]) for k in sorted(nos.as_py())]
            size += len(data.as_py())
            if len(out) > 10_000 or size > CHUNK:
                yield _line_batch(out)
                out, size = [], 0
        if out:
            yield _line_batch(out)


def _line_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "th", "line_no", "line"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, data = utf8(b.column(1))
        for lo, hi in chunks(offsets):
            edges = offsets[lo : hi + 1] - offsets[lo]
            start, hashes, _ = words(data[offsets[lo] : offsets[hi]], edges)
            line, key, kind = variants(hashes, np.diff(np.searchsorted(start, edges)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(line + lo)), pa.array(key), pa.array(kind)], ["o", "key", "kind"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [within_one(x.as_py().split(), y.as_py().split()) for x, y in zip(b.column(3), b.column(4), strict=True)]
        yield b.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))


def _deduped(docs: DataFrame, s: Settings) -> DataFrame:
    """row (all columns as they were, but for the text), n_lines, n_removed. Only these names are used beside the row."""
    place = docs.columns.index("text")
    whole = F.struct(*[(F.lit(None).cast("string").alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns])
    plain = docs.select(whole.alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), packed("text").alias("packed"))
    both = _with_lines(plain, removed_lines(docs.select("doc_id", "text"), s)).select("row", "packed", "line_nos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                piece = b.slice(at, 500)
                texts, lines, lost = [], [], []
                for data, nos in zip(piece.column(1), piece.column(2), strict=True):
                    text = None if data.as_py() is None else z.decompress(data.as_py()).decode()
                    drop = set(nos.as_py() or ())
                    lines.append(0 if text is None else text.count("\n") + 1)
                    texts.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop) if drop else text)
                    lost.append(len(drop))
                row = piece.column(0)
                fields = [pa.array(texts, pa.string()) if k == place else x for k, x in enumerate(row.flatten())]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type)), pa.array(lines, pa.int32()), pa.array(lost, pa.int32())], ["row", "n_lines", "n_removed"])

    schema = both.select("row", F.lit(0).alias("n_lines"), F.lit(0).alias("n_removed")).schema
    return both.mapInArrow(trimmed(run), schema)


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents, text without the lines that go; n_lines and n_removed beside it. Texts may become empty."""
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _deduped(docs, s).select(*rest, "n_lines", "n_removed")


def keep_new(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents with the lines that stay, n_chars following; those of which no line with words stays go."""
    rest = _deduped(docs, s).where((F.col("n_removed") == 0) | F.col("row.text").rlike(r"\S"))
    kinds = dict(docs.dtypes)
    length = F.when(F.col("n_removed") > 0, F.length("row.text").cast(kinds.get("n_chars", "long")))
    return rest.select(*[F.coalesce(length, F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
