"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment.

Texts are compared in a normal form (lower case, runs of other characters than letters and digits as one space).
Every benchmark item longer than ``segment`` bytes is cut into half-overlapping segments of that size, so that an
excerpt is found as well as the whole item; items of under two segments are a segment as a whole, too, and those of
under 1.25 are found by an excerpt only where that is unedited. A document is contaminated when some stretch of it aligns with a segment of m
bytes within k edits (floor(rate * m), or 0 for such an excerpt). By the q-gram lemma such a stretch shares at least m + 1 - q - k*q
q-grams with the segment, all within diagonals at most k apart; documents are filtered on that count, first over
all segments together in a sliding window, then by segment and diagonal band (bands of 2k + 1 diagonals that
overlap by half, so no alignment straddles). What is left is aligned in a band of the edit budget.

Items too short for that (under q + 8 bytes in normal form) are found where they stand unedited, as whole words, by
one automaton over all of them; pieces of under two q-grams (24 bytes) are searched without edits.

The benchmark is divided by hash into blocks of about ``block_bytes`` (one block here). A task for each block lays out its q-grams
once, as a file of plain arrays in the shared folder, which workers map into memory, so that those of a machine
share its pages; a bit for each of 16 to 32 slots a q-gram tells most of a text's positions from hits before they are looked up. A worker takes
``round_bytes`` of texts through one block after the other, whatever the number of blocks. Bands are
counted over stretches of a text with at most ``hits`` q-gram hits at once (where many segments share a phrase, over ranges of
segments, too), so memory is bounded by the block and not by what repeats. No shuffle of documents.

Defined cases: null and empty texts and items, and items of no letter or digit, match nothing; an item whose id is
null is left out, rows of one item_id are one item; documents keep a row each, whatever their ids (null, repeated);
very long texts are searched whole; an empty table gives no rows; extra columns are ignored by ``decontaminate`` and
kept by ``keep_clean``. Of equally good places of an item the first found is named.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mapped, open_output, scratch, trimmed

OTHER = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class Settings:
    q: int = 12
    rate: float = 0.05
    segment: int = 100
    window: int = 64
    block_bytes: int = 16 << 20  # three for each character of an item
    round_bytes: int = 32 << 20  # of texts that go through all blocks together
    hits: int = 1 << 20  # q-gram hits that are counted at once


def normal(text: str | None) -> bytes:
    """Lower case in UTF-8, with every run of ASCII characters that are no letters or digits as one space."""
    return OTHER.sub(b" ", (text or "").lower().encode("utf-8", "surrogatepass")).strip()


def segments(text: bytes, s: Settings) -> list[tuple[bytes, int]]:
    """Half-overlapping pieces that cover a text, with their edit budgets; a text of under two pieces is there as a whole, too."""
    if len(text) < s.q + 8:
        return []
    # Under two q-grams, the lemma leaves no q-gram to look for beside an edit.
    whole = [(text, int(s.rate * len(text)) if len(text) >= 2 * s.q else 0)]
    if len(text) <= s.segment:
        return whole
    # Pieces that are nearly the whole count unedited only: with edits, it is for the whole to decide.
    edits = int(s.rate * s.segment) if 4 * len(text) >= 5 * s.segment else 0
    starts = [*range(0, len(text) - s.segment, s.segment // 2), len(text) - s.segment]
    pieces = [(text[a : a + s.segment], edits) for a in starts]
    return pieces if len(text) >= 2 * s.segment else whole + pieces


def codes(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit code of the q-gram at each position (8 <= q <= 16): exact in its 8-byte halves, then mixed."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", pad, strides=(1,)) if pad.flags.c_contiguous else None
    a, b = eight[:n], eight[q - 8 : q - 8 + n]
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


# ---------------------------------------------------------------------------- the index of a block

#: Arrays of an index. Pieces: bytes and where each begins, edits, items (where each piece's begin). q-grams by code:
#: piece and place in it. A bit for each slot that a code begins with. The automaton of short items, pickled.
ARRAYS = {
    "data": np.uint8, "begin": np.int64, "edits": np.int32, "owner": np.int64, "owners": np.int64,
    "code": np.uint64, "part": np.int32, "place": np.int16, "bits": np.uint8, "short": np.uint8,
}


def laid_out(items: list[tuple[int, str | None]], s: Settings) -> dict[str, np.ndarray]:
    """ARRAYS of a block of items. Equal pieces are one piece of all their items."""
    pieces: dict[tuple[bytes, int], list[int]] = {}
    short: dict[str, set[int]] = {}
    for item, text in items:
        plain = normal(text)
        if 0 < len(plain) < s.q + 8:
            short.setdefault(f" {plain.decode('latin-1')} ", set()).add(item)
        for piece in segments(plain, s):
            held = pieces.setdefault(piece, [])
            if not held or held[-1] != item:
                held.append(item)
    size = np.array([len(p) for p, _ in pieces], np.int64)
    out = {"edits": np.array([k for _, k in pieces], np.int32), "begin": np.concatenate([[0], np.cumsum(size)]).astype(np.int64)}
    out["owner"] = np.concatenate([[0], np.cumsum([len(v) for v in pieces.values()])]).astype(np.int64)
    out["owners"] = np.array([i for v in pieces.values() for i in v], np.int64)
    out["data"] = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
    del pieces
    # Codes at all places of the joined pieces, but for those that run over a piece's end.
    code, grams = codes(out["data"], s.q), size - s.q + 1
    if len(code):
        part = np.repeat(np.arange(len(size), dtype=np.int32), grams)
        place = (np.arange(len(part)) - np.repeat(np.cumsum(grams) - grams, grams)).astype(np.int16)
        code = code[out["begin"][part] + place]
        order = np.argsort(code, kind="stable")
        out["code"], out["part"], out["place"] = code[order], part[order], place[order]
    else:
        out |= {"code": np.zeros(0, np.uint64), "part": np.zeros(0, np.int32), "place": np.zeros(0, np.int16)}
    wide = slot_bits(len(out["code"]))
    out["bits"] = np.zeros(1 << (wide - 3), np.uint8)
    slot = out["code"] >> np.uint64(64 - wide)
    np.bitwise_or.at(out["bits"], slot >> np.uint64(3), np.left_shift(np.uint8(1), (slot & np.uint64(7)).astype(np.uint8)))
    out["short"] = np.zeros(0, np.uint8)
    if short:
        found = ahocorasick.Automaton()
        for text, ids in short.items():
            found.add_word(text, (len(text) - 2, sorted(ids)))
        found.make_automaton()
        out["short"] = np.frombuffer(pickle.dumps(found), np.uint8)
    return out


def slot_bits(n: int) -> int:
    """How many leading bits of a code name its slot: 16 to 32 slots a q-gram."""
    return max(16, int(n).bit_length() + 4)


def save(arrays: dict[str, np.ndarray], uri: str) -> None:
    """A line of sizes, then the arrays, each at a multiple of 64 bytes."""
    head = json.dumps({name: len(arrays[name]) for name in ARRAYS}).encode() + b"\n"
    with open_output(uri) as f:
        f.write(head + b" " * (-len(head) % 64))
        for name, kind in ARRAYS.items():
            raw = np.ascontiguousarray(arrays[name], kind)
            f.write(memoryview(raw).cast("B") if len(raw) else b"")
            f.write(b"\0" * (-raw.nbytes % 64))


def load(uri: str) -> dict[str, np.ndarray]:
    """What save() wrote: mapped where the folder is mounted, else read."""
    raw = mapped(uri)
    line = bytes(raw[:1024]).split(b"\n", 1)[0]
    at, out = len(line) + 1, {}
    for name, n in json.loads(line).items():
        at += -at % 64
        out[name] = np.frombuffer(raw, ARRAYS[name], n, at)
        at += out[name].nbytes
    return out


class Index:
    """Search of texts for the pieces of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]] | dict[str, np.ndarray], s: Settings):
        held = items if isinstance(items, dict) else laid_out(items, s)
        self.s, self.data, self.begin, self.owner, self.owners = s, held["data"], held["begin"], held["owner"], held["owners"]
        self.code, self.part, self.place, self.bits = held["code"], held["part"], held["place"], held["bits"]
        self.k, m = held["edits"].astype(np.int64), np.diff(held["begin"])
        self.short = pickle.loads(held["short"].tobytes()) if len(held["short"]) else None
        self.shift = np.uint64(64 - slot_bits(len(self.code)))
        self.least = m + 1 - s.q - self.k * s.q
        # A stretch of m + k bytes is covered by so many windows; one of them holds that share of the q-grams.
        cover = -(-(m + self.k) // s.window)
        self.flag = int(np.min(-(-self.least // cover))) if len(m) else 1 << 60
        self.longest = int((m + 2 * self.k).max()) if len(m) else 0
        self.widest = int(m.max()) if len(m) else 0

    @property
    def parts(self) -> list[bytes]:
        """The pieces."""
        return [self.data[a:b].tobytes() for a, b in zip(self.begin, self.begin[1:], strict=False)]

    def search(self, text: bytes) -> dict[int, tuple[int, int, int]]:
        """By item, (edits, start, end) in the normal form of the best alignment in budget."""
        best: dict[int, tuple[int, int, int]] = {}
        if self.short is not None:
            # Bytes as characters of their own, so that places are those of the bytes.
            for end, (n, ids) in self.short.iter(f" {text.decode('latin-1')} "):
                for item in ids:
                    best.setdefault(item, (0, end - n - 1, end - 1))
        self._search_long(text, best)
        return best

    def _search_long(self, text: bytes, best: dict[int, tuple[int, int, int]]) -> None:
        s = self.s
        data = np.frombuffer(text, np.uint8)
        if len(data) < s.q or not len(self.k):
            return
        code = codes(data, s.q)
        slot = code >> self.shift
        at = np.flatnonzero(self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        if len(at) < self.flag:
            return
        lo = np.searchsorted(self.code, code[at], "left")
        real = self.code[np.minimum(lo, len(self.code) - 1)] == code[at]
        at, lo = at[real], lo[real]
        if len(at) < self.flag:
            return
        # Positions from which a window holds enough hits, and what an alignment there may reach.
        n = len(code)
        total = np.zeros(n + 1, np.int64)
        total[at + 1] = 1
        np.cumsum(total, out=total)
        dense = np.flatnonzero(total[np.minimum(np.arange(n) + s.window, n)] - total[:-1] >= self.flag)
        if not len(dense):
            return
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.maximum(0, dense - self.longest), 1)
        np.add.at(near, np.minimum(n, dense + s.window + self.longest), -1)
        keep = np.cumsum(near[:-1])[at] > 0
        at, lo = at[keep], lo[keep]
        many = np.searchsorted(self.code, code[at], "right") - lo
        for a, b in self._stretches(at, many):
            for first, where in self._entries(lo[a:b], many[a:b]):
                part = self.part[where].astype(np.int64)
                step = (at[a:b][first] - self.place[where] + self.widest) // (self.k[part] + 1)
                for p, at_step in self._counts(part, step):
                    self._align(text, p, at_step, best)

    def _stretches(self, at: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of hits [a, b) of about ``hits`` entries, but of twice the longest alignment at least; each
        begins so far before the end of the last that no alignment is in neither."""
        upto = np.concatenate([[0], np.cumsum(many)])
        a = 0
        while a < len(at):
            b = max(int(np.searchsorted(upto, upto[a] + self.s.hits, "right")) - 1, int(np.searchsorted(at, at[a] + 2 * self.longest, "right")))
            yield a, b
            if b >= len(at):
                return
            a = int(np.searchsorted(at, at[b] - self.longest))

    def _entries(self, lo: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hit, place in the index) of all entries of some hits; in turn by ranges of pieces where they are more than ``hits``."""
        total = int(many.sum())
        turns = min(len(self.k), max(1, -(-total // (2 * self.s.hits))))
        cuts = np.linspace(0, len(self.k), turns + 1).astype(np.int64)
        for low, high in zip(cuts, cuts[1:], strict=False):
            if turns > 1:  # within a code, pieces ascend
                runs = [np.searchsorted(self.part[x : x + y], (low, high)) for x, y in zip(lo, many, strict=True)]
                begin, n = lo + np.array([r[0] for r in runs]), np.array([r[1] - r[0] for r in runs])
            else:
                begin, n = lo, many
            first = np.repeat(np.arange(len(n)), n)
            yield first, np.arange(len(first)) + np.repeat(begin - (np.cumsum(n) - n), n)

    def _counts(self, part: np.ndarray, step: np.ndarray) -> list[tuple[int, int]]:
        """(segment, first step) of the bands of two steps that hold enough q-gram hits."""
        key = np.concatenate([part * (1 << 40) + step + 1, part * (1 << 40) + step])
        key, size = np.unique(key, return_counts=True)
        p = key >> 40
        good = size >= self.least[p]
        return [(int(a), int(b) - 1) for a, b in zip(p[good], key[good] & ((1 << 40) - 1), strict=True)]

    def _align(self, text: bytes, p: int, step: int, best: dict) -> None:
        piece, k = self.data[self.begin[p] : self.begin[p + 1]].tobytes(), int(self.k[p])
        items = [i for i in self.owners[self.owner[p] : self.owner[p + 1]].tolist() if i not in best or best[i][0]]
        if not items:
            return
        first = step * (k + 1) - self.widest  # the band's lowest diagonal: document place less segment place
        last = first + 2 * k + 1
        at = text.find(piece, max(0, first), max(0, last + len(piece)))
        found = (0, at + len(piece)) if at >= 0 else banded(piece, text, first, last, k)
        if found is not None:
            for item in items:
                if item not in best or found[0] < best[item][0]:
                    best[item] = (found[0], max(0, found[1] - len(piece)), found[1])


def banded(piece: bytes, text: bytes, first: int, last: int, k: int) -> tuple[int, int] | None:
    """(edits, end) of the best alignment of the piece with a stretch of the text, or None beyond k edits.

    Only diagonals (text place less piece place) from first to last are filled: 2k + 2 cells for each byte of the piece.
    """
    n, far = len(text), 1 << 20
    diagonal = np.arange(first, last + 1)
    # Places first - 1 to last + len(piece) of the text; those outside it match nothing.
    lo, hi = max(0, first), min(n, last + len(piece) + 1)
    around = np.full(last - first + 1 + len(piece), -1, np.int16)
    if hi > lo:
        around[lo - first : hi - first] = np.frombuffer(text, np.uint8, hi - lo, lo)
    ramp = np.arange(len(diagonal))
    row = np.where((diagonal >= 0) & (diagonal <= n), 0, far)
    for i, c in enumerate(piece):
        new = row + (around[i : i + len(diagonal)] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - ramp) + ramp
        place = diagonal + i + 1
        row = np.where((place >= 0) & (place <= n), new, far)
        if row.min() > k:
            return None
    at = int(row.argmin())
    return int(row[at]), int(diagonal[at]) + len(piece)


def indexes(benchmark: DataFrame, s: Settings = Settings()) -> list[str]:
    """Files of the benchmark's blocks: one for each, written by a task that holds the block. The driver holds their names."""
    weight = 3 * F.coalesce(F.length("text"), F.lit(0)) + F.when(F.length("text") < s.q + 8, 1200).otherwise(0)  # an automaton is larger
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    if not total:
        return []
    blocks = 1 if total <= s.block_bytes else -(-5 * total // (4 * s.block_bytes))
    folder = scratch(benchmark.sparkSession, "benchmark-grams")

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        items = [x for b in batches for x in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
        uri = f"{folder}/{uuid.uuid4().hex}"
        save(laid_out(sorted(items, key=lambda x: (x[0], x[1] or "")), s), uri)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int64()), "uri": [uri]})

    made = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).groupBy("block").applyInArrow(build, "block long, uri string")
    return [r["uri"] for r in sorted(made.collect())]


def _searched(batches: Iterator[pa.RecordBatch], at: int, uris: list[str], s: Settings) -> Iterator[tuple[pa.RecordBatch, list[dict[int, tuple[int, int, int]]]]]:
    """Each batch with what is found in each of its texts (column ``at``), best places of all blocks."""

    def through(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        found: list[list[dict]] = [[{} for _ in range(b.num_rows)] for b in held]
        for k in range(len(uris)):
            index = only or Index(load(uris[k]), s)
            for b, of in zip(held, found, strict=True):
                for best, text in zip(of, b.column(at), strict=True):
                    for item, place in index.search(normal(text.as_py())).items():
                        if item not in best or place[0] < best[item][0]:
                            best[item] = place
        yield from zip(held, found, strict=True)

    only = Index(load(uris[0]), s) if len(uris) == 1 else None
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if only or size >= s.round_bytes:
            yield from through(held)
            held, size = [], 0
    yield from through(held)


def decontaminate(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_items, items (benchmark ids found, ascending), spans (of the normal form), contaminated."""
    held = "array<struct<item: long, edits: int, start: long, stop: long>>"
    uris, kind = indexes(benchmark, s), pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _searched(batches, 1, uris, s):
            out = [[{"item": i, "edits": e, "start": x, "stop": y} for i, (e, x, y) in sorted(best.items())] for best in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "found"])

    only = docs.select("doc_id", "text")
    now = only.mapInArrow(trimmed(run), f"doc_id {only.schema['doc_id'].dataType.simpleString()}, found {held}")
    span = lambda f: F.format_string("%d:%d-%d~%d", f["item"], f["start"], f["stop"], f["edits"])
    return now.select("doc_id", F.size("found").alias("n_items"), F.col("found.item").alias("items"), F.transform("found", span).alias("spans"), (F.size("found") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents in which no block of the benchmark is found, all columns and rows as they are; narrow."""
    at, uris = docs.columns.index("text"), indexes(benchmark, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _searched(batches, at, uris, s):
            yield b.filter(pa.array([not x for x in found], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
