"""Suffix dedup by bucket-pointer refinement: bytes covered by a string of 100 bytes that starts earlier too.

A filter of anchors finds the suffixes that are worth sorting; those are refined by sorting:

1. Filter. Composed hashes name the 16-, 32- and 64-grams at every position. Of the 69 32-grams in a string of 100
   bytes the one with the least name (the first of equals) is its anchor. A stretch of strings with one anchor is a run;
   its name is (string at its start, string at its end, place of the anchor). Equal strings have equal anchors: an anchor
   with one run is settled, and of runs equal as a whole all but the first are repeats. Each task combines its own
   runs first, so that a passage that a third of all documents share sends one row a task.
2. Where different runs share an anchor, their first occurrences go on as bytes. A string holds 34 bytes after its
   anchor or 35 before, so each run is cut in two at most, and the anchor with these bytes is the q-gram of 66 whose
   bucket its strings belong to. Buckets meet in tasks.
3. Refinement, on the bytes, within a task: the positions of some buckets are sorted by their 8 bytes and numbered, equal
   ones alike. Then positions are sorted by (number, number 8 bytes on) and numbered anew, in place, and again with 16, 32
   and 36 bytes, each pass using the numbers that the last one wrote at both ends. A number with one position is settled:
   neither it nor any string that holds it is sorted again. Positions of one number at the end are strings of
   100 equal bytes; all but the first are repeats.
4. A bucket of more than `OVERFULL` runs never meets in one task: its strings are told apart by composed names (96
   bits) instead, dealt by name and combined in each task before they move.

Rows move as compressed column blocks, one for each partition a task has rows for. Text moves twice, compressed, by
doc_id and hash of the text (so that rows without a doc_id are spread), to be met by the blocks for its documents.
Names of the filter are 64 bits wide and compared only in buckets that agree before, so unequal runs meet with
a chance of about pairs / 2**64 at least; numbers of the refinement are exact.

Defined cases: null is empty; empty texts and those under 100 bytes have no strings and stay; matches never cross
documents; rows that repeat id and text are one document, and of rows with one id the smaller hash of the text is
earlier; a null doc_id comes first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import partitions, release, trimmed, utf8, written

#: Bytes of a string, of an anchor, and anchors in a string.
LENGTH, GRAM = 100, 32
WIDTH = LENGTH - GRAM + 1
#: Bytes worked on at a time, and runs a task holds before it combines and sends them.
CHUNK, HELD = 1 << 19, 2_000_000
NULL_ID = -(1 << 63)
MOVED = "part int, kind int, data binary"
RUNS, REPEATS, ASKED, CONTEXTS = 0, 1, 2, 3
#: Bytes of a run with one bucket: a string and 34 more. Strings that begin up to HALF before the anchor go by what follows it.
WIDE, HALF = 134, 34
KINDS = ["<u8", "<u4", "u1", f"V{WIDE}"]
#: Runs of a bucket that a task takes at most, runs refined at a time, and overfull buckets known by name (of more,
#: the rest hold at most one run in that many each).
OVERFULL, TOGETHER, LISTED = 1 << 13, 1 << 13, 100_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def refined(here: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Name of the pair of a bucket and the bucket at a later offset."""
    x = here * _A
    x += (later ^ (later >> np.uint64(29))) * _B
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as numbers (the last 7 padded)."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", pad, strides=(1,)).copy()


class Grams:
    """Buckets of the positions of some bytes."""

    def __init__(self, data: np.ndarray):
        self.eight = eights(data)
        n = len(data)
        sixteen = refined(self.eight[: n - 8], self.eight[8:])
        self.g32 = refined(sixteen[: n - GRAM + 1], sixteen[16 : n - GRAM + 17])

    def string(self, at: np.ndarray) -> np.ndarray:
        """Buckets of the strings of 100 at some positions, by way of 64."""
        first = refined(self.g32[at], self.g32[at + 32])
        second = refined(self.g32[at + 36], self.g32[at + 68])
        return refined(first, second)

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names of the strings of 100 at some positions: 64 and 32 bits."""
        a, b = np.full(len(at), 1, np.uint64), np.full(len(at), 2, np.uint64)
        for k in (*range(0, 96, 8), 92):
            x = self.eight[at + k]
            a = refined(a, x)
            b = (b ^ x) * _B
            b ^= b >> np.uint64(28)
        return a, ((b * _A) >> np.uint64(32)).astype(np.uint32)

    def anchors(self) -> np.ndarray:
        """For each string of 100, the position of its least 32-gram, the first of equals."""
        value, index = self.g32, np.arange(len(self.g32), dtype=np.int32)
        reach = 1
        while reach < WIDTH:
            step = min(reach, WIDTH - reach)
            right = value[step:] < value[:-step]
            value, index = np.where(right, value[step:], value[:-step]), np.where(right, index[step:], index[:-step])
            reach += step
        return index


def runs_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor bucket, run name, start in the document, further strings) of texts end to end in data."""
    long_enough = np.diff(edges) >= LENGTH
    if not long_enough.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    g = Grams(data)
    anchor = g.anchors()
    n = len(anchor)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[:n]
    valid = np.arange(n) + LENGTH <= edges[doc + 1]
    fresh = valid.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(fresh)
    # A run ends where the next one begins or the document's strings end.
    hi = np.minimum(np.append(lo[1:], n) - 1, edges[doc[lo] + 1] - LENGTH)
    a = anchor[lo]
    shape = ((a - lo).astype(np.uint64) << np.uint64(8)) | (hi - lo).astype(np.uint64)
    return doc[lo], g.g32[a], refined(refined(g.string(lo), g.string(hi)), shape), lo - edges[doc[lo]], hi - lo


def blocks(part: np.ndarray, columns: list[np.ndarray], docs: np.ndarray, doc: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, kind, block) of rows by part. docs: a row (id, hash, part) for each document; doc: an index into it."""
    z = zstandard.ZstdCompressor(level=1)
    order = np.lexsort((doc, part))
    part, doc, columns = part[order], doc[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(edge, np.append(edge[1:], len(part)), strict=True):
        used, index = np.unique(doc[lo:hi], return_inverse=True)
        head = np.array([hi - lo, len(used)], "<i8").tobytes()
        step = np.diff(index, prepend=0).astype("<u4")
        body = head + np.ascontiguousarray(docs[used]).tobytes() + step.tobytes() + b"".join(np.ascontiguousarray(c[lo:hi]).tobytes() for c in columns)
        yield int(part[lo]), kind, z.compress(body)


def unblock(data: list[bytes], kinds: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """docs, doc, columns of some blocks together. Documents are listed once, in their order."""
    z = zstandard.ZstdDecompressor()
    tables, index, columns, seen = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)], [[np.zeros(0, k)] for k in kinds], 0
    for d in data:
        raw = z.decompress(d)
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16
        tables.append(np.frombuffer(raw, "<i8", 3 * m, at).reshape(m, 3))
        at += 24 * m
        index.append(np.cumsum(np.frombuffer(raw, "<u4", n, at).astype(np.int64)) + seen)
        at += 4 * n
        for c, k in zip(columns, kinds, strict=True):
            c.append(np.frombuffer(raw, k, n, at))
            at += np.dtype(k).itemsize * n
        seen += m
    docs, of = distinct(np.concatenate(tables))
    return docs, of[np.concatenate(index)], [np.concatenate(c) for c in columns]


def distinct(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (id, hash, part) rows in order of id and hash, and where each row went."""
    if not len(docs):
        return docs, np.zeros(0, np.int64)
    order = np.lexsort((docs[:, 1], docs[:, 0]))
    s = docs[order]
    new = np.append(True, (s[1:, :2] != s[:-1, :2]).any(1))
    place = np.empty(len(docs), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[new], place


def settle_runs(docs, doc, anchor, name, lo, span, several, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """One round over runs that a task holds; several: an anchor that some task has seen with different runs.

    Repeats and strings asked for go to the documents' parts; with ``parts``, runs that are alone go on by anchor.
    """
    order = np.lexsort((lo, doc, name, anchor))
    doc, anchor, name, lo, span, several = (x[order] for x in (doc, anchor, name, lo, span, several))
    new_name = np.append(True, (name[1:] != name[:-1]) | (anchor[1:] != anchor[:-1]))[: len(name)] | several
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])[: len(name)]
    group = np.cumsum(new_anchor) - 1
    repeat = ~new_name
    if repeat.any():
        yield from ranges(docs, doc[repeat], lo[repeat], lo[repeat] + span[repeat] + LENGTH)
    held = np.bincount(group, weights=new_name) if len(group) else np.zeros(0)
    mixed = (held > 1)[group]
    ask = mixed & new_name & ~several
    if ask.any():
        yield from blocks(docs[doc[ask], 2], [lo[ask].astype("<u4"), span[ask].astype("u1")], docs, doc[ask], ASKED)
    if parts:
        alone = new_name & ~mixed
        tell = mixed & new_anchor  # one row says that the anchor has different runs
        send = alone | tell
        part = (anchor[send] % np.uint64(parts)).astype(np.int64)
        flag = tell[send].astype("u1")
        yield from blocks(part, [anchor[send], name[send], lo[send].astype("<u4"), span[send].astype("u1"), flag], docs, doc[send], RUNS)


def ranges(docs: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of byte ranges, those that touch joined, for the documents' parts."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    # In one document the furthest end so far; documents are kept apart by a stride beyond any length.
    far = np.maximum.accumulate(hi + doc * (1 << 40))
    new = np.append(True, (lo[1:] + doc[1:] * (1 << 40)) > far[:-1])
    first = np.flatnonzero(new)
    end = far[np.append(first[1:], len(far)) - 1] - doc[first] * (1 << 40)
    yield from blocks(docs[doc[first], 2], [lo[first].astype("<u4"), end.astype("<u4")], docs, doc[first], REPEATS)


def _moved(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > 1 << 23:
            yield _moved_batch(held)
            held, size = [], 0
    if held:
        yield _moved_batch(held)


def _moved_batch(held: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["part", "kind", "data"])


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents a few at a time: about CHUNK bytes, or one document of any length."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, "right")) - 1)
        yield start, min(stop, len(offsets) - 1)
        start = stop


def first_round(parts: int):
    """Documents (part, doc_id, th, text) to runs by anchor, and what the task settles itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows, seen, held = [], [], 0, 0
        for b in batches:
            table = np.stack([np.asarray(b.column(1)), np.asarray(b.column(2)), np.asarray(b.column(0)).astype(np.int64)], 1)
            offsets, data = utf8(b.column(3))
            tables.append(table)
            for lo, hi in _chunks(offsets):
                edges = offsets[lo : hi + 1] - offsets[lo]
                found = runs_of(data[offsets[lo] : offsets[hi]], edges)
                rows.append((found[0] + seen + lo, *found[1:3], found[3].astype(np.uint32), found[4].astype(np.uint8)))
                held += len(found[0])
            seen += len(table)
            if held > HELD:
                yield from _moved(combine(tables, rows))
                tables, rows, seen, held = [], [], 0, 0
        if rows:
            yield from _moved(combine(tables, rows))

    def combine(tables: list, rows: list) -> Iterator[tuple[int, int, bytes]]:
        docs, place = distinct(np.concatenate(tables))
        doc, anchor, name, lo, span = (np.concatenate(x) for x in zip(*rows, strict=True))
        yield from settle_runs(docs, place[doc], anchor, name, lo.astype(np.int64), span.astype(np.int64), np.zeros(len(doc), bool), parts)

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    part, held = None, {}
    for b in batches:
        for p, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if p != part and held:
                yield part, held
                held = {}
            part = p
            held.setdefault(kind, []).append(data.as_py())
    if held:
        yield part, held


def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a part, from all tasks, settled; what tasks have settled passes through."""
    for part, held in _by_part(batches):
        for kind in (REPEATS, ASKED):
            yield from _moved((part, kind, d) for d in held.get(kind, ()))
        if RUNS in held:
            docs, doc, (anchor, name, lo, span, flag) = unblock(held[RUNS], ["<u8", "<u8", "<u4", "u1", "u1"])
            yield from _moved(settle_runs(docs, doc, anchor, name, lo.astype(np.int64), span.astype(np.int64), flag.astype(bool), 0))


def _texts(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    z = zstandard.ZstdDecompressor()
    for doc_id, th, data in zip(table.column("doc_id").to_pylist(), table.column("th").to_pylist(), table.column("packed"), strict=True):
        yield doc_id, th, z.decompress(data.as_py())


def third_round(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a part and the runs asked for there: the runs' bytes, each with its bucket."""
    out: list[tuple[int, int, bytes]] = []
    if right.num_rows and left.num_rows:
        docs, doc, (lo, span) = unblock([x.as_py() for x in right.column("data")], ["<u4", "u1"])
        order = np.argsort(doc, kind="stable")
        doc, lo, span = doc[order], lo[order].astype(np.int64), span[order].astype(np.int64)
        edge = np.searchsorted(doc, np.arange(len(docs) + 1))
        where = {(int(a), int(b)): k for k, (a, b, _) in enumerate(docs)}
        rows, held = [], 0
        for doc_id, th, text in _texts(left):
            k = where.pop((doc_id, th), None)
            if k is None:
                continue
            for cut in range(edge[k], edge[k + 1], TOGETHER):
                here = slice(cut, min(cut + TOGETHER, edge[k + 1]))
                found = contexts(np.frombuffer(text, np.uint8), lo[here], lo[here] + span[here])
                rows.append((np.full(len(found[0]), k), *found))
                held += len(found[0])
                if held > TOGETHER:
                    out += context_blocks(docs, rows, 1)
                    rows, held = [], 0
        out += context_blocks(docs, rows, 1)
    return pa.Table.from_batches(list(_moved(iter(out))), schema=pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())]))


def contexts(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, first string, strings, bytes) of the runs of strings lo to hi of a text, cut where the bucket changes."""
    first = int(lo.min())
    text = text[first : int(hi.max()) + 2 * LENGTH]  # what the runs and their anchors reach
    lo, hi = lo - first, hi - first
    g = Grams(text).g32
    anchor = lo + np.argmin(g[lo[:, None] + np.arange(WIDTH)], axis=1)
    late = hi >= anchor - HALF
    early = lo < anchor - HALF
    after = refined(g[anchor[late]], g[anchor[late] + HALF])
    before = refined(g[anchor[early] - HALF - 1], g[anchor[early]]) ^ _C
    start = np.concatenate([np.maximum(lo, anchor - HALF)[late], lo[early]])
    end = np.concatenate([hi[late], np.minimum(hi, anchor - HALF - 1)[early]])
    many = end - start + 1
    column = np.arange(WIDE)
    body = np.where(column < (many + LENGTH - 1)[:, None], text[np.minimum(start[:, None] + column, len(text) - 1)], 0).astype(np.uint8)
    return np.concatenate([after, before]), (start + first).astype(np.uint32), many.astype(np.uint8), body.view(f"V{WIDE}")[:, 0]


def context_blocks(docs: np.ndarray, rows: list[tuple], parts: int) -> list[tuple[int, int, bytes]]:
    if not rows:
        return []
    doc, key, *rest = (np.concatenate(x) for x in zip(*rows, strict=True))
    return list(blocks((key % np.uint64(parts)).astype(np.int64), [key, *rest], docs, doc, CONTEXTS))


def bucket_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, runs) of blocks of runs' bytes."""
    for b in batches:
        for data in b.column("data"):
            key, n = np.unique(unblock([data.as_py()], KINDS)[2][0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["bucket", "n"])


def dealt_contexts(parts: int, overfull: np.ndarray):
    """Runs' bytes by bucket; strings of overfull buckets by name, combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data"):
                docs, doc, columns = unblock([data.as_py()], KINDS)
                much = np.isin(columns[0], overfull)
                yield from _moved(iter(context_blocks(docs, [(doc[~much], *[c[~much] for c in columns])], parts)))
                if much.any():
                    yield from _moved(by_name(docs, doc[much], *[c[much] for c in columns[1:]], parts))

    return run


def by_name(docs, doc, lo, many, body, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """One round over the single strings of runs, told apart by their names."""
    row = np.repeat(np.arange(len(doc)), many)
    step = np.arange(len(row)) - np.repeat(np.cumsum(many, dtype=np.int64) - many, many)
    a, b = Single(body.tobytes()).names(row * WIDE + step)
    yield from settle_strings(docs, doc[row], a, b, lo[row].astype(np.int64) + step, parts)


def refine(body: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, number) of the strings of 100 in rows of bytes that are not alone; equal strings have equal numbers."""
    size = len(body) * WIDE
    room = (many.astype(np.int16) + LENGTH - 1)[:, None] - np.arange(WIDE, dtype=np.int16)
    room = room.ravel()  # bytes from a position to its row's end
    number = np.full(size + LENGTH, -1, np.int64)  # -1: settled

    def renumber(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        at, key = at[order], key[order]
        group = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]) - 1
        several = (np.bincount(group) > 1)[group] if len(group) else np.zeros(0, bool)
        number[:] = -1
        number[at[several]] = group[several]
        return np.flatnonzero(number >= 0)

    at = np.flatnonzero(room >= 8)
    at = renumber(at, eights(np.frombuffer(body.tobytes(), np.uint8))[at])
    depth = 8
    for step in (8, 16, 32, 36):
        depth += step
        at = at[(room[at] >= depth) & (number[at + step] >= 0)]
        at = renumber(at, number[at] * size + number[at + step])
    return at // WIDE, at % WIDE, number[at]


def settle_contexts(docs, doc, key, lo, many, body) -> Iterator[tuple[int, int, bytes]]:
    """Buckets that met in a task, some at a time. A bucket of one run has no two equal strings: their anchor is one."""
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])[: len(key)]
    size = np.bincount(np.cumsum(new) - 1) if len(key) else np.zeros(0, np.int64)
    order = order[np.repeat(size > 1, size)]
    size = size[size > 1]
    edge = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(edge, edge[start] + TOGETHER, "right")) - 1)
        r = order[edge[start] : edge[stop]]
        start = stop
        if len(r) > max(OVERFULL, TOGETHER):
            yield from by_name(docs, doc[r], lo[r], many[r], body[r], 0)
            continue
        row, place, number = refine(body[r], many[r])
        d, at = doc[r][row], lo[r][row].astype(np.int64) + place
        by = np.lexsort((at, d, number))
        again = by[1:][number[by][1:] == number[by][:-1]]
        if len(again):
            yield from ranges(docs, d[again], at[again], at[again] + LENGTH)


class Single(Grams):
    """Names of strings alone need the 8-grams only."""

    def __init__(self, text: bytes):
        self.eight = eights(np.frombuffer(text, np.uint8))


def settle_strings(docs, doc, a, b, at, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Of equal strings all but the first are repeats; with ``parts``, the first go on by name."""
    order = np.lexsort((at, doc, b, a))
    doc, a, b, at = doc[order], a[order], b[order], at[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    if not new.all():
        yield from ranges(docs, doc[~new], at[~new], at[~new] + LENGTH)
    if parts and len(a):
        yield from blocks((a[new] % np.uint64(parts)).astype(np.int64), [a[new], b[new], at[new].astype("<u4")], docs, doc[new], RUNS)


def fourth_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of a part, from all tasks, refined, and single strings settled by name; ranges pass through."""
    for part, held in _by_part(batches):
        yield from _moved((part, REPEATS, d) for d in held.get(REPEATS, ()))
        if RUNS in held:
            docs, doc, (a, b, at) = unblock(held[RUNS], ["<u8", "<u4", "<u4"])
            yield from _moved(settle_strings(docs, doc, a, b, at.astype(np.int64), 0))
        if CONTEXTS in held:
            docs, doc, columns = unblock(held[CONTEXTS], KINDS)
            yield from _moved(settle_contexts(docs, doc, *columns))


def kept(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and the bytes that stay."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    pieces, at = [], 0
    for a, b in out:
        pieces.append(text[at:a])
        at = b
    pieces.append(text[at:])
    return out, b"".join(pieces)


RESULT = "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _last_round(digest: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, doc, (lo, hi) = unblock([x.as_py() for x in right.column("data")], ["<u4", "<u4"])
        order = np.argsort(doc, kind="stable")
        lo, hi = lo[order].astype(np.int64), hi[order].astype(np.int64)
        edge = np.searchsorted(doc[order], np.arange(len(docs) + 1))
        where = {(int(a), int(b)): k for k, (a, b, _) in enumerate(docs)}
        none = np.zeros(0, np.int64)
        rows = []
        for doc_id, th, text in _texts(left):
            k = where.get((doc_id, th))
            runs, rest = kept(text, none, none) if k is None else kept(text, lo[edge[k] : edge[k + 1]], hi[edge[k] : edge[k + 1]])
            doc_id = None if doc_id == NULL_ID else doc_id
            if digest:
                rows.append((doc_id, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
            else:
                rows.append((doc_id, len(text), [{"start": a, "end": b} for a, b in runs], rest))
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64())]
        kinds += [("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] if digest else [("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def by_part(docs: DataFrame, parts: int) -> DataFrame:
    """part, doc_id, th, text: parts go by id and text, so that rows without an id are spread."""
    ident, text = F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), F.coalesce(F.col("text"), F.lit(""))
    part = F.pmod(F.xxhash64(ident, F.xxhash64(text)), F.lit(parts)).cast("int")
    return docs.select(part.alias("part"), ident.alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, removed (maximal runs), kept (bytes); or their digest: n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    parts = partitions(docs)
    keyed = by_part(docs, parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            offsets, data = utf8(b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([z.compress(data[lo:hi]) for lo, hi in zip(offsets, offsets[1:], strict=False)], pa.binary())], ["part", "doc_id", "th", "packed"])

    # Both sides of a cogroup are dealt into as many partitions as there are parts, whatever the session's setting.
    packed = keyed.mapInArrow(pack, "part int, doc_id long, th long, packed binary").repartition(parts, "part").groupBy("part")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "part").sortWithinPartitions("part", "kind")

    one = written(dealt(keyed.mapInArrow(trimmed(first_round(parts)), MOVED)).mapInArrow(trimmed(second_round), MOVED), "suffix-runs")
    release(spark)
    asked = one.where(F.col("kind") == ASKED)
    met = packed.cogroup(asked.repartition(parts, "part").groupBy("part")).applyInArrow(third_round, MOVED)
    met = written(met, "suffix-contexts")
    release(spark)
    sizes = met.mapInArrow(bucket_sizes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > OVERFULL)
    overfull = np.array([r["bucket"] for r in sizes.orderBy(F.desc("n"), "bucket").limit(LISTED).collect()], np.int64).view(np.uint64)
    two = written(dealt(met.mapInArrow(trimmed(dealt_contexts(parts, overfull)), MOVED)).mapInArrow(trimmed(fourth_round), MOVED), "suffix-strings")
    release(spark)
    repeats = one.where(F.col("kind") == REPEATS).unionByName(two)
    return packed.cogroup(repeats.repartition(parts, "part").groupBy("part")).applyInArrow(_last_round(digest), DIGEST if digest else RESULT)
