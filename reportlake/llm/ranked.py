"""Ranked lexical search: an inverted treap for each term, and a traversal of all terms of a query at once.

Documents are indexed where they are read: a task gathers documents into shards of about ``postings_a_shard`` postings
and lays out, for each term of a shard, its documents in doc_id order with the impacts (what an occurrence there is worth
before the term's weight) and the links of a treap over them: search order by document, heap order by impact, equal
impacts by a scrambled place, so that trees are shallow. A shard's treaps are rows of a table, one a term, so a search
reads the rows of its terms alone; texts are never shuffled. Impacts depend on the number of documents and of terms in
all, which one earlier pass counts.

A search sends the treaps of its terms to one group a shard. There the items' terms start with the roots of their treaps
and the whole range of documents. The largest impacts in a range are those of its highest treap nodes; where their
weighted sum cannot enter the item's top k of the shard, the range is dropped. Else the document of the strongest
node is scored in all terms and parts the range in two, each with the highest nodes of either side. All ranges of many items go on
together, level by level, as arrays. A shard returns k documents for each item at most, and these are ranked, first in
groups of shards, then in all.

The driver holds items' terms of one block (``terms_a_block`` at most; more are searched block by block) and the two
counts. A task holds one shard, or the treaps of one shard.

Defined cases: a null text has no terms and such a document is never found; a null doc_id sorts before others and comes
back null; rows that repeat a doc_id are documents each, so an identifier may come up more than once; equal scores are
ranked by doc_id; a very long document is a shard of its own at most; a null item_id is an item; items that repeat an
item_id are one item with the terms of all; items without terms, or whose terms no document has, return no row; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import trimmed, written

NULL_ID = -(1 << 63)
INDEX = "shard long, term binary, n int, docs binary, impacts binary, lower binary, higher binary"
INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]

#: Bytes of terms: ASCII digits and letters, capitals as small ones, and all of letters beyond ASCII; others part terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    k: int = 50
    postings_a_shard: int = 1_000_000
    terms_a_block: int = 500_000
    frontier: int = 1_000_000  # postings of the items that are searched together in a shard
    merges: int = 64  # groups of shards whose best are ranked before all are


@dataclass(frozen=True)
class Index:
    """treaps: rows of INDEX, and for each shard one row without a term, whose docs are its doc_ids."""

    treaps: DataFrame
    documents: int
    terms: int


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LETTERS).split() if text else []


# ---------------------------------------------------------------------------- treaps


def links(priority: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(roots, lower, higher) of one treap for each stretch [first, end) of postings; -1 where there is no child.

    priority: distinct numbers. All stretches grow by a level at a time: the largest of a stretch is its root and parts it in two.
    """
    n = len(priority)
    place = np.full(n + 1, -1, np.int64)
    lower, higher = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    order = np.argsort(priority, kind="stable")
    place[order] = np.arange(n)  # ranks: the root of a stretch is where its largest rank stands
    roots = None
    owner, side = None, None
    while len(first):
        marks = np.empty(2 * len(first), np.int64)
        marks[0::2], marks[1::2] = first, end
        root = order[np.maximum.reduceat(place, marks)[0::2]]
        if roots is None:
            roots = root
        else:
            lower[owner[~side]] = root[~side]
            higher[owner[side]] = root[side]
        left, right = root > first, root + 1 < end
        # Stretches stay in ascending order, as reduceat wants them.
        both = np.argsort(np.concatenate([first[left], root[right] + 1]), kind="stable")
        owner = np.concatenate([root[left], root[right]])[both]
        side = np.concatenate([np.zeros(left.sum(), bool), np.ones(right.sum(), bool)])[both]
        first, end = np.concatenate([first[left], root[right] + 1])[both], np.concatenate([root[left], end[right]])[both]
    return roots if roots is not None else np.zeros(0, np.int64), lower, higher


def scrambled(n: int) -> np.ndarray:
    """Numbers that look drawn at random, for ties of impact."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


class Shard:
    """Documents gathered by a task until there are enough."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.term, self.tf, self.distinct, self.length, self.ids = array("i"), array("q"), array("q"), array("q"), array("q")

    def add(self, doc_id: int, words: list[bytes]) -> None:
        counts = Counter(words)
        self.term.extend(map(self.vocabulary.__getitem__, counts))
        self.tf.extend(counts.values())
        self.distinct.append(len(counts))
        self.length.append(len(words))
        self.ids.append(doc_id)

    def rows(self, shard: int, documents: int, terms: int) -> Iterator[pa.RecordBatch]:
        """INDEX rows: treaps by term, and the doc_ids."""
        ids, length = np.array(self.ids), np.array(self.length)
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        term, tf = np.array(self.term), np.array(self.tf)
        doc = np.repeat(rank, np.array(self.distinct))
        size = np.repeat(length, np.array(self.distinct))
        order = np.argsort(term.astype(np.int64) * len(ids) + doc, kind="stable")
        term, tf, doc, size = term[order], tf[order], doc[order].astype(np.int32), size[order]
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * size * documents) // terms))
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        end = np.append(first[1:], len(term))
        # Impacts are below 1,000,000.
        _, lower, higher = links((impact << 32) | scrambled(len(term)).astype(np.int64), first, end)
        start = np.repeat(first, end - first).astype(np.int32)
        lower, higher = np.where(lower < 0, -1, lower - start), np.where(higher < 0, -1, higher - start)
        names = list(self.vocabulary)
        offsets = pa.py_buffer(np.append(first, len(term)).astype(np.int32) * 4)
        packed = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(np.ascontiguousarray(x, np.int32))]) for x in (doc, impact, lower, higher)]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([None], pa.binary()), pa.array([len(ids)], pa.int32()), pa.array([ids[by_id].tobytes()], pa.binary()), *[pa.array([b""], pa.binary())] * 3], INDEX_NAMES)
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(first), shard)), pa.array(names, pa.binary()), pa.array((end - first).astype(np.int32)), *packed], INDEX_NAMES)
        for k in range(0, whole.num_rows, 5000):
            yield whole.slice(k, 5000)


def counted(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats) of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for b in batches:
            for text in b.column(0):
                n = len(terms_of(text.as_py()))
                documents, terms = documents + (n > 0), terms + n
        yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [terms]})

    got = docs.select("text").mapInArrow(trimmed(run), "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return int(got[0]), int(got[1])


def index(docs: DataFrame, s: Settings = Settings()) -> Index:
    """All documents in treaps, written to the shared folder."""
    documents, terms = counted(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made, now = TaskContext.get().partitionId() << 32, 0, Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                words = terms_of(text.as_py())
                if words:
                    now.add(NULL_ID if doc_id.as_py() is None else doc_id.as_py(), words)
                if len(now.term) >= s.postings_a_shard:
                    yield from now.rows(place + made, documents, terms)
                    made, now = made + 1, Shard()
        if len(now.ids):
            yield from now.rows(place + made, documents, terms)

    return Index(written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), INDEX), "ranked-treaps"), documents, terms)


# ---------------------------------------------------------------------------- search


def asked(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0), b.column(1), strict=True):
                words = list(set(terms_of(text.as_py())))
                for k in range(0, len(words), 10_000):
                    some = words[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(some), pa.int64()), pa.array(some, pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term binary").distinct()


def topmost(node: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, lower: np.ndarray, higher: np.ndarray) -> np.ndarray:
    """The highest node with a document in [low, high], for each of many treaps at once; -1 where there is none."""
    node = node.copy()
    open_ = np.flatnonzero(node >= 0)
    while len(open_):
        at = node[open_]
        d = doc[at]
        above, below = d > high[open_], d < low[open_]
        go = above | below
        open_, at, above = open_[go], at[go], above[go]
        at = np.where(above, lower[at], higher[at])
        node[open_] = at
        open_ = open_[at >= 0]
    return node


def traverse(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], treaps: tuple[np.ndarray, ...], n_items: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of the k best of each item; equal scores by document.

    pairs: item (ascending), root, weight of each of its terms here; treaps: doc, impact, lower, higher.
    """
    doc, impact, lower, higher = treaps
    item, node, weight = pairs
    group = np.concatenate([[0], np.cumsum(item[1:] != item[:-1])]) if len(item) else np.zeros(0, np.int64)
    at_item = item[np.flatnonzero(np.append(True, item[1:] != item[:-1]))] if len(item) else np.zeros(0, np.int64)
    low, high = np.zeros(len(at_item), np.int32), np.full(len(at_item), np.iinfo(np.int32).max, np.int32)
    least = np.ones(n_items, np.int64)  # a score that enters the item's top k at least
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    while len(group):
        worth = weight * impact[node]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        bound = np.add.reduceat(worth, first)
        alive = bound >= least[at_item]
        keep = alive[group]
        if not keep.any():
            break
        group, node, weight, worth = group[keep], node[keep], weight[keep], worth[keep]
        at_item, low, high = at_item[alive], low[alive], high[alive]
        group = (np.cumsum(alive) - 1)[group]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        # The strongest node's document parts the range.
        top = worth == np.maximum.reduceat(worth, first)[group]
        at = np.flatnonzero(top)
        split = np.empty(len(first), np.int32)
        split[group[at][::-1]] = doc[node[at]][::-1]
        middle = split[group]
        hit = topmost(node, middle, middle, doc, lower, higher)
        score = np.add.reduceat(np.where(hit >= 0, weight * impact[hit], 0), first)
        best = highest(np.concatenate([best[0], at_item]), np.concatenate([best[1], split.astype(np.int64)]), np.concatenate([best[2], score]), k)
        count = np.bincount(best[0], minlength=n_items)
        last = np.cumsum(count) - 1
        full = count >= k
        least[full] = np.maximum(1, best[2][last[full]])
        left = topmost(node, low[group], middle - 1, doc, lower, higher)
        right = topmost(node, middle + 1, high[group], doc, lower, higher)
        n, a, b = len(split), left >= 0, right >= 0
        group = np.concatenate([group[a], group[b] + n])
        node, weight = np.concatenate([left[a], right[b]]), np.concatenate([weight[a], weight[b]])
        used, group = np.unique(group, return_inverse=True) if len(group) else (np.zeros(0, np.int64), group)
        at_item = np.concatenate([at_item, at_item])[used]
        low, high = np.concatenate([low, split + 1])[used], np.concatenate([split - 1, high])[used]
    return best


def highest(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best by item, in order."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    nth = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    keep = (nth < k) & (score > 0)
    return item[keep], doc[keep], score[keep]


FOUND = "shard long, item int, doc_id long, score long"


def _search_block(treaps: DataFrame, asking: list[tuple[int, bytes, int]], s: Settings) -> DataFrame:
    """shard, item (number), doc_id, score: k best of each item and shard. asking: item number, term, weight."""
    of: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for item, term, weight in asking:
        of[term].append((item, weight))
    sent = treaps.sparkSession.sparkContext.broadcast(dict(of))
    n_items = 1 + max(x[0] for x in asking)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        ids, total = np.zeros(0, np.int64), 0
        wanted: list[tuple[int, int, int]] = []  # item, where its treap begins and its weight
        size: dict[int, int] = defaultdict(int)
        for b in batches:
            for term, docs, *rest in zip(*(b.column(c) for c in ("term", "docs", "impacts", "lower", "higher")), strict=True):
                if (name := term.as_py()) is None:
                    ids = np.frombuffer(docs.as_py(), np.int64)
                    continue
                arrays = [np.frombuffer(x.as_py(), np.int32) for x in (docs, *rest)]
                for item, weight in sent.value[name]:
                    wanted.append((item, total, weight))
                    size[item] += len(arrays[0])
                parts[0].append(arrays[0])
                parts[1].append(arrays[1].astype(np.int64))
                parts[2] += [np.where(arrays[2] < 0, -1, arrays[2] + total)]
                parts[3] += [np.where(arrays[3] < 0, -1, arrays[3] + total)]
                total += len(arrays[0])
        if not wanted:
            return
        treap = tuple(np.concatenate(p) for p in parts)
        roots = _roots(treap[2], treap[3], np.unique([w[1] for w in wanted]))
        asked_here = np.array(sorted(wanted), np.int64)
        item, root, weight = asked_here[:, 0], roots[asked_here[:, 1]], asked_here[:, 2]
        # As many items together as their postings allow.
        numbers = np.unique(item)
        block = np.cumsum([size[int(x)] for x in numbers]) // s.frontier
        for x in np.unique(block):
            some = numbers[block == x]
            lo, hi = np.searchsorted(item, some[0]), np.searchsorted(item, some[-1], "right")
            i, d, score = traverse((item[lo:hi] - some[0], root[lo:hi], weight[lo:hi]), treap, int(some[-1] - some[0]) + 1, s.k)
            if len(i):
                found = ids[d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), key[0].as_py(), np.int64)), pa.array((i + some[0]).astype(np.int32)), pa.array(found, mask=found == NULL_ID), pa.array(score)], ["shard", "item", "doc_id", "score"]
                )

    return treaps.groupBy("shard").applyInArrow(run, FOUND)


def _roots(lower: np.ndarray, higher: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """By where a treap begins: its root, the one node that is nobody's child."""
    child = np.zeros(len(lower), bool)
    child[lower[lower >= 0]] = True
    child[higher[higher >= 0]] = True
    out = np.full(len(lower) + 1, -1, np.int64)
    out[begins] = np.flatnonzero(~child)
    return out


def _top(rows: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(at: Index, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item."""
    spark = items.sparkSession
    terms, found = written(asked(items), "ranked-asked"), None
    # A number for each item, dense, and items dealt to blocks by the terms before them.
    counts = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    held = written(counts.repartitionByRange(F.col("item_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "ranked-items")
    before, n, m = [], 0, 0
    for r in held.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("m")).orderBy("part").toLocalIterator():
        before += [F.lit(r["part"]), F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"))]
        n, m = n + r["n"], m + r["m"]
    if not n or not at.terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    in_part = Window.partitionBy("part").orderBy(F.col("item_id").asc_nulls_first())
    start = F.create_map(*before)[F.col("part")]
    numbered = written(held.select("item_id", (start["n"] + F.row_number().over(in_part) - 1).cast("int").alias("item"), F.floor((start["m"] + F.sum("n").over(in_part) - 1) / s.terms_a_block).cast("int").alias("block")), "ranked-numbers")
    df = at.treaps.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").cast("long").alias("df"))
    named = terms.join(numbered, terms["item_id"].eqNullSafe(numbered["item_id"])).select("item", "block", "term")
    known = written(named.join(df, "term"), "ranked-terms")
    for (block,) in numbered.select("block").distinct().orderBy("block").toLocalIterator():
        rows = known.where(F.col("block") == block).select("item", "term", "df").collect()  # terms_a_block, and one item's more
        if not rows:
            continue
        asking = [(r["item"], bytes(r["term"]), math.floor(1000 * math.log((2 * at.documents + 2) / (2 * r["df"] + 1)))) for r in rows]
        wanted = known.where(F.col("block") == block).select("term").distinct()
        here = at.treaps.join(wanted, "term", "left_semi").unionByName(at.treaps.where("term is null"))
        got = _search_block(here, asking, s)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    groups = _top(found.withColumn("some", F.pmod(F.xxhash64("shard"), F.lit(s.merges))), ["item", "some"], s.k).drop("rank")
    ranked = _top(groups, ["item"], s.k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Index docs and search it for all items."""
    return search(index(docs, s), items, s)
