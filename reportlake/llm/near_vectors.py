"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors form a class and go on as one. Centroids are fitted on a bounded sample (``sample`` vectors), and
every class goes to the shards of its ``overlap`` nearest centroids. Beyond ``most_shards`` shards the cells of these
centroids are divided again, each by centroids of a bounded sample of its own, so that shards keep their size.

Each shard builds a graph by inserting its vectors in batches: a batch searches the graph of those before it, what
the search met is cut by robust pruning to a node's list, and links go back from there; a second pass does so with
all in place. A node's adjacency lists of all its shards are united, and every member then searches the shards it
lies in: greedy with a beam from the shard's medoids and its own list, and from whatever lies in range on through the
graph until nothing new does. What then hangs together is verified pair by pair in double precision. A pair counts
in the first shard that both share, so no pair leaves a task: a shard gives a row for each linked class, with its
links and one edge of a forest that spans them.

A shard of more than ``most`` classes is dealt in blocks, each pair of blocks a unit, so nothing is left out and
no task outgrows 2 x ``most`` rows. The links of ``audited`` vectors are counted by brute force, too, and the recall
is returned with the result. Below ``least_recall`` the whole is done again with twice the degree, beam and hops and two more
shards for each class, at most ``widenings`` times; a recall that stays below is an error.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
kept; vectors link with others of their length only; rows that repeat a vec_id are members of their own, and a null
vec_id names no component unless nothing else is there; very long vectors and ties need no care of their own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, scratch, trimmed, written
from .frames import Reader, Writer


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    shard: int = 1000
    most: int = 4096
    most_shards: int = 4096
    overlap: int = 3
    sample: int = 20_000
    degree: int = 32
    alpha: float = 1.2
    beam: int = 24
    hops: int = 16
    medoids: int = 16
    audited: int = 500
    least_recall: float = 0.9
    widenings: int = 3
    seed: int = 5

    def wider(self) -> Settings:
        return replace(self, degree=2 * self.degree, beam=2 * self.beam, hops=2 * self.hops, overlap=self.overlap + 2, widenings=self.widenings - 1)


def unit_rows(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length scaled to length 1, in double precision."""
    x = np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) of the vectors of each length."""
    size = np.diff(np.asarray(column.offsets))
    for d in np.unique(size).tolist():
        yield int(d), np.flatnonzero(size == d)


def centroids(sample: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def nearest(v: np.ndarray, middles: np.ndarray, many: int) -> np.ndarray:
    """Indices of the ``many`` nearest centroids of each row, ascending."""
    sims = v.astype(np.float32) @ middles.T
    many = min(many, sims.shape[1])
    return np.sort(np.argpartition(-sims, many - 1, axis=1)[:, :many], axis=1)


def greedy(v: np.ndarray, adj: np.ndarray, q: np.ndarray, start: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam search of some members: (ids met, their similarities, -2 for those met before; which nodes each has seen)."""
    n, m = len(q), len(v)
    row = np.arange(n)[:, None]
    seen = np.zeros((n, m + 1), bool)  # the last column takes the padding
    seen[np.arange(n), q] = True
    seen[:, m] = True

    def fresh(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.where(ids < 0, m, ids)
        new = ~seen[row, ids]
        seen[row, ids] = True
        sims = np.matmul(v[np.minimum(ids, m - 1)], v[q][:, :, None])[:, :, 0]
        return ids, np.where(new, sims, -2)

    ids, sims = fresh(start)
    met, worth_met = [ids], [sims]
    keep = np.argsort(-sims, axis=1, kind="stable")[:, : s.beam]
    beam, worth = np.take_along_axis(ids, keep, 1), np.take_along_axis(sims, keep, 1)
    spent = np.zeros_like(beam, bool)
    for _ in range(s.hops):
        open_ = np.where(spent | (worth < -1.5), -9.0, worth)
        pick = open_.argmax(1)
        live = open_[np.arange(n), pick] > -9
        if not live.any():
            break
        spent[np.arange(n), pick] = True
        ids, sims = fresh(np.where(live[:, None], adj[np.minimum(beam[np.arange(n), pick], m - 1)], -1))
        met.append(ids)
        worth_met.append(sims)
        both, value, done = np.concatenate([beam, ids], 1), np.concatenate([worth, sims], 1), np.concatenate([spent, np.zeros_like(ids, bool)], 1)
        keep = np.argsort(-value, axis=1, kind="stable")[:, : s.beam]
        beam, worth, spent = (np.take_along_axis(x, keep, 1) for x in (both, value, done))
    return np.concatenate(met, 1), np.concatenate(worth_met, 1), seen


def pruned(v: np.ndarray, rows: np.ndarray, pool: np.ndarray, s: Settings) -> np.ndarray:
    """Robust pruning of candidates (-1: none) to lists: one stays if none nearer that stays is alpha times as near to it as the node."""
    far = 1 - np.matmul(v[np.maximum(pool, 0)], v[rows][:, :, None])[:, :, 0]  # half the squared distance
    alive = (pool >= 0) & (pool != rows[:, None])
    far = np.where(alive, far, 9.0)
    order = np.argsort(far, axis=1, kind="stable")[:, : 2 * s.degree]
    pool, far, alive = (np.take_along_axis(x, order, 1) for x in (pool, far, alive))
    alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    near = v[np.maximum(pool, 0)]
    between = 1 - np.matmul(near, near.transpose(0, 2, 1))
    kept = np.zeros_like(alive)
    count = np.zeros(len(rows), int)
    for c in range(pool.shape[1]):
        take = alive[:, c] & (count < s.degree)
        kept[:, c] = take
        count += take
        alive[:, c + 1 :] &= ~(take[:, None] & (s.alpha**2 * between[:, c, c + 1 :] <= far[:, c + 1 :]))
    first = np.argsort(~kept, axis=1, kind="stable")[:, : s.degree]
    out = np.full((len(rows), s.degree), -1)
    out[:, : first.shape[1]] = np.where(np.take_along_axis(kept, first, 1), np.take_along_axis(pool, first, 1), -1)
    return out


def graph(v: np.ndarray, s: Settings) -> np.ndarray:
    """Adjacency lists (-1: none) of a shard, by inserting its vectors in batches that double, and a second pass."""
    m = len(v)
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(m)
    adj = np.full((m, s.degree), -1)

    def insert(batch: np.ndarray, known: np.ndarray) -> None:
        """Lists of a batch from what its searches meet among the known ones, then links back."""
        start = np.concatenate([np.broadcast_to(known[: s.medoids], (len(batch), min(len(known), s.medoids))), adj[batch]], 1)
        ids, sims, _ = greedy(v, adj, batch, start, s)
        best = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * s.degree]
        pool = np.where(np.take_along_axis(sims, best, 1) > -1.5, np.take_along_axis(ids, best, 1), -1)
        adj[batch] = pruned(v, batch, np.concatenate([pool, adj[batch]], 1), s)
        a, b = np.repeat(batch, s.degree), adj[batch].reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        ends, at, many = np.unique(b, return_index=True, return_counts=True)
        for lo in range(0, len(ends), 256):
            some = slice(lo, lo + 256)
            back = np.full((len(ends[some]), int(many[some].max())), -1)
            line = np.repeat(np.arange(len(ends[some])), many[some])
            inside = np.arange(many[some].sum()) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
            back[line, inside] = a[at[lo] : at[lo] + many[some].sum()]
            adj[ends[some]] = pruned(v, ends[some], np.concatenate([adj[ends[some]], back], 1), s)

    done = 1
    while done < m:
        batch = order[done : done + min(256, done)]
        insert(batch, order[:done])
        done += len(batch)
    for lo in range(0, m, 256):
        insert(order[lo : lo + 256], order)
    return adj


def found_in_range(v: np.ndarray, adj: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the members' searches meet in range. v: float32 rows of length 1."""
    m = len(v)
    rng = np.random.default_rng(s.seed)
    middles = centroids(v[rng.choice(m, min(m, 2000), replace=False)], s.medoids, 4, s.seed)
    medoids = np.unique((v @ middles.T).argmax(0))
    least = s.threshold - 1e-4
    left, right = [], []
    for lo in range(0, m, 256):
        q = np.arange(lo, min(m, lo + 256))
        n = len(q)
        ids, sims, seen = greedy(v, adj, q, np.concatenate([np.broadcast_to(medoids, (n, len(medoids))), adj[q]], axis=1), s)
        inside = np.zeros((n, m + 1), bool)
        hit = sims >= least
        inside[np.broadcast_to(np.arange(n)[:, None], ids.shape)[hit], ids[hit]] = True
        # Range expansion: from all that is in range, until nothing new is.
        edge = inside[:, :m].copy()
        while edge.any():
            a, b = np.nonzero(edge)
            new = np.zeros((n, m + 1), bool)
            for k in range(0, len(a), 1 << 16):
                new[a[k : k + (1 << 16), None], adj[b[k : k + (1 << 16)]]] = True
            new &= ~seen
            seen |= new
            a, b = np.nonzero(new[:, :m])
            good = np.concatenate([np.einsum("ij,ij->i", v[q[a[k : k + 65536]]], v[b[k : k + 65536]]) >= least for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
            edge = np.zeros((n, m), bool)
            edge[a[good], b[good]] = True
            inside[:, :m] |= edge
        a, b = np.nonzero(inside[:, :m])
        left.append(q[a])
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def heads(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member that each of m reaches by edges."""
    parent = np.arange(m)
    while True:
        least = parent.copy()
        np.minimum.at(least, i, parent[j])
        np.minimum.at(least, j, parent[i])
        least = least[least]
        if (least == parent).all():
            return parent
        parent = least


def verified(exact: np.ndarray, i: np.ndarray, j: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i < j) within what the pairs found connect: all of its pairs, in double precision, in strips."""
    head = heads(len(exact), i, j)
    order = np.argsort(head, kind="stable")
    edge = np.flatnonzero(np.diff(head[order], prepend=-1))
    for lo, hi in zip(edge, np.append(edge[1:], len(order)), strict=True):
        if hi - lo > 1:
            some = np.sort(order[lo:hi])
            for at in range(0, len(some), 512):
                a, b = np.nonzero(exact[some[at : at + 512]] @ exact[some].T >= s.threshold)
                a = a + at
                yield some[a[a < b]], some[b[a < b]]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows that share the first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        unit = np.asarray(b.column(0))
        edges = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            piece = b.slice(lo, hi - lo)
            if held and held[0].column(0)[0].as_py() != piece.column(0)[0].as_py():
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fitting() -> Column:
    """Whether a vector v can link: all components finite, one not zero."""
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return finite & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))


PLACED = "cls long, copies long, d int, shards array<long>, v array<double>"


def in_shards(classes: DataFrame, s: Settings) -> DataFrame:
    """cls, copies, d, shards (numbers of its shards, ascending), v. classes: cls, copies, v."""
    spark = classes.sparkSession
    many = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = classes.orderBy(F.xxhash64("cls", F.lit(s.seed)), "cls").limit(max(s.sample, min(s.most_shards, sum(many.values()) // s.shard))).select("v").toArrow()["v"].combine_chunks()
    middles = {d: centroids(unit_rows(drawn.take(pa.array(at))).astype(np.float32), max(1, min(s.most_shards, many[d] // s.shard)), 8, s.seed) for d, at in (by_length(drawn) if len(drawn) else ())}
    sent = spark.sparkContext.broadcast(middles)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                piece = b.slice(at, 2048)
                for d, rows in by_length(piece.column(2)):
                    some = piece.take(pa.array(rows))
                    # Lengths too rare to be in the sample have one shard.
                    top = nearest(unit_rows(some.column(2)), sent.value[d], s.overlap) if d in sent.value else np.zeros((len(rows), 1), np.int64)
                    shards = pa.array(list((np.int64(d) << np.int64(40)) + top), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.full(len(rows), d, np.int32)), shards, some.column(2)], ["cls", "copies", "d", "shards", "v"])

    cells = written(classes.select("cls", "copies", "v").mapInArrow(trimmed(place), PLACED), "vector-cells")
    return divided(cells, s) if any(n // s.shard > s.most_shards for n in many.values()) else cells


def divided(cells: DataFrame, s: Settings) -> DataFrame:
    """Cells divided again by centroids of their own, fitted on at most ``sample`` vectors of each."""
    spark = cells.sparkSession
    each = cells.withColumn("cell", F.explode("shards"))
    sizes = each.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))  # at most most_shards for each length
    chance = (F.xxhash64("cls", F.lit(s.seed + 1)).cast("double") + 2.0**63) / 2.0**64
    drawn = each.join(F.broadcast(sizes), "cell").where(chance < F.lit(float(s.sample)) / F.col("m")).select("cell", "m", "v")
    folder = scratch(spark, "vector-cells")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, rows = None, f"{folder}/centroids-{uuid.uuid4().hex}.zst", []
        for b in _units(batches):
            v = unit_rows(b.column(2)).astype(np.float32)
            c = centroids(v, max(1, min(s.most_shards, b.column(1)[0].as_py() // (s.shard * s.overlap))), 8, s.seed)
            out = out or Writer(uri)
            out.add(b.column(0)[0].as_py(), c.astype("<f4").tobytes())
            rows.append(b.column(0)[0].as_py())
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([uri] * len(rows))], ["cell", "uri"])

    fitted = written(drawn.repartition("cell").sortWithinPartitions("cell").mapInArrow(trimmed(fit), "cell long, uri string"), "vector-centroids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for b in _units(batches):
            cell, uri, d = (b.column(k)[0].as_py() for k in (0, 1, 4))
            if held[0] != cell:
                reader = Reader(uri)
                held = cell, np.frombuffer(next(reader.pieces([cell]))[1], "<f4").reshape(-1, d)
                reader.close()
            for at in range(0, b.num_rows, 2048):
                piece = b.slice(at, 2048)
                top = nearest(unit_rows(piece.column(5)), held[1], s.overlap)
                # A part of a cell: numbers by mixing, which are apart from those of other parts but for 1 in 2**63.
                named = (np.uint64(cell) * np.uint64(0x9E3779B97F4A7C15) + (top.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(1)
                shards = pa.array(list(named.astype(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column(2), piece.column(3), piece.column(4), shards, piece.column(5)], ["cls", "copies", "d", "shards", "v"])

    spread = F.pmod("cls", F.greatest(F.lit(1), F.ceil(F.col("m") / F.lit(100 * s.most)).cast("int")))
    rows = each.join(F.broadcast(sizes), "cell").join(fitted, "cell").repartition("cell", spread).sortWithinPartitions("cell")
    parts = rows.select("cell", "uri", "cls", "copies", "d", "v").mapInArrow(trimmed(place), PLACED)
    # The nearest parts of the nearest cells, together again.
    return written(parts.groupBy("cls").agg(F.first("copies").alias("copies"), F.first("d").alias("d"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("shards")))).alias("shards"), F.first("v").alias("v")), "vector-parts")


def linked(classes: DataFrame, s: Settings) -> DataFrame:
    """cls, links (copies of linked classes), other (a linked class): a row for each class and unit with links."""
    placed = in_shards(classes, s)
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / F.lit(s.most)).cast("int")
    member = (
        placed.withColumn("shard", F.explode("shards")).join(sizes, "shard")
        .withColumn("blocks", blocks).withColumn("block", F.pmod("cls", F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("shard", F.least("block", "with"), F.greatest("block", "with")).alias("unit"), "shard",
            F.when(F.col("block") > F.col("with"), 1).otherwise(0).alias("side"), "cls", "copies", "shards", "v",
        )
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _units(batches):
            ids = np.asarray(b.column(1))
            adj = graph(unit_rows(b.column(2)).astype(np.float32), s)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[x[x >= 0]] for x in adj], pa.list_(pa.int64()))], ["cls", "near"])

    dealt = member.repartition("unit").sortWithinPartitions("unit", "cls")
    lists = dealt.select("unit", "cls", "v").mapInArrow(trimmed(build), "cls long, near array<long>")
    united = written(lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-graph")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _units(batches):
            ids, shard, side, copies = np.asarray(b.column(1)), b.column(2)[0].as_py(), np.asarray(b.column(3)), np.asarray(b.column(4))
            exact = unit_rows(b.column(6))
            order = np.argsort(ids)
            lists = []
            for x in b.column(7):
                x = np.array(x.as_py() or [], np.int64)
                at = order[np.minimum(np.searchsorted(ids, x, sorter=order), len(ids) - 1)]
                lists.append(at[ids[at] == x])
            adj = np.full((len(ids), max(1, max(map(len, lists)))), -1)
            for k, x in enumerate(lists):
                adj[k, : len(x)] = x
            met = found_in_range(exact.astype(np.float32), adj, s)
            many = max(map(len, b.column(5).to_pylist()))
            shards = np.full((len(ids), many), -1)
            for r, x in enumerate(b.column(5).to_pylist()):
                shards[r, : len(x)] = x
            links, left, right = np.zeros(len(ids), np.int64), [], []
            for i, j in verified(exact, *met, s):
                # The first shard that both lie in counts the pair; of a shard in blocks, the unit of both blocks.
                own = (side[i] != side[j]) | (not side.any())
                a = shards[i]
                both = (a[:, :, None] == shards[j][:, None, :]).any(2) & (a >= 0)
                own &= np.where(both, a, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == shard
                i, j = i[own], j[own]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                left.append(i)
                right.append(j)
            hit = np.flatnonzero(links)
            if len(hit):
                head = heads(len(ids), np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[head[hit]])], ["cls", "links", "other"])

    seek = member.join(united, "cls").select("unit", "cls", "shard", "side", "copies", "shards", "v", "near")
    return written(seek.repartition("unit").sortWithinPartitions("unit", "cls").mapInArrow(trimmed(search), "cls long, links long, other long"), "vector-links")


def near(embeddings: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall (the same in every row; null without links to find)."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    # Floats to the largest scale of doubles: scaled by the largest component, so that squares neither over- nor underflow.
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y))))
    valid = rows.where(fitting()).select("vec_id", scaled.alias("v"))
    grouped = valid.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = written(grouped.withColumns({"cls": F.monotonically_increasing_id(), "k1": F.xxhash64("v"), "k2": F.hash("v")}), "vector-classes")
    while True:
        found = linked(classes.select("cls", "copies", "v"), s)
        links = found.groupBy("cls").agg(F.sum("links").alias("links"))
        recall = audit(classes, links, s)
        if recall is None or recall >= s.least_recall:
            break
        if not s.widenings:
            raise ValueError(f"Recall {recall:.3f} of audited links is below {s.least_recall} with beam {s.beam}, hops {s.hops} and overlap {s.overlap}")
        s = s.wider()
    reach = components(found.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    reps = classes.select("cls", F.col("id").alias("vec"), "copies")
    # Written, so that the join by component has an exchange at either side, which is split where one component has most.
    least = written(reach.join(reps, F.col("id") == F.col("cls")).groupBy("component").agg(F.min("vec").alias("head")), "vector-heads")
    of = reach.select(F.col("id").alias("cls"), "component").join(least, "component").select("cls", "head")
    facts = classes.join(links, "cls", "left").join(of, "cls", "left").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "id").alias("component_id"))
    keyed = rows.select("vec_id", F.when(fitting(), F.xxhash64(scaled)).alias("k1"), F.when(fitting(), F.hash(scaled)).alias("k2"))
    return keyed.join(facts, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("audited_recall", F.lit(recall).cast("double"))


def audit(classes: DataFrame, links: DataFrame, s: Settings = Settings()) -> float | None:
    """Recall of links of some classes (``audited`` by hash) against all rows, by brute force in blocks; one pass."""
    spark = classes.sparkSession
    asked = classes.orderBy(F.xxhash64("cls", F.lit(s.seed + 2)), "cls").limit(s.audited).join(links, "cls", "left").select("v", "copies", F.coalesce("links", F.lit(0)).alias("links")).toArrow()
    if not len(asked):
        return None
    column = asked["v"].combine_chunks()
    parts = {d: (unit_rows(column.take(pa.array(at))), at) for d, at in by_length(column)}
    sent = spark.sparkContext.broadcast(parts)
    n = len(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                piece = b.slice(at, 2048)
                for d, rows in by_length(piece.column(0)):
                    if d in sent.value:
                        q, place = sent.value[d]
                        some = piece.take(pa.array(rows))
                        total[place] += (unit_rows(some.column(0)) @ q.T >= s.threshold).T @ np.asarray(some.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], ["k", "n"])

    counted = classes.select("v", "copies").mapInArrow(trimmed(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    copies = asked["copies"].to_pylist()
    # A class meets itself, whatever rounding says of its cosine: at least its own copies are there.
    want = sum(max(0, r["n"] - copies[r["k"]]) for r in counted)
    return sum(asked["links"].to_pylist()) / want if want else None
