"""Sharding by sampled splitters: sizes near equal (law ``bytes``), equal texts together.

The sort key is (hash of the text, doc_id, number of the written row), so equal texts are neighbours. A sample of keys drawn with chance
proportional to weight (bytes, or a row where rows are small) gives quantile boundaries of many fine ranges, which fall between groups of equal texts; exact
totals of the ranges follow from one small aggregate, and overfull ranges are subdivided by a denser sample of
their own until none is left. Groups larger than a range (found exactly by an aggregate over hashes, at most one for
each range's worth) are cut out and subdivided by doc_id and number, so that a text that a third of the rows share is no single task.
Ranges go to shards, largest first, each to the shard with most room, so shards differ by about a fine range at most; a
group's ranges go to one shard as long as that shard has room for all of them, and only a group that no
shard can hold is divided. A record larger than a shard has its shard
alone or nearly so. A slot is the rows of the shard's ranges before plus the row's number in its range.

Only narrow rows (identifier, size, checksum, hash, number) move, by range. The driver holds the sample, the cuts and a row
for each range: some 4 * ``most_ranges`` * ``keys_a_range`` keys at most, however many rows there are.

Defined cases: a null text has size 1 and the checksum of nothing; a null doc_id sorts first; repeated rows (id and
text) each take a slot; ties have no order beyond (hash, id), so where ids repeat their rows' slots are as the rows were read; very
long texts count by their whole size; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import trimmed, written

LOW = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    shards: int = 16
    ranges_a_shard: int = 64
    rows_a_range: int = 100_000
    most_ranges: int = 65_536
    keys_a_range: int = 16


def keys(*columns: np.ndarray) -> np.ndarray:
    """Composite keys whose byte order is that of (hash, id, number)."""
    both = np.empty((len(columns[0]), len(columns)), ">u8")
    for k, c in enumerate(columns):
        both[:, k] = np.asarray(c).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return both.view(f"S{8 * len(columns)}").reshape(-1)


def splitters(sample: list[tuple[int, int, int, float]], unit: float, between: bool = True) -> list[tuple[int, int, int]]:
    """Boundaries about one range's worth apart; a sampled row stands for ``unit`` of a range, or its weight if larger.

    between: only before a whole group of equal hashes.
    """
    out: list[tuple[int, int, int]] = []
    held, last = 0.0, None
    for h, i, number, weight in sorted(sample):
        if held >= 1 and (h != last or not between):
            out.append((h, LOW, LOW) if between else (h, i, number))
            held = 0.0
        held += max(unit, weight)
        last = h
    return out


KEYED = "doc_id long, size long, text_crc32 long, h long, number long"


def _ranged(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """rid: how many boundaries are at or below the key."""
    sent = rows.sparkSession.sparkContext.broadcast(keys(*np.array(cuts, np.int64).reshape(-1, 3).T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = keys(b.column("h"), b.column("doc_id").fill_null(LOW), b.column("number"))
            rid = np.searchsorted(sent.value, mine, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rid)], [*b.schema.names, "rid"])

    return rows.select(*[c.split()[0] for c in KEYED.split(", ")]).mapInArrow(trimmed(run), f"{KEYED}, rid int")


def ranges(rows: DataFrame, total: int, count: int, s: Settings) -> tuple[DataFrame, dict[int, tuple[int, int]], dict[int, int]]:
    """rows with rid, (bytes, rows) of each range, and the hash of ranges that are parts of a large group. rows: KEYED."""
    n = int(min(s.most_ranges, max(s.shards * s.ranges_a_shard, count / s.rows_a_range)))
    step, row_step = max(1.0, total / n), max(s.rows_a_range, count / n)
    weight = F.greatest(F.col("size") / F.lit(step), F.lit(1 / row_step))  # in ranges; 2 * n in all at most
    chance = (F.xxhash64("doc_id", "h", "number", F.lit(11)).cast("double") + 2.0**63) / 2.0**64

    def draw(of: DataFrame, unit: float) -> list[tuple[int, int, int, float]]:
        got = of.where(chance < weight / F.lit(unit)).select("h", F.coalesce("doc_id", F.lit(LOW)), "number", weight)
        return [tuple(r) for r in got.toLocalIterator()]

    unit = 1 / s.keys_a_range
    # Fewer than 2 * n groups are as large as that.
    sums = rows.groupBy("h").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("m")).where((F.col("b") > step) | (F.col("m") > row_step))
    large = {r["h"] for r in sums.select("h").toLocalIterator()}
    cuts = {c for h in large for c in [(h, LOW, LOW), *([(h + 1, LOW, LOW)] if h < (1 << 63) - 1 else [])]}
    sample = draw(rows, unit)
    cuts |= set(splitters(sample, unit))
    by_group: dict[int, list] = {}
    for x in sample:
        if x[0] in large:
            by_group.setdefault(x[0], []).append(x)
    for mine in by_group.values():
        cuts |= set(splitters(mine, unit, between=False))
    while True:
        ranged = _ranged(rows, sorted(cuts))
        facts = ranged.groupBy("rid").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("h"), F.max("h").alias("h2"))
        found = sorted(tuple(r) for r in facts.toLocalIterator())
        over = {rid: h == h2 for rid, b, m, h, h2 in found if m > 1 and (b > 2 * step or m > 2 * row_step) and (h != h2 or h in large)}
        if not over:
            return ranged, {rid: (b, m) for rid, b, m, _, _ in found}, {rid: h for rid, _, _, h, h2 in found if h == h2 and h in large}
        # Four times as dense each time: at the latest when all keys are drawn, no range has two groups or two rows of a large one beyond a step.
        unit /= 4
        denser = draw(ranged.where(F.col("rid").isin(list(over))), unit)
        cuts |= set(splitters(denser, unit))
        by_group = {}
        for x in denser:
            if x[0] in large:
                by_group.setdefault(x[0], []).append(x)
        for mine in by_group.values():
            cuts |= set(splitters(mine, unit, between=False))


def dealt(sums: dict[int, tuple[int, int]], shards: int, groups: dict[int, int] | None = None) -> list[tuple[int, int, int]]:
    """(range, shard, slot of its first row): largest first, each to the shard with most room; ranges of one group
    together if that shard has room for them. sums: bytes and rows by range; groups: of some ranges."""
    room = -(-sum(b for b, _ in sums.values()) // shards)
    units: dict[tuple, list[int]] = {}
    for rid in sums:
        units.setdefault(("group", groups[rid]) if groups and rid in groups else ("range", rid), []).append(rid)
    waiting = [(-sum(sums[rid][0] for rid in parts), min(parts), parts) for parts in units.values()]
    heapq.heapify(waiting)
    load = [(0, k) for k in range(shards)]
    of: dict[int, int] = {}
    while waiting:
        less, _, parts = heapq.heappop(waiting)
        held, k = load[0]
        if len(parts) > 1 and held - less > room:
            for rid in parts:
                heapq.heappush(waiting, (-sums[rid][0], rid, [rid]))
            continue
        of |= dict.fromkeys(parts, k)
        heapq.heapreplace(load, (held - less, k))
    slots, out = [0] * shards, []
    for rid in sorted(of):
        out.append((rid, of[rid], slots[of[rid]]))
        slots[of[rid]] += sums[rid][1]
    return out


def shard(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("number")), "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranged, sums, groups = ranges(rows, total, count, s)
    places = docs.sparkSession.createDataFrame(dealt(sums, s.shards, groups), "rid int, shard int, first long")
    order = Window.partitionBy("rid").orderBy("h", F.col("doc_id").asc_nulls_first(), "number")
    placed = ranged.withColumn("n", F.row_number().over(order)).join(F.broadcast(places), "rid")  # a row for each range: bounded
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Documents by shard folder, in slot order within a shard's files. Rows meet by id and text, each in its place."""
    n = Window.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot")
    keyed = placed.select("doc_id", "text_crc32", "shard", "slot").withColumn("nth", F.row_number().over(n))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"))
    whole = whole.withColumn("k", F.row_number().over(Window.partitionBy("id", "crc").orderBy(F.xxhash64("row"))))
    both = whole.join(keyed, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("crc") == F.col("text_crc32")) & (F.col("k") == F.col("nth")))
    both.repartition("shard").sortWithinPartitions("shard", "slot").select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
