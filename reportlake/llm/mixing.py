"""Mixing sources to target weights by hash-threshold histograms.

Sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` of all words by weight; a target
stops at ``most`` times its source's words, and what is over is shared again by weight until none is above. A source
takes each document ``target div words`` times, and once more those whose hash is below a threshold, which is where
the running sum of words in hash order comes nearest to what is left of the target.

Thresholds are found without a sort: words are summed by source and the hash's first digit (``digit_bits`` wide), the
digit in which the budget ends is found from those sums, and only that digit's documents are summed again by the next
one, until a single document is left. The hash is that of doc_id and text, so it is the same in each run; rows that
share it are the same row to this operator, and further digits, of a number that each row got when the keys were
written, tell them apart: which of them is taken shows in no column.

Work for each row is a word count, a hash and a comparison. Keys (identifier, source, words, hash, number) are written
once; then only sums move: at most a row for each source and digit and task. The histogram of one source has
2 ** digit_bits rows whatever its share of the rows, so a hot source loads no task. Sources are a table; its rows are
broadcast only where a count shows that they are few. The driver holds four numbers.

Defined cases: a null text has no words and is taken 0 words; a null source is a source of its own, an empty one too; a
null doc_id hashes as an empty identifier; repeated rows are documents each, and ties among them are settled as said; very
long texts count whole, and one that the budget ends in is in or out as is nearer; an empty table gives no rows, a table
without words takes none; extra columns are ignored, but for ``row`` when asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .common import written

#: Words are runs of anything but these.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (3, 1, 2)
    share: tuple[int, int] = (3, 2)  # as a fraction
    most: int = 2
    digit_bits: int = 12
    few_sources: int = 100_000


HASH_BITS, NUMBER_BITS = 60, 63


def _shifts(bits: int, digit_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the digits of a number, highest first."""
    return [(max(0, bits - done - digit_bits), min(digit_bits, bits - done)) for done in range(0, bits, digit_bits)]


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, source, size, hash, number, written once; whole: also each document as a struct ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)
    cols = [
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"), F.monotonically_increasing_id().alias("number"),
    ]
    return written(docs.select(*cols, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else [])), "mix-keys")


def sources(keys: DataFrame, s: Settings = Settings()) -> DataFrame:
    """source, words, weight: weights dealt in turn to sources in order, without a single task that holds them all."""
    sums = keys.groupBy("source").agg(F.sum("size").alias("words"))
    held = written(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, total = [], 0
    for r in held.groupBy("part").count().orderBy("part").toLocalIterator():  # a row for each partition
        before += [F.lit(r["part"]), F.lit(total)]
        total += r["count"]
    first = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    place = first + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in s.weights]), (place % len(s.weights)).cast("int"))
    return held.select("source", "words", weight.cast("long").alias("weight"))


def targets(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """source, words, target, copies (of every document), rest (words of one more copy). rows: source, words, weight.

    A source is at its limit if weight * left > most * words * open, where left and open are the words and the weight
    that the sources below theirs share. Each round is one aggregate; the level only rises, so it ends.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    up, down = s.share
    total, weight = rows.agg(F.coalesce(F.sum(big("words")), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, open_ = int(total) * up, -1  # left: in units of 1 / down words
    while open_ != weight:
        open_ = weight
        full = big("weight") * F.lit(left).cast("decimal(38,0)") > big("words") * F.lit(s.most * down * max(1, open_))
        held, weight = rows.agg(F.coalesce(F.sum(F.when(full, big("words"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        left = int(total) * up - int(held) * s.most * down
    share = F.lit(left / down) * F.col("weight").cast("double") / F.lit(float(max(1, open_)))
    words = F.col("words").cast("double")
    goal = rows.withColumn("target", F.when(full | (F.col("words") == 0), words * s.most).otherwise(share))
    goal = goal.withColumn("copies", F.when(F.col("words") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / words)).cast("long"))
    return goal.select("source", "words", "target", "copies", (F.col("target") - (F.col("copies") * F.col("words")).cast("double")).alias("rest"))


def thresholds(keys: DataFrame, goals: DataFrame, s: Settings = Settings()) -> DataFrame:
    """source, hash_cut, number_cut: documents below (hash, number) come in. keys: of keyed(); goals: of targets(), written.

    ``rest`` is what is left of the budget within the digits settled so far. The first digit whose documents overrun it
    is refined; the document found last comes in if the sum is nearer with it than without.
    """
    few = goals.count() <= s.few_sources
    small = lambda df: F.broadcast(df) if few else df
    at = F.col("source").eqNullSafe(F.col("at"))
    now = goals.select("source", "rest", F.lit(0).cast("long").alias("hash_cut"), F.lit(0).cast("long").alias("number_cut"), F.lit(True).alias("more"))
    inside, last = keys.select("source", "size", "hash", "number"), None
    for name, bits in (("hash", HASH_BITS), ("number", NUMBER_BITS)):
        for shift, width in _shifts(bits, s.digit_bits):
            going = now.where("more").select(F.col("source").alias("at"), "rest", "hash_cut", "number_cut")
            if last:
                column, low = last
                same = F.shiftright(column, low) == F.shiftright(f"{column}_cut", low)
                inside = written(inside.join(small(going), at & same, "left_semi"), "mix-inside")  # one in 2 ** digit_bits
            digit = F.shiftright(name, shift).bitwiseAND(F.lit((1 << width) - 1))
            sums = inside.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
            sums = sums.withColumn("c", F.sum("b").over(Window.partitionBy("source").orderBy("digit")))
            over = sums.join(small(going), at).where(F.col("c").cast("double") > F.col("rest"))
            over = over.groupBy("source").agg(F.min(F.struct("digit", "b", "c", "n", "rest", "hash_cut", "number_cut")).alias("x")).select("source", "x.*")
            left = F.col("rest") - (F.col("c") - F.col("b")).cast("double")
            comes_in = (F.col("n") == 1) & (F.col("b").cast("double") < 2 * left)
            step = F.shiftleft(F.col("digit") + comes_in.cast("long"), shift)
            found = over.select("source", left.alias("rest"), *[(F.col(f"{c}_cut") + (step if c == name else 0)).alias(f"{c}_cut") for c in ("hash", "number")], ((F.col("n") > 1) & (left > 0)).alias("more"))
            # A budget that no digit overruns has all of the source within it.
            rest = now.where("more").join(small(found.select(F.col("source").alias("at"))), at, "left_anti")
            all_in = rest.select("source", "rest", F.lit(1 << HASH_BITS).alias("hash_cut"), F.lit(0).cast("long").alias("number_cut"), F.lit(False).alias("more"))
            now = written(now.where("not more").unionByName(found).unionByName(all_in), "mix-cuts")
            last = (name, shift)
            if now.where("more").isEmpty():
                return now.select("source", "hash_cut", "number_cut")
    return now.select("source", "hash_cut", "number_cut")


def mix(docs: DataFrame, s: Settings = Settings(), whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words, repeats counted), copies; whole: and the document as ``row``."""
    keys = keyed(docs, whole)
    goals = written(targets(written(sources(keys, s), "mix-weights"), s), "mix-targets")
    plan = goals.join(thresholds(keys, goals, s).withColumnRenamed("source", "at"), F.col("source").eqNullSafe(F.col("at"))).drop("at")
    plan = written(plan.withColumnRenamed("source", "at").withColumnRenamed("copies", "every"), "mix-plan")
    few = plan.count() <= s.few_sources
    both = keys.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("at")))
    below = (F.col("hash") < F.col("hash_cut")) | ((F.col("hash") == F.col("hash_cut")) & (F.col("number") < F.col("number_cut")))
    copies = F.col("every") + below.cast("long")
    return both.select("doc_id", "size", F.col("words").alias("source_size"), "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *(["row"] if whole else []))


def mixture(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The mix itself: each document of docs, all its columns, as often as it is taken."""
    taken = mix(docs, s, whole=True).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
