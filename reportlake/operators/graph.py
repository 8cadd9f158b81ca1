"""Co-occurrence network of themes, receivers, coroners and areas as two DataFrames: nodes and edges.

Nulls and blank values make no node; a report's repeated values count once; ties go by lower-cased name, then name;
empty tables give empty networks; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import dashboard_value, first_seen, receivers
from ..storage import stored

#: Nodes shown of each kind, edges, theme pairs, theme pairs of one theme.
NODE_CAPS = {"receiver": 72, "coroner": 44, "area": 36}
EDGE_CAP, PAIR_CAP, PAIRS_EACH = 2600, 420, 8
#: Edges between classes that a task may hold whole: 32 MB twice over, both ways.
EDGES_IN_TASK = 2_000_000


def node_rows(reports: DataFrame, themes: Sequence[str] = (), key: str = "report_id") -> DataFrame:
    """(key, kind, value): each report's nodes once. With themes, reports without any have none."""
    active = F.filter(F.array(*[F.when(F.col(t), F.lit(t)) for t in themes]), lambda x: x.isNotNull()) if themes else F.array().cast("array<string>")
    one = lambda c: F.filter(F.array(dashboard_value(F.col(c))), lambda x: x != "")
    kinds = {"theme": active, "receiver": first_seen(receivers(F.col("receiver"))), "coroner": one("coroner"), "area": one("area")}
    named = lambda k, v: F.transform(v, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("value")))
    rows = F.flatten(F.array(*[named(k, v) for k, v in kinds.items()]))
    chosen = reports.where(F.size(active) > 0) if themes else reports
    return chosen.select(key, F.inline(rows))


def nodes(rows: DataFrame) -> DataFrame:
    """kind, value, n: reports of each node."""
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


#: Which kinds make an edge, with and without themes.
WITH_THEMES = [("theme", "receiver"), ("theme", "coroner"), ("theme", "area")]
WITHOUT_THEMES = [("receiver", "coroner"), ("receiver", "area"), ("coroner", "area")]


def edges(reports: DataFrame, themes: Sequence[str] = (), key: str = "report_id") -> DataFrame:
    """kind, source, target, n. Pairs are made inside a row (a report's own lists), so nothing is shuffled but counts."""
    active = F.array_sort(F.filter(F.array(*[F.when(F.col(t), F.lit(t)) for t in themes]), lambda x: x.isNotNull())) if themes else F.array().cast("array<string>")
    one = lambda c: F.filter(F.array(dashboard_value(F.col(c))), lambda x: x != "")
    held = reports.select(active.alias("theme"), first_seen(receivers(F.col("receiver"))).alias("receiver"), one("coroner").alias("coroner"), one("area").alias("area"))

    def pairs(a: str, b: str):
        return F.flatten(F.transform(F.col(a), lambda x: F.transform(F.col(b), lambda y: F.struct(F.lit(f"{a}_{b}").alias("kind"), F.concat(F.lit(f"{a}::"), x).alias("source"), F.concat(F.lit(f"{b}::"), y).alias("target")))))

    if themes:
        held = held.where(F.size("theme") > 0)
        own = F.flatten(F.transform(F.col("theme"), lambda x: F.transform(F.filter(F.col("theme"), lambda y: y > x), lambda y: F.struct(F.lit("theme_theme").alias("kind"), F.concat(F.lit("theme::"), x).alias("source"), F.concat(F.lit("theme::"), y).alias("target")))))
        lists = [pairs(a, b) for a, b in WITH_THEMES] + [own]
    else:
        lists = [pairs(a, b) for a, b in WITHOUT_THEMES]
    return held.select(F.inline(F.flatten(F.array(*lists)))).groupBy("kind", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def jaccard(edge: DataFrame, node: DataFrame) -> DataFrame:
    """theme_theme edges with their Jaccard index, six places."""
    size = node.where("kind = 'theme'").select(F.concat(F.lit("theme::"), F.col("value")).alias("id"), F.col("n").alias("size"))
    a, b = size.select(F.col("id").alias("source"), F.col("size").alias("na")), size.select(F.col("id").alias("target"), F.col("size").alias("nb"))
    both = edge.where("kind = 'theme_theme'").join(a, "source").join(b, "target")
    return both.select("source", "target", "n", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))


def by_count() -> list:
    return [F.desc("n"), F.lower("value"), F.col("value")]


def first_of_kinds(node: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The first nodes of some kinds by count: a top-k for each, so that no task sorts a kind whole. Others stay."""
    out = node.where(~F.col("kind").isin(list(caps)))
    for k, n in caps.items():
        out = out.unionByName(node.where(F.col("kind") == k).orderBy(*by_count()).limit(n))
    return out


def capped(node: DataFrame, reports: int, caps: dict[str, int] = NODE_CAPS, forced: Sequence[str] = ()) -> DataFrame:
    """The most common nodes of each kind, all themes; rare ones (below 2) only in small collections (250 reports).

    Forced ones (kind::value; of those that differ in case alone the first) that occur are there beyond cap and rarity.
    ``rank`` is the place in the kind. Kinds without a cap (themes) are those of columns, a few hundred at most.
    """
    common = node.where(F.col("n") >= (1 if reports <= 250 else 2))
    shown = first_of_kinds(common, caps).withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*by_count())))
    wanted = list({x.casefold(): x for x in reversed(forced)}.values())
    if not wanted:
        return shown
    named = node.where(F.concat("kind", F.lit("::"), "value").isin(wanted)).join(shown.select("kind", "value"), ["kind", "value"], "left_anti")
    place = lambda c: F.struct(-F.col(f"{c}.n"), F.lower(f"{c}.value"), F.col(f"{c}.value"))
    before = node.alias("x").join(F.broadcast(named).alias("y"), (F.col("x.kind") == F.col("y.kind")) & (place("x") < place("y")))  # as many as the caller names
    ranks = before.groupBy(F.col("y.kind").alias("kind"), F.col("y.value").alias("value")).agg((F.count(F.lit(1)) + 1).cast("int").alias("rank"))
    late = named.join(ranks, ["kind", "value"], "left").withColumn("rank", F.coalesce("rank", F.lit(1)))
    return shown.unionByName(late.select(*shown.columns))


def theme_capped(node: DataFrame, themes: int) -> DataFrame:
    """Nodes with no more than a number of themes, the most common ones; everything else as it is."""
    return first_of_kinds(node, {"theme": themes})


def sized(node: DataFrame, low: float = 10.0, high: float = 40.0, power: float = 0.62) -> DataFrame:
    """Display size by kind: min-max scaled with an exponent; the middle where all are equal."""
    bounds = node.groupBy("kind").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    both = node.join(bounds, "kind")
    share = F.pow((F.col("n") - F.col("least")) / (F.col("most") - F.col("least")), F.lit(power))
    size = F.when(F.col("most") == F.col("least"), (low + high) / 2).otherwise(low + share * (high - low))
    return both.withColumn("size", F.round(size, 2)).select(*node.columns, "size")


def accented(node: DataFrame, colours: int = 6) -> DataFrame:
    """``accent``: colours in turn, by rank in the kind. node: as capped() returns it."""
    return node.withColumn("accent", F.pmod(F.col("rank") - 1, F.lit(colours)))


def connected_only(node: DataFrame, edge: DataFrame, forced: Sequence[str] = ()) -> DataFrame:
    """Nodes with an edge, and forced ones; all of them where there is no edge at all. node: kind, value."""
    ends = edge.select(F.col("source").alias("id")).union(edge.select("target")).distinct()
    ided = node.withColumn("id", F.concat("kind", F.lit("::"), "value"))
    if edge.isEmpty():
        return ided
    return ided.join(ends.union(node.sparkSession.createDataFrame([(x,) for x in forced], "id string")).distinct(), "id", "left_semi")


def top_edges(edge: DataFrame, n: int = EDGE_CAP) -> DataFrame:
    return edge.orderBy(F.desc("n"), "source", "target").limit(n)


def label_threshold(node: DataFrame) -> DataFrame:
    """The count at the end of the first fifth of the nodes by count."""
    ordered = node.orderBy(F.desc("n"))
    k = max(0, int(ordered.count() * 0.2) - 1)
    return ordered.select("n").offset(k).limit(1)


def greedy_pairs(pairs: DataFrame, each: int = PAIRS_EACH, total: int = PAIR_CAP) -> DataFrame:
    """Theme pairs by Jaccard, then count, then names; a pair is skipped once either theme has its number.

    In rounds: a pair that is among the best left at both of its themes, as many as each has room for, is taken, since
    no better pair can fill either before its turn; pairs at a theme without room left go, since those that filled it
    are better. That takes the same pairs as one after the other, and each round takes the best pair left at
    least. Only the first ``each`` pairs of a theme are ranked, in two steps, so a theme of many pairs loads no task.
    Themes must differ within a pair; a pair that comes up twice is two.
    """
    named = pairs.select("source", "target", "n", "jaccard").withColumn("nth", F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("jaccard"), F.desc("n"))))
    left = stored(named, "pairs")
    taken = left.where("false")
    order = [F.desc("jaccard"), F.desc("n"), F.col("source"), F.col("target"), F.col("nth")]
    while not left.isEmpty():
        held = taken.select(F.explode(F.array("source", "target")).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("has"))
        ends = left.select("*", F.explode(F.array("source", "target")).alias("theme"))
        for by in ([F.col("theme"), F.pmod(F.xxhash64("source", "target"), F.lit(32))], [F.col("theme")]):
            ends = ends.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= each)
        good = ends.join(held, "theme", "left").where(F.col("place") <= each - F.coalesce("has", F.lit(0)))
        both = good.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("ends")).where("ends = 2").drop("ends")
        taken = stored(taken.unionByName(both), "pairs")
        full = taken.select(F.explode(F.array("source", "target")).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("has")).where(F.col("has") >= each)
        left = left.join(taken, left.columns, "left_anti")
        for end in ("source", "target"):
            left = left.join(full.select(F.col("theme").alias(end)), end, "left_anti")
        left = stored(left.select(*taken.columns), "pairs")
    return taken.orderBy(*order).limit(total).drop("nth")


def degree(edge: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """id, degree centrality (distinct neighbours by the other nodes), strength (sum of weights)."""
    both = edge.select(F.col("source").alias("id"), F.col("target").alias("other"), "n").union(edge.select("target", "source", "n"))
    total = n_nodes if n_nodes is not None else both.select("id").distinct().count()
    return both.groupBy("id").agg((F.countDistinct("other") / F.lit(max(1, total - 1))).alias("degree"), F.sum("n").alias("strength"))


def betweenness(edge: DataFrame, most_edges: int = EDGES_IN_TASK, sources_a_block: int = 2_000) -> DataFrame:
    """Betweenness by shortest paths, undirected, scaled by the pairs of other nodes (Brandes 2001).

    Nodes with the same neighbours lie on paths alike, so they are one class that counts as many times as it has nodes,
    and paths are followed between classes: of a network of a few themes and any number of receivers, coroners and areas,
    there are no more classes than sets of themes. Classes are numbered and their graph is written once. Up to
    ``most_edges`` edges of it, each task reads it whole from there and follows the paths from sources of its own, a level of
    all their frontiers at a time; beyond that, the levels of a block of sources are tables, and a step is a join of the
    frontier with the edges. The driver sees neither. Where no two nodes have the same neighbours, the work is nodes times edges.
    Repeated edges count once; an edge to itself is none; nodes without an edge have no row.
    """
    spark = edge.sparkSession
    named = stored(edge.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct(), "edges")
    both = named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = stored(twins(both), "twins")
    n = nodes.count()
    numbers, n_classes = numbered(nodes.where("id = twin").select("id"))
    classes = stored(numbers.join(nodes.where("id = twin").select("id", "size"), "id"), "twins")
    from_id = classes.select(F.col("id").alias("a"), F.col("number").alias("x"), F.col("size").alias("x_size"))
    to_id = classes.select(F.col("id").alias("b"), F.col("number").alias("y"), F.col("size").alias("y_size"))
    graph_rows = stored(both.join(from_id, "a").join(to_id, "b").select("x", "y", "x_size", "y_size"), "edges")
    # Nodes of one class are two steps apart, by each of their neighbours.
    near = graph_rows.where("x_size > 1").groupBy("x").agg(F.sum("y_size").alias("near"))
    within = graph_rows.join(near, "x").groupBy(F.col("y").alias("number")).agg(F.sum(F.col("x_size") * (F.col("x_size").cast("double") - 1) / F.col("near")).alias("share"))
    if graph_rows.count() <= 2 * most_edges:
        shares = _shares_in_tasks(spark, graph_rows, n_classes)
    else:
        shares = spark.createDataFrame([], "number long, share double")
        for low in range(0, n_classes, sources_a_block):
            block = _shares_by_joins(graph_rows, classes.where(F.col("number").between(low, low + sources_a_block - 1)).select("number", "size"))
            shares = stored(shares.unionByName(block).groupBy("number").agg(F.sum("share").alias("share")), "shares")
    scale = F.lit(float(max(1, (n - 1) * (n - 2))))
    total = shares.unionByName(within).groupBy("number").agg(F.sum("share").alias("share"))
    of_class = classes.join(total, "number", "left").select(F.col("id").alias("twin"), (F.coalesce("share", F.lit(0.0)) / scale).alias("betweenness"))
    return nodes.join(of_class, "twin").select("id", "betweenness")


def twins(both: DataFrame, fingerprint: Callable[[Column, int], Column] = lambda b, k: F.xxhash64(b, F.lit(k))) -> DataFrame:
    """(id, twin, size): the least of the nodes with the same neighbours, and how many they are. both: distinct (a, b), each edge both ways.

    Fingerprints of the neighbours only propose classes: each is checked, neighbour by neighbour, and taken apart where one of them
    is not a neighbour of all its nodes. No list of neighbours is formed, so a node may have any number.
    """
    marks = [F.bit_xor(fingerprint(F.col("b"), k)).alias(f"mark{k}") for k in (0, 1)]
    marked = stored(both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("near"), *marks), "twins")
    alike = ["near", "mark0", "mark1"]
    proposed = marked.join(marked.groupBy(*alike).agg(F.min("id").alias("twin"), F.count(F.lit(1)).alias("size")), alike).select("id", "twin", "size")
    met = both.join(proposed.where("size > 1"), both["a"] == proposed["id"]).groupBy("twin", "size", "b").agg(F.count(F.lit(1)).alias("n"))
    apart = stored(met.where("n <> size").select("twin", F.lit(True).alias("apart")).distinct(), "twins")
    told = proposed.join(apart, "twin", "left")
    return told.select("id", F.when(F.col("apart"), F.col("id")).otherwise(F.col("twin")).alias("twin"), F.when(F.col("apart"), F.lit(1)).otherwise(F.col("size")).cast("long").alias("size"))


def numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """(id, number) with numbers from 0 on without gaps, in order of the id, and how many: ranked within ranges, which are counted."""
    held = stored(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    first, n = [], 0
    for r in held.groupBy("part").count().orderBy("part").toLocalIterator():  # a row for each range
        first += [F.lit(r["part"]), F.lit(n)]
        n += r["count"]
    start = F.create_map(*first)[F.col("part")] if first else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return stored(held.select("id", (start + place - 1).cast("long").alias("number")), "ids"), n


def _shares_in_tasks(spark: SparkSession, graph_rows: DataFrame, n: int) -> DataFrame:
    """number, share of each node of a class by each task; the graph comes from its files, sources from a range."""
    files = graph_rows.inputFiles()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = np.ones(n)
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *[_pairs_of(f, size) for f in files]])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        begin = np.searchsorted(pairs[:, 0], np.arange(n + 1))
        near, through = pairs[:, 1], np.zeros(n)
        for f in frames:
            for source in f["id"]:
                _add_shares(int(source), begin, near, size, through)
        got = np.flatnonzero(through)
        yield pd.DataFrame({"number": got, "share": through[got]})

    parts = max(1, min(n // 50, 2000))
    return spark.range(0, n, 1, parts).mapInPandas(run, "number long, share double")


def _pairs_of(uri: str, size: np.ndarray) -> np.ndarray:
    """(x, y) of one file of edges, from any store that pyarrow knows, or a local mount; sizes of y are put in place."""
    import pyarrow.parquet as pq

    columns = ["x", "y", "y_size"]
    if uri.startswith("file:"):
        table = pq.read_table("/" + uri[5:].lstrip("/"), columns=columns, partitioning=None)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        table = pq.read_table(path, columns=columns, filesystem=store, partitioning=None)
    size[table["y"].to_numpy()] = table["y_size"].to_numpy()
    return np.stack([table["x"].to_numpy(), table["y"].to_numpy()], axis=1)


def _add_shares(source: int, begin: np.ndarray, near: np.ndarray, size: np.ndarray, through: np.ndarray) -> None:
    """Add to each node of a class its share of the shortest paths from the nodes of a source to other classes: out level by
    level, and back. paths: those from one node of the source to one of the class."""
    n = len(begin) - 1
    level, paths, share = np.full(n, -1), np.zeros(n), np.zeros(n)
    level[source], paths[source] = 0, 1.0
    front, steps = np.array([source]), []
    while len(front):
        many = begin[front + 1] - begin[front]
        a = np.repeat(front, many)
        b = near[np.repeat(begin[front] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        level[b[level[b] < 0]] = len(steps) + 1
        on = level[b] == len(steps) + 1
        a, b = a[on], b[on]
        np.add.at(paths, b, paths[a] * (size[a] if steps else 1.0))
        steps.append((a, b))
        front = np.unique(b)
    for a, b in reversed(steps):
        np.add.at(share, a, size[b] * paths[a] / paths[b] * (1 + share[b]))
    share[source] = 0.0
    through += size[source] * share


def _shares_by_joins(graph_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """number, share of each node of a class from a block of sources: levels as tables (source, number, paths), each written."""
    front = stored(sources.select(F.col("number").alias("source"), "number", F.lit(1.0).alias("paths")), "level")
    levels = [front]
    seen = front.select("source", "number")
    while True:
        ways = F.col("paths") * F.when(F.col("x") == F.col("source"), F.lit(1)).otherwise(F.col("x_size"))
        reached = front.join(graph_rows, front["number"] == graph_rows["x"]).groupBy("source", F.col("y").alias("number")).agg(F.sum(ways).alias("paths"))
        # A neighbour of a level is on the one before, on the same, or new.
        front = stored(reached.join(seen, ["source", "number"], "left_anti"), "level")
        if front.isEmpty():
            break
        seen = levels[-1].select("source", "number").unionByName(front.select("source", "number"))
        levels.append(front)
    share = levels[-1].select("source", "number", "paths", F.lit(0.0).alias("share"))
    every = share.select("source", "number", "share")
    for before in reversed(levels[1:-1]):
        a = before.select("source", F.col("number").alias("x"), F.col("paths").alias("own"))
        back = share.join(graph_rows.select("x", F.col("y").alias("number"), "y_size"), "number").join(a, ["source", "x"])
        given = back.groupBy("source", F.col("x").alias("number")).agg(F.sum(F.col("y_size") * F.col("own") / F.col("paths") * (1 + F.col("share"))).alias("share"))
        share = stored(before.join(given, ["source", "number"], "left").select("source", "number", "paths", F.coalesce("share", F.lit(0.0)).alias("share")), "share")
        every = every.unionByName(share.select("source", "number", "share"))
    weighed = every.join(sources.select(F.col("number").alias("source"), "size"), "source")
    return weighed.groupBy("number").agg(F.sum(F.col("size") * F.col("share")).alias("share"))


def visible(node: DataFrame, edge: DataFrame, kinds: Sequence[str], theme_cap: int, limit: int, least_weight: int, focus: str | None = None, text: str | None = None) -> DataFrame:
    """Nodes shown: kinds, at most theme_cap themes in the whole order, a limit (50 at least), edges of a weight,
    isolated nodes dropped if any edge is left, then a node's or a search's neighbourhood."""
    ided = node.where(F.col("kind").isin(list(kinds))).withColumn("id", F.concat("kind", F.lit("::"), "value"))
    shown = theme_capped(ided, theme_cap).orderBy(*by_count(), "kind").limit(max(50, limit))
    ids = shown.select("id")
    kept = edge.where(F.col("n") >= least_weight).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    if not kept.isEmpty():
        shown = shown.join(kept.select(F.col("source").alias("id")).union(kept.select("target")).distinct(), "id", "left_semi")
    for seed in ([F.col("id") == focus] if focus else []) + ([F.contains(F.lower("value"), F.lit(text.lower()))] if text else []):
        hit = shown.where(seed).select("id")
        a = kept.join(hit.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
        b = kept.join(hit.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
        shown = shown.join(hit.union(a).union(b).distinct(), "id", "left_semi")
    return shown


def scope(reports: DataFrame, rows: DataFrame, shown: DataFrame, required: Sequence[str] = (), key: str = "report_id") -> DataFrame:
    """Reports with a node that is shown, and with all required nodes."""
    ided = rows.select(key, F.concat("kind", F.lit("::"), "value").alias("id"))
    keys = ided.join(shown.select("id"), "id", "left_semi").select(key).distinct()
    out = reports.join(keys, key, "left_semi")
    if required:
        full = ided.where(F.col("id").isin(list(required))).groupBy(key).agg(F.countDistinct("id").alias("m")).where(F.col("m") == len(set(required)))
        out = out.join(full, key, "left_semi")
    return out


def focus_panel(edge: DataFrame, node_id: str, overall: int = 10, each: int = 5) -> DataFrame:
    """Neighbours of a node by weight: which are among the first overall and among the first of their kind."""
    near = edge.where(F.col("source") == node_id).select(F.col("target").alias("id"), "n").union(edge.where(F.col("target") == node_id).select("source", "n"))
    near = near.groupBy("id").agg(F.sum("n").alias("n")).withColumn("kind", F.split_part("id", F.lit("::"), F.lit(1)))
    best = near.orderBy(F.desc("n"), "id").limit(overall).select("id", F.lit(True).alias("overall"))
    kinds = [r["kind"] for r in near.select("kind").distinct().collect()]  # four kinds of nodes
    firsts = [near.where(F.col("kind") == k).orderBy(F.desc("n"), "id").limit(max(each, overall)) for k in kinds]
    few = reduce(lambda a, b: a.unionByName(b), firsts, near.limit(0))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "id"))
    return few.withColumn("rank", rank).join(best, "id", "left").where((F.col("rank") <= each) | F.col("overall")).select("id", "kind", "n", "rank", F.coalesce("overall", F.lit(False)).alias("overall"))


def fallback_nodes(node: DataFrame, shown: DataFrame, themes: int = 24, receivers: int = 40) -> DataFrame:
    """What is shown, or the most common themes and receivers where that is nothing."""
    return shown if not shown.isEmpty() else first_of_kinds(node.where(F.col("kind").isin("theme", "receiver")), {"theme": themes, "receiver": receivers})


def search_nodes(node: DataFrame, text: str, n: int = 80) -> DataFrame:
    """Nodes whose name or kind holds a text, most common first."""
    t = F.lit(text.lower())
    return node.where(F.contains(F.lower("value"), t) | F.contains(F.lower("kind"), t)).orderBy(F.desc("n"), F.lower("value"), "value", "kind").limit(n)


def summary(rows: DataFrame, node: DataFrame, edge: DataFrame) -> DataFrame:
    """One row: reports with a theme, theme assignments, nodes, edges, the top theme, limits of the display."""
    t = rows.where("kind = 'theme'").agg(F.countDistinct("report_id").alias("reports_with_theme"), F.count(F.lit(1)).alias("theme_assignments"))
    top = node.where("kind = 'theme'").orderBy(F.desc("n"), "value").limit(1).select(F.col("value").alias("top_theme"))
    ns, es = node.agg(F.count(F.lit(1)).alias("nodes")), edge.agg(F.count(F.lit(1)).alias("edges"), F.greatest(F.lit(1), F.coalesce(F.max("n"), F.lit(1))).alias("max_edge_weight"))
    one = t.crossJoin(F.broadcast(ns)).crossJoin(F.broadcast(es)).join(F.broadcast(top), F.lit(True), "left")  # one row each
    n = F.col("nodes")
    default = F.least(F.lit(180), F.greatest(F.lit(50), n))
    return one.withColumn("default_limit", default).withColumn("max_limit", F.greatest(default, F.least(F.lit(420), F.greatest(F.lit(80), n))))
