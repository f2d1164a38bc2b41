"""What a graph shows: hubs, surprises, questions, cycles, betweenness."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.fixed import IMAGE_SUFFIXES, JSON_NOISE_LABELS, NOISE_LABELS, PAPER_SUFFIXES, STRUCTURAL_RELATIONS, SURPRISE_FAMILIES
from graphlake.functions.text import suffix, top_level_dir
from graphlake.operators.build import is_concept_node, is_file_node, lookup
from graphlake.operators.cluster import connected_components
from graphlake.operators.graph import both_ways, node_degrees, with_pair
from graphlake.plans.storage import cut
from graphlake.schema import CODE_SUFFIXES


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The best connected entities: no files, concepts, JSON keys or builtin names."""
    n = node_degrees(nodes, edges)
    json_key = F.endswith(F.lower("source_file"), F.lit(".json")) & F.lower(F.trim("label")).isin(*JSON_NOISE_LABELS)
    noise = F.col("label").isin(*NOISE_LABELS)
    n = n.filter(~is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) & ~is_concept_node(F.col("source_file")) & ~json_key & ~noise)
    return n.orderBy(F.desc("degree"), "ord").limit(top).select("id", "label", "degree")


def file_category(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*CODE_SUFFIXES), "code").when(s.isin(*PAPER_SUFFIXES), "paper").when(s.isin(*IMAGE_SUFFIXES), "image").otherwise("doc")


def scored_surprises(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between files with their surprise score and reasons; structural relations and file nodes excluded."""
    n = node_degrees(nodes, edges)
    n = n.withColumn("plain", is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) | is_concept_node(F.col("source_file")))
    n = n.withColumns({"category": file_category(F.col("source_file")), "dir": top_level_dir(F.col("source_file")), "family": lookup(SURPRISE_FAMILIES, suffix(F.col("source_file")))})
    cols = ["label", "source_file", "community", "degree", "plain", "category", "dir", "family"]
    # Nodes are few beside edges: they are looked up by hash, so edges are not sorted.
    n = cut(n.select("id", *cols)).hint("shuffle_hash")
    u = n.select(F.col("id").alias("source"), *[F.col(c).alias(f"u_{c}") for c in cols])
    v = n.select(F.col("id").alias("target"), *[F.col(c).alias(f"v_{c}") for c in cols])
    e = edges.filter(~F.col("relation").isin(*STRUCTURAL_RELATIONS)).join(u, "source").join(v, "target")
    e = e.filter(~F.col("u_plain") & ~F.col("v_plain") & (F.col("u_source_file") != F.col("v_source_file")))
    conf = F.coalesce(F.when(F.col("confidence") == "", "EXTRACTED").otherwise(F.col("confidence")), F.lit("EXTRACTED"))
    crossing = F.coalesce(F.col("u_family") != F.col("v_family"), F.lit(False))
    mixed = F.array_sort(F.array("u_category", "v_category")) == F.array(F.lit("code"), F.lit("doc"))
    quiet = (conf == "INFERRED") & F.col("relation").isin("calls", "uses") & (crossing | mixed)
    bonus = F.when(quiet, 0).when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1)
    types = (F.col("u_category") != F.col("v_category")) & ~quiet
    dirs = (F.col("u_dir") != F.col("v_dir")) & ~quiet
    bridge = F.coalesce(F.col("u_community") != F.col("v_community"), F.lit(False)) & ~quiet
    base = bonus + types.cast("int") * 2 + dirs.cast("int") * 2 + bridge.cast("int")
    base = F.when(F.col("relation") == "semantically_similar_to", F.floor(base * 1.5).cast("int")).otherwise(base)
    edge_hub = (F.least("u_degree", "v_degree") <= 2) & (F.greatest("u_degree", "v_degree") >= 5)
    reasons = F.array_compact(
        F.array(
            F.when(conf.isin("AMBIGUOUS", "INFERRED"), F.concat(F.lower(conf), F.lit(" link, not stated in the source"))),
            F.when(types, F.concat(F.lit("joins file types "), F.col("u_category"), F.lit(" and "), F.col("v_category"))),
            F.when(dirs, F.lit("joins different directories")),
            F.when(bridge, F.lit("joins separate communities")),
            F.when(F.col("relation") == "semantically_similar_to", F.lit("similar without a structural link")),
            F.when(edge_hub, F.lit("a peripheral node reaches a hub")),
        )
    )
    return e.select("source", "target", "relation", "confidence", (base + edge_hub.cast("int")).alias("score"), F.array_join(reasons, "; ").alias("reasons"), F.col("u_community").alias("cu"), F.col("v_community").alias("cv"))


def surprises(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    return scored_surprises(nodes, edges).orderBy(F.desc("score"), "source", "target", "relation").limit(top).drop("cu", "cv")


def community_surprises(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The least certain edge between each pair of communities."""
    c = nodes.filter("community is not null").select("id", "community")
    e = edges.filter(~F.col("relation").isin(*STRUCTURAL_RELATIONS))
    e = e.join(c.select(F.col("id").alias("source"), F.col("community").alias("cu")), "source").join(c.select(F.col("id").alias("target"), F.col("community").alias("cv")), "target").filter("cu <> cv")
    doubt = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    best = e.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.min(F.struct(doubt.alias("doubt"), "source", "target", "relation", "confidence")).alias("e"))
    return best.select("a", "b", "e.*").orderBy("doubt", "source", "target").limit(top).select("a", "b", "source", "target", "relation", "confidence")


def questions(nodes: DataFrame, edges: DataFrame, betweenness: DataFrame, cohesion: DataFrame, top: int = 7, spell: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """What to ask about a graph: ``section, ord, subject, detail``, the first ``top`` over all sections.

    Sections: ambiguous edges, bridge nodes (three of highest betweenness), hubs with two or more inferred
    edges (the first five by degree), isolated nodes, communities of five or more with cohesion under 0.15.
    ``spell`` makes the text of an id where ids are numbers; order goes by that text.
    """
    text = lambda c: F.col(c).cast("string")
    name = lambda c: spell(F.col(c))
    amb = edges.filter("confidence = 'AMBIGUOUS'").select(F.lit(1).alias("section"), F.concat_ws("|", name("source"), name("target"), "relation").alias("key"), name("source").alias("subject"), name("target").alias("detail"))
    bridge = betweenness.filter("betweenness > 0").orderBy(F.desc("betweenness"), name("id")).limit(3).select(F.lit(2).alias("section"), F.format_string("%012.6f|%s", 99999 - F.col("betweenness"), name("id")).alias("key"), name("id").alias("subject"), F.lit("bridge").alias("detail"))
    # Degrees and inferred edges of each node in one sum over the ends of edges.
    doubt = (F.col("confidence") == "INFERRED").alias("inferred")
    ends = edges.select(F.col("source").alias("id"), doubt).unionByName(edges.select(F.col("target").alias("id"), doubt))
    sums = ends.groupBy("id").agg(F.count("*").alias("degree"), F.count_if("inferred").alias("k"))
    degrees = cut(nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), "k"))
    hubs = degrees.orderBy(F.desc("degree"), name("id")).limit(5).filter("k >= 2")
    hubs = hubs.select(F.lit(3).alias("section"), F.format_string("%012d|%s", 999999999 - F.col("degree"), name("id")).alias("key"), name("id").alias("subject"), text("k").alias("detail"))
    alone = degrees.filter("degree <= 1").agg(F.count("*").alias("k"), F.min(name("id")).alias("id")).filter("k > 0").select(F.lit(4).alias("section"), F.lit("").alias("key"), F.col("id").alias("subject"), text("k").alias("detail"))
    loose = cohesion.filter("cohesion < 0.15 and size >= 5").select(F.lit(5).alias("section"), F.format_string("%09d", "community").alias("key"), text("community").alias("subject"), text("size").alias("detail"))
    everything = amb.unionByName(bridge).unionByName(hubs).unionByName(alone).unionByName(loose)
    return everything.orderBy("section", "key").limit(top).select("section", "subject", "detail")


def import_cycles(links: DataFrame, max_length: int = 5, top: int | None = 20) -> DataFrame:
    """Simple cycles of a directed ``(source, target)`` table: ``cycle, length``, each from its least node, shortest first."""
    e = links.select("source", "target").distinct()
    paths = e.filter("target >= source").select(F.col("source").alias("start"), F.col("target").alias("at"), F.array("source").alias("path"))
    found = None
    for _ in range(max_length):
        closed = paths.filter("at = start").select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        step = paths.filter("at <> start").join(e.withColumnsRenamed({"source": "at", "target": "next"}), "at")
        paths = step.filter((F.col("next") >= F.col("start")) & (F.col("next") != F.col("at")) & (~F.array_contains("path", F.col("next")) | (F.col("next") == F.col("start"))))
        paths = paths.select("start", F.col("next").alias("at"), F.concat("path", F.array("at")).alias("path"))
    found = found.distinct().withColumn("length", F.col("length").cast("long"))
    return found.orderBy("length", "cycle").limit(top) if top else found


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges one after the other."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(first - end + size, size)


#: Edge places of one level that a step of :func:`_brandes` expands at once; it bounds the step's memory.
_STEP_PLACES = 1 << 22


def _brandes(begin: np.ndarray, near: np.ndarray, target: np.ndarray, sources: list[tuple[int, int]], edges: bool) -> np.ndarray:
    """Sums over ``sources`` (node, multiplicity) of what each node, or each place of ``near``, carries of their shortest paths, level by level.

    ``near[begin[v]:begin[v + 1]]`` are the neighbours of node v, ``target[v]`` is how many ends of paths it stands for.
    """
    n = len(begin) - 1
    out = np.zeros(len(near) if edges else n)

    def steps(front: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = begin[front + 1] - begin[front]
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // _STEP_PLACES)) + 1
        for f, k in zip(np.split(front, cuts), np.split(size, cuts), strict=True):
            place = _ranges(begin[f], k)
            yield place, np.repeat(f, k), near[place]

    for s, times in sources:
        level, count, share = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
        level[s], count[s] = 0, 1.0
        fronts, depth = [np.array([s])], 0
        while len(fronts[-1]):
            depth += 1
            for _, v, w in steps(fronts[-1]):
                level[w[level[w] < 0]] = depth
                on = level[w] == depth
                count += np.bincount(w[on], count[v[on]], n)
            fronts.append(np.flatnonzero(level == depth))
        for depth in range(len(fronts) - 2, 0, -1):
            for place, v, w in steps(fronts[depth - 1]):
                on = level[w] == depth
                v, w = v[on], w[on]
                c = count[v] / count[w] * (target[w] + share[w])
                share += np.bincount(v, c, n)
                if edges:
                    out[place[on]] += c * times
        if not edges:
            share[s] = 0.0
            out += share * times
    return out


#: Edges up to which adjacency is sent to every task; beyond, the sums are made by joins.
BETWEENNESS_EDGES = 16_000_000


def _dependencies_by_joins(weights: DataFrame, around: DataFrame, per_edge: bool) -> DataFrame:
    """The sums of :func:`_brandes` by joins, one for each level on the way out and one on the way back.

    Neighbours of a level lie in it, before it or after it, so only two levels tell what is new. Each
    level is a table of (source, node); no task holds more of the graph than its share.
    """
    ahead = around.select(F.col("u").alias("v"), F.col("v").alias("w")).join(weights.select(F.col("id").alias("w"), F.col("t").alias("to")), "w")
    ahead = cut(ahead.select("v", "w", "to"))
    levels = [cut(weights.filter("s > 0").select(F.col("id").alias("s"), F.col("s").alias("times"), F.col("id").alias("v"), F.lit(1.0).alias("paths"), F.col("t").alias("to")))]
    while not levels[-1].isEmpty():
        step = levels[-1].drop("to").join(ahead, "v").groupBy("s", "times", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"), F.max("to").alias("to"))
        for old in levels[-2:]:
            step = step.join(old.select("s", "v"), ["s", "v"], "left_anti")
        levels.append(cut(step))
    sums = []
    below = levels[-2].withColumn("share", F.lit(0.0)) if len(levels) > 2 else None
    for above in reversed(levels[:-2]):
        parents = above.select("s", F.col("v").alias("w"), F.col("paths").alias("ways"))
        flow = cut(below.join(ahead.select("v", "w"), "v").join(parents, ["s", "w"]).select("s", "times", "v", "w", (F.col("ways") / F.col("paths") * (F.col("to") + F.col("share"))).alias("c")))
        if per_edge:
            sums.append(flow.groupBy(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).agg(F.sum(F.col("c") * F.col("times")).alias("d")))
        else:
            sums.append(below.groupBy(F.col("v").alias("id")).agg(F.sum(F.col("share") * F.col("times")).alias("d")))
        shares = flow.groupBy("s", F.col("w").alias("v")).agg(F.sum("c").alias("share"))
        below = above.join(shares, ["s", "v"], "left").fillna(0.0, "share")
    if not sums:
        return weights.sparkSession.createDataFrame([], "a string, b string, d double" if per_edge else "id string, d double")
    return reduce(DataFrame.unionByName, sums)


#: Rounds in which leaves are taken off. What is left then is summed up like any other part, so they bound the steps and not the results.
PEEL_ROUNDS = 64


def _peel(own: DataFrame, links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Leaves taken off round by round: ``id, parent, s, t`` of each round, and the links that are left.

    ``own``: id and for how many sources and targets it stands; ``links``: u, v both ways, once each. ``s`` and ``t`` are
    the sums of all that hangs on a leaf, itself included.
    """
    hung: list[DataFrame] = []
    while len(hung) < PEEL_ROUNDS:
        ends = cut(links.groupBy("u").agg(F.count("*").alias("d"), F.min("v").alias("v")).filter("d = 1").select("u", "v"))
        # Of two leaves that have but each other the lesser goes.
        leaves = ends.join(ends.select(F.col("u").alias("v"), F.lit(True).alias("end")), "v", "left").filter("end is null or u < v")
        leaves = leaves.select(F.col("u").alias("id"), F.col("v").alias("parent")).join(own, "id")
        if hung:
            leaves = leaves.join(_hanging(hung), "id", "left").select("id", "parent", (F.col("s") + F.coalesce("hs", F.lit(0))).alias("s"), (F.col("t") + F.coalesce("ht", F.lit(0))).alias("t"))
        leaves = cut(leaves)
        if leaves.isEmpty():
            break
        hung.append(leaves)
        links = cut(links.join(leaves.select(F.col("id").alias("u")), "u", "left_anti").join(leaves.select(F.col("id").alias("v")), "v", "left_anti"))
    return hung, links


def _hanging(hung: list[DataFrame]) -> DataFrame:
    """For each parent the sums over its branches: sources, targets, and their products."""
    return reduce(DataFrame.unionByName, hung).groupBy(F.col("parent").alias("id")).agg(F.sum("s").alias("hs"), F.sum("t").alias("ht"), F.sum(F.col("s") * F.col("t")).alias("hst"))


def _dependencies(nodes: DataFrame, edges: DataFrame, pivots: int | None, per_edge: bool, exact_upto: int) -> tuple[DataFrame, int, int]:
    """Sums of path shares for each node or pair, from all nodes or from pivots, with the numbers of nodes and of sources.

    What hangs on the graph as a tree is taken off first: between its branches all paths are known, so their
    shares are products of branch sizes, and each node left stands for all that hung on it. Paths are searched among
    those alone; a forest needs no search at all.
    """
    n = nodes.count()
    around = cut(both_ways(edges.filter("source <> target")))
    k = n if n <= exact_upto else min(n, pivots or n)
    sources = nodes.select("id") if k == n else nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(k)
    one = F.lit(1).cast("long")
    own = sources.select("id", one.alias("s")).unionByName(around.select(F.col("u").alias("id"), F.lit(0).cast("long").alias("s")).distinct()).unionByName(nodes.select("id", F.lit(0).cast("long").alias("s")))
    own = cut(own.groupBy("id").agg(F.sum("s").alias("s")).withColumn("t", one))
    hung, core = _peel(own, around)
    weights = own.select("id", F.col("s").alias("own_s"), F.col("t").alias("own_t"))
    if hung:
        weights = weights.join(_hanging(hung), "id", "left").fillna(0, ["hs", "ht", "hst"])
    else:
        weights = weights.withColumns({c: F.lit(0).cast("long") for c in ("hs", "ht", "hst")})
    weights = cut(weights.withColumns({"s": F.col("own_s") + F.col("hs"), "t": F.col("own_t") + F.col("ht")}))
    searched = not core.isEmpty()
    held = core.select(F.col("u").alias("id")).distinct()
    found = _searched(weights.join(held, "id", "left_semi").select("id", "s", "t"), core, per_edge) if searched else None
    if not hung:
        return found if found is not None else weights.sparkSession.createDataFrame([], "a string, b string, d double" if per_edge else "id string, d double"), n, k
    # Sources and targets of the whole component: known at what was never taken off, handed down to what hung on it.
    off = reduce(DataFrame.unionByName, hung).select("id")
    total = weights.join(off, "id", "left_anti").select("id", F.col("s").alias("all_s"), F.col("t").alias("all_t"))
    if searched:
        parts = connected_components(core.filter("u < v").select(F.col("u").alias("source"), F.col("v").alias("target")))
        named = total.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
        sums = named.groupBy("part").agg(F.sum("all_s").alias("all_s"), F.sum("all_t").alias("all_t"))
        total = named.select("id", "part").join(sums, "part").select("id", "all_s", "all_t")
    totals = [cut(total)]
    for leaves in reversed(hung):
        above = reduce(DataFrame.unionByName, totals).withColumnRenamed("id", "parent")
        totals.append(cut(leaves.select("id", "parent").join(above, "parent").select("id", "all_s", "all_t")))
    total = reduce(DataFrame.unionByName, totals)
    if per_edge:
        trees = reduce(DataFrame.unionByName, hung).join(total, "id")
        carried = F.col("s") * (F.col("all_t") - F.col("t")) + F.col("t") * (F.col("all_s") - F.col("s"))
        known = trees.select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"), carried.cast("double").alias("d"))
    else:
        # Pairs in different branches of a node: all pairs less those within one hanging branch and those beyond it.
        carried = (F.col("all_s") - F.col("own_s")) * (F.col("all_t") - F.col("own_t")) - F.col("hst") - (F.col("all_s") - F.col("s")) * (F.col("all_t") - F.col("t"))
        known = weights.join(total, "id").select("id", carried.cast("double").alias("d"))
    return known if found is None else known.unionByName(found), n, k


def _searched(weights: DataFrame, around: DataFrame, per_edge: bool) -> DataFrame:
    """Sums over shortest paths among the nodes ``weights`` (id, s, t), found by search from every node with sources."""
    spark = weights.sparkSession
    if around.count() > 2 * BETWEENNESS_EDGES:
        return _dependencies_by_joins(weights, around, per_edge)
    # Numbers in the order of the ids; the adjacency of so many edges is two arrays of bounded size.
    names = cut(weights.orderBy("id"))
    known = names.orderBy("id").toArrow()
    every = known.column("id").combine_chunks()
    target, times = known.column("t").to_numpy(), known.column("s").to_numpy()
    number = spark.createDataFrame(pa.table({"id": every, "n": pa.array(np.arange(len(every), dtype=np.int32))}))
    number = cut(number)
    lo, hi = number.select(F.col("id").alias("u"), F.col("n").alias("nu")), number.select(F.col("id").alias("v"), F.col("n").alias("nv"))
    table = around.join(lo, "u").join(hi, "v").select("nu", "nv").toArrow()
    u, v = (table.column(c).to_numpy() for c in ("nu", "nv"))
    order = np.argsort(u, kind="stable")
    near, begin = v[order], np.searchsorted(u[order], np.arange(len(every) + 1))
    del table, u, v, order
    shared = spark.sparkContext.broadcast((begin, near, target))
    chosen = [(int(i), int(times[i])) for i in np.flatnonzero(times)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            d = _brandes(*shared.value, list(zip(part["s"].tolist(), part["times"].tolist(), strict=True)), per_edge)
            at = np.flatnonzero(d)
            yield pd.DataFrame({"at": at, "d": d[at]})

    work = spark.createDataFrame(chosen, "s long, times long").repartition(max(1, min(64, len(chosen) // 4)), "s")
    sums = work.mapInPandas(run, "at long, d double").groupBy("at").agg(F.sum("d").alias("d"))
    if per_edge:
        ends = np.repeat(np.arange(len(every)), np.diff(begin))
        spots = pa.table({"at": np.arange(len(near)), "a": every.take(pa.array(np.minimum(ends, near))), "b": every.take(pa.array(np.maximum(ends, near)))})
        return sums.join(spark.createDataFrame(spots), "at").select("a", "b", "d")
    return sums.join(number.withColumnRenamed("n", "at"), "at").select("id", "d")


def node_betweenness(nodes: DataFrame, edges: DataFrame, pivots: int | None = 100, exact_upto: int = 1000) -> DataFrame:
    """Shares of shortest paths through each node; from pivots, scaled, in graphs over ``exact_upto`` nodes. Without ``pivots`` exact at every size."""
    d, n, k = _dependencies(nodes, edges, pivots, False, exact_upto)
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    total = d.groupBy("id").agg(F.sum("d").alias("d"))
    return nodes.select("id").join(total, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def edge_betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d, n, _ = _dependencies(nodes, edges, None, True, 0)
    scale = 1.0 / (n * (n - 1)) if n > 1 else 1.0
    total = d.groupBy("a", "b").agg((F.sum("d") * scale).alias("betweenness"))
    pairs = with_pair(edges.filter("source <> target")).select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
    return pairs.join(total, ["a", "b"], "left").select("a", "b", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def bridge_surprises(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """For a graph without communities, of any size: its edges of highest betweenness with a note, ``a, b, betweenness, note``."""
    first = edge_betweenness(nodes, edges).withColumn("betweenness", F.round("betweenness", 9)).orderBy(F.desc("betweenness"), "a", "b").limit(top)
    return first.withColumn("note", F.concat(F.lit("bridges parts of the graph, betweenness "), F.format_number("betweenness", 3)))
