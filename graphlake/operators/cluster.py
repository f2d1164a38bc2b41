"""Communities: Leiden, cohesion, hubs, splits, numbering, labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators import blocks
from graphlake.operators.graph import both_ways, degrees, node_degrees, numbered, with_pair
from graphlake.plans.storage import cut

#: Nodes up to which the driver and each task hold numbers of all nodes: about 40 bytes each at the driver.
HELD_NODES = 1 << 25


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (least id reachable) by hooking to the least neighbour and contracting."""
    left = cut(with_pair(edges).filter("lo <> hi").select(F.col("lo").alias("u"), F.col("hi").alias("v")).distinct())
    names = None
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("root")))
        for _ in range(2):
            up = hook.select(F.col("id").alias("root"), F.col("root").alias("up"))
            hook = cut(hook.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")))
        step = hook.select(F.col("id").alias("root"), F.col("root").alias("up"))
        names = hook if names is None else cut(names.join(step, "root", "left").select("id", F.coalesce("up", "root").alias("root")))
        u, v = hook.select(F.col("id").alias("u"), F.col("root").alias("ru")), hook.select(F.col("id").alias("v"), F.col("root").alias("rv"))
        moved = left.join(u, "u").join(v, "v").filter("ru <> rv")
        left = cut(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        if left.isEmpty():
            return names.select("id", F.col("root").alias("component"))


def cohesion(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """``community, size, cohesion``: inner pairs over possible pairs; 1 for single members."""
    size = membership.groupBy("community").agg(F.count("*").alias("size"))
    # Repeated members count as often as they stand there.
    m = membership.groupBy("id", "community").agg(F.count("*").alias("times"))
    a = m.select(F.col("id").alias("lo"), "community", "times")
    b = m.select(F.col("id").alias("hi"), F.col("community").alias("other"), F.col("times").alias("others"))
    # Pairs of two communities go before parallel edges are dropped, so that takes no shuffle of all edges.
    pairs = with_pair(edges).filter("lo <> hi").select("lo", "hi").join(a, "lo").join(b, "hi").filter("community = other")
    inner = pairs.select("lo", "hi", "community", (F.col("times") * F.col("others")).alias("k")).distinct().groupBy("community").agg(F.sum("k").alias("inner"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    return size.join(inner, "community", "left").select("community", "size", F.when(F.col("size") <= 1, 1.0).otherwise(F.coalesce("inner", F.lit(0)) / possible).alias("cohesion"))


def label_by_hub(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Each community's name: the label of its member of highest degree, then least id, without ``()``."""
    n = node_degrees(nodes.drop("community"), edges).join(membership, "id")
    best = n.groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("less"), "id", "label")).alias("b"))
    return best.select("community", F.regexp_replace("b.label", r"\(\)$", "").alias("name"))


def hubs_over_percentile(nodes: DataFrame, edges: DataFrame, percent: float) -> DataFrame:
    """Nodes whose degree is over the one at index ``int(n * percent / 100) - 1``."""
    from graphlake.operators.graph import order_statistic

    d = node_degrees(nodes, edges)
    at = F.greatest(F.floor(F.col("n") * F.lit(percent) / 100) - 1, F.lit(0))
    limit = order_statistic(d, "degree", at).withColumnRenamed("degree", "limit")
    return d.crossJoin(F.broadcast(limit)).filter("degree > limit").select("id", "degree")


def reattach(orphans: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Orphans ``(id)`` join the community most of their placed neighbours have; ties go to the least number."""
    placed = membership.select(F.col("id").alias("v"), "community")
    votes = orphans.select(F.col("id").alias("u")).join(both_ways(edges), "u").join(placed, "v").groupBy("u", "community").agg(F.count("*").alias("n"))
    return votes.groupBy(F.col("u").alias("id")).agg(F.max_by("community", F.struct(F.col("n"), -F.col("community"))).alias("community"))


def number_communities(membership: DataFrame) -> DataFrame:
    """Communities numbered from 0 by size, largest first, then by least member."""
    size = membership.groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    # One row for each community.
    numbered = size.withColumn("number", F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1)
    return membership.join(numbered.select("community", "number"), "community").select("id", F.col("number").alias("community"))


def _moved(links: DataFrame, strength: DataFrame, state: DataFrame, resolution: float, rounds: int, seed: int) -> DataFrame:
    """Local moves ``(id, c)`` by modularity gain, half of the nodes in a round, until two rounds move nothing.

    ``links``: u, v, w both ways without loops; ``strength``: id, k with loops counted twice, and t, the sum of k over
    the graph that the node belongs to. A node weighs its own community without itself, as if it had left it. Sums are of whole numbers, so the moves are the same on every run.
    """
    k, quiet = strength.withColumnRenamed("id", "u"), 0
    for r in range(rounds):
        held = state.join(strength.select("id", "k"), "id").groupBy("c").agg(F.sum("k").alias("held"))
        near = links.join(state.select(F.col("id").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
        own = state.select(F.col("id").alias("u"), F.col("c").alias("own"))
        stay = own.select("u", F.col("own").alias("c"), F.lit(0).cast("long").alias("w"))
        asked = near.unionByName(stay).groupBy("u", "c").agg(F.sum("w").alias("w")).join(own, "u").join(k, "u").join(held, "c")
        gain = F.col("w") - resolution * F.col("k") * (F.col("held") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)) / F.col("t")
        best = asked.withColumn("gain", gain).groupBy("u").agg(
            F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("b"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay")
        )
        turn = F.pmod(F.xxhash64("u", F.lit(seed)), F.lit(2)) == r % 2
        best = best.filter(turn & (F.col("b.gain") > F.col("stay") + 1e-12)).select(F.col("u").alias("id"), (-F.col("b.c")).alias("to"))
        state = cut(state.join(best, "id", "left").select("id", F.coalesce("to", "c").alias("c"), (F.col("to").isNotNull() & (F.col("to") != F.col("c"))).alias("went")))
        went = state.filter("went").count()
        state, quiet = state.drop("went"), 0 if went else quiet + 1
        if quiet == 2:
            break
    return state


def _inside(links: DataFrame, state: DataFrame) -> DataFrame:
    """The links within communities."""
    a, b = state.select(F.col("id").alias("u"), F.col("c").alias("cu")), state.select(F.col("id").alias("v"), F.col("c").alias("cv"))
    return links.join(a, "u").join(b, "v").filter("cu = cv").select("u", "v", "w")


def _linked(links: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` with every community cut into its connected parts, each named by its least member."""
    parts = connected_components(_inside(links, state).select(F.col("u").alias("source"), F.col("v").alias("target")))
    return cut(state.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("c")))


def leiden(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, groups: DataFrame | None = None, rounds: int = 10, levels: int = 32, held_nodes: int = HELD_NODES) -> DataFrame:
    """``id, community`` (the least member's id); isolated nodes stand alone.

    Each level moves nodes between communities by modularity gain, refines every community from single
    nodes by the same moves over its inner links, cuts what is not connected, and contracts the refined parts to the
    nodes of the next level, which starts from the unrefined communities. It ends where nothing moves or
    contracts. At most ``rounds`` rounds of moves are made in a level, two in its refinement, and at most ``levels`` levels.
    With ``groups`` (id, grp), of which no edge leads to another, each group is a graph of its own.

    Up to ``held_nodes`` nodes, links stay in blocks and rounds send one number for each node to the tasks
    (:mod:`graphlake.operators.blocks`); beyond, the same moves are joins. Both give the same communities.
    """
    ends = cut(edges.filter("source <> target").select("source", "target"))
    # Numbers in the order of the ids, from 0.
    names = cut(numbered(ends.select(F.explode(F.array("source", "target")).alias("id")).distinct(), ["id"], "n").select("id", (F.col("n") - 1).alias("n")))
    count = names.count()
    if not count:
        return nodes.select("id", F.col("id").alias("community"))
    # Nodes are few beside edges: they are looked up by hash, so edges are not sorted.
    side = names.hint("shuffle_hash")
    one = ends.join(side.toDF("source", "u"), "source").join(side.toDF("target", "v"), "target").select("u", "v", F.lit(1).cast("long").alias("w"))
    kind = "int" if count <= held_nodes else "long"
    one = cut(one.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"), "w"))
    links = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    of = None if groups is None else names.withColumnRenamed("id", "name").join(groups.withColumnRenamed("id", "name"), "name").select(F.col("n").alias("id"), "grp")
    found = (_leiden_held if count <= held_nodes else _leiden_joined)(names, links, of, count, resolution, rounds, levels)
    out = found.join(names.select(F.col("n").alias("c"), F.col("id").alias("community")), "c").select("id", "community")
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def _leiden_held(names: DataFrame, links: DataFrame, groups: DataFrame | None, count: int, resolution: float, rounds: int, levels: int) -> DataFrame:
    """``id, c`` (least member's number) of the names ``id, n``; the driver holds a few numbers for each node."""
    held = whole = blocks.blocks(links, 2 * links.count(), True)
    k = blocks.strengths(held, count)
    t = np.asarray(float(k.sum()))
    if groups is not None:
        size = groups.groupBy("grp").agg(F.min("id").alias("head"))
        who, head = blocks.gathered(groups.join(size, "grp").select("id", "head"))
        t = np.bincount(head, weights=k[who], minlength=count)
        t[who] = t[head]
    name = at = np.arange(count, dtype=np.int32)
    c = name
    for level in range(levels):
        c = blocks.moved(held, name, k, t, c, None, resolution, rounds, level)
        part = blocks.moved(held, name, k, t, np.arange(len(c), dtype=np.int32), c, resolution, 2, level)
        part = blocks.connected(held, part)
        # Nodes of the next level are the refined parts, in the order of their least members; they start in the communities that hold them.
        least, part = np.unique(part, return_inverse=True)
        part = part.astype(np.int32)
        at, done = part[at], len(least) == len(c)
        c = np.unique(c[least], return_inverse=True)[1].astype(np.int32)
        if done or level == levels - 1:
            break
        held = blocks.contracted(held, part)
        name, k = name[least], np.bincount(part, weights=k).astype(np.int64)
        t = t[least] if t.ndim else t
    found = blocks.connected(whole, c[at])
    sent = names.sparkSession.sparkContext.broadcast(found)

    def placed(parts):
        for p in parts:
            yield pa.RecordBatch.from_arrays([p.column("id"), pa.array(sent.value[p.column("n").to_numpy()].astype(np.int64))], ["id", "c"])

    return names.mapInArrow(placed, "id string, c long")


def _leiden_joined(names: DataFrame, links: DataFrame, groups: DataFrame | None, count: int, resolution: float, rounds: int, levels: int) -> DataFrame:
    """:func:`_leiden_held` by joins and partial sums alone."""
    links = cut(links.distinct())
    strength = links.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))
    if groups is None:
        strength = cut(strength.withColumn("t", F.lit(float(links.count()))))
    else:
        strength = strength.join(groups, "id")
        sums = strength.groupBy("grp").agg(F.sum("k").cast("double").alias("t"))
        strength = cut(strength.join(sums, "grp").select("id", "k", "t"))
    size = count
    whole, first = links, names.select(F.col("n").alias("node"), F.col("n").alias("at"))
    state = cut(names.select(F.col("n").alias("id"), F.col("n").alias("c")))
    for level in range(levels):
        state = _moved(links, strength, state, resolution, rounds, level)
        inner = cut(_inside(links, state))
        alone = cut(state.select("id", F.col("id").alias("c")))
        parts = _moved(inner, strength, alone, resolution, 2, level)
        parts = _linked(inner, parts)
        # Nodes of the next level are the refined parts; they start in the communities that hold them.
        step = parts.select(F.col("id").alias("at"), F.col("c").alias("part"))
        first = cut(first.join(step, "at").select("node", F.col("part").alias("at")))
        begin = parts.join(state.withColumnRenamed("c", "whole"), "id").groupBy("c").agg(F.min("whole").alias("whole"))
        a, b = parts.select(F.col("id").alias("u"), F.col("c").alias("pu")), parts.select(F.col("id").alias("v"), F.col("c").alias("pv"))
        links = cut(links.join(a, "u").join(b, "v").filter("pu <> pv").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(F.sum("w").alias("w")))
        strength = cut(strength.join(parts, "id").groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k"), F.max("t").alias("t")))
        state = cut(begin.select(F.col("c").alias("id"), F.col("whole").alias("c")))
        count = state.count()
        if count == size:
            break
        size = count
    found = first.join(state.withColumnRenamed("id", "at"), "at").select(F.col("node").alias("id"), "c")
    found = _linked(whole, cut(found))
    return found.join(names.select(F.col("id").alias("name"), F.col("n").alias("id")), "id").select(F.col("name").alias("id"), "c")


def split_oversized(membership: DataFrame, edges: DataFrame, share: float = 0.25, floor: int = 10, least_cohesion: float = 0.05, loose_from: int = 50) -> DataFrame:
    """Run Leiden again inside communities over ``max(floor, share * nodes)`` and large loose ones, on their own edges."""
    n = membership.count()
    c = cohesion(membership, edges)
    big = c.filter((F.col("size") > max(floor, int(n * share))) | ((F.col("size") >= loose_from) & (F.col("cohesion") < least_cohesion))).select("community")
    a = membership.select(F.col("id").alias("lo"), "community")
    b = membership.select(F.col("id").alias("hi"), F.col("community").alias("other"))
    inner = with_pair(edges).select("lo", "hi").distinct().join(a, "lo").join(b, "hi").filter("community = other").join(big, "community", "left_semi")
    inside = membership.join(big, "community", "left_semi").select("id", F.col("community").alias("grp"))
    parts = leiden(inside.select("id"), inner.select(F.col("lo").alias("source"), F.col("hi").alias("target")), groups=inside).withColumnRenamed("community", "part")
    own = F.col("community").cast("string")
    return membership.join(parts, "id", "left").select("id", F.when(F.col("part").isNotNull(), F.concat(own, F.lit("/"), "part")).otherwise(own).alias("community"))


def modularity(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: Newman modularity of a membership over unordered pairs."""
    pairs = with_pair(edges).filter("lo <> hi").select("lo", "hi").distinct()
    a, b = membership.select(F.col("id").alias("lo"), F.col("community").alias("ca")), membership.select(F.col("id").alias("hi"), F.col("community").alias("cb"))
    inner = pairs.join(a, "lo").join(b, "hi").agg(F.count("*").alias("m"), F.count_if(F.col("ca") == F.col("cb")).alias("inner"))
    d = degrees(pairs.select(F.col("lo").alias("source"), F.col("hi").alias("target"))).join(membership, "id").groupBy("community").agg(F.sum("degree").alias("k"))
    return inner.crossJoin(d.agg(F.sum(F.col("k") * F.col("k")).alias("kk"))).select((F.col("inner") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, hub_percent: float = 0.0) -> DataFrame:
    """``id, community``: numbered communities of a whole graph, the largest first.

    With ``hub_percent``, nodes over that percentile of degree are set aside, the rest is clustered
    without them, and hubs, and nodes that have hubs alone for neighbours, then join the community that most of their placed
    neighbours have (hubs first). What has no placed neighbour stands alone. Oversized and loose communities are split.
    """
    links = edges.filter("source <> target")
    hubs = cut(hubs_over_percentile(nodes, edges, hub_percent).select("id")) if hub_percent > 0 else nodes.select("id").filter("false")
    inner = links.join(hubs.withColumnRenamed("id", "source"), "source", "left_anti").join(hubs.withColumnRenamed("id", "target"), "target", "left_anti")
    rest = nodes.select("id").join(hubs, "id", "left_anti")
    linked = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    inside = inner.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    stranded = rest.join(linked, "id", "left_semi").join(inside, "id", "left_anti")
    placed = rest.join(stranded, "id", "left_anti")
    found = cut(split_oversized(leiden(placed, inner, resolution), inner))
    for late in (hubs, stranded):
        late = late.join(found, "id", "left_anti")
        votes = late.select(F.col("id").alias("u")).join(both_ways(links), "u").join(found.select(F.col("id").alias("v"), "community"), "v").groupBy("u", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("u").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("less"), "community")).alias("b")).select("id", F.col("b.community").alias("community"))
        found = cut(found.unionByName(late.join(best, "id", "left").select("id", F.coalesce("community", "id").alias("community"))))
    return number_communities(found)
