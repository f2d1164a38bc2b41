"""Core algebra over ``nodes`` and ``edges``: pairs, the edge fold, degrees, neighbourhoods, subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.fixed import CONFIDENCE_RANK, GENERIC_RELATIONS


def rank_of(confidence: Column) -> Column:
    out = F.lit(0)
    for name, rank in CONFIDENCE_RANK.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def with_pair(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")})


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair, by an ordered fold over ``source, target, relation, ...``.

    A reversed edge of the same relation is skipped; a generic relation never replaces a specific
    one; of one relation the higher confidence stays, then the located edge, then the higher score;
    otherwise the later edge replaces and takes over what it lacks itself. One shuffle, by pair: sets are
    built up before it, so equal rows are dropped there and a pair's array is bounded by its distinct facts.
    """
    rest = [c for c in edges.columns if c not in ("source", "target", "relation")]
    ranked = with_pair(edges).withColumn("_rank", rank_of(F.col("confidence")))
    # The rank follows from the confidence, so it does not change the order.
    item = F.struct("source", "target", "relation", *rest, "_rank")
    grouped = ranked.groupBy("lo", "hi").agg(F.array_sort(F.collect_set(item)).alias("facts"))
    first = F.element_at("facts", 1)

    def step(acc: Column, e: Column) -> Column:
        same = acc["relation"] == e["relation"]
        reversed_ = same & (acc["source"] == e["target"]) & (acc["target"] == e["source"])
        weaker = e["relation"].isin(*GENERIC_RELATIONS) & ~acc["relation"].isin(*GENERIC_RELATIONS)
        ra, rb = acc["_rank"], e["_rank"]
        located = acc["location"].isNotNull() & e["location"].isNull()
        scored = F.coalesce(acc["score"] > e["score"], F.lit(False))
        keeps = reversed_ | weaker | (same & ((ra > rb) | ((ra == rb) & (located | scored))))
        merged = F.struct(*[e[c].alias(c) for c in ("source", "target", "relation")], *[(F.coalesce(e[c], acc[c]) if c != "confidence" else e[c]).alias(c) for c in rest], e["_rank"].alias("_rank"))
        return F.when(keeps, acc).otherwise(merged)

    kept = F.aggregate(F.slice("facts", 2, F.greatest(F.size("facts") - 1, F.lit(0))), first, step)
    return grouped.select(kept.alias("e")).select("e.*").drop("_rank")


def endpoints(edges: DataFrame) -> DataFrame:
    """Every end of every edge; a self loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id"))


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Adjacency: every edge from either end, a self loop once."""
    out = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    return out.unionByName(edges.filter("source <> target").select(F.col("target").alias("u"), F.col("source").alias("v"))).distinct()


def induced_subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids(id)``."""
    s, t = ids.select(F.col("id").alias("source")).distinct(), ids.select(F.col("id").alias("target")).distinct()
    return edges.join(s, "source", "left_semi").join(t, "target", "left_semi").select(edges.columns)


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, relation: str | None = None) -> DataFrame:
    """Neighbours of a node with relation, direction and degree, the best connected first."""
    e = edges.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    if relation:
        e = e.filter(F.col("relation") == relation)
    out = F.col("source") == node_id
    e = e.select(F.when(out, F.col("target")).otherwise(F.col("source")).alias("id"), F.when(out, "out").otherwise("in").alias("direction"), "relation", "confidence")
    return e.join(node_degrees(nodes, edges).select("id", "label", "degree"), "id").select("id", "label", "direction", "relation", "confidence", "degree")


def order_statistic(values: DataFrame, column: str, index: Column) -> DataFrame:
    """The value at a zero-based ``index`` (of the count ``n``) in ascending order.

    Values are counted first, so the running sum goes over distinct values only.
    """
    from pyspark.sql import Window

    counts = values.groupBy(column).agg(F.count("*").alias("k"))
    w = Window.orderBy(column)
    ranked = counts.withColumn("upto", F.sum("k").over(w)).crossJoin(F.broadcast(counts.agg(F.sum("k").alias("n"))))
    return ranked.filter(F.col("upto") > index).agg(F.min(column).alias(column))


def hub_threshold(nodes: DataFrame, edges: DataFrame, share: float = 0.99, floor: int = 50) -> DataFrame:
    """One row: the degree at index ``int(n * share)``, at least ``floor``."""
    return threshold_of(node_degrees(nodes, edges), share, floor)


def threshold_of(degrees: DataFrame, share: float = 0.99, floor: int = 50) -> DataFrame:
    """:func:`hub_threshold` of given degrees."""
    at = F.floor(F.col("n") * F.lit(share))
    picked = order_statistic(degrees, "degree", F.least(at, F.col("n") - 1))
    return picked.select(F.greatest(F.col("degree"), F.lit(floor).cast("long")).alias("threshold"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by confidence, relation and file type, and of nodes, edges and communities, in one table."""
    by_edge = (
        edges.groupingSets([[F.col("confidence")], [F.col("relation")], []], "confidence", "relation")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        .select(F.when(F.col("g") == 1, "confidence").when(F.col("g") == 2, "relation").otherwise("edges").alias("kind"), F.coalesce("confidence", "relation", F.lit("all")).alias("name"), "n")
    )
    by_type = nodes.groupBy(F.lit("file_type").alias("kind"), F.col("file_type").alias("name")).agg(F.count("*").alias("n"))
    totals = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities"))
    totals = totals.select(F.explode(F.create_map(F.lit("nodes"), "nodes", F.lit("communities"), "communities")).alias("kind", "n")).select("kind", F.lit("all").alias("name"), "n")
    return by_edge.unionByName(by_type).unionByName(totals)


def graph_diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Nodes and (unordered pair, relation) edges that came or went: ``change, kind, a, b, relation``."""
    none = F.lit(None).cast("string")

    def keys(e: DataFrame) -> DataFrame:
        return with_pair(e).select(F.col("lo").alias("a"), F.col("hi").alias("b"), "relation").distinct()

    def nodes(x: DataFrame, y: DataFrame, change: str) -> DataFrame:
        return x.join(y.select("id"), "id", "left_anti").select(F.lit(change).alias("change"), F.lit("node").alias("kind"), F.col("id").alias("a"), none.alias("b"), none.alias("relation"))

    def edges(x: DataFrame, y: DataFrame, change: str) -> DataFrame:
        return keys(x).join(keys(y), ["a", "b", "relation"], "left_anti").select(F.lit(change).alias("change"), F.lit("edge").alias("kind"), "a", "b", "relation")

    return (
        nodes(new_nodes, old_nodes, "added").unionByName(nodes(old_nodes, new_nodes, "removed"))
        .unionByName(edges(new_edges, old_edges, "added")).unionByName(edges(old_edges, new_edges, "removed"))
    )


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 in ``order`` by a range sort: partitions count themselves and start after those before."""
    from graphlake.plans.storage import cut

    held = cut(rows.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    # The high bits are the sorted partition: one row for each.
    part = F.shiftright(name, 33)
    counts = held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["part"], total))
        total += r["n"]
    start = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    place = F.col("_start") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(F.broadcast(start), F.shiftright(name, 33) == F.col("_part")).select(*rows.columns, place.alias(name))
