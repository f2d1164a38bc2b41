"""Several graphs as one: prefixes, community offsets, last wins, links across repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators.graph import with_pair
from graphlake.operators.resolve import unique_match


def repo_tags(paths: DataFrame) -> DataFrame:
    """``path, tag`` of graph documents ``ord, path``: the directory above the document's own, ``repo`` where there is none.

    Where several share it, its parent is put in front, and what still repeats is numbered from the second on.
    """
    parts = F.split("path", "/")
    at = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))
    n = paths.select("path", "ord", F.when(at(3).isin("", "."), "repo").otherwise(at(3)).alias("name"), at(4).alias("parent"))
    same = n.groupBy("name").agg(F.count("*").alias("k"))
    n = n.join(same, "name").withColumn("tag", F.when((F.col("k") > 1) & ~F.col("parent").isin("", "."), F.concat_ws("_", "parent", "name")).otherwise(F.col("name")))
    again = F.row_number().over(Window.partitionBy("tag").orderBy("ord", "path"))
    return n.withColumn("i", again).select("path", F.when(F.col("i") > 1, F.concat_ws("-", "tag", F.col("i").cast("string"))).otherwise(F.col("tag")).alias("tag"))


def prefixed(nodes: DataFrame, edges: DataFrame, tag: str, offset: int) -> tuple[DataFrame, DataFrame]:
    """Own nodes become ``tag::id`` with community numbers moved by ``offset``; external ones stay as they are.

    Edges with an end that is no node of ``nodes`` are left out.
    """
    own = ~F.coalesce(F.col("external"), F.lit(False))
    n = nodes.withColumn("local_id", F.col("id")).withColumn("repo", F.when(own, F.lit(tag)))
    n = n.withColumn("community", F.when(own, F.col("community") + offset).otherwise(F.col("community"))).withColumn("id", F.when(own, F.concat(F.lit(f"{tag}::"), "id")).otherwise(F.col("id")))
    ids = n.select("local_id", "id")
    s, t = ids.select(F.col("local_id").alias("source"), F.col("id").alias("s2")), ids.select(F.col("local_id").alias("target"), F.col("id").alias("t2"))
    e = edges.join(s, "source").join(t, "target").select(F.col("s2").alias("source"), F.col("t2").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])
    return n, e


def last_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """For each key the row of the highest ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def merge_graphs(graphs: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Union of tagged graphs; of nodes by id and edges by unordered pair the last one wins.

    The first graph's community numbers stay; each later graph starts after all before it.
    """
    nodes, edges, offset = [], [], 0
    for k, (tag, n, e) in enumerate(graphs):
        pn, pe = prefixed(n, e, tag, offset)
        nodes.append(pn.withColumn("graph", F.lit(k)))
        edges.append(pe.withColumn("graph", F.lit(k)))
        top = n.filter(~F.coalesce(F.col("external"), F.lit(False))).agg(F.max("community")).first()[0]
        offset += (top + 1) if top is not None else 0
    all_nodes = last_wins(reduce(DataFrame.unionByName, nodes), ["id"], "graph").drop("graph")
    all_edges = with_pair(reduce(DataFrame.unionByName, edges))
    best = all_edges.groupBy("lo", "hi").agg(F.max(F.struct("graph", *[c for c in all_edges.columns if c not in ("lo", "hi", "graph")])).alias("r"))
    return all_nodes, best.select("r.*").drop("graph")


def dedupe_hyperedges(hyperedges: DataFrame) -> DataFrame:
    """The first hyperedge of each id; those without an id all stay."""
    rest = [c for c in hyperedges.columns if c not in ("id", "ord")]
    named = F.coalesce("id", F.lit("")) != ""
    first = hyperedges.filter(named).groupBy("id").agg(F.min(F.struct("ord", *rest)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])
    return first.unionByName(hyperedges.filter(~named).select("id", *rest))


def shared_types(types: DataFrame, existing: DataFrame) -> DataFrame:
    """``same_type_as`` (0.9) between types ``id, label, namespace, repo, ord`` of one name in different repositories."""
    a = types.select(*[F.col(c).alias(f"a_{c}") for c in types.columns])
    b = types.select(*[F.col(c).alias(f"b_{c}") for c in types.columns])
    m = a.join(b, (F.col("a_label") == F.col("b_label")) & (F.col("a_namespace") == F.col("b_namespace")) & (F.col("a_repo") != F.col("b_repo")) & (F.col("a_ord") < F.col("b_ord")))
    pairs = m.select(F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"))
    have = with_pair(existing).select("lo", "hi").distinct()
    return pairs.join(have, ["lo", "hi"], "left_anti").select("source", "target", F.lit("same_type_as").alias("relation"), F.lit(0.9).alias("score"))


def cross_repo_calls(parked: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """Parked calls ``caller_id, repo, callee, type_name`` bound to the one type of that name in other repositories and its one method."""
    # Types are summed up by name and repository before calls meet them: least and greatest id are all that uniqueness needs.
    held = types.groupBy(F.col("label").alias("type_name"), F.col("repo").alias("type_repo")).agg(F.min("id").alias("type_id"), F.max("id").alias("_most"))
    asked = parked.select("caller_id", "repo", "callee", "type_name").distinct()
    m = asked.join(held, "type_name").filter("repo <> type_repo")
    sole = m.groupBy("caller_id", "callee", "type_name").agg(F.min("type_id").alias("type_id"), F.max("_most").alias("_most")).filter("type_id = _most").drop("_most")
    one = unique_match(methods, ["type_id", "name"]).select("type_id", F.col("name").alias("callee"), F.col("id").alias("target"))
    return sole.join(one, ["type_id", "callee"]).select(F.col("caller_id").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("score")).distinct()


def in_adjacency_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with ``place``: by the earlier of their ends' positions, then the later, then the relation."""
    o = nodes.select("id", "ord")
    e = edges.join(o.select(F.col("id").alias("source"), F.col("ord").alias("so")), "source").join(o.select(F.col("id").alias("target"), F.col("ord").alias("to")), "target")
    return e.withColumn("place", F.struct(F.least("so", "to").alias("first"), F.greatest("so", "to").alias("second"), F.col("relation"))).drop("so", "to")
