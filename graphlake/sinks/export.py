"""Exports: one row for each line or article, written by Spark's text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.operators.cluster import cohesion
from graphlake.operators.graph import node_degrees

DEFAULT_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.55, "AMBIGUOUS": 0.2}


def cypher_text(s: Column) -> Column:
    """Control characters but tabs removed, then backslash and quote escaped."""
    clean = F.regexp_replace(F.coalesce(s, F.lit("")), r"[\x00-\x08\x0A-\x1F]", "")
    return F.replace(F.replace(clean, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def cypher_name(s: Column, fallback: str) -> Column:
    name = F.regexp_replace(s, "[^A-Za-z0-9_]", "")
    return F.when(name.rlike("^[A-Za-z]"), name).otherwise(fallback)


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MERGE statements, nodes before edges: ``part, key, line``."""
    kind = cypher_name(F.concat(F.upper(F.substring("file_type", 1, 1)), F.lower(F.substring("file_type", 2, 1000))), "Entity")
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: '"), cypher_text(F.col("id")), F.lit("', label: '"), cypher_text(F.col("label")), F.lit("'});")).alias("line"))
    rel = F.upper(cypher_name(F.col("relation"), "RELATES_TO"))
    e = edges.select(
        F.lit(1).alias("part"), F.concat_ws("|", "source", "target", "relation").alias("key"),
        F.concat(F.lit("MATCH (a {id: '"), cypher_text(F.col("source")), F.lit("'}), (b {id: '"), cypher_text(F.col("target")), F.lit("'}) MERGE (a)-[:"), rel, F.lit(" {confidence: '"), cypher_text(F.col("confidence")), F.lit("'}]->(b);")).alias("line"),
    )
    return n.unionByName(e)


def xml_text(s: Column) -> Column:
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML element lines between the document's head and foot: ``part, key, line``."""
    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="d0" for="node" attr.name="label" attr.type="string"/>', '<key id="d1" for="edge" attr.name="relation" attr.type="string"/>', '<graph edgedefault="undirected">']
    frame = spark.createDataFrame([(0, f"{i:02d}", x) for i, x in enumerate(head)] + [(3, "00", "</graph></graphml>")], "part int, key string, line string")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('"><data key="d0">'), xml_text(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "source", "target", "relation").alias("key"), F.concat(F.lit('<edge source="'), xml_text(F.col("source")), F.lit('" target="'), xml_text(F.col("target")), F.lit('"><data key="d1">'), xml_text(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    return frame.unionByName(n).unionByName(e)


def graph_json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JSON objects of nodes and links with default scores: ``part, key, line``."""
    score = F.lit(None).cast("double")
    for name, value in DEFAULT_SCORES.items():
        score = F.when(F.col("confidence") == name, value).otherwise(score)
    given = F.col("score") if "score" in edges.columns else F.lit(None).cast("double")
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.to_json(F.struct("id", "label", "file_type", "source_file", "source_location", "community", F.lower("label").alias("norm_label"))).alias("line"))
    e = edges.withColumn("confidence_score", F.coalesce(given, score)).select(F.lit(1).alias("part"), F.concat_ws("|", "source", "target", "relation").alias("key"), F.to_json(F.struct("source", "target", "relation", "confidence", "confidence_score")).alias("line"))
    return n.unionByName(e)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, parts: bool = False) -> None:
    """One canonical node-link document at ``path`` (a folder holding one text file), which has a single writer.

    With ``parts``, for graphs too large for that, the same lines go to two sorted tables, ``path/nodes`` and
    ``path/links``, by many writers; ``configs.read_graph_lines`` reads those.
    """
    rows = graph_json_rows(nodes, edges)
    if parts:
        for k, name in ((0, "nodes"), (1, "links")):
            rows.filter(F.col("part") == k).orderBy("key", "line").select("line").write.mode("overwrite").text(f"{path}/{name}")
        return
    doc = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "key", "line"))).alias("x"))
    part = lambda k: F.array_join(F.transform(F.filter("x", lambda r: r["part"] == k), lambda r: r["line"]), ",\n")
    doc.select(F.concat(F.lit('{"directed":false,"multigraph":false,"graph":{},"nodes":['), part(0), F.lit('],\n"links":['), part(1), F.lit('],"hyperedges":[]}')).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.orderBy("part", "key").select("line").write.mode("overwrite").text(path)


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def wiki_articles(nodes: DataFrame, edges: DataFrame, membership: DataFrame, names: DataFrame, top: int = 20) -> DataFrame:
    """``name, body``: an article for each community with its ``top`` best connected members."""
    from pyspark.sql import Window

    n = node_degrees(nodes.drop("community"), edges).join(membership, "id")
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    first = n.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= top)
    listed = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("- "), "label", F.lit(" ("), F.col("degree").cast("string"), F.lit(")")).alias("line")))), lambda r: r["line"]), "\n").alias("members"))
    size = n.groupBy("community").agg(F.count("*").alias("size"))
    a = listed.join(size, "community").join(names.withColumnRenamed("name", "title"), "community")
    return a.select(F.concat_ws("-", slug(F.col("title")), F.col("community").cast("string")).alias("name"), F.concat(F.lit("# "), "title", F.lit("\n\nMembers: "), F.col("size").cast("string"), F.lit("\n\n"), "members").alias("body"))


def obsidian_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``name, body``: a note for each node with links to those it points to.

    A note lists its own out-edges; a hub's list is as long as its edges, as its file has to be.
    """
    clean = F.regexp_replace("label", r'[\\/:*?"<>|#^\[\]]', "_")
    title = nodes.select("id", F.concat_ws(" ", clean, F.concat(F.lit("("), "id", F.lit(")"))).alias("name"), "file_type")
    out = edges.join(title.select(F.col("id").alias("target"), F.col("name").alias("to")), "target").groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "relation", F.lit(" [["), "to", F.lit("]]")))), "\n").alias("links"))
    return title.join(out, "id", "left").select("name", F.concat(F.lit("---\ntype: "), "file_type", F.lit("\n---\n"), F.coalesce("links", F.lit(""))).alias("body"))


def html_meta_graph(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between communities with their counts: what a page shows of a graph too large to draw."""
    # Members are few beside edges: they are looked up by hash, so edges are not sorted.
    member = membership.select("id", "community").hint("shuffle_hash")
    a, b = member.toDF("source", "ca"), member.toDF("target", "cb")
    m = edges.select("source", "target").join(a, "source").join(b, "target").filter("ca <> cb")
    return m.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n"))


def report_lines(nodes: DataFrame, edges: DataFrame, membership: DataFrame, top: int = 10) -> DataFrame:
    """``section, ord, line`` of a text report: totals, confidence, hubs, communities."""
    from graphlake.operators.analyze import god_nodes

    total = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))
    summary = total.select(F.lit("1 summary").alias("section"), F.lit(0).cast("long").alias("ord"), F.concat(F.col("n").cast("string"), F.lit(" nodes, "), F.col("m").cast("string"), F.lit(" edges")).alias("line"))
    conf = edges.groupBy(F.coalesce(F.when(F.col("confidence") != "", F.col("confidence")), F.lit("EXTRACTED")).alias("c")).agg(F.count("*").alias("k")).crossJoin(total)
    share = F.bround(F.col("k") * 100.0 / F.col("m"), 0).cast("int").cast("string")
    trust = conf.select(F.lit("2 confidence").alias("section"), F.when(F.col("c") == "EXTRACTED", 0).when(F.col("c") == "INFERRED", 1).otherwise(2).cast("long").alias("ord"), F.concat("c", F.lit(": "), share, F.lit("%")).alias("line"))
    gods = god_nodes(nodes, edges, top).select(F.lit("3 hubs").alias("section"), (-F.col("degree")).cast("long").alias("ord"), F.concat("label", F.lit(" - "), F.col("degree").cast("string"), F.lit(" edges")).alias("line"))
    com = cohesion(membership, edges).select(F.lit("4 communities").alias("section"), F.col("community").cast("long").alias("ord"), F.concat(F.lit("Community "), F.col("community").cast("string"), F.lit(": "), F.col("size").cast("string"), F.lit(" members")).alias("line"))
    return summary.unionByName(trust).unionByName(gods).unionByName(com)


def wiki_index(membership: DataFrame, names: DataFrame) -> DataFrame:
    """``ord, line`` of the wiki's index: a link for each community, the largest first."""
    size = membership.groupBy("community").agg(F.count("*").alias("size")).join(names, "community")
    link = F.concat_ws("-", slug(F.col("name")), F.col("community").cast("string"))
    return size.select(F.format_string("%012d|%09d", 999999999999 - F.col("size"), "community").alias("ord"), F.concat(F.lit("- [["), link, F.lit("]] ("), F.col("size").cast("string"), F.lit(")")).alias("line"))


def god_articles(nodes: DataFrame, edges: DataFrame, gods: DataFrame, top: int = 20) -> DataFrame:
    """``name, body``: an article for each god node with its first neighbours by degree; names that repeat carry the id."""
    from pyspark.sql import Window

    from graphlake.operators.graph import both_ways

    g = gods.select("id", "label", "degree")
    near = both_ways(edges).join(g.select(F.col("id").alias("u")), "u").join(node_degrees(nodes, edges).select(F.col("id").alias("v"), F.col("label").alias("other"), F.col("degree").alias("k")), "v")
    first = near.withColumn("i", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("k"), "v"))).filter(F.col("i") <= top)
    listed = first.groupBy(F.col("u").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "other"))), lambda r: F.concat(F.lit("- "), r["other"])), "\n").alias("lines"))
    same = g.groupBy(slug(F.col("label")).alias("slug")).agg(F.count("*").alias("n"))
    a = g.withColumn("slug", slug(F.col("label"))).join(same, "slug").join(listed, "id", "left")
    name = F.when(F.col("n") > 1, F.concat_ws("-", "slug", "id")).otherwise(F.col("slug"))
    return a.select(name.alias("name"), F.concat(F.lit("# "), "label", F.lit("\n\nEdges: "), F.col("degree").cast("string"), F.lit("\n\n"), F.coalesce("lines", F.lit(""))).alias("body"))


def stale_articles(written: DataFrame, articles: DataFrame) -> DataFrame:
    """Names among ``written`` that no article has any more: the files to remove."""
    return written.select("name").join(articles.select("name"), "name", "left_anti")


def analysis_sidecar(membership: DataFrame, cohesion: DataFrame, gods: DataFrame, surprises: DataFrame) -> DataFrame:
    """The analysis beside a graph document as JSON lines: ``part, key, line``; one line for each member, community, god and surprise."""
    m = membership.select(F.lit("community").alias("part"), F.concat_ws("|", F.format_string("%09d", "community"), "id").alias("key"), F.to_json(F.struct("community", "id")).alias("line"))
    c = cohesion.select(F.lit("cohesion").alias("part"), F.format_string("%09d", "community").alias("key"), F.to_json(F.struct("community", "size")).alias("line"))
    g = gods.select(F.lit("god").alias("part"), F.col("id").alias("key"), F.to_json(F.struct("id", "label", "degree")).alias("line"))
    s = surprises.select(F.lit("surprise").alias("part"), F.concat_ws("|", "source", "target", "relation").alias("key"), F.to_json(F.struct("source", "target", "relation", "score")).alias("line"))
    return m.unionByName(c).unionByName(g).unionByName(s)
