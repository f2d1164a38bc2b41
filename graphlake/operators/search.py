"""Keyword search and traversal: scoring, expansion, paths, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.functions.text import tokens
from graphlake.operators.graph import both_ways, induced_subgraph, node_degrees, threshold_of
from graphlake.plans.storage import cut


def search_index(nodes: DataFrame) -> DataFrame:
    """Nodes with their lower-case label, the label without trailing parentheses and its token string."""
    norm = F.lower("label")
    return nodes.withColumns({"norm": norm, "bare": F.regexp_replace(norm, r"[()]+$", ""), "toks": F.array_join(F.regexp_extract_all(norm, F.lit("([a-z0-9]+)"), F.lit(1)), " "), "lid": F.lower("id")})


def query_tokens(spark, terms: list[str]) -> list[str]:
    """Distinct ASCII tokens of the terms in order."""
    row = spark.range(1).select(tokens(F.lit(" ".join(terms))).alias("t")).first()
    return list(row["t"])


def idf_terms(index: DataFrame, terms: list[str]) -> DataFrame:
    """``term, df, idf`` by substring of the label, all terms in one pass."""
    counts = index.agg(F.count("*").alias("n"), *[F.count_if(F.contains("norm", F.lit(t))).alias(f"t{k}") for k, t in enumerate(terms)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{k}").alias("df")) for k, t in enumerate(terms)]))
    return counts.select("n", rows.alias("x")).select("x.term", "x.df", (F.log((F.col("n") + 1) / (F.col("x.df") + 1)) + 1).alias("idf"))


def score_nodes(nodes: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """``id, score, degree`` of every node that the terms match, best first.

    The joined terms weigh most (equal, then prefix), then each term by its first fitting tier (equal,
    prefix, substring) times its rarity; the source path adds half a point of rarity. Rarities are a few
    numbers, one for each term, and go into the expression as literals.
    """
    index = search_index(nodes)
    words = query_tokens(nodes.sparkSession, terms)
    if not words:
        return index.select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("degree")).filter("false")
    idf = {r["term"]: r["idf"] for r in idf_terms(index, words).collect()}
    joined, weight = " ".join(words), max([1.0, *idf.values()])
    equal = (F.col("norm") == joined) | (F.col("bare") == joined) | (F.col("toks") == joined) | (F.col("lid") == joined)
    prefix = F.startswith("norm", F.lit(joined)) | F.startswith("bare", F.lit(joined)) | F.startswith("toks", F.lit(joined))
    whole = F.when(equal, 10000.0 * weight).when(prefix, 1000.0 * weight).otherwise(0.0)
    tier, loose, hits, source = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0.0)
    for t in words:
        same = (F.col("norm") == t) | (F.col("bare") == t)
        begins = F.startswith("norm", F.lit(t)) | F.startswith("bare", F.lit(t))
        inside = F.contains("norm", F.lit(t))
        tier = tier + F.when(same, 1000.0 * idf[t]).when(begins, 100.0 * idf[t]).otherwise(0.0)
        loose = loose + F.when(~same & ~begins & inside, idf[t]).otherwise(0.0)
        hits = hits + (same | begins | inside).cast("int")
        source = source + F.when(F.contains(F.lower("source_file"), F.lit(t)), 0.5 * idf[t]).otherwise(0.0)
    score = whole + loose + source + tier * hits / len(words)
    scored = index.select("id", F.coalesce(score, F.lit(0.0)).alias("score")).filter("score > 0")
    return scored.join(node_degrees(nodes, edges).select("id", "degree"), "id").select("id", "score", "degree")


def top_scored(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc("degree"), "id").limit(k)


def find(nodes: DataFrame, edges: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Nodes named exactly ``text`` by degree, else the best scored."""
    want = text.lower()
    exact = search_index(nodes).filter((F.col("norm") == want) | (F.col("bare") == want) | (F.col("lid") == want)).select("id")
    exact = exact.join(node_degrees(nodes, edges).select("id", "degree"), "id").select("id", F.lit(0.0).alias("score"), "degree")
    if not exact.isEmpty():
        return exact.orderBy(F.desc("degree"), "id").limit(k)
    return top_scored(score_nodes(nodes, edges, [text]), k)


def _ends(edges: DataFrame) -> DataFrame:
    """``u, v`` of edges from either end, without loops; a pair may repeat, as every level drops repetitions."""
    e = edges.filter("source <> target")
    return e.select(F.explode(F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v")))).alias("x")).select("x.*")


def expand_bfs(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = 2, hubs: bool = True) -> DataFrame:
    """``id, hop`` of the nodes within ``depth`` of the seeds.

    With ``hubs`` false, nodes of at least the hub threshold's degree are reached but not expanded, seeds
    excepted. One join for each level; every level is cut into a table.
    """
    adjacency = _ends(edges)
    spark = nodes.sparkSession
    seen = nodes.filter(F.col("id").isin(*seeds)).select("id", F.lit(0).alias("hop"))
    busy = None
    if not hubs:
        d = cut(node_degrees(nodes, edges).select("id", "degree"))
        limit = threshold_of(d).first()["threshold"]
        busy = cut(d.filter((F.col("degree") >= limit) & ~F.col("id").isin(*seeds)).select("id"))
    frontier = seen
    for hop in range(1, depth + 1):
        # Hubs are taken from the level, not from all edges.
        open_ = frontier if busy is None else frontier.join(busy, "id", "left_anti")
        step = open_.select(F.col("id").alias("u")).join(adjacency, "u").select(F.col("v").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if depth else spark.createDataFrame([(s, 0) for s in seeds], "id string, hop int")


def expand_edges(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """All edges among the visited nodes: what a breadth-first expansion records."""
    return induced_subgraph(edges, visited)


def expand_dfs(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = 2, batch: int = 2000) -> DataFrame:
    """``id, hop`` in depth-first order of a stack: neighbours pushed in ascending, popped in descending order.

    The order is sequential by nature, so the driver walks it. It holds the visited ids and the stack; the
    neighbours of up to ``batch`` stack tops come from one scan of the adjacency at a time, and nodes at the
    last level are not looked up at all.
    """
    adjacency = cut(both_ways(edges.filter("source <> target")).distinct())
    known: dict[str, list[str]] = {}
    visited: dict[str, int] = {}
    stack = [(s, 0) for s in reversed(seeds)]
    while stack:
        v, d = stack.pop()
        if v in visited or d > depth:
            continue
        visited[v] = d
        if d == depth:
            continue
        if v not in known:
            ask = list(dict.fromkeys([v, *(w for w, e in reversed(stack[-4 * batch :]) if e < depth and w not in visited and w not in known)]))[:batch]
            known.update({w: [] for w in ask})
            for r in adjacency.filter(F.col("u").isin(ask)).collect():
                known[r["u"]].append(r["v"])
        for w in sorted(known.pop(v)):
            if w not in visited:
                stack.append((w, d + 1))
    return nodes.sparkSession.createDataFrame([(k, v) for k, v in visited.items()], "id string, hop int")


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """``pos, id`` along the shortest undirected path; of several the least by ids. Empty if there is none.

    Levels grow from ``end`` until they hold ``start`` or nothing is left. A row is a node and its least
    neighbour one level nearer; the path is read back along these, one row from each level.
    """
    adjacency = _ends(edges)
    spark = edges.sparkSession
    level = cut(spark.createDataFrame([(end, end)], "id string, nearer string"))
    levels, before = [level], None
    while start != end and level.filter(F.col("id") == start).isEmpty():
        step = level.select(F.col("id").alias("u")).join(adjacency, "u").groupBy(F.col("v").alias("id")).agg(F.min("u").alias("nearer"))
        # A neighbour of a level lies in it, before or after it.
        known = level.select("id") if before is None else level.select("id").unionByName(before.select("id"))
        before, level = level, cut(step.join(known, "id", "left_anti"))
        if level.isEmpty():
            return spark.createDataFrame([], "pos int, id string")
        levels.append(level)
    path = [start]
    for at in reversed(levels[1:]):
        path.append(at.filter(F.col("id") == path[-1]).first()["nearer"])
    return spark.createDataFrame(list(enumerate(path)), "pos int, id string")


def path_directions(edges: DataFrame, path: DataFrame) -> DataFrame:
    """The edges along a path with the way each points: ``pos, a, b, relation, arrow``."""
    nxt = path.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("b"))
    steps = path.withColumnRenamed("id", "a").join(nxt, "pos")
    e = edges.select("source", "target", "relation")
    ahead = steps.join(e, (F.col("a") == F.col("source")) & (F.col("b") == F.col("target"))).select("pos", "a", "b", "relation", F.lit("-->").alias("arrow"))
    back = steps.join(e, (F.col("b") == F.col("source")) & (F.col("a") == F.col("target"))).select("pos", "a", "b", "relation", F.lit("<--").alias("arrow"))
    return ahead.unionByName(back)


def explain_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """A node's card and its neighbours, the best connected first: ``section, id, label, detail, degree``."""
    from graphlake.operators.graph import neighbors

    own = node_degrees(nodes, edges).filter(F.col("id") == node_id).select(F.lit("node").alias("section"), "id", "label", F.col("source_file").alias("detail"), "degree")
    near = neighbors(nodes, edges, node_id).select(F.lit("neighbor").alias("section"), "id", "label", F.concat_ws(" ", "direction", "relation").alias("detail"), "degree")
    return own.unionByName(near)


def community_members(nodes: DataFrame, edges: DataFrame, community: int) -> DataFrame:
    """``id, label, source_file, degree`` of one community."""
    return node_degrees(nodes.filter(F.col("community") == community), edges).select("id", "label", "source_file", "degree")


def within_budget(lines: DataFrame, line: str, order: list[Column | str], budget: int) -> DataFrame:
    """Lines in order while their bytes, with one line end each, fit ``3 * budget``.

    Lines are first cut to those that could fit by count, so the running sum sees few rows.
    """
    size = 3 * budget
    first = lines.orderBy(*order).limit(size + 1)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("upto", F.sum(F.octet_length(line) + 1).over(w) - 1).filter(F.col("upto") <= size).drop("upto")


def render(nodes: DataFrame, edges: DataFrame, visited: DataFrame, budget: int = 2000) -> DataFrame:
    """Node lines by hop, degree and id, then edge lines, within the budget: ``line``."""
    n = node_degrees(nodes, edges).join(visited, "id")
    first = n.select(F.lit(0).alias("part"), "hop", (-F.col("degree")).alias("less"), F.col("id").alias("key"), F.concat(F.lit("NODE "), "label", F.lit(" [src="), "source_file", F.lit(" loc="), "source_location", F.lit("]")).alias("line"))
    names = nodes.select("id", "label")
    e = induced_subgraph(edges, visited).join(names.select(F.col("id").alias("source"), F.col("label").alias("sl")), "source").join(names.select(F.col("id").alias("target"), F.col("label").alias("tl")), "target")
    second = e.select(F.lit(1).alias("part"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("less"), F.concat_ws("|", "source", "target", "relation").alias("key"), F.concat(F.lit("EDGE "), "sl", F.lit(" --"), "relation", F.lit(" ["), "confidence", F.lit("]--> "), "tl").alias("line"))
    return within_budget(first.unionByName(second), "line", ["part", "hop", "less", "key"], budget)


def query(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 2, budget: int = 2000, seeds: int = 3) -> DataFrame:
    """Search, expand and render; zero options mean the defaults."""
    depth, budget, seeds = depth or 2, budget or 2000, seeds or 3
    start = [r["id"] for r in top_scored(score_nodes(nodes, edges, question.split()), seeds).collect()]
    if not start:
        return nodes.select(F.lit("").alias("line")).limit(0)
    return render(nodes, edges, expand_bfs(nodes, edges, start, depth, hubs=False), budget)

