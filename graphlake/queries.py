"""The registered queries over the catalogue graphs, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.operators import analyze, build, cluster, graph, merge, search
from graphlake.plans import fixtures
from graphlake.plans.fixtures import EDGES, EVENTS, NODES, RAW_EDGES, SMALL_EDGES, SMALL_NODES, frame
from graphlake.plans.storage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


_N, _E = f"nodes AS ({NODES})", f"edges AS ({EDGES})"
_DEG = "ends AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges), deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id), nd AS (SELECT n.*, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN deg d ON n.id = d.id)"
_ADJ = "adj AS (SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges)"
_BASE = f"WITH RECURSIVE {_N}, {_E}, {_DEG}, {_ADJ}"
_SMALL = f"WITH RECURSIVE nodes AS ({SMALL_NODES}), edges AS ({SMALL_EDGES}), {_DEG}, {_ADJ}"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the catalogue; the edges are derived once, as queries read them several times."""
    return frame(spark, sf_dir, NODES), cut(frame(spark, sf_dir, EDGES))


def _small(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return frame(spark, sf_dir, SMALL_NODES), frame(spark, sf_dir, SMALL_EDGES)


# ------------------------------------------------------------------ fold, degrees, statistics

_RANK = "CASE {} WHEN 'EXTRACTED' THEN 3 WHEN 'INFERRED' THEN 2 WHEN 'AMBIGUOUS' THEN 1 ELSE 0 END"
_GENERIC = "('references', 'uses', 'mentions')"


@query(
    f"""
    WITH raw AS (SELECT DISTINCT * FROM ({RAW_EDGES})), g AS (
        SELECT least(source, target) AS lo, greatest(source, target) AS hi,
            list({{'source': source, 'target': target, 'relation': relation, 'confidence': confidence, 'score': score, 'location': location, 'context': context}}
                 ORDER BY source, target, relation, confidence NULLS FIRST, score NULLS FIRST, location NULLS FIRST, context NULLS FIRST) AS facts
        FROM raw GROUP BY ALL
    ), f AS (
        SELECT list_reduce(facts, lambda a, e: CASE WHEN
            (a.relation = e.relation AND a.source = e.target AND a.target = e.source)
            OR (e.relation IN {_GENERIC} AND a.relation NOT IN {_GENERIC})
            OR (a.relation = e.relation AND ({_RANK.format("a.confidence")} > {_RANK.format("e.confidence")}
                OR ({_RANK.format("a.confidence")} = {_RANK.format("e.confidence")} AND ((a.location IS NOT NULL AND e.location IS NULL) OR coalesce(a.score > e.score, false)))))
            THEN a ELSE {{'source': e.source, 'target': e.target, 'relation': e.relation, 'confidence': e.confidence,
                'score': coalesce(e.score, a.score), 'location': coalesce(e.location, a.location), 'context': coalesce(e.context, a.context)}} END) AS e FROM g
    )
    SELECT e.source AS source, e.target AS target, e.relation AS relation, e.confidence AS confidence, e.score AS score, e.location AS location, e.context AS context FROM f
    """
)
def collapse_edges(spark, sf_dir):
    return graph.collapse_edges(frame(spark, sf_dir, RAW_EDGES))


@query(f"{_BASE} SELECT id, degree FROM nd")
def degree(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return graph.node_degrees(n, e).select("id", "degree")


@query(f"{_BASE} SELECT id, label, degree FROM nd WHERE id NOT LIKE 'region%' ORDER BY degree DESC, ord LIMIT 10")
def god_nodes(spark, sf_dir):
    return analyze.god_nodes(*_graph(spark, sf_dir))


@query(
    f"""{_BASE}, o AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM nd)
    SELECT greatest(degree, 50)::BIGINT AS threshold FROM o WHERE i = least(floor(n * 0.99)::BIGINT, n - 1)"""
)
def hub_threshold(spark, sf_dir):
    return graph.hub_threshold(*_graph(spark, sf_dir))


@query(
    f"""{_BASE} SELECT 'confidence' AS kind, confidence AS name, count(*) AS n FROM edges GROUP BY confidence
    UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation
    UNION ALL SELECT 'edges', 'all', count(*) FROM edges
    UNION ALL SELECT 'file_type', file_type, count(*) FROM nodes GROUP BY file_type
    UNION ALL SELECT 'nodes', 'all', count(*) FROM nodes
    UNION ALL SELECT 'communities', 'all', count(DISTINCT community) FROM nodes"""
)
def graph_stats(spark, sf_dir):
    return graph.graph_stats(*_graph(spark, sf_dir))


@query(f"{_BASE} SELECT e.* FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.community < 5 AND b.community < 5")
def induced_subgraph(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return graph.induced_subgraph(e, n.filter("community < 5").select("id"))


_NEAR = "SELECT CASE WHEN source = '{0}' THEN target ELSE source END AS id, CASE WHEN source = '{0}' THEN 'out' ELSE 'in' END AS direction, relation, confidence FROM edges WHERE (source = '{0}' OR target = '{0}')"


@query(f"{_BASE}, x AS ({_NEAR.format('supplier_3')} AND relation = 'calls') SELECT x.id, label, direction, relation, confidence, degree FROM x JOIN nd ON nd.id = x.id")
def neighbors_by_relation(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return graph.neighbors(n, e, "supplier_3", "calls")


@query(
    f"""{_BASE}, x AS ({_NEAR.format('nation_3')})
    SELECT 'node' AS section, id, label, source_file AS detail, degree FROM nd WHERE id = 'nation_3'
    UNION ALL SELECT 'neighbor', x.id, label, concat(direction, ' ', relation), degree FROM x JOIN nd ON nd.id = x.id"""
)
def explain_node(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return search.explain_node(n, e, "nation_3")


# ------------------------------------------------------------------ traversal and search

_HOPS = "walk AS (SELECT {seeds} AS id, 0 AS hop UNION SELECT a.v, w.hop + 1 FROM walk w JOIN adj a ON a.u = w.id WHERE w.hop < {depth} {guard})"


@query(f"{_BASE}, {_HOPS.format(seeds=chr(39) + 'supplier_1' + chr(39), depth=2, guard='')} SELECT id, min(hop)::INTEGER AS hop FROM walk GROUP BY id")
def bfs_expand_d2(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return search.expand_bfs(n, e, ["supplier_1"], 2)


@query(
    f"""{_BASE}, o AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM nd),
    lim AS (SELECT greatest(degree, 50) AS t FROM o WHERE i = least(floor(n * 0.99)::BIGINT, n - 1)),
    busy AS (SELECT id FROM nd, lim WHERE degree >= t AND id <> 'customer_1'),
    {_HOPS.format(seeds=chr(39) + 'customer_1' + chr(39), depth=3, guard='AND w.id NOT IN (SELECT id FROM busy)')} SELECT id, min(hop)::INTEGER AS hop FROM walk GROUP BY id"""
)
def bfs_hub_suppressed(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return search.expand_bfs(n, e, ["customer_1"], 3, hubs=False)


@query(
    f"""{_BASE}, {_HOPS.format(seeds=chr(39) + 'nation_3' + chr(39), depth=1, guard='')}
    SELECT e.source, e.target, e.relation, e.confidence FROM edges e WHERE source IN (SELECT id FROM walk) AND target IN (SELECT id FROM walk)"""
)
def bfs_edges(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return search.expand_edges(e, search.expand_bfs(n, e, ["nation_3"], 1))


@query()
def dfs_expand(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return search.expand_dfs(n, e, ["region_0"], 2)


#: All shortest paths from {0} to {1}, by distance to the end.
_PATH = """far AS (SELECT '{1}' AS id, 0 AS hop UNION SELECT a.v, f.hop + 1 FROM far f JOIN adj a ON a.u = f.id WHERE f.hop < 4), near AS (SELECT id, min(hop) AS hop FROM far GROUP BY id),
    paths AS (SELECT '{0}' AS id, ['{0}'] AS path UNION ALL SELECT a.v, list_append(p.path, a.v) FROM paths p JOIN near x ON x.id = p.id JOIN adj a ON a.u = p.id JOIN near y ON y.id = a.v AND y.hop = x.hop - 1),
    best AS (SELECT min(path) AS path FROM paths WHERE id = '{1}')"""


@query(f"{_BASE}, {_PATH.format('supplier_1', 'customer_2')} SELECT (unnest(range(len(path))))::INTEGER AS pos, unnest(path) AS id FROM best")
def shortest_path(spark, sf_dir):
    return search.shortest_path(frame(spark, sf_dir, EDGES), "supplier_1", "customer_2")


@query(
    f"""{_BASE}, {_PATH.format('supplier_1', 'region_0')}, s AS (SELECT (unnest(range(len(path) - 1)))::INTEGER AS pos, unnest(path[:-2]) AS a, unnest(path[2:]) AS b FROM best)
    SELECT pos, a, b, relation, '-->' AS arrow FROM s JOIN edges ON source = a AND target = b
    UNION ALL SELECT pos, a, b, relation, '<--' FROM s JOIN edges ON source = b AND target = a"""
)
def path_directions(spark, sf_dir):
    e = cut(frame(spark, sf_dir, EDGES))
    return search.path_directions(e, search.shortest_path(e, "supplier_1", "region_0"))


_TERMS = ["steel", "green", "brass"]


@query(
    f"{_BASE} SELECT term, df::BIGINT AS df, round(ln((n + 1.0) / (df + 1.0)) + 1, 6) AS idf FROM (SELECT t.term, count_if(contains(lower(label), t.term)) AS df, count(*) AS n FROM nodes, (VALUES ('steel'), ('green'), ('brass')) AS t(term) GROUP BY t.term)"
)
def idf_terms(spark, sf_dir):
    n, _ = _graph(spark, sf_dir)
    return search.idf_terms(search.search_index(n), _TERMS).withColumn("idf", F.round("idf", 6))


_SCORE = f"""
    idx AS (SELECT *, lower(label) AS norm, regexp_replace(lower(label), '[()]+$', '') AS bare, array_to_string(regexp_extract_all(lower(label), '[a-z0-9]+'), ' ') AS toks FROM nd),
    q AS (SELECT * FROM (VALUES (1, 'customer'), (2, '000000012')) AS t(k, term)),
    w AS (SELECT k, term, ln((count(*) + 1.0) / (count_if(contains(norm, term)) + 1.0)) + 1 AS idf FROM q, idx GROUP BY k, term),
    best AS (SELECT greatest(1.0, max(idf)) AS jw, string_agg(term, ' ' ORDER BY k) AS joined, count(*) AS m FROM w),
    one AS (SELECT id, degree, norm, bare, toks, lower(id) AS lid,
        sum(CASE WHEN term IN (norm, bare) THEN 1000.0 * idf WHEN starts_with(norm, term) OR starts_with(bare, term) THEN 100.0 * idf ELSE 0 END) AS tier,
        sum(CASE WHEN term IN (norm, bare) OR starts_with(norm, term) OR starts_with(bare, term) THEN 0 WHEN contains(norm, term) THEN idf ELSE 0 END) AS loose,
        count_if(contains(norm, term)) AS hits, sum(CASE WHEN contains(lower(source_file), term) THEN 0.5 * idf ELSE 0 END) AS src
        FROM idx, w GROUP BY ALL),
    scored AS (SELECT id, degree, CASE WHEN joined IN (norm, bare, toks, lid) THEN 10000.0 * jw WHEN starts_with(norm, joined) OR starts_with(bare, joined) OR starts_with(toks, joined) THEN 1000.0 * jw ELSE 0 END
        + loose + src + tier * hits / m AS score FROM one, best)"""


@query(f"{_BASE}, {_SCORE} SELECT id, round(score, 4) AS score, degree FROM scored WHERE score > 0")
def score_nodes(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return search.score_nodes(n, e, ["Customer", "000000012"]).withColumn("score", F.round("score", 4))


@query(f"{_BASE} SELECT id, 0.0::DOUBLE AS score, degree FROM nd WHERE lower(label) = 'supplier#000000002' OR lower(id) = 'supplier#000000002' ORDER BY degree DESC, id LIMIT 10")
def find_label(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return search.find(n, e, "Supplier#000000002")


@query(
    f"""{_SMALL}, v AS (SELECT 'region_0' AS id, 0 AS hop UNION SELECT target, 1 FROM edges WHERE source = 'region_0'),
    lines AS (SELECT 0 AS part, hop, -degree AS less, nd.id AS key, concat('NODE ', label, ' [src=', source_file, ' loc=', source_location, ']') AS line FROM nd JOIN v ON v.id = nd.id
        UNION ALL SELECT 1, 0, 0, concat(e.source, '|', e.target, '|', relation), concat('EDGE ', a.label, ' --', relation, ' [', confidence, ']--> ', b.label)
        FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.source IN (SELECT id FROM v) AND e.target IN (SELECT id FROM v)),
    fit AS (SELECT line, sum(strlen(line) + 1) OVER (ORDER BY part, hop, less, key) - 1 AS upto FROM lines)
    SELECT line FROM fit WHERE upto <= 300"""
)
def query_budget(spark, sf_dir):
    n, e = _small(spark, sf_dir)
    return search.render(n, e, search.expand_bfs(n, e, ["region_0"], 1), 100).select("line")


@query()
def query_question(spark, sf_dir):
    return search.query(*_graph(spark, sf_dir), "which supplier calls steel parts").select("line")


# ------------------------------------------------------------------ communities

_COH = """m AS (SELECT id, community FROM nodes WHERE community IS NOT NULL), sz AS (SELECT community, count(*) AS size FROM m GROUP BY community),
    inn AS (SELECT a.community, count(*) AS k FROM edges e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target WHERE a.community = b.community AND e.source <> e.target GROUP BY a.community),
    coh AS (SELECT sz.community, size, CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(k, 0) / (size * (size - 1) / 2.0) END AS cohesion FROM sz LEFT JOIN inn ON inn.community = sz.community)"""


def _membership(n: DataFrame) -> DataFrame:
    return n.filter("community is not null").select("id", "community")


@query(f"{_BASE}, {_COH} SELECT community, size, round(cohesion, 6) AS cohesion FROM coh")
def cohesion(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return cluster.cohesion(_membership(n), e).withColumn("cohesion", F.round("cohesion", 6))


@query(f"{_BASE} SELECT community, arg_min(label, (-degree, id)) AS name FROM nd WHERE community IS NOT NULL GROUP BY community")
def label_by_hub(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return cluster.label_by_hub(n, e, _membership(n))


@query(f"{_BASE}, {_COH} SELECT community, size FROM coh WHERE cohesion < 0.15 AND size >= 5")
def low_cohesion(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return cluster.cohesion(_membership(n), e).filter("cohesion < 0.15 and size >= 5").select("community", "size")


@query(
    f"""{_BASE}, o AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM nd), lim AS (SELECT degree AS t FROM o WHERE i = greatest(floor(n * 0.95)::BIGINT - 1, 0))
    SELECT id, degree FROM nd, lim WHERE degree > t"""
)
def cluster_hubs(spark, sf_dir):
    return cluster.hubs_over_percentile(*_graph(spark, sf_dir), 95.0)


@query(
    f"""{_BASE}, votes AS (SELECT a.u, n.community, count(*) AS k FROM adj a JOIN nodes n ON n.id = a.v WHERE a.u LIKE 'part%' AND n.id NOT LIKE 'part%' AND n.community IS NOT NULL GROUP BY ALL)
    SELECT u AS id, arg_max(community, (k, -community)) AS community FROM votes GROUP BY u"""
)
def hub_reattach(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return cluster.reattach(n.filter("id like 'part%'").select("id"), e, _membership(n.filter("id not like 'part%'")))


@query(
    f"""{_BASE}, m AS (SELECT id, community FROM nodes WHERE community IS NOT NULL), s AS (SELECT community, count(*) AS k, min(id) AS f FROM m GROUP BY community),
    r AS (SELECT community, (row_number() OVER (ORDER BY k DESC, f) - 1)::INTEGER AS number FROM s) SELECT id, number AS community FROM m JOIN r ON r.community = m.community"""
)
def number_communities(spark, sf_dir):
    n, _ = _graph(spark, sf_dir)
    return cluster.number_communities(_membership(n))


@query()
def leiden_communities(spark, sf_dir):
    return cluster.leiden(*_graph(spark, sf_dir))


@query()
def split_oversized(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return cluster.split_oversized(_membership(n), e)


@query(
    f"""{_BASE}, p AS (SELECT a.community AS ca, b.community AS cb FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.community IS NOT NULL AND b.community IS NOT NULL),
    k AS (SELECT n.community, count(*) AS k FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) x JOIN nodes n ON n.id = x.id WHERE n.community IS NOT NULL GROUP BY n.community)
    SELECT round((SELECT count_if(ca = cb) / count(*) FROM p) - (SELECT sum(k::DOUBLE * k) FROM k) / (4.0 * (SELECT count(*) FROM p) * (SELECT count(*) FROM p)), 6) AS modularity"""
)
def modularity(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return cluster.modularity(_membership(n), e).withColumn("modularity", F.round("modularity", 6))


#: Regions hold trees of nations, suppliers and customers; parts join the regions of all that relate to them.
_REGIONS = """reg AS (SELECT concat('region_', r_regionkey) AS id, r_regionkey AS r FROM region UNION ALL SELECT concat('nation_', n_nationkey), n_regionkey FROM nation
    UNION ALL SELECT concat('supplier_', s_suppkey), n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT concat('customer_', c_custkey), n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
    held AS (SELECT DISTINCT e.target AS id, r FROM edges e JOIN reg ON reg.id = e.source WHERE e.target LIKE 'part%'), link AS (SELECT DISTINCT a.r AS u, b.r AS v FROM held a JOIN held b ON a.id = b.id),
    walk AS (SELECT DISTINCT r AS u, r AS v FROM reg UNION SELECT w.u, l.v FROM walk w JOIN link l ON l.u = w.v), root AS (SELECT u AS r, min(v) AS root FROM walk GROUP BY u),
    placed AS (SELECT id, root FROM reg JOIN root USING (r) UNION SELECT id, root FROM held JOIN root USING (r))"""


@query(f"{_BASE}, {_REGIONS} SELECT id, min(id) OVER (PARTITION BY root) AS component FROM placed WHERE id IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def components(spark, sf_dir):
    return cluster.connected_components(frame(spark, sf_dir, EDGES))


# ------------------------------------------------------------------ analysis

_SURP = """t AS (SELECT *, CASE WHEN source_file LIKE '%.md' THEN 'doc' ELSE 'code' END AS cat, split_part(source_file, '/', 1) AS dir,
        CASE WHEN source_file LIKE '%.go' THEN 'go' WHEN source_file LIKE '%.py' THEN 'python' WHEN source_file LIKE '%.ts' THEN 'js' END AS fam FROM nd),
    j AS (SELECT e.source, e.target, e.relation, e.confidence, u.cat AS uc, v.cat AS vc, u.dir AS ud, v.dir AS vd, u.community AS cu, v.community AS cv, u.degree AS du, v.degree AS dv,
        confidence = 'INFERRED' AND relation IN ('calls', 'uses') AND (coalesce(u.fam <> v.fam, false) OR u.cat <> v.cat) AS quiet
        FROM edges e JOIN t u ON u.id = e.source JOIN t v ON v.id = e.target WHERE relation NOT IN ('imports', 'imports_from', 'contains', 'method') AND u.source_file <> v.source_file),
    s AS (SELECT *, CASE WHEN quiet THEN 0 WHEN confidence = 'AMBIGUOUS' THEN 3 WHEN confidence = 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN uc <> vc AND NOT quiet THEN 2 ELSE 0 END + CASE WHEN ud <> vd AND NOT quiet THEN 2 ELSE 0 END
        + CASE WHEN coalesce(cu <> cv, false) AND NOT quiet THEN 1 ELSE 0 END + CASE WHEN least(du, dv) <= 2 AND greatest(du, dv) >= 5 THEN 1 ELSE 0 END AS score,
        array_to_string(list_filter([CASE WHEN confidence IN ('AMBIGUOUS', 'INFERRED') THEN concat(lower(confidence), ' link, not stated in the source') END, CASE WHEN uc <> vc AND NOT quiet THEN concat('joins file types ', uc, ' and ', vc) END,
        CASE WHEN ud <> vd AND NOT quiet THEN 'joins different directories' END, CASE WHEN coalesce(cu <> cv, false) AND NOT quiet THEN 'joins separate communities' END, CASE WHEN least(du, dv) <= 2 AND greatest(du, dv) >= 5 THEN 'a peripheral node reaches a hub' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM j)"""


@query(f"{_BASE}, {_SURP} SELECT source, target, relation, confidence, score, reasons FROM s ORDER BY score DESC, source, target, relation LIMIT 25")
def surprises_cross_file(spark, sf_dir):
    return analyze.surprises(*_graph(spark, sf_dir), 25)


@query(f"{_BASE}, {_SURP} SELECT score, count(*) AS n FROM s GROUP BY score")
def surprise_scores(spark, sf_dir):
    return analyze.scored_surprises(*_graph(spark, sf_dir)).groupBy("score").agg(F.count("*").alias("n"))


@query(
    f"""{_BASE}, x AS (SELECT e.*, a.community AS cu, b.community AS cv FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE relation NOT IN ('imports', 'imports_from', 'contains', 'method') AND a.community <> b.community),
    r AS (SELECT *, least(cu, cv) AS a, greatest(cu, cv) AS b, CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END AS doubt FROM x),
    f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doubt, source, target) AS i FROM r)
    SELECT a, b, source, target, relation, confidence FROM f WHERE i = 1 ORDER BY doubt, source, target LIMIT 40"""
)
def surprises_cross_community(spark, sf_dir):
    return analyze.community_surprises(*_graph(spark, sf_dir), 40)


_EV = f"ev AS ({EVENTS})"


@query(
    f"""WITH RECURSIVE {_EV}, p AS (SELECT source AS start, target AS cur, [source] AS path FROM ev WHERE target >= source
    UNION ALL SELECT p.start, e.target, list_append(p.path, p.cur) FROM p JOIN ev e ON e.source = p.cur WHERE p.cur <> p.start AND len(p.path) < 5 AND e.target >= p.start AND (e.target = p.start OR (NOT list_contains(p.path, e.target) AND e.target <> p.cur)))
    SELECT array_to_string(path, '>') AS cycle, len(path)::BIGINT AS length FROM p WHERE cur = start"""
)
def import_cycles(spark, sf_dir):
    return analyze.import_cycles(frame(spark, sf_dir, EVENTS), 5, None)


#: Subtree sizes of the containment tree, which give its shortest paths in closed form.
_TREE = """up AS (SELECT id, id AS anc FROM nodes UNION ALL SELECT u.id, e.source FROM up u JOIN edges e ON e.target = u.anc), size AS (SELECT anc AS id, count(*) AS k FROM up GROUP BY anc),
    total AS (SELECT count(*) AS n FROM nodes), part AS (SELECT e.source AS id, s.k FROM edges e JOIN size s ON s.id = e.target UNION ALL SELECT s.id, n - s.k FROM size s, total)"""


@query(f"{_SMALL}, {_TREE} SELECT id, round(((max(n) - 1.0) * (max(n) - 1.0) - sum(k * k)) / ((max(n) - 1.0) * (max(n) - 2.0)), 6) AS betweenness FROM part, total GROUP BY id")
def betweenness_nodes(spark, sf_dir):
    n, e = _small(spark, sf_dir)
    return analyze.node_betweenness(n, e, pivots=None).withColumn("betweenness", F.round("betweenness", 6))


@query(f"{_SMALL}, {_TREE} SELECT least(e.source, e.target) AS a, greatest(e.source, e.target) AS b, round(2.0 * s.k * (n - s.k) / (n * (n - 1.0)), 6) AS betweenness FROM edges e JOIN size s ON s.id = e.target, total")
def betweenness_edges(spark, sf_dir):
    return analyze.edge_betweenness(*_small(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 6))


@query()
def betweenness_pivots(spark, sf_dir):
    return analyze.node_betweenness(*_graph(spark, sf_dir))


@query(
    f"""{_BASE}, {_COH}, amb AS (SELECT 1 AS section, concat_ws('|', source, target, relation) AS key, source AS subject, target AS detail FROM edges WHERE confidence = 'AMBIGUOUS'),
    inf AS (SELECT id, count(*) AS k FROM (SELECT source AS id FROM edges WHERE confidence = 'INFERRED' UNION ALL SELECT target FROM edges WHERE confidence = 'INFERRED') GROUP BY id HAVING count(*) >= 2),
    hubs AS (SELECT 3 AS section, printf('%012d|%s', 999999999 - degree, h.id) AS key, h.id AS subject, k::VARCHAR AS detail FROM (SELECT id, degree FROM nd ORDER BY degree DESC, id LIMIT 5) h JOIN inf ON inf.id = h.id),
    alone AS (SELECT 4 AS section, '' AS key, min(id) AS subject, count(*)::VARCHAR AS detail FROM nd WHERE degree <= 1 HAVING count(*) > 0),
    loose AS (SELECT 5 AS section, printf('%09d', community) AS key, community::VARCHAR AS subject, size::VARCHAR AS detail FROM coh WHERE cohesion < 0.15 AND size >= 5)
    SELECT section, subject, detail FROM (SELECT * FROM amb UNION ALL SELECT * FROM hubs UNION ALL SELECT * FROM alone UNION ALL SELECT * FROM loose) ORDER BY section, key LIMIT 100000"""
)
def questions(spark, sf_dir):
    n, e = frame(spark, sf_dir, fixtures.NUMBERED_NODES), cut(frame(spark, sf_dir, fixtures.NUMBERED_EDGES))
    none = n.select("id", F.lit(0.0).alias("betweenness")).filter("false")
    return analyze.questions(n, e, none, cluster.cohesion(_membership(n), e), 100_000, fixtures.spelled)


_OLD = "SELECT * FROM edges WHERE confidence <> 'AMBIGUOUS'"
_NEW = "SELECT * FROM edges WHERE relation <> 'references'"


@query(
    f"""{_BASE}, oe AS ({_OLD}), ne AS ({_NEW}), onn AS (SELECT * FROM nodes WHERE file_type <> 'document'), nn AS (SELECT * FROM nodes WHERE source_file NOT LIKE '%.py'),
    ok AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, relation FROM oe), nk AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, relation FROM ne)
    SELECT 'added' AS change, 'node' AS kind, id AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS relation FROM nn WHERE id NOT IN (SELECT id FROM onn)
    UNION ALL SELECT 'removed', 'node', id, NULL, NULL FROM onn WHERE id NOT IN (SELECT id FROM nn)
    UNION ALL SELECT 'added', 'edge', * FROM (SELECT * FROM nk EXCEPT SELECT * FROM ok) UNION ALL SELECT 'removed', 'edge', * FROM (SELECT * FROM ok EXCEPT SELECT * FROM nk)"""
)
def graph_diff(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return graph.graph_diff(n.filter("file_type <> 'document'"), e.filter("confidence <> 'AMBIGUOUS'"), n.filter("source_file not like '%.py'"), e.filter("relation <> 'references'"))


# ------------------------------------------------------------------ merge

_MERGED = f"""{_BASE}, g0 AS (SELECT concat('a::', id) AS id, label, coalesce(community, -1) AS community, 'a' AS repo FROM nodes WHERE source_file NOT LIKE 'app/%'),
    off AS (SELECT max(community) + 1 AS k FROM g0), g1 AS (SELECT concat('b::', id) AS id, label, coalesce(community + (SELECT k FROM off), -1) AS community, 'b' AS repo FROM nodes WHERE source_file NOT LIKE 'src/%')"""


def _two_repositories(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    n = n.withColumn("external", F.lit(False))
    a, b = n.filter("source_file not like 'app/%'"), n.filter("source_file not like 'src/%'")
    # Prefixing keeps the edges between a graph's own nodes only.
    return merge.merge_graphs([("a", a, e), ("b", b, e)])


@query(f"{_MERGED} SELECT * FROM g0 UNION ALL SELECT * FROM g1")
def merge_graphs(spark, sf_dir):
    return _two_repositories(spark, sf_dir)[0].select("id", "label", F.coalesce("community", F.lit(-1)).alias("community"), "repo")


@query(
    f"""{_MERGED} SELECT concat('a::', source) AS source, concat('a::', target) AS target, relation FROM edges WHERE concat('a::', source) IN (SELECT id FROM g0) AND concat('a::', target) IN (SELECT id FROM g0)
    UNION ALL SELECT concat('b::', source), concat('b::', target), relation FROM edges WHERE concat('b::', source) IN (SELECT id FROM g1) AND concat('b::', target) IN (SELECT id FROM g1)"""
)
def merge_graph_edges(spark, sf_dir):
    return _two_repositories(spark, sf_dir)[1].select("source", "target", "relation")


#: A part's brand and type declare a type; each part size is a repository.
_DECLARED = "SELECT min(concat('part_', p_partkey)) AS id, concat(p_brand, ' ', p_type) AS label, '' AS namespace, concat('r', p_size) AS repo, min(p_partkey) AS ord FROM part GROUP BY p_brand, p_type, p_size"


@query(f"WITH t AS ({_DECLARED}) SELECT a.id AS source, b.id AS target, 'same_type_as' AS relation, 0.9::DOUBLE AS score FROM t a JOIN t b ON a.label = b.label AND a.repo <> b.repo AND a.ord < b.ord")
def shared_types(spark, sf_dir):
    return merge.shared_types(frame(spark, sf_dir, _DECLARED), frame(spark, sf_dir, EDGES))


@query(f"{_BASE} SELECT source, target, relation, row_number() OVER (ORDER BY least(a.ord, b.ord), greatest(a.ord, b.ord), relation, source, target) AS pos FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target")
def edge_order(spark, sf_dir):
    ordered = merge.in_adjacency_order(*_graph(spark, sf_dir)).select("source", "target", "relation", "place")
    return graph.numbered(ordered, ["place", "source", "target"], "pos").drop("place")


# ------------------------------------------------------------------ build

_COLLIDING = f"SELECT * FROM ({NODES}) UNION ALL SELECT id, concat(label, ' copy'), 'mystery', source_file, NULL, NULL, ord + 500000000 FROM ({NODES}) UNION ALL SELECT id, label, 'code', concat('archive/', source_file), 'L7', 1, ord + 900000000 FROM ({NODES})"


@query(
    f"""WITH c AS ({_COLLIDING}), r AS (SELECT *, CASE WHEN starts_with(id, regexp_replace(regexp_replace(lower(regexp_replace(source_file, '\\.[^./]*$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) THEN 0 ELSE 1 END AS r0,
        CASE WHEN source_file LIKE 'archive/%' THEN 2 ELSE 1 END AS r1, length(label) AS r2, list_reverse(string_split(source_file, '/')) AS r4 FROM c),
    own AS (SELECT id, arg_min(source_file, (r0, r1, r2, label, r4, ord)) AS own, min(ord) AS first FROM r GROUP BY id)
    SELECT r.id, arg_min(label, (r0, r1, r2, label, r4, r.ord)) AS label,
        CASE WHEN arg_min(file_type, (r0, r1, r2, label, r4, r.ord)) IN ('code', 'document', 'paper', 'image', 'rationale', 'concept') THEN arg_min(file_type, (r0, r1, r2, label, r4, r.ord)) ELSE 'concept' END AS file_type,
        min(source_file) AS source_file, arg_min(source_location, (r0, r1, r2, label, r4, r.ord)) FILTER (WHERE source_location IS NOT NULL) AS source_location,
        coalesce(arg_min(community, (r0, r1, r2, label, r4, r.ord)) FILTER (WHERE community IS NOT NULL), -1) AS community, min(first) AS ord FROM r JOIN own ON own.id = r.id AND own.own = r.source_file GROUP BY r.id"""
)
def dedupe_nodes(spark, sf_dir):
    return build.dedupe_nodes(frame(spark, sf_dir, _COLLIDING)).withColumn("community", F.coalesce("community", F.lit(-1)))


_MIXED = f"SELECT id FROM ({NODES}) WHERE source_file NOT LIKE 'lib/%' UNION ALL SELECT upper(id) FROM ({NODES}) WHERE source_file NOT LIKE 'app/%' UNION ALL SELECT concat(id, '!') FROM ({NODES}) WHERE source_file LIKE 'src/%'"
_ALIAS = f"""n AS ({_MIXED}), f AS (SELECT DISTINCT id, regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS alias FROM n UNION SELECT id, concat('.', regexp_extract(id, '[^_]+$')) FROM n),
    u AS (SELECT alias, min(id) AS id FROM f GROUP BY alias HAVING count(DISTINCT id) = 1), al AS (SELECT alias, id FROM u WHERE alias NOT IN (SELECT id FROM n))"""


@query(f"WITH {_ALIAS} SELECT alias, id FROM al")
def id_alias(spark, sf_dir):
    return build.alias_map(frame(spark, sf_dir, _MIXED))


_LOOSE = f"SELECT source, target, relation FROM ({EDGES}) WHERE relation = 'contains' UNION ALL SELECT source, concat('ext_', target), 'imports' FROM ({EDGES}) WHERE relation = 'contains' AND source LIKE 'nation%' AND target LIKE 'supplier%' UNION ALL SELECT 'nation_1', concat('ext_', target), 'calls' FROM ({EDGES}) WHERE source LIKE 'nation%' AND target LIKE 'supplier%'"
_REMAP = f"""k AS (SELECT id FROM ({NODES})), e AS ({_LOOSE}), ok AS (SELECT e.*, target IN (SELECT id FROM k) AS t FROM e WHERE source IN (SELECT id FROM k)),
    st AS (SELECT target AS id, min((source, target, relation)) AS since FROM ok WHERE NOT t AND relation IN ('imports', 'imports_from', 're_exports') GROUP BY target)"""


@query(f"WITH {_REMAP} SELECT source, target, relation FROM ok LEFT JOIN st ON st.id = ok.target WHERE t OR (since IS NOT NULL AND (source, target, relation) >= since)")
def endpoint_remap(spark, sf_dir):
    n = frame(spark, sf_dir, f"SELECT id FROM ({NODES})")
    return build.remap_endpoints(n, frame(spark, sf_dir, _LOOSE), build.alias_map(n))[0]


@query(f"WITH {_REMAP} SELECT id, id AS label, 'concept' AS file_type, 'external' AS type FROM st")
def external_stubs(spark, sf_dir):
    n = frame(spark, sf_dir, f"SELECT id FROM ({NODES})")
    return build.remap_endpoints(n, frame(spark, sf_dir, _LOOSE), build.alias_map(n))[1]


@query(
    f"""{_BASE}, s AS (SELECT id, regexp_extract(source_file, '\\.[^.]+$') AS x FROM nodes), f AS (SELECT id, x, CASE x WHEN '.go' THEN 'go' WHEN '.py' THEN 'py' WHEN '.ts' THEN 'js' ELSE '' END AS f FROM s)
    SELECT e.* FROM edges e JOIN f a ON a.id = e.source JOIN f b ON b.id = e.target WHERE NOT ((relation = 'calls' AND confidence = 'INFERRED' AND a.x <> '' AND b.x <> '' AND a.f <> b.f) OR (relation IN ('imports', 'imports_from', 'references') AND a.f <> '' AND b.f <> '' AND a.f <> b.f))"""
)
def cross_language_filter(spark, sf_dir):
    return build.drop_cross_language(*_graph(spark, sf_dir))


_FILES = "SELECT concat('f', row_number() OVER (ORDER BY p)) AS id, regexp_extract(p, '[^/]+$', 0) AS label, p AS source_file FROM (VALUES ('a/x/util.py'), ('b/x/util.py'), ('b/y/util.py'), ('main.go'), ('c/main.rs'), ('c/d/main.rs')) AS t(p)"


@query(
    f"""WITH f AS ({_FILES}), m AS (SELECT * FROM f WHERE label IN (SELECT label FROM f GROUP BY label HAVING count(DISTINCT source_file) > 1)),
    t AS (SELECT id, label, k, array_to_string(list_slice(string_split(source_file, '/'), -k, -1), '/') AS tail FROM m, (SELECT unnest(range(1, 9)) AS k) WHERE k <= len(string_split(source_file, '/'))),
    c AS (SELECT label, tail, count(DISTINCT id) AS n FROM t GROUP BY ALL) SELECT t.id, coalesce(arg_min(t.tail, k) FILTER (WHERE n = 1), arg_max(t.tail, k)) AS label FROM t JOIN c ON c.label = t.label AND c.tail = t.tail GROUP BY t.id"""
)
def file_label_suffix(spark, sf_dir):
    return build.file_label_suffixes(frame(spark, sf_dir, _FILES))


_HYPER = f"SELECT source AS id, target AS member FROM ({EDGES}) WHERE relation = 'contains' AND source LIKE 'nation%'"


@query(
    f"""WITH h AS ({_HYPER}), k AS (SELECT id FROM ({NODES}) WHERE id LIKE 'supplier%')
    SELECT id, string_agg(member, ',' ORDER BY member) AS members FROM h WHERE member IN (SELECT id FROM k) GROUP BY id"""
)
def hyperedge_remap(spark, sf_dir):
    h = frame(spark, sf_dir, _HYPER).groupBy("id").agg(F.sort_array(F.collect_list("member")).alias("nodes"))
    n = frame(spark, sf_dir, f"SELECT id FROM ({NODES}) WHERE id LIKE 'supplier%'")
    return build.remap_hyperedges(h, n, build.alias_map(n)).select("id", F.array_join("nodes", ",").alias("members"))


@query(f"{_BASE} SELECT source, target FROM (SELECT source, target, 'imports' AS relation FROM edges UNION ALL SELECT id, id, 'imports' FROM nodes UNION ALL SELECT id, id, 'calls' FROM nodes) WHERE NOT (source = target AND relation = 'imports')")
def self_import_drop(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    loops = n.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("imports").alias("relation"))
    calls = n.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("calls").alias("relation"))
    mixed = e.select("source", "target", F.lit("imports").alias("relation")).unionByName(loops).unionByName(calls)
    return build.drop_self_imports(mixed).select("source", "target")


from graphlake import queries_build, queries_corpus, queries_functions, queries_languages, queries_report, queries_sources  # noqa: E402,F401  (they add to the registry)
