"""Queries of the report's sections over the whole catalogue graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlake.operators import analyze, cluster, merge
from graphlake.plans.fixtures import EDGES, EVENTS, frame
from graphlake.queries import _BASE, _COH, _HYPER, SQL, _graph, _membership, query
from graphlake.sinks import report

_MEMBERS = "mem AS (SELECT community, id, label FROM nodes WHERE community IS NOT NULL), ms AS (SELECT community, count(*) AS k FROM mem GROUP BY community)"


def _real(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    m = _membership(n)
    return n, e, m, report.real_members(n, e, m)


@query("SELECT 'corpus' AS section, '0' AS ord, concat(count(*), ' files, about ', format('{:,}', sum(n_chars)::BIGINT), ' words') AS line FROM documents")
def report_corpus(spark, sf_dir):
    return report.corpus_section(frame(spark, sf_dir, "SELECT doc_id AS path, n_chars AS words FROM documents"))


@query(
    f"""{_BASE}, {_MEMBERS}, c AS (SELECT count(*) AS c, count(*) FILTER (k < 3) AS t FROM ms), e AS (SELECT count(*) AS m, count(*) FILTER (confidence = 'EXTRACTED') AS x, count(*) FILTER (confidence = 'INFERRED') AS i, count(*) FILTER (confidence = 'AMBIGUOUS') AS a FROM edges)
    SELECT 'summary' AS section, '0' AS ord, concat((SELECT count(*) FROM nodes), ' nodes, ', m, ' edges, ', c, ' communities', CASE WHEN t > 0 THEN concat(', ', t, ' thin') ELSE '' END) AS line FROM c, e
    UNION ALL SELECT 'summary', '1', concat('EXTRACTED ', round_even(x * 100.0 / m, 0)::INT, '%, INFERRED ', round_even(i * 100.0 / m, 0)::INT, '%, AMBIGUOUS ', round_even(a * 100.0 / m, 0)::INT, '%') FROM e"""
)
def report_summary(spark, sf_dir):
    return report.summary_section(*_real(spark, sf_dir))


@query("SELECT 'freshness' AS section, '0' AS ord, concat('built from commit ', substr(md5(min(r_name)), 1, 8)) AS line FROM region")
def report_freshness(spark, sf_dir):
    commit = frame(spark, sf_dir, "SELECT md5(min(r_name)) AS c FROM region").first()["c"]
    return report.freshness_section(spark, commit)


@query(f"SELECT 'hubs' AS section, printf('%09d', community) AS ord, name AS line FROM ({SQL['label_by_hub']})")
def report_hubs(spark, sf_dir):
    n, e, m, real = _real(spark, sf_dir)
    return report.hubs_section(cluster.label_by_hub(n, e, m), real)


@query(f"SELECT 'gods' AS section, printf('%012d|%s', 999999999999 - degree, id) AS ord, concat('`', label, '` - ', degree, ' edges') AS line FROM ({SQL['god_nodes']})")
def report_gods(spark, sf_dir):
    return report.gods_section(analyze.god_nodes(*_graph(spark, sf_dir)))


@query(
    f"""{_BASE} SELECT 'surprises' AS section, printf('%06d|%s|%s|%s', 999999 - s.score, s.source, s.target, s.relation) AS ord,
    concat('`', a.label, '` --', s.relation, '--> `', b.label, '` [', s.confidence, '] ', a.source_file, ' | ', b.source_file) AS line
    FROM ({SQL['surprises_cross_file']}) s JOIN nodes a ON a.id = s.source JOIN nodes b ON b.id = s.target"""
)
def report_surprises(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return report.surprises_section(n, analyze.surprises(n, e, 25))


@query(f"SELECT 'cycles' AS section, printf('%03d|%s', length, cycle) AS ord, concat(length, '-file cycle: ', replace(cycle, '>', ' -> '), ' -> ', split_part(cycle, '>', 1)) AS line FROM (SELECT * FROM ({SQL['import_cycles']}) ORDER BY length, cycle LIMIT 20)")
def report_cycles(spark, sf_dir):
    return report.cycles_section(analyze.import_cycles(frame(spark, sf_dir, EVENTS), 5, None))


@query(
    f"""SELECT 'hyperedges' AS section, id AS ord, concat(CASE WHEN id LIKE '%1' THEN concat('Group ', id) ELSE id END, ': ', string_agg(member, ', ' ORDER BY member), ' [', CASE WHEN id LIKE '%2' THEN 'EXTRACTED' ELSE 'INFERRED' END, ']') AS line FROM ({_HYPER}) GROUP BY id"""
)
def report_hyperedges(spark, sf_dir):
    h = frame(spark, sf_dir, _HYPER).groupBy("id").agg(F.sort_array(F.collect_list("member")).alias("nodes"))
    return report.hyperedges_section(h.withColumns({"label": F.when(F.endswith("id", F.lit("1")), F.concat(F.lit("Group "), "id")), "confidence": F.when(F.endswith("id", F.lit("2")), "EXTRACTED")}))


@query(
    f"""{_BASE}, {_COH}, {_MEMBERS}, f AS (SELECT community, label, id, row_number() OVER (PARTITION BY community ORDER BY id) AS i FROM mem), l AS (SELECT community, string_agg(label, ', ' ORDER BY i) AS labels FROM f WHERE i <= 8 GROUP BY community)
    SELECT 'communities' AS section, printf('%09d', ms.community) AS ord, concat('Community ', ms.community, ' "', name, '", cohesion ', format('{{:.2f}}', cohesion), ', ', k, ' nodes: ', labels, CASE WHEN k > 8 THEN concat(' (+', k - 8, ' more)') ELSE '' END) AS line
    FROM ms JOIN l ON l.community = ms.community JOIN coh ON coh.community = ms.community JOIN ({SQL['label_by_hub']}) h ON h.community = ms.community WHERE k >= 3"""
)
def report_communities(spark, sf_dir):
    n, e, m, real = _real(spark, sf_dir)
    return report.communities_section(real, cluster.cohesion(m, e), cluster.label_by_hub(n, e, m))


@query(f"{_BASE} SELECT 'ambiguous' AS section, concat_ws('|', source, target, relation) AS ord, concat('`', a.label, '` -> `', b.label, '` ', relation) AS line FROM edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE confidence = 'AMBIGUOUS'")
def report_ambiguous(spark, sf_dir):
    return report.ambiguous_section(*_graph(spark, sf_dir))


@query(
    f"""{_BASE}, {_MEMBERS}, i AS (SELECT id, label FROM nd WHERE degree <= 1), l AS (SELECT string_agg(concat('`', label, '`'), ', ' ORDER BY id) AS labels FROM (SELECT * FROM i ORDER BY id LIMIT 5)), t AS (SELECT count(*) FILTER (k < 3) AS t FROM ms),
    d AS (SELECT round_even(count(*) FILTER (confidence = 'AMBIGUOUS') * 100.0 / count(*), 0)::INT AS p FROM edges)
    SELECT 'gaps' AS section, '0' AS ord, concat(count(*), ' isolated nodes: ', (SELECT labels FROM l), CASE WHEN count(*) > 5 THEN concat(' (+', count(*) - 5, ' more)') ELSE '' END, '; ', count(*), ' with files, concepts and rationales') AS line FROM i HAVING count(*) > 0
    UNION ALL SELECT 'gaps', '1', concat(t, ' thin communities') FROM t WHERE t > 0 UNION ALL SELECT 'gaps', '2', concat(p, '% of edges are AMBIGUOUS') FROM d WHERE p > 20"""
)
def report_gaps(spark, sf_dir):
    return report.gaps_section(*_real(spark, sf_dir))


@query(
    f"""SELECT 'questions' AS section, concat_ws('|', section, subject, detail) AS ord, CASE section WHEN 1 THEN concat('What relates `', subject, '` and `', detail, '`?') WHEN 2 THEN concat('Why does `', subject, '` join parts of the graph?')
    WHEN 3 THEN concat('Are the ', detail, ' inferred relations of `', subject, '` right?') WHEN 4 THEN concat('What joins `', subject, '` and the other isolated nodes (', detail, ' in all) to the rest?')
    ELSE concat('Should community ', subject, ' of ', detail, ' be split?') END AS line FROM ({SQL['questions']})"""
)
def report_questions(spark, sf_dir):
    from graphlake.queries import questions

    return report.questions_section(questions(spark, sf_dir))


# ------------------------------------------------------------------ calls across repositories

_PARKED = "SELECT DISTINCT concat('customer_', o_custkey) AS caller_id, concat('r', c_nationkey % 5) AS repo, concat('m', o_orderkey % 7) AS callee, concat('T', o_orderkey % 40) AS type_name FROM orders JOIN customer ON c_custkey = o_custkey"
_TYPES = "SELECT concat('supplier_', s_suppkey) AS id, concat('T', s_suppkey % 60) AS label, concat('r', s_nationkey % 5) AS repo FROM supplier"
_METHODS = "SELECT DISTINCT concat('supplier_', l_suppkey) AS type_id, concat('m', l_partkey % 7) AS name, concat('part_', CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 7 ELSE l_partkey % 14 END) AS id FROM lineitem"


@query(
    f"""WITH p AS ({_PARKED}), t AS ({_TYPES}), m AS ({_METHODS}), s AS (SELECT caller_id, callee, type_name, min(t.id) AS type_id FROM p JOIN t ON t.label = p.type_name AND t.repo <> p.repo GROUP BY ALL HAVING min(t.id) = max(t.id)),
    o AS (SELECT type_id, name, min(id) AS id FROM m GROUP BY ALL HAVING min(id) = max(id))
    SELECT DISTINCT caller_id AS source, o.id AS target, 'calls' AS relation, 'INFERRED' AS confidence, 0.8::DOUBLE AS score FROM s JOIN o ON o.type_id = s.type_id AND o.name = s.callee"""
)
def cross_repo_calls(spark, sf_dir):
    return merge.cross_repo_calls(*(frame(spark, sf_dir, x) for x in (_PARKED, _TYPES, _METHODS)))


@query(
    """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.x, b.x), 12) AS score FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS i FROM p)
    SELECT concat('vec_', least(id, other)) AS source, concat('vec_', greatest(id, other)) AS target, 'semantically_similar_to' AS relation, 'INFERRED' AS confidence, round(max(score), 6) AS score FROM r WHERE i = 1 AND score >= 0.3 GROUP BY least(id, other), greatest(id, other)"""
)
def semantic_similarity_edges(spark, sf_dir):
    from graphlake.operators.semantic import semantic_similarity_edges as edges

    found = edges(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), 0.3)
    return found.select(F.concat(F.lit("vec_"), "source").alias("source"), F.concat(F.lit("vec_"), "target").alias("target"), "relation", "confidence", F.round("score", 6).alias("score"))
