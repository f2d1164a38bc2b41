"""Registered queries over single-language passes, repository tags and the language registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlake.operators import languages, merge, search
from graphlake.operators.graph import numbered
from graphlake.plans.fixtures import EDGES, NODES, frame
from graphlake.queries import _BASE, _graph, query
from graphlake.sources import code, files

#: Suppliers reference types ``brand.Type`` of parts; half of the brands are imported, some types are the project's own.
_GO_TYPES = "SELECT concat('own_', p_partkey) AS id, concat('example.org/', lower(replace(p_brand, '#', ''))) AS import_path, replace(p_type, ' ', '') AS name FROM part WHERE p_size < 10"
_GO_STUBS = "SELECT DISTINCT concat('ref_', lower(replace(p_brand, '#', '')), '_', replace(p_type, ' ', '')) AS id, concat(lower(replace(p_brand, '#', '')), '.', replace(p_type, ' ', '')) AS label FROM part"
_GO_REFS = """SELECT DISTINCT concat('supplier_', l_suppkey) AS source, concat('ref_', lower(replace(p_brand, '#', '')), '_', replace(p_type, ' ', '')) AS target,
    CASE WHEN l_linenumber = 1 THEN 'contains' ELSE 'references' END AS relation, concat('f', l_suppkey % 40, '.go') AS source_file FROM lineitem JOIN part ON p_partkey = l_partkey"""
_GO_ALIASES = "SELECT DISTINCT concat('f', l_suppkey % 40, '.go') AS source_file, lower(replace(p_brand, '#', '')) AS alias, concat('example.org/', lower(replace(p_brand, '#', ''))) AS import_path FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND p_size < 25"
_GO = f"""t AS ({_GO_TYPES}), s AS ({_GO_STUBS}), e AS ({_GO_REFS}), i AS ({_GO_ALIASES}), own AS (SELECT import_path, name, min(id) AS id FROM t GROUP BY ALL HAVING count(DISTINCT id) = 1),
    m AS (SELECT e.*, i.import_path, split_part(s.label, '.', 2) AS name, own.id AS own FROM e JOIN s ON s.id = e.target LEFT JOIN i ON i.source_file = e.source_file AND i.alias = split_part(s.label, '.', 1) AND e.relation = 'references'
        LEFT JOIN own ON own.import_path = i.import_path AND own.name = split_part(s.label, '.', 2)),
    o AS (SELECT *, concat('go_type_', regexp_replace(lower(concat(import_path, '.', name)), '[^a-z0-9]+', '_', 'g')) AS outside FROM m)"""


def _go(spark, sf_dir):
    return languages.go_type_references(frame(spark, sf_dir, _GO_REFS), frame(spark, sf_dir, _GO_STUBS), frame(spark, sf_dir, _GO_ALIASES), frame(spark, sf_dir, _GO_TYPES))


@query(f"WITH {_GO} SELECT source, CASE WHEN import_path IS NULL THEN target ELSE coalesce(own, outside) END AS target, relation, source_file FROM o")
def go_type_references(spark, sf_dir):
    return _go(spark, sf_dir)[0]


@query(f"WITH {_GO} SELECT DISTINCT outside AS id, concat(import_path, '.', name) AS label FROM o WHERE import_path IS NOT NULL AND own IS NULL")
def go_type_stubs(spark, sf_dir):
    return _go(spark, sf_dir)[1]


_PASSED = f"SELECT row_number() OVER (ORDER BY source, target) AS ord, source AS caller_id, n.label AS callee, CASE WHEN n.ord % 2 = 0 THEN 'field' END AS context FROM ({EDGES}) e JOIN ({NODES}) n ON n.id = e.target WHERE e.source LIKE 'customer%' AND e.target LIKE 'part%'"
#: The same without numbers, which come from a range sort: a window over all rows is one task.
_PASSED_UNNUMBERED = f"SELECT source AS caller_id, target, n.label AS callee, CASE WHEN n.ord % 2 = 0 THEN 'field' END AS context FROM ({EDGES}) e JOIN ({NODES}) n ON n.id = e.target WHERE e.source LIKE 'customer%' AND e.target LIKE 'part%'"
_CALLABLES = f"SELECT id, concat(label, '()') AS label, ord % 3 <> 0 AS callable, ord % 5 = 0 AS is_class FROM ({NODES}) WHERE id LIKE 'part%'"
_CALLED = f"SELECT source, target, 'calls' AS relation FROM ({EDGES}) WHERE source LIKE 'customer%' AND target LIKE 'part%' AND confidence = 'EXTRACTED'"


@query(
    f"""WITH p AS ({_PASSED}), k AS ({_CALLABLES}), c AS ({_CALLED}) SELECT p.caller_id AS source, k.id AS target, p.ord, 'indirect_call' AS relation, coalesce(context, 'argument') AS context, 0.85::DOUBLE AS score
    FROM p JOIN k ON k.label = concat(p.callee, '()') AND callable AND NOT is_class LEFT JOIN c ON c.source = p.caller_id AND c.target = k.id WHERE c.source IS NULL"""
)
def indirect_calls(spark, sf_dir):
    passed = numbered(frame(spark, sf_dir, _PASSED_UNNUMBERED), ["caller_id", "target"], "ord").drop("target")
    found = languages.indirect_calls(passed, frame(spark, sf_dir, _CALLABLES), frame(spark, sf_dir, _CALLED))
    return found.withColumn("ord", F.col("ord").cast("long"))


#: Python files in one directory for each part size; a brand's initialiser makes a package.
_MODULES = "SELECT DISTINCT concat('lib', p_size % 7, '/', lower(replace(p_brand, '#', '')), CASE WHEN p_size % 3 = 0 THEN '/__init__.py' WHEN p_size % 3 = 1 THEN concat('/mod', p_size % 5, '.py') ELSE '/9bad.py' END) AS path FROM part"
_ALIASES = f"""m AS ({_MODULES}), p AS (SELECT path, string_split(regexp_replace(path, '(/__init__)?\\.py$', ''), '/') AS parts FROM m),
    k AS (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS k FROM p), a AS (SELECT path, k = 1 AS whole, array_to_string(parts[k:], '_') AS alias FROM k WHERE len(list_filter(parts[k:], lambda x: NOT regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))) = 0),
    amb AS (SELECT alias FROM a GROUP BY alias HAVING count(DISTINCT path) > 1 AND NOT bool_or(whole))"""


@query(f"WITH {_ALIASES} SELECT alias FROM amb")
def ambiguous_modules(spark, sf_dir):
    return languages.ambiguous_modules(frame(spark, sf_dir, _MODULES))


_BINDINGS = "SELECT DISTINCT concat('app', c_custkey % 500, '.py') AS source_file, concat('brand', c_nationkey % 5 + 1, c_custkey % 5 + 1) AS module, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('mod', c_custkey % 5) WHEN 2 THEN CASE WHEN c_custkey % 47 = 2 THEN '*' ELSE 'other' END END AS name, concat('n', c_custkey % 20) AS local FROM customer"
_USES = "SELECT c_custkey AS ord, concat('app', c_custkey % 500, '.py') AS source_file, concat('n', c_custkey % 23) AS callee, CASE WHEN c_custkey % 2 = 0 THEN concat('n', c_custkey % 29, '.x') END AS receiver FROM customer"


@query(
    f"""WITH {_ALIASES}, b AS ({_BINDINGS}), u AS ({_USES}),
    hit AS (SELECT *, module IN (SELECT alias FROM amb) AS own, concat(module, '_', name) IN (SELECT alias FROM amb) AS below, EXISTS (SELECT 1 FROM amb WHERE starts_with(alias, concat(b.module, '_'))) AS above FROM b),
    bad AS (SELECT DISTINCT source_file FROM hit WHERE name = '*' AND (own OR above)), few AS (SELECT DISTINCT source_file, local FROM hit WHERE coalesce(name, '') <> '*' AND (own OR coalesce(below, false)))
    SELECT ord, source_file, callee, receiver FROM u WHERE source_file NOT IN (SELECT source_file FROM bad) AND NOT EXISTS (SELECT 1 FROM few s WHERE s.source_file = u.source_file AND (s.local = u.callee OR s.local = split_part(coalesce(u.receiver, ''), '.', 1)))"""
)
def guarded_calls(spark, sf_dir):
    bad = languages.ambiguous_modules(frame(spark, sf_dir, _MODULES))
    return languages.guarded_calls(frame(spark, sf_dir, _USES), frame(spark, sf_dir, _BINDINGS), bad)




_GRAPHS = "SELECT ord, path FROM (VALUES (1, 'home/a/api/out/graph.json'), (2, 'home/b/api/out/graph.json'), (3, 'home/web/out/graph.json'), (4, 'out/graph.json'), (5, 'srv/b/api/out/graph.json')) AS t(ord, path)"


@query("SELECT * FROM (VALUES ('home/a/api/out/graph.json', 'a_api'), ('home/b/api/out/graph.json', 'b_api'), ('home/web/out/graph.json', 'web'), ('out/graph.json', 'repo'), ('srv/b/api/out/graph.json', 'b_api-2')) AS t(path, tag)")
def repo_tags(spark, sf_dir):
    return merge.repo_tags(spark.sql(_GRAPHS))


_GROUPS = "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 10 <> 0 THEN concat('h', o_custkey) END AS id, o_orderpriority AS label FROM orders"


@query(f"WITH h AS ({_GROUPS}) SELECT id, arg_min(label, ord) AS label FROM h WHERE id IS NOT NULL GROUP BY id UNION ALL SELECT id, label FROM h WHERE id IS NULL")
def hyperedge_dedupe(spark, sf_dir):
    return merge.dedupe_hyperedges(frame(spark, sf_dir, _GROUPS))




@query(f"{_BASE} SELECT id, label, source_file, degree FROM nd WHERE community = 3")
def community_members(spark, sf_dir):
    return search.community_members(*_graph(spark, sf_dir), 3)




def _facts(spark):
    rows = [("t.py", 'def run(x):\n    return x\nTABLE = {"a": run}\nmap(run, key=run)\ngetattr(o, "stop")\n'), ("p.astro", '---\nimport { h } from "./h"\n---\n<p>import no from "no"</p>\n<script>\nfunction go() {\n}\n</script>\n')]
    return code.extract_code(spark.createDataFrame(rows, "path string, content string"))


