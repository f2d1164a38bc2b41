"""Queries of name functions and of written articles, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlake.functions import names, text
from graphlake.operators import analyze, cluster
from graphlake.plans.fixtures import RAW_EDGES, frame
from graphlake.queries import _BASE, _COH, SQL, _graph, _membership, _small, query
from graphlake.sinks import export

_LABELS = "SELECT p_partkey AS k, concat('.', p_name, '_', p_partkey, '()') AS label, concat('lib.', replace(p_type, ' ', '.')) AS dotted, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS package FROM part"


@query(
    f"""SELECT k, lower(regexp_replace(label, '[^a-zA-Z0-9]+', '', 'g')) AS key, split_part(dotted, '.', -1) AS last, regexp_matches(split_part(dotted, '.', -1), '^[A-Z]') AS upper,
    regexp_full_match(dotted, '[A-Za-z_][A-Za-z0-9_]*') AS identifier, CASE WHEN package <> '' THEN concat(package, '.', label) ELSE label END AS joined FROM ({_LABELS})"""
)
def name_shapes(spark, sf_dir):
    x, last = frame(spark, sf_dir, _LABELS), names.last_segment(F.col("dotted"), ".")
    return x.select("k", names.member_key(F.col("label")).alias("key"), last.alias("last"), names.starts_upper(last).alias("upper"), names.is_identifier(F.col("dotted")).alias("identifier"), names.joined_name(F.col("package"), F.col("label")).alias("joined"))


#: Names as written in the files of nations: absolute, qualified and bare; and what each file's use lines rename.
_WRITTEN = "SELECT c_custkey AS k, c_nationkey AS file, CASE c_custkey % 4 WHEN 0 THEN concat('|Abs|C', c_custkey % 9) WHEN 1 THEN concat('Seg', c_custkey % 5, '|C', c_custkey % 9) WHEN 2 THEN concat(' Seg', c_custkey % 5, ' ') ELSE concat('C', c_custkey % 9) END AS raw, CASE WHEN c_nationkey % 2 = 0 THEN concat('App|N', c_nationkey) ELSE '' END AS ns FROM customer"
_USES = "SELECT s_nationkey AS file, lower(concat('Seg', s_suppkey % 5)) AS alias, min(concat('Vendor|S', s_suppkey % 7)) AS used FROM supplier GROUP BY s_nationkey, lower(concat('Seg', s_suppkey % 5))"


@query(
    f"""WITH w AS ({_WRITTEN}), u AS ({_USES}), r AS (SELECT k, ns, w.file, trim(raw) AS raw, CASE WHEN left(trim(raw), 1) <> '|' THEN lower(split_part(trim(raw), '|', 1)) END AS alias FROM w)
    SELECT k, replace(CASE WHEN left(raw, 1) = '|' THEN substr(raw, 2) WHEN used IS NOT NULL THEN concat(used, CASE WHEN strpos(raw, '|') > 0 THEN substr(raw, strpos(raw, '|')) ELSE '' END)
    WHEN ns <> '' THEN concat(ns, '|', raw) ELSE raw END, '|', '/') AS fqn FROM r LEFT JOIN u ON u.file = r.file AND u.alias = r.alias"""
)
def php_names(spark, sf_dir):
    back = lambda c: F.replace(c, F.lit("|"), F.lit("\\"))
    w = frame(spark, sf_dir, _WRITTEN).withColumns({"raw": back(F.col("raw")), "ns": back(F.col("ns"))})
    u = frame(spark, sf_dir, _USES).withColumn("used", back(F.col("used")))
    found = w.withColumn("alias", names.php_alias_key(F.col("raw"))).join(u, ["file", "alias"], "left")
    return found.select("k", F.replace(names.php_name(F.col("raw"), F.col("ns"), F.col("used")), F.lit("\\"), F.lit("/")).alias("fqn"))


@query(
    """SELECT doc_id, md5(substr(regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256)) AS label, concat('"', lang, '<\\/', source, '"') AS json,
    CASE WHEN doc_id % 3 = 0 THEN concat('out/', doc_id, '.html') ELSE concat(doc_id, '.html') END AS title FROM documents"""
)
def safe_labels(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "site/out/").otherwise("site/"), F.col("doc_id").cast("string"), F.lit(".html"))
    json = F.concat(F.lit('"'), "lang", F.lit("</"), "source", F.lit('"'))
    return d.select("doc_id", F.md5(names.safe_label(F.col("text"))).alias("label"), names.script_safe(json).alias("json"), names.page_title(path, ["out"]).alias("title"))


@query(f"SELECT concat('Technical discussion about ', string_agg(label, ', ' ORDER BY degree DESC, id), '. Use proper punctuation and paragraph breaks.') AS prompt FROM (SELECT * FROM ({SQL['god_nodes']}) ORDER BY degree DESC, id LIMIT 5)")
def transcription_prompt(spark, sf_dir):
    gods = analyze.god_nodes(*_graph(spark, sf_dir)).select((-F.col("degree")).alias("less"), "id", "label")
    labels = gods.agg(F.transform(F.array_sort(F.collect_list(F.struct("less", "id", "label"))), lambda r: r["label"]).alias("x"))
    return labels.select(names.transcription_prompt(F.col("x"), "").alias("prompt"))


@query(f"SELECT relation, confidence, count(score) AS scored, round(avg(score), 6) AS mean FROM ({RAW_EDGES}) GROUP BY relation, confidence")
def mean_scores(spark, sf_dir):
    """Mean of a nullable score by relation and confidence."""
    return frame(spark, sf_dir, RAW_EDGES).groupBy("relation", "confidence").agg(F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("mean"))


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT printf('%012d|%09d', 999999999999 - count(*), n.community) AS ord, concat('- [[', {_slug('any_value(h.name)')}, '-', n.community, ']] (', count(*), ')') AS line FROM ({_BASE} SELECT id, community FROM nodes WHERE community IS NOT NULL) n JOIN ({SQL['label_by_hub']}) h ON h.community = n.community GROUP BY n.community")
def wiki_index(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return export.wiki_index(_membership(n), cluster.label_by_hub(n, e, _membership(n)))


@query(
    f"""{_BASE}, g AS (SELECT * FROM ({SQL['god_nodes']})), x AS (SELECT adj.u, nd.label AS other, row_number() OVER (PARTITION BY adj.u ORDER BY nd.degree DESC, nd.id) AS i FROM adj JOIN nd ON nd.id = adj.v WHERE adj.u IN (SELECT id FROM g)),
    l AS (SELECT u, string_agg(concat('- ', other), chr(10) ORDER BY i) AS lines FROM x WHERE i <= 20 GROUP BY u), s AS (SELECT {_slug('label')} AS slug, count(*) AS n FROM g GROUP BY 1)
    SELECT CASE WHEN n > 1 THEN concat(slug, '-', id) ELSE slug END AS name, concat('# ', label, chr(10), chr(10), 'Edges: ', degree, chr(10), chr(10), lines) AS body FROM g JOIN s ON s.slug = {_slug('label')} JOIN l ON l.u = g.id"""
)
def god_articles(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return export.god_articles(n, e, analyze.god_nodes(n, e))


@query(
    f"""{_BASE}, {_COH} SELECT 'community' AS part, concat(printf('%09d', community), '|', id) AS key, concat('{{"community":', community, ',"id":"', id, '"}}') AS line FROM nodes WHERE community IS NOT NULL
    UNION ALL SELECT 'cohesion', printf('%09d', community), concat('{{"community":', community, ',"size":', size, '}}') FROM coh
    UNION ALL SELECT 'god', id, concat('{{"id":"', id, '","label":"', label, '","degree":', degree, '}}') FROM ({SQL['god_nodes']})
    UNION ALL SELECT 'surprise', concat_ws('|', source, target, relation), concat('{{"source":"', source, '","target":"', target, '","relation":"', relation, '","score":', score, '}}') FROM ({SQL['surprises_cross_file']})"""
)
def analysis_sidecar(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return export.analysis_sidecar(_membership(n), cluster.cohesion(_membership(n), e), analyze.god_nodes(n, e), analyze.surprises(n, e, 25))


SQL["wiki_articles"] = f"""{_BASE}, r AS (SELECT community, label, degree, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS i FROM nd WHERE community IS NOT NULL),
    l AS (SELECT community, string_agg(concat('- ', label, ' (', degree, ')'), chr(10) ORDER BY i) FILTER (i <= 20) AS members, count(*) AS size FROM r GROUP BY community)
    SELECT concat({_slug('name')}, '-', l.community) AS name, concat('# ', name, chr(10), chr(10), 'Members: ', size, chr(10), chr(10), members) AS body FROM l JOIN ({SQL['label_by_hub']}) h ON h.community = l.community"""
SQL["obsidian_notes"] = f"""{_BASE}, t AS (SELECT id, file_type, concat(regexp_replace(label, '[\\\\/:*?"<>|#^\\[\\]]', '_', 'g'), ' (', id, ')') AS name FROM nodes),
    l AS (SELECT e.source AS id, string_agg(DISTINCT concat('- ', relation, ' [[', t.name, ']]'), chr(10) ORDER BY concat('- ', relation, ' [[', t.name, ']]')) AS links FROM edges e JOIN t ON t.id = e.target GROUP BY e.source)
    SELECT name, concat('---', chr(10), 'type: ', file_type, chr(10), '---', chr(10), coalesce(links, '')) AS body FROM t LEFT JOIN l ON l.id = t.id"""


@query("SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS plain FROM documents")
def plain_letters(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(text.strip_diacritics(F.coalesce("text", F.lit("")))).alias("plain"))


@query("SELECT doc_id, md5(trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS form FROM documents")
def label_forms(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(text.norm_label(F.coalesce("text", F.lit("")))).alias("form"))


@query(f"SELECT a, b, betweenness, concat('bridges parts of the graph, betweenness ', format('{{:.3f}}', betweenness)) AS note FROM (SELECT * FROM ({SQL['betweenness_edges']}) ORDER BY betweenness DESC, a, b LIMIT 10)")
def surprises_without_communities(spark, sf_dir):
    n, e = _small(spark, sf_dir)
    found = analyze.bridge_surprises(n, e, 10)
    return found.withColumn("betweenness", F.round("betweenness", 6))
