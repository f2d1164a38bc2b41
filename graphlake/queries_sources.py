"""Queries of file scans and per-file extraction, over files written out from the rows of whole tables.

The rules that make a file from a row's number also say what its extraction must find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlake.operators import languages
from graphlake.plans.fixtures import frame
from graphlake.queries import query
from graphlake.sources import code, configs, documents, files

# ------------------------------------------------------------------ paths

_DIRS = ("src", "doc", "node_modules", ".ssh", "build", "logs/a", "src/keep")
_ENDS = (".py", ".md", ".PNG", ".pdf", ".mp4", ".bin", ".go", ".pem", ".log", ".mcp.json", ".key.sample")
_PATHS = "SELECT p_partkey % 7 AS d, p_partkey % 11 AS x, concat({}, '/f', p_partkey, {}) AS path FROM part".format(
    "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_DIRS)) + " END", "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ENDS)) + " END"
)


@query(f"SELECT path, CASE WHEN x IN (0, 6, 9) THEN 'code' WHEN x = 1 THEN 'document' WHEN x = 2 THEN 'image' WHEN x = 3 THEN 'paper' WHEN x = 4 THEN 'video' END AS category FROM ({_PATHS})")
def classify_files(spark, sf_dir):
    return frame(spark, sf_dir, _PATHS).select("path", files.category(F.col("path")).alias("category"))


@query(f"SELECT path, d = 3 OR x = 7 AS sensitive, d IN (2, 4) AS skipped FROM ({_PATHS})")
def sensitive_files(spark, sf_dir):
    return frame(spark, sf_dir, _PATHS).select("path", files.is_sensitive(F.col("path")).alias("sensitive"), files.is_skipped(F.col("path")).alias("skipped"))


@query(f"SELECT path, x = 8 OR d IN (1, 4) OR (x = 6 AND d IN (0, 6)) AS ignored FROM ({_PATHS})")
def ignore_rules(spark, sf_dir):
    return files.ignored(frame(spark, sf_dir, _PATHS).select("path"), ["# comment", "*.log", "!important.log", "build/", "/doc", "src/**/*.go"])


_REGISTRY = [("php", (".php",), ()), ("blade", (".blade.php",), ()), ("make", (".mk",), ("Makefile",)), ("python", (".py", ".pyi"), ()), ("starlark", (".bzl",), ("BUILD",)), ("stubs", (".pyi",), ())]
_SOURCES = "SELECT c_custkey % 8 AS x, concat('d', c_custkey, '/', CASE c_custkey % 8 WHEN 0 THEN 'view.blade.php' WHEN 1 THEN 'x.PHP' WHEN 2 THEN 'Makefile' WHEN 3 THEN 'BUILD' WHEN 4 THEN 't.pyi' WHEN 5 THEN concat('m.', c_nationkey, '.py') WHEN 6 THEN '.py' ELSE 'none' END) AS path FROM customer"


@query(f"SELECT path, CASE x WHEN 0 THEN 'blade' WHEN 1 THEN 'php' WHEN 2 THEN 'make' WHEN 3 THEN 'starlark' WHEN 4 THEN 'stubs' WHEN 5 THEN 'python' END AS language FROM ({_SOURCES})")
def language_lookup(spark, sf_dir):
    return frame(spark, sf_dir, _SOURCES).select("path", files.language_of(F.col("path"), _REGISTRY).alias("language"))


_PLACES = "SELECT c_custkey % 4 AS x, c_custkey AS k, concat('/work/', CASE c_custkey % 4 WHEN 0 THEN 'repo/src/' WHEN 1 THEN 'repo/' WHEN 2 THEN 'other/' ELSE 'x/y/' END, 'f', c_custkey, '.py') AS path FROM customer"


@query(f"SELECT path, concat(CASE x WHEN 0 THEN '' WHEN 1 THEN '../' WHEN 2 THEN '../../other/' ELSE '../../x/y/' END, 'f', k, '.py') AS near, concat('f', k, '.py') AS far FROM ({_PLACES})")
def portable_paths(spark, sf_dir):
    """From a root beside the files, and from one over three steps away."""
    p = frame(spark, sf_dir, _PLACES)
    return p.select("path", languages.portable_path(F.col("path"), "/work/repo/src").alias("near"), languages.portable_path(F.col("path"), "/home/a/b/c/d").alias("far"))


# ------------------------------------------------------------------ documents

_MD = """SELECT c_custkey AS k, concat('doc/', c_custkey, '.md') AS path, concat_ws(chr(10), '---', concat('title: "', c_name, '"'), concat('tags: ', c_mktsegment), '---', concat('# ', c_name),
    concat('see [one](', c_nationkey, '.md) and [[', c_mktsegment, '|w]]'), '## Sub', '```', '# not a heading', '[no](no.md)', '```', CASE WHEN c_custkey % 2 = 0 THEN '### Deep' ELSE 'plain' END, '## Next', concat('[ref]: https://example.org/', c_custkey), '[anchor](#top)') AS content FROM customer"""
_DOC = "SELECT c_custkey AS k, concat('doc/', c_custkey, '.md') AS path, c_name AS name, c_mktsegment AS tag, c_nationkey AS n FROM customer"


@query(f"WITH d AS ({_DOC}) SELECT path, 5 AS line, 1 AS level, name AS title, -1 AS parent_line FROM d UNION ALL SELECT path, 7, 2, 'Sub', 5 FROM d UNION ALL SELECT path, 12, 3, 'Deep', 7 FROM d WHERE k % 2 = 0 UNION ALL SELECT path, 13, 2, 'Next', 5 FROM d")
def markdown_headings(spark, sf_dir):
    return documents.headings(frame(spark, sf_dir, _MD).select("path", "content")).withColumn("parent_line", F.coalesce("parent_line", F.lit(-1)))


@query(f"WITH d AS ({_DOC}) SELECT path, 6 AS line, 'inline' AS kind, concat(n, '.md') AS target FROM d UNION ALL SELECT path, 6, 'wiki', tag FROM d UNION ALL SELECT path, 14, 'reference', concat('https://example.org/', k) FROM d")
def markdown_links(spark, sf_dir):
    return documents.links(frame(spark, sf_dir, _MD).select("path", "content"))


@query(f"WITH d AS ({_DOC}) SELECT path, 'title' AS key, name AS value FROM d UNION ALL SELECT path, 'tags', tag FROM d")
def markdown_frontmatter(spark, sf_dir):
    return documents.frontmatter(frame(spark, sf_dir, _MD).select("path", "content"))


_NOTED = """SELECT c_custkey AS k, concat('src/', c_custkey, '.py') AS path, concat_ws(chr(10), CASE WHEN c_custkey % 5 = 0 THEN '# Code generated. DO NOT EDIT' ELSE 'import os' END, concat('# NOTE: keep ', c_name), 'def f():',
    CASE WHEN c_custkey % 3 = 0 THEN concat('    # WHY: RFC ', c_custkey + 1, ' and ADR-', c_nationkey + 1) ELSE '    # TODO fix' END, '    return 1') AS content FROM customer"""


@query("WITH c AS (SELECT *, concat('src/', c_custkey, '.py') AS path FROM customer WHERE c_custkey % 5 <> 0) SELECT path, 2 AS line, 'NOTE' AS kind, concat('keep ', c_name) AS note FROM c UNION ALL SELECT path, 4, CASE WHEN c_custkey % 3 = 0 THEN 'WHY' ELSE 'TODO' END, CASE WHEN c_custkey % 3 = 0 THEN concat('RFC ', c_custkey + 1, ' and ADR-', c_nationkey + 1) ELSE 'fix' END FROM c")
def rationale_comments(spark, sf_dir):
    return documents.rationale(frame(spark, sf_dir, _NOTED).select("path", "content"))


@query("WITH c AS (SELECT *, concat('src/', c_custkey, '.py') AS path FROM customer WHERE c_custkey % 3 = 0) SELECT path, 4 AS line, concat('RFC-', c_custkey + 1) AS document FROM c UNION ALL SELECT path, 4, concat('ADR-', c_nationkey + 1) FROM c")
def document_citations(spark, sf_dir):
    return documents.citations(frame(spark, sf_dir, _NOTED).select("path", "content"))


# ------------------------------------------------------------------ code

_CODE = """SELECT c_custkey AS k, concat('m', c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.ts' ELSE '.py' END) AS path, CASE c_custkey % 4
    WHEN 0 THEN concat_ws(chr(10), 'import os', concat('class A', c_custkey, '(B):'), '    def f(self):', concat('        return g', c_nationkey, '(os.path)'), '')
    WHEN 1 THEN concat_ws(chr(10), '// note', concat('func main', c_custkey, '() {'), concat('  run', c_nationkey, '()'), '}')
    WHEN 2 THEN concat_ws(chr(10), concat('export class T', c_custkey, ' extends U {'), concat('  help', c_nationkey, '()'), '}') ELSE 'def broken(' END AS content FROM customer"""
_K = "SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 4 AS x, concat('m', c_custkey, CASE c_custkey % 4 WHEN 1 THEN '.go' WHEN 2 THEN '.ts' ELSE '.py' END) AS path FROM customer"


@query(
    f"""WITH c AS ({_K}) SELECT path, 'import' AS kind, 'os' AS name, '' AS owner, 'os' AS target FROM c WHERE x = 0 UNION ALL SELECT path, 'class', concat('A', k), '', '' FROM c WHERE x = 0 UNION ALL SELECT path, 'base', concat('A', k), concat('A', k), 'B' FROM c WHERE x = 0
    UNION ALL SELECT path, 'method', 'f', concat('A', k), '' FROM c WHERE x = 0 UNION ALL SELECT path, 'call', concat('g', n), concat('A', k, '.f'), concat('g', n) FROM c WHERE x = 0
    UNION ALL SELECT path, 'function', concat('main', k), '', '' FROM c WHERE x = 1 UNION ALL SELECT path, 'call', concat('run', n), concat('main', k), concat('run', n) FROM c WHERE x = 1
    UNION ALL SELECT path, 'class', concat('T', k), '', '' FROM c WHERE x = 2 UNION ALL SELECT path, 'base', concat('T', k), '', 'U' FROM c WHERE x = 2 UNION ALL SELECT path, 'call', concat('help', n), concat('T', k), concat('help', n) FROM c WHERE x = 2
    UNION ALL SELECT path, 'error', 'SyntaxError', '', '-' FROM c WHERE x = 3"""
)
def extract_code(spark, sf_dir):
    facts = code.extract_code(frame(spark, sf_dir, _CODE).select("path", "content"))
    return facts.select("path", "kind", "name", F.coalesce("owner", F.lit("")).alias("owner"), F.when(F.col("kind") == "error", "-").otherwise(F.coalesce("target", F.lit(""))).alias("target"))


_VALUES = "SELECT s_suppkey AS k, concat('t', s_suppkey, '.py') AS path, concat_ws(chr(10), concat('def run', s_suppkey, '(x):'), '    return x', concat('TABLE = {\"a\": run', s_suppkey, '}'), concat('map(run', s_suppkey, ', key=run', s_suppkey, ')'), concat('getattr(o, \"stop', s_nationkey, '\")'), '') AS content FROM supplier"


@query("WITH s AS (SELECT *, concat('t', s_suppkey, '.py') AS path, concat('run', s_suppkey) AS run FROM supplier) SELECT path, run AS name, 3 AS line, 'table' AS target FROM s UNION ALL SELECT path, run, 4, 'argument' FROM s UNION ALL SELECT path, run, 4, 'argument' FROM s UNION ALL SELECT path, 'o', 5, 'argument' FROM s UNION ALL SELECT path, concat('stop', s_nationkey), 5, 'getattr' FROM s")
def indirect_references(spark, sf_dir):
    return code.extract_code(frame(spark, sf_dir, _VALUES).select("path", "content")).filter("kind = 'indirect'").select("path", "name", "line", "target")


_COMPONENTS = "SELECT concat('p', s_suppkey, '.astro') AS path, concat_ws(chr(10), '---', concat('import { h } from \"./h', s_nationkey, '\"'), '---', '<p>import no from \"no\"</p>', '<script>', concat('function go', s_suppkey, '() {'), '}', '</script>', '') AS content FROM supplier"


@query("WITH s AS (SELECT *, concat('p', s_suppkey, '.astro') AS path FROM supplier) SELECT path, 'import' AS kind, concat('./h', s_nationkey) AS name, 2 AS line FROM s UNION ALL SELECT path, 'function', concat('go', s_suppkey), 6 FROM s")
def component_scripts(spark, sf_dir):
    return code.extract_code(frame(spark, sf_dir, _COMPONENTS)).select("path", "kind", "name", "line")


# ------------------------------------------------------------------ manifests and configurations

_MANIFESTS = """SELECT concat('d', s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '/go.mod' WHEN 1 THEN '/package.json' WHEN 2 THEN '/pyproject.toml' ELSE '/Cargo.toml' END) AS path, CASE s_suppkey % 4
    WHEN 0 THEN concat_ws(chr(10), concat('module example.org/a', s_suppkey), 'require (', concat('  example.org/b', s_nationkey, ' v1.2.0'), ')') WHEN 1 THEN concat('{"name": "web', s_suppkey, '", "dependencies": {"left', s_nationkey, '": "1"}}')
    WHEN 2 THEN concat_ws(chr(10), '[project]', concat('name = "py', s_suppkey, '"'), concat('dependencies = ["Numpy', s_nationkey, '>=1"]')) ELSE '= no' END AS content FROM supplier"""


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 4 AS x FROM supplier WHERE s_suppkey % 4 < 3), m AS (SELECT concat('d', k, CASE x WHEN 0 THEN '/go.mod' WHEN 1 THEN '/package.json' ELSE '/pyproject.toml' END) AS path, CASE x WHEN 0 THEN 'go' WHEN 1 THEN 'npm' ELSE 'python' END AS ecosystem,
    concat(CASE x WHEN 0 THEN 'example.org/a' WHEN 1 THEN 'web' ELSE 'py' END, k) AS package, concat(CASE x WHEN 0 THEN 'example.org/b' WHEN 1 THEN 'left' ELSE 'numpy' END, n) AS dependency FROM s)
    SELECT path, ecosystem, package, '' AS dependency FROM m UNION ALL SELECT * FROM m"""
)
def manifests(spark, sf_dir):
    return code.manifests(frame(spark, sf_dir, _MANIFESTS))


_CONFIG = """SELECT concat('d', s_suppkey, '/.mcp.json') AS path, concat('{"mcpServers": {"files', s_suppkey, '": {"command": "npx", "args": ["-y", "@scope/files', s_nationkey, '@1.2"], "env": {"TOKEN": "x", "HOME": "y"}}, "web": {"command": "node", "args": ["w.js"]}}}') AS content FROM supplier"""


@query("WITH s AS (SELECT *, concat('d', s_suppkey, '/.mcp.json') AS path FROM supplier) SELECT path, concat('files', s_suppkey) AS server, 'npx' AS command, concat('@scope/files', s_nationkey) AS package, 'HOME,TOKEN' AS env FROM s UNION ALL SELECT path, 'web', 'node', '', '' FROM s")
def mcp_servers(spark, sf_dir):
    return configs.mcp_servers(frame(spark, sf_dir, _CONFIG)).fillna("", ["package", "env"])


@query(
    """WITH s AS (SELECT concat('d', s_suppkey, '/.mcp.json') AS path, concat('mcpServers.files', s_suppkey) AS f FROM supplier) SELECT path, 'mcpServers' AS key, 1 AS level FROM s UNION ALL SELECT path, f, 2 FROM s UNION ALL SELECT path, 'mcpServers.web', 2 FROM s UNION ALL SELECT path, concat(f, '.command'), 3 FROM s
    UNION ALL SELECT path, concat(f, '.args'), 3 FROM s UNION ALL SELECT path, concat(f, '.env'), 3 FROM s UNION ALL SELECT path, 'mcpServers.web.command', 3 FROM s UNION ALL SELECT path, 'mcpServers.web.args', 3 FROM s UNION ALL SELECT path, concat(f, '.env.TOKEN'), 4 FROM s UNION ALL SELECT path, concat(f, '.env.HOME'), 4 FROM s"""
)
def json_keys(spark, sf_dir):
    return configs.json_keys(frame(spark, sf_dir, _CONFIG))


_ANSWERS = """SELECT CAST(c_custkey AS INT) AS chunk, CASE WHEN c_custkey % 3 = 0 THEN 'no json at all' ELSE concat('Sure:', chr(10), '```json', chr(10), '{"nodes": [], "edges": [{"source": "A ', c_custkey, '", "target": "C', c_nationkey, '", "relation": "calls", "confidence": "extracted"}, {"source": "x"}]}', chr(10), '```') END AS answer FROM customer"""


@query("SELECT c_custkey::INTEGER AS chunk, concat('a_', c_custkey) AS source, concat('c', c_nationkey) AS target, 'calls' AS relation, 'EXTRACTED' AS confidence FROM customer WHERE c_custkey % 3 <> 0")
def parse_fragment(spark, sf_dir):
    return configs.parse_fragment(frame(spark, sf_dir, _ANSWERS))


_LINKED = """SELECT concat('doc/n', c_nationkey, '/', c_custkey, '.md') AS path, concat_ws(chr(10), concat('[up](../n', (c_nationkey + 1) % 25, '/', c_custkey + 1, '.md#top)'), concat('[same](./', c_custkey, '.md?raw)'), '[root](/doc/../doc/none.md)',
    '[far](https://example.org/x.md)') AS content FROM customer"""


@query(
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, concat('doc/n', c_nationkey, '/', c_custkey, '.md') AS path FROM customer) SELECT a.path, 1 AS line, concat('../n', (a.n + 1) % 25, '/', a.k + 1, '.md#top') AS target, b.path AS file FROM c a JOIN c b ON b.k = a.k + 1 AND b.n = (a.n + 1) % 25
    UNION ALL SELECT path, 2, concat('./', k, '.md?raw'), path FROM c"""
)
def markdown_targets(spark, sf_dir):
    md = frame(spark, sf_dir, _LINKED)
    return documents.resolve_links(documents.links(md), md).select("path", "line", "target", "file")
