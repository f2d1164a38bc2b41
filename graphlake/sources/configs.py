"""JSON sources: tool-server configurations, configuration keys, and graph documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SERVERS = "map<string,struct<command:string,args:array<string>,env:map<string,string>,url:string>>"


def mcp_servers(files: DataFrame, most: int = 200) -> DataFrame:
    """``path, server, command, package, env`` of tool-server configurations: at most ``most`` servers of a file, by name."""
    spec = F.from_json("content", f"struct<mcpServers:{_SERVERS},servers:{_SERVERS}>")
    rows = files.select("path", F.coalesce(spec["mcpServers"], spec["servers"]).alias("m"))
    rows = rows.select("path", "m", F.explode(F.slice(F.array_sort(F.map_keys("m")), 1, most)).alias("server")).select("path", "server", F.col("m")[F.col("server")].alias("x")).select("path", "server", "x.*")
    package = F.get(F.filter("args", lambda a: ~F.startswith(a, F.lit("-"))), F.lit(0))
    return rows.select("path", "server", "command", F.when(F.col("command").isin("npx", "uvx", "bunx", "pipx"), F.regexp_replace(package, r"(?<=.)@[^@/]*$", "")).alias("package"), F.array_join(F.array_sort(F.map_keys("env")), ",").alias("env"))


def json_keys(files: DataFrame, depth: int = 6, most: int = 500, most_bytes: int = 1 << 20) -> DataFrame:
    """``path, key, level``: keys of JSON documents down to ``depth`` levels, ``most`` of a file in the order of level and key."""
    from pyspark.sql import Window

    rows = files.filter(F.octet_length("content") <= most_bytes).select("path", F.lit("").alias("at"), F.lit(0).alias("level"), F.col("content").alias("json"))
    found = None
    for level in range(1, depth + 1):
        keys = rows.select("path", "at", "json", F.explode(F.json_object_keys("json")).alias("k"))
        rows = keys.select("path", F.concat_ws(".", F.when(F.col("at") != "", F.col("at")), "k").alias("at"), F.lit(level).alias("level"), F.element_at(F.from_json("json", "map<string,string>"), F.col("k")).alias("json"))
        part = rows.select("path", F.col("at").alias("key"), "level")
        found = part if found is None else found.unionByName(part)
        rows = rows.filter(F.startswith(F.trim("json"), F.lit("{")))
    w = Window.partitionBy("path").orderBy("level", "key")
    return found.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most).drop("i")


_NODE = "id string, label string, file_type string, source_file string, source_location string, community int, norm_label string"
_LINK = "source string, target string, relation string, confidence string, confidence_score double, source_file string, source_location string, weight double, context string"
GRAPH = f"struct<nodes:array<struct<{_NODE.replace(' string', ':string').replace(' int', ':int')}>>,links:array<struct<{_LINK.replace(' string', ':string').replace(' double', ':double')}>>,edges:array<struct<{_LINK.replace(' string', ':string').replace(' double', ':double')}>>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link JSON documents; nodes without id and edges with an unknown end are dropped."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", GRAPH).alias("g")).select("g.*")
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("n.*", F.col("ord").cast("long").alias("ord")).filter("id is not null and id <> ''")
    edges = doc.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*")
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, edges


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph written as lines in ``path/nodes`` and ``path/links``."""
    nodes = spark.read.schema(_NODE).json(f"{path}/nodes").filter("id is not null and id <> ''")
    edges = spark.read.schema(_LINK).json(f"{path}/links")
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, edges


def parse_fragment(answers: DataFrame) -> DataFrame:
    """Node and edge lists in model answers ``chunk, answer``: fences and prose around the JSON object are cut.

    ``chunk, source, target, relation, confidence`` of complete edges, ids in normal form, confidence in upper case.
    """
    from graphlake.functions.text import normalize_id_ascii

    body = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    spec = "struct<nodes:array<struct<id:string,label:string>>,edges:array<struct<source:string,target:string,relation:string,confidence:string>>>"
    e = answers.select("chunk", F.from_json(body, spec).alias("g")).select("chunk", F.explode("g.edges").alias("e")).select("chunk", "e.*")
    e = e.filter("source is not null and target is not null and relation is not null")
    return e.select("chunk", normalize_id_ascii(F.col("source")).alias("source"), normalize_id_ascii(F.col("target")).alias("target"), "relation", F.upper(F.coalesce("confidence", F.lit("INFERRED"))).alias("confidence"))
