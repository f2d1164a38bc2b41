"""From source files to a graph: extraction, facts as rows, resolution, build, communities.

Facts of one file become nodes (the file, its classes, functions, methods and rationales) and relations
(contains, method, inherits, imports, imports_from, rationale_for). Calls are bound over the whole corpus by the
unique-match joins of ``operators.resolve``; the build passes then give one row for each id and each pair.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.functions.text import normalize_id_ascii
from graphlake.operators import build, cluster, graph, languages, resolve
from graphlake.plans.storage import cut
from graphlake.sources.code import extract_code


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def file_id(path: Column) -> Column:
    """The id of a file: its path without the final suffix."""
    return normalize_id_ascii(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""))


def _entity(path: Column, *names: Column) -> Column:
    return F.concat_ws("_", file_id(path), *[normalize_id_ascii(n) for n in names])


def fact_nodes(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Files and definitions as nodes, one row for each definition; an id may repeat."""
    place = F.concat(F.lit("L"), F.col("line").cast("string"))
    name = F.when(F.col("kind") == "class", F.col("name")).when(F.col("kind") == "method", F.concat(F.lit("."), "name", F.lit("()"))).otherwise(F.concat("name", F.lit("()")))
    common = [F.lit(None).cast("int").alias("community")]
    own = files.select(file_id(F.col("path")).alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"), F.lit("L1").alias("source_location"), *common, F.lit(0).cast("long").alias("ord"))
    d = facts.filter(F.col("kind").isin("class", "function", "method"))
    defs = d.select(_entity(F.col("path"), F.col("owner"), F.col("name")).alias("id"), name.alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"), place.alias("source_location"), *common, F.col("line").cast("long").alias("ord"))
    r = facts.filter(F.col("kind") == "rationale")
    why = r.select(_rationale_id().alias("id"), F.col("target").alias("label"), F.lit("rationale").alias("file_type"), F.col("path").alias("source_file"), place.alias("source_location"), *common, F.col("line").cast("long").alias("ord"))
    return own.unionByName(defs).unionByName(why)


def _rationale_id() -> Column:
    return F.concat_ws("_", _entity(F.col("path"), F.col("owner")), F.lit("rationale"), F.col("line").cast("string"))


def _edges(rows: DataFrame, source: Column, target: Column, relation: Column | str, confidence: str = "EXTRACTED", score: float = 1.0) -> DataFrame:
    kind = F.lit(relation) if isinstance(relation, str) else relation
    return rows.select(
        source.alias("source"), target.alias("target"), kind.alias("relation"), F.lit(confidence).alias("confidence"), F.lit(score).alias("score"),
        F.concat(F.lit("L"), F.col("line").cast("string")).alias("location"), F.lit(None).cast("string").alias("context"),
    )


def structure_edges(facts: DataFrame) -> DataFrame:
    """``contains`` from files and outer functions, ``method`` from classes, ``rationale_for`` from rationales."""
    path, owner = F.col("path"), F.col("owner")
    own = _entity(path, owner, F.col("name"))
    d = facts.filter(F.col("kind").isin("class", "function", "method"))
    inside = F.when(owner.isNull(), file_id(path)).otherwise(_entity(path, owner))
    relation = F.when((F.col("kind") == "method") & owner.isNotNull(), "method").otherwise("contains")
    why = facts.filter(F.col("kind") == "rationale")
    return _edges(d, inside, own, relation).unionByName(_edges(why, _rationale_id(), _entity(path, owner), "rationale_for"))


def module_imports(files: DataFrame, facts: DataFrame) -> DataFrame:
    """``path, line, module, symbol, target_file``: imports with the one file their module names, if there is one.

    Leading dots count directories up from the importing file. A symbol may itself be a module.
    """
    i = facts.filter(F.col("kind") == "import").select("path", "line", F.split("target", ":").alias("x")).distinct()
    i = i.select("path", "line", F.col("x")[0].alias("module"), F.try_element_at("x", F.lit(2)).alias("symbol"))
    dots = F.length(F.regexp_extract("module", r"^\.*", 0))
    folder = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - dots, F.lit(0))), "_")
    bare = F.regexp_replace("module", r"^\.+", "")
    wanted = normalize_id_ascii(F.when(dots > 0, F.concat_ws("_", folder, bare)).otherwise(bare))
    a = languages.module_aliases(files)
    # A name from the root wins over one that starts lower.
    known = a.groupBy("alias", "whole").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    known = known.groupBy("alias").agg(F.max_by(F.struct("low", "high"), "whole").alias("b")).filter("b.low = b.high").select("alias", F.col("b.low").alias("target_file"))
    i = i.withColumn("alias", wanted).withColumn("deeper", F.concat_ws("_", "alias", normalize_id_ascii(F.col("symbol"))))
    second = known.select(F.col("alias").alias("deeper"), F.col("target_file").alias("deeper_file"))
    i = i.join(second, "deeper", "left").join(known, "alias", "left")
    return i.select("path", "line", "module", "symbol", "alias", F.coalesce("deeper_file", "target_file").alias("target_file"))


def fact_edges(files: DataFrame, facts: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """All relations that the facts state: structure, bases and imports. Unknown ends are named and stay unbound."""
    classes = resolve.unique_match(nodes.filter("label not like '%()'").filter("ord > 0").select(F.col("label").alias("base"), "id"), ["base"])
    b = facts.filter(F.col("kind") == "base").withColumn("base", F.element_at(F.split("target", r"\."), -1)).join(classes, "base", "left")
    held = (F.col("owner") == F.col("name")) | F.endswith("owner", F.concat(F.lit("."), "name"))
    own = F.when(held, _entity(F.col("path"), F.col("owner"))).otherwise(_entity(F.col("path"), F.col("owner"), F.col("name")))
    inherits = _edges(b, own, F.coalesce("id", normalize_id_ascii(F.col("base"))), "inherits")
    target = F.coalesce(file_id(F.col("target_file")), F.col("alias"))
    taken = _edges(imports, file_id(F.col("path")), target, F.when(F.col("symbol").isNull(), "imports").otherwise("imports_from"))
    return structure_edges(facts).unionByName(inherits).unionByName(taken)


def call_edges(facts: DataFrame, nodes: DataFrame, imports: DataFrame, existing: DataFrame) -> DataFrame:
    """Calls bound over the corpus: bare ones, those on ``self``, on a type's name, and functions handed on as values."""
    caller = F.when(F.col("owner").isNull(), file_id(F.col("path"))).otherwise(_entity(F.col("path"), F.col("owner")))
    c = facts.filter(F.col("kind") == "call").select("ord", caller.alias("caller_id"), F.col("name").alias("callee"), F.col("path").alias("source_file"), F.contains("target", F.lit(".")).alias("is_member"), "path", "owner", "target", "line")
    bound = nodes.select("id", "label", "source_file", "file_type")
    symbols = imports.filter("target_file is not null and symbol is not null").select("path", F.concat_ws("_", file_id(F.col("target_file")), normalize_id_ascii(F.col("symbol"))).alias("id"))
    seen = imports.select(F.col("path").alias("source_file"), F.lit(None).cast("string").alias("target_id"), "target_file").unionByName(symbols.select(F.col("path").alias("source_file"), F.col("id").alias("target_id"), F.lit(None).cast("string").alias("target_file")))
    have = existing.select("source", "target", "relation")
    bare = resolve.resolve_calls(c, bound, seen, have)
    own = F.regexp_extract("owner", r"^(.*)\.[^.]+$", 1)
    mine = c.filter((F.col("target") == F.concat(F.lit("self."), "callee")) & (own != "")).withColumn("target_id", _entity(F.col("path"), own, F.col("callee")))
    mine = mine.join(nodes.select(F.col("id").alias("target_id")).distinct(), "target_id").select(F.col("caller_id").alias("source"), F.col("target_id").alias("target"), "ord", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("score"))
    mine = resolve.new_edges(mine, have)
    types = nodes.filter("ord > 0 and label not like '%()' and file_type = 'code'").select("id", F.col("label").alias("name"))
    methods = existing.filter("relation = 'method'").select(F.col("source").alias("type_id"), F.col("target").alias("id")).join(nodes.select("id", F.regexp_extract("label", r"^\.(.*)\(\)$", 1).alias("name")), "id")
    on_type = c.filter("is_member").withColumn("receiver", F.element_at(F.split("target", r"\."), -2)).select("ord", "caller_id", "receiver", "callee")
    nothing = on_type.select("caller_id", "receiver", F.lit("").alias("type_name")).filter("false")
    member = resolve.member_calls(on_type, types, methods, nothing, have)
    passed = facts.filter(F.col("kind") == "indirect").select("ord", caller.alias("caller_id"), F.col("name").alias("callee"), F.col("target").alias("context"))
    sure = [x.select("source", "target", "relation", "confidence", "score", F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("context")) for x in (bare, mine, member)]
    direct = reduce(DataFrame.unionByName, sure)
    handed = languages.indirect_calls(passed, bound.withColumns({"callable": F.endswith("label", F.lit("()")), "is_class": F.lit(False)}), direct)
    handed = handed.select("source", "target", F.lit("indirect_call").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.85).alias("score"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("context"))
    return direct.unionByName(handed)


def build_graph(files: DataFrame, communities: bool = False) -> Graph:
    """The graph of source files ``path, content``.

    Files are extracted each on its own; all later steps are joins over the facts. Imports of modules outside the
    corpus end in stub nodes; bases that no file defines are dropped with their edges. With ``communities``
    the nodes carry community numbers, largest first.
    """
    facts = cut(extract_code(files)).withColumn("ord", F.monotonically_increasing_id())
    facts = cut(facts)
    raw = cut(fact_nodes(files, facts))
    imports = cut(module_imports(files, facts))
    stated = cut(fact_edges(files, facts, raw, imports))
    found = call_edges(facts, raw, imports, stated)
    nodes = cut(build.dedupe_nodes(raw))
    edges, stubs = build.remap_endpoints(nodes, stated.unionByName(found), build.alias_map(nodes))
    more = stubs.select("id", "label", "file_type", F.lit("").alias("source_file"), F.lit(None).cast("string").alias("source_location"), F.lit(None).cast("int").alias("community"), F.lit(0).cast("long").alias("ord"))
    nodes = cut(nodes.unionByName(more))
    edges = build.drop_self_imports(build.drop_cross_language(nodes, edges))
    edges = cut(graph.collapse_edges(edges.filter("source <> target")))
    if communities:
        numbered = cluster.number_communities(cluster.leiden(nodes, edges)).select("id", F.col("community").cast("int").alias("number"))
        nodes = cut(nodes.join(numbered, "id", "left").select(*[F.coalesce("number", "community").alias("community") if c == "community" else F.col(c) for c in nodes.columns]))
    return Graph(nodes, edges)
