"""Resolution passes of single languages: Go types, Python modules, functions passed as values, portable paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.fixed import BUILTIN_GLOBALS
from graphlake.functions.text import normalize_id_ascii
from graphlake.operators.resolve import new_edges, unique_match


def go_type_references(edges: DataFrame, stubs: DataFrame, imports: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Type references through an import alias: ``(edges, stubs to add)``.

    ``stubs`` are nodes ``id, label`` without a file whose label is ``alias.Type``; ``imports`` has
    ``source_file, alias, import_path``, ``types`` the project's ``import_path, name, id``. A reference or
    embedding of such a stub goes to the one type of that path and name, else to a stub named after both.
    """
    dot = F.length("label") - F.length(F.substring_index("label", ".", -1)) - 1
    q = stubs.filter(F.contains("label", F.lit("."))).select(F.col("id").alias("target"), F.substring("label", F.lit(1), dot).alias("alias"), F.substring_index("label", ".", -1).alias("name"))
    one = imports.groupBy("source_file", "alias").agg(F.max("import_path").alias("import_path"))
    owned = unique_match(types.select("import_path", "name", F.col("id").alias("real")), ["import_path", "name"], "real")
    kinds = F.col("relation").isin("references", "embeds")
    e = edges.join(q.filter("name <> ''"), "target", "left").join(one, ["source_file", "alias"], "left").join(owned, ["import_path", "name"], "left")
    full = F.concat_ws(".", "import_path", "name")
    moved = kinds & F.col("import_path").isNotNull() & F.col("name").isNotNull()
    outside = F.concat(F.lit("go_type_"), normalize_id_ascii(full))
    e = e.withColumns({"moved": F.coalesce(moved, F.lit(False)), "full": full, "outside": outside})
    target = F.when(F.col("moved"), F.coalesce("real", "outside")).otherwise(F.col("target"))
    fresh = e.filter("moved and real is null").select(F.col("outside").alias("id"), F.col("full").alias("label")).distinct()
    return e.select(*[target.alias("target") if c == "target" else F.col(c) for c in edges.columns]), fresh


def indirect_calls(passed: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """Functions handed on as values: edges ``indirect_call`` of score 0.85 from ``passed`` (``ord, caller_id, callee, context``).

    A name binds if one definition bears it; only callables that are no classes count, and only where the
    pair has no call yet. ``nodes`` are ``id, label, callable, is_class``.
    """
    named = nodes.select("id", F.regexp_replace("label", r"^[()]+|[()]+$", "").alias("callee"))
    fit = nodes.filter("callable and not is_class").select(F.col("id").alias("target"))
    found = passed.filter(~F.col("callee").isin(*BUILTIN_GLOBALS)).join(unique_match(named, ["callee"]), "callee").withColumnRenamed("id", "target").join(fit, "target", "left_semi")
    found = found.select(F.col("caller_id").alias("source"), "target", "ord", F.lit("indirect_call").alias("relation"), F.coalesce("context", F.lit("argument")).alias("context"), F.lit(0.85).alias("score"))
    calls = existing.filter(F.col("relation").isin("calls", "indirect_call"))
    return new_edges(found, calls)


def module_aliases(files: DataFrame) -> DataFrame:
    """``alias, path, whole``: every dotted name under which a Python file ``path`` may be imported.

    A name starts at any directory above the file (``whole``: at the root); a package's initialiser has the
    package's name. Segments that are no identifiers end the names that would hold them.
    """
    parts = F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    f = files.filter(F.endswith("path", F.lit(".py"))).select("path", parts.alias("parts"))
    starts = f.select("path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
    name = F.slice("parts", F.col("k"), F.size("parts") - F.col("k") + 1)
    good = F.forall(name, lambda p: p.rlike(r"^[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*$"))
    return starts.filter(good).select(normalize_id_ascii(F.array_join(name, ".")).alias("alias"), "path", (F.col("k") == 1).alias("whole"))


def ambiguous_modules(files: DataFrame) -> DataFrame:
    """``alias``: module names that several files answer to, and none from the root."""
    a = module_aliases(files).groupBy("alias").agg(F.min("path").alias("a"), F.max("path").alias("b"), F.max("whole").alias("whole"))
    return a.filter("a <> b and not whole").select("alias")


def guarded_calls(calls: DataFrame, bindings: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """``calls`` without those bound through an ambiguous module.

    ``bindings`` are a file's imports ``source_file, module, name, local``; ``name`` is null where the module itself is
    bound, ``*`` for all of its names. A star import of an ambiguous module, or of one above it, taints
    every call of the file; other imports taint calls of the local name or through it as receiver.
    """
    module = normalize_id_ascii(F.col("module"))
    b = bindings.withColumn("id", module).withColumn("inner", F.when(F.col("name").isNotNull() & (F.col("name") != "*"), normalize_id_ascii(F.concat_ws(".", "module", "name"))))
    own, inner = ambiguous.select(F.col("alias").alias("id"), F.lit(True).alias("own")), ambiguous.select(F.col("alias").alias("inner"), F.lit(True).alias("below"))
    # Every name above an ambiguous one, for star imports.
    parts = F.split("alias", "_")
    above = ambiguous.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))).alias("id")).distinct().withColumn("star", F.lit(True))
    b = b.join(own, "id", "left").join(inner, "inner", "left").join(above, "id", "left")
    every = b.filter("name = '*' and star").select("source_file").distinct()
    some = b.filter("(name is null or name <> '*') and (own or below)").select("source_file", "local").distinct()
    left = calls.join(every, "source_file", "left_anti")
    left = left.join(some.withColumnRenamed("local", "callee"), ["source_file", "callee"], "left_anti")
    root = left.withColumn("root", F.substring_index(F.coalesce("receiver", F.lit("")), ".", 1))
    return root.join(some.withColumnRenamed("local", "root"), ["source_file", "root"], "left_anti").select(calls.columns)


def portable_path(path: Column, root: str) -> Column:
    """``path`` as seen from ``root``; over three steps up, its name only."""
    top = [p for p in root.split("/") if p]
    own = F.filter(F.split(path, "/"), lambda p: p != "")
    base = F.array(*[F.lit(p) for p in top]) if top else F.array().cast("array<string>")
    same = F.zip_with(own, base, lambda a, b: F.coalesce(a == b, F.lit(False)))
    depth = F.coalesce(F.array_position(F.slice(same, 1, F.least(F.size(own), F.lit(len(top)))), F.lit(False)), F.lit(0)).cast("int")
    depth = F.when(depth > 0, depth - 1).otherwise(F.least(F.size(own), F.lit(len(top))))
    up = F.lit(len(top)) - depth
    rest = F.slice(own, depth + 1, F.greatest(F.size(own) - depth, F.lit(0)))
    return F.when(up > 3, F.element_at(own, -1)).otherwise(F.array_join(F.concat(F.array_repeat(F.lit(".."), up), rest), "/"))
