"""Corpus resolution: binding names to definitions by unique-match joins.

The common shape of all passes: join on a key, keep the match only if it names one target,
emit only pairs that are not related yet, first raw call first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.fixed import BUILTIN_GLOBALS, CALL_FAMILIES, CASE_FREE_SUFFIXES, IMPORT_BOUND_SUFFIXES, TEST_DIRS, TEST_NAMES
from graphlake.functions.text import suffix
from graphlake.operators.build import lookup
from graphlake.plans.storage import cut


def unique_match(candidates: DataFrame, keys: list[str], target: str = "id") -> DataFrame:
    """``keys, target`` where a key names exactly one target. Least and greatest are partial aggregates, so a common key is no hot group."""
    out = candidates.groupBy(*keys).agg(F.min(target).alias(target), F.max(target).alias("_other"))
    return out.filter(F.col(target) == F.col("_other")).drop("_other")


def new_edges(found: DataFrame, existing: DataFrame, only_relation: str | None = None) -> DataFrame:
    """Of edges ``source, target, ord, ...`` the first for each pair that is no loop and not among ``existing``."""
    have = existing if only_relation is None else existing.filter(F.col("relation") == only_relation)
    fresh = found.filter("source <> target").join(have.select("source", "target"), ["source", "target"], "left_anti")
    rest = [c for c in found.columns if c not in ("source", "target")]
    first = fresh.groupBy("source", "target").agg(F.min(F.struct("ord", *[c for c in rest if c != "ord"])).alias("r"))
    return first.select("source", "target", *[F.col(f"r.{c}").alias(c) for c in rest])


def is_test_path(path: Column) -> Column:
    """A test directory among the segments, or a test's file name."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.element_at(parts, -1)
    return F.exists(parts, lambda p: F.lower(p).isin(*TEST_DIRS)) | reduce(Column.__or__, [name.rlike(p) for p in TEST_NAMES])


def _dir_steps(path: Column) -> Column:
    """``(step, place)`` by which a file is looked for: the file, its directory, and every directory above by depth."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    text = F.array_join(folders, "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(folders)), lambda k: k > 0), lambda k: F.struct(k.cast("int").alias("step"), F.array_join(F.slice(folders, 1, k), "/").alias("place")))
    nearest = F.array(F.struct(F.lit(_FILE).alias("step"), path.alias("place")), F.struct(F.lit(_DIR).alias("step"), text.alias("place")), F.struct(F.lit(_ANY).alias("step"), F.lit("").alias("place")))
    return F.concat(nearest, above)


#: Steps of :func:`nearest` beside directory depths: the same file, the same directory, anywhere.
_FILE, _DIR, _ANY = 1_000_000, 500_000, 0


def nearest(calls: DataFrame, definitions: DataFrame, on: list[str]) -> DataFrame:
    """For calls ``call, caller_file, *on`` the one definition ``id, file, *on`` that is nearest by path, if there is one.

    Calls outside tests see no definitions in tests; calls in tests see only those, if there are any. A
    single definition left is it. Else those in the same file decide, else those in the same directory,
    else those under the longest common directory of at least one segment; two of a kind decide nothing.

    Definitions are first summed up for each place, as least and greatest id, so a name with many
    definitions and many calls makes no pairs of them.
    """
    d = definitions.select(*on, "id", is_test_path(F.col("file")).alias("test"), F.explode(_dir_steps(F.col("file"))).alias("x"))
    places = d.groupBy(*on, "test", "x").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    c = calls.select("call", *on, is_test_path(F.col("caller_file")).alias("from_test"), F.explode(_dir_steps(F.col("caller_file"))).alias("x"))
    met = c.join(places, [*on, "x"]).filter(F.col("from_test") | ~F.col("test"))
    pick = F.max_by(F.struct("id", "other"), "x.step")
    best = met.groupBy("call", "test").agg(pick.alias("b"), F.max("x.step").alias("step"), F.max(F.when(F.col("x.step") == _ANY, F.struct("id", "other"))).alias("all"))
    # Of tests and others, tests first: only calls in tests have both.
    best = best.groupBy("call").agg(F.max_by(F.struct("b", "step", "all"), F.col("test").cast("int")).alias("r")).select("call", "r.*")
    found = F.when(F.col("all.id") == F.col("all.other"), F.col("all.id")).when((F.col("step") != _ANY) & (F.col("b.id") == F.col("b.other")), F.col("b.id"))
    return best.select("call", found.alias("id")).filter("id is not null")


def proximity(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """For calls ``call, caller_file`` and candidates ``call, id, file``: the nearest one by :func:`nearest`."""
    own = calls.withColumn("key", F.col("call"))
    return nearest(own, candidates.withColumnRenamed("call", "key"), ["key"])


def _bare(label: Column) -> Column:
    """A label without surrounding parentheses and leading dots."""
    return F.regexp_replace(F.regexp_replace(label, r"^[()]+|[()]+$", ""), r"^\.+", "")


def resolve_calls(calls: DataFrame, nodes: DataFrame, imports: DataFrame, existing: DataFrame) -> DataFrame:
    """Bind bare calls ``ord, caller_id, callee, source_file, is_member`` to definitions: edges ``calls``.

    Library names are never bound. Candidates have the callee's label, or where no definition has it and
    the caller's language ignores case, that label in lower case; their language family is the
    caller's or unknown. One candidate binds: EXTRACTED with score 1 if the caller's file imports it or its
    file, else INFERRED with 0.85, save that JavaScript needs an import. Of several, the one imported
    symbol binds, else the one imported module's, else the nearest by path. ``imports`` holds
    ``source_file, target_id`` and ``source_file, target_file``.

    All candidates of a name are summed up before any join with calls; a name that a third of all calls
    use costs one row for each call.
    """
    on = ["name", "family"]
    kind = lambda path: F.coalesce(lookup(CALL_FAMILIES, suffix(path)), F.lit(""))
    case_free = lambda path: F.coalesce(suffix(path).isin(*CASE_FREE_SUFFIXES), F.lit(False))
    defs = nodes.filter(F.col("file_type") != "rationale") if "file_type" in nodes.columns else nodes
    defs = defs.select("id", _bare(F.col("label")).alias("label"), F.coalesce("source_file", F.lit("")).alias("file")).filter("label <> ''")
    exact = defs.select("label").distinct().select(F.col("label").alias("callee"), F.lit(True).alias("exact"))
    # A definition of unknown family is met by callers of every family, and every definition by unknown callers.
    every = F.array(*[F.lit(f) for f in ["", *dict.fromkeys(CALL_FAMILIES.values())]])
    met_by = F.when(kind(F.col("file")) == "", every).otherwise(F.array(kind(F.col("file")), F.lit("")))
    names = F.array_compact(F.array(F.concat(F.lit("="), "label"), F.when(case_free(F.col("file")), F.concat(F.lit("~"), F.lower("label")))))
    defs = defs.withColumn("family", F.explode(met_by)).withColumn("name", F.explode(names)).select(*on, "id", "file")

    c = calls.filter(~F.col("is_member") & (F.col("callee") != "") & ~F.col("callee").isin(*BUILTIN_GLOBALS)).join(exact, "callee", "left")
    name = F.when(F.col("exact"), F.concat(F.lit("="), "callee")).when(case_free(F.col("source_file")), F.concat(F.lit("~"), F.lower("callee")))
    c = c.select(F.col("ord").alias("call"), "caller_id", F.col("source_file").alias("caller_file"), name.alias("name"), kind(F.col("source_file")).alias("family")).filter("name is not null")

    def one(candidates: DataFrame, keys: list[str], alias: str) -> DataFrame:
        return candidates.groupBy(*keys).agg(F.min("id").alias(alias), F.max("id").alias(f"{alias}_other"))

    by_id = imports.filter("target_id is not null").select(F.col("source_file").alias("caller_file"), F.col("target_id").alias("id")).distinct().join(defs, "id")
    by_file = imports.filter("target_file is not null").select(F.col("source_file").alias("caller_file"), F.col("target_file").alias("file")).distinct().join(defs, "file")
    seen = c.join(one(defs, on, "only"), on).join(one(by_id, ["caller_file", *on], "symbol"), ["caller_file", *on], "left").join(one(by_file, ["caller_file", *on], "module"), ["caller_file", *on], "left")
    unique = lambda k: F.when(F.col(k) == F.col(f"{k}_other"), F.col(k))
    alone = F.col("only") == F.col("only_other")
    imported = F.coalesce(unique("symbol"), unique("module"))
    seen = seen.select("call", "caller_id", "caller_file", *on, F.when(alone, F.col("only")).otherwise(imported).alias("target"), F.when(alone, F.coalesce("symbol", "module").isNotNull()).otherwise(imported.isNotNull()).alias("proven"))
    near = nearest(seen.filter("target is null").select("call", "caller_file", *on), defs, on)
    found = seen.join(near, "call", "left").withColumn("target", F.coalesce("target", "id")).filter("target is not null")
    found = found.filter(F.col("proven") | ~suffix(F.col("caller_file")).isin(*IMPORT_BOUND_SUFFIXES))
    nowhere = nodes.filter(F.coalesce("source_file", F.lit("")) == "").select(F.col("id").alias("target")).distinct()
    found = found.join(nowhere, "target", "left_anti")
    found = found.select(
        F.col("caller_id").alias("source"), "target", F.col("call").alias("ord"), F.lit("calls").alias("relation"),
        F.when(F.col("proven"), "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.when(F.col("proven"), 1.0).otherwise(0.85).alias("score"),
    )
    return new_edges(found, existing)


def rewire_stubs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without a file give way to the one definition of their label: by case, then without case.

    Stubs that no edge needs any more are dropped.
    """
    empty = F.coalesce("source_file", F.lit("")).eqNullSafe("")
    stubs, defs = nodes.filter(empty).select("id", "label"), nodes.filter(~empty).select("id", "label")
    exact = unique_match(defs.withColumnRenamed("id", "real"), ["label"], "real")
    loose = unique_match(defs.select(F.col("id").alias("loose"), F.lower("label").alias("low")), ["low"], "loose")
    m = stubs.join(exact, "label", "left").withColumn("low", F.lower("label")).join(loose, "low", "left").select("id", F.coalesce("real", "loose").alias("real")).filter("real is not null")
    s, t = m.select(F.col("id").alias("source"), F.col("real").alias("sr")), m.select(F.col("id").alias("target"), F.col("real").alias("tr"))
    e = edges.join(s, "source", "left").join(t, "target", "left")
    e = e.select(F.coalesce("sr", "source").alias("source"), F.coalesce("tr", "target").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])
    used = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    kept = nodes.filter(~empty).unionByName(nodes.filter(empty).join(used, "id", "left_semi").select(nodes.columns))
    return kept, e


def disambiguate_ids(nodes: DataFrame) -> DataFrame:
    """``old_id, source_file, id``: ids that several files share get their file's form as prefix, and a digest where that still collides."""
    from graphlake.functions.text import normalize_id_ascii

    keys = nodes.select("id", "source_file").distinct()
    shared = keys.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    salted = keys.join(shared, "id", "left_semi").select(F.col("id").alias("old_id"), "source_file", F.concat_ws("_", normalize_id_ascii(F.col("source_file")), F.col("id")).alias("salted"))
    again = salted.groupBy("salted").agg(F.count("*").alias("n"))
    digest = F.concat_ws("_", "salted", F.substring(F.sha1("source_file"), 1, 6))
    return salted.join(again, "salted").select("old_id", "source_file", F.when(F.col("n") > 1, digest).otherwise(F.col("salted")).alias("id"))


def barrel_closure(exports: DataFrame, rounds: int = 8) -> DataFrame:
    """``name, target``: re-export chains ``name -> target`` followed to their ends, unique targets only, up to ``rounds`` steps."""
    unique = cut(unique_match(exports.filter("name <> target"), ["name"], "target"))
    state = unique
    for _ in range(rounds):
        step = unique.select(F.col("name").alias("target"), F.col("target").alias("next"))
        moved = cut(state.join(step, "target", "left").select("name", "target", "next"))
        if moved.filter("next is not null").isEmpty():
            break
        state = moved.select("name", F.coalesce("next", "target").alias("target"))
    return state.filter("name <> target")


def canonical_namespaces(nodes: DataFrame) -> DataFrame:
    """``id, canonical`` for namespace nodes: of each label the first by file, place and id."""
    first = nodes.groupBy("label").agg(F.min_by("id", F.struct("source_file", "source_location", "id")).alias("canonical"))
    return nodes.join(first, "label").select("id", "canonical")


def merge_declarations(nodes: DataFrame) -> DataFrame:
    """Headers win over their implementations of the same id, directory and stem: ``id, source_file, definition_file``."""
    s = suffix(F.col("source_file"))
    stem = F.regexp_replace(F.regexp_replace("source_file", r"\.[^./]*$", ""), r"\+[^/]*$", "")
    n = nodes.withColumns({"header": s.isin(".h", ".hh", ".hpp", ".hxx"), "impl": s.isin(".c", ".cc", ".cpp", ".cxx", ".m", ".mm"), "stem": stem})
    g = n.groupBy("id", "stem").agg(F.count_if("header").alias("h"), F.count_if("impl").alias("i"), F.min(F.when(F.col("header"), F.col("source_file"))).alias("source_file"), F.min(F.when(F.col("impl"), F.col("source_file"))).alias("definition_file"))
    return g.filter("h > 0 and i > 0").select("id", "source_file", "definition_file")


def go_import_fanout(imports: DataFrame, packages: DataFrame, existing: DataFrame) -> DataFrame:
    """Imports ``source, import_path`` of a package become edges to its files ``import_path, file_id``; no pair twice."""
    # Files of a package as one list, and what a source takes as one group: no table of all pairs is made distinct.
    files = packages.groupBy("import_path").agg(F.collect_set("file_id").alias("files"))
    taken = imports.select("source", "import_path").distinct().join(files, "import_path").groupBy("source").agg(F.array_distinct(F.flatten(F.collect_list("files"))).alias("files"))
    found = taken.select("source", F.explode("files").alias("target")).filter("source <> target")
    return found.join(existing.select("source", "target"), ["source", "target"], "left_anti").select("source", "target", F.lit("imports_from").alias("relation"))


def member_calls(calls: DataFrame, types: DataFrame, methods: DataFrame, receivers: DataFrame, existing: DataFrame) -> DataFrame:
    """Bind ``receiver.callee()``: qualified by a type's name (EXTRACTED, 1), or by the receiver's declared type (INFERRED, 0.8).

    ``calls``: ord, caller_id, receiver, callee; ``types``: id, name; ``methods``: type_id, name, id;
    ``receivers``: caller_id, receiver, type_name.
    """
    one_type = unique_match(types.withColumnRenamed("id", "type_id"), ["name"], "type_id")
    one_method = unique_match(methods, ["type_id", "name"])
    named = one_type.select(F.col("name").alias("receiver"), F.col("type_id").alias("direct"))
    declared = unique_match(receivers, ["caller_id", "receiver"], "type_name").join(one_type.withColumnRenamed("name", "type_name"), "type_name").select("caller_id", "receiver", F.col("type_id").alias("typed"))
    c = calls.join(declared, ["caller_id", "receiver"], "left").join(named, "receiver", "left")
    c = c.withColumn("type_id", F.coalesce("direct", "typed")).filter("type_id is not null")
    found = c.join(one_method.select("type_id", F.col("name").alias("callee"), F.col("id").alias("target")), ["type_id", "callee"])
    sure = F.col("direct").isNotNull()
    found = found.select(F.col("caller_id").alias("source"), "target", "ord", F.lit("calls").alias("relation"), F.when(sure, "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.when(sure, 1.0).otherwise(0.8).alias("score"))
    return new_edges(found, existing)


def parked_calls(calls: DataFrame, types: DataFrame, receivers: DataFrame, most: int = 64) -> DataFrame:
    """Calls whose receiver type is declared but unknown here: up to ``most`` distinct ones for each caller, in order."""
    known = types.select(F.col("name").alias("type_name")).distinct()
    p = calls.join(receivers, ["caller_id", "receiver"]).join(known, "type_name", "left_anti")
    first = p.groupBy("caller_id", "callee", "type_name").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("caller_id").orderBy("ord", "callee", "type_name")
    return first.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("caller_id", "callee", "type_name", "ord")


def inherited_methods(types: DataFrame, bases: DataFrame, methods: DataFrame) -> DataFrame:
    """``type_id, name, id``: each type's own method, or the one found at the nearest level of its bases where it is unique.

    ``bases``: type_id, base_id. Bases are followed to the top; a base met before is not followed again, which
    ends cycles. A level with two different definitions is ambiguous and binds nothing above it.
    """
    up = types.select(F.col("id").alias("type_id"), F.col("id").alias("at"), F.lit(0).alias("level"))
    reach, step, k = up, up, 0
    while True:
        k += 1
        above = bases.select(F.col("type_id").alias("at"), "base_id")
        step = step.join(above, "at").select("type_id", F.col("base_id").alias("at"), F.lit(k).alias("level")).distinct()
        step = cut(step.join(reach.select("type_id", "at"), ["type_id", "at"], "left_anti"))
        if step.isEmpty():
            break
        reach = reach.unionByName(step)
    m = reach.join(methods.select(F.col("type_id").alias("at"), "name", "id"), "at").groupBy("type_id", "name", "level").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    nearest = m.groupBy("type_id", "name").agg(F.min_by(F.struct("id", "other"), "level").alias("b"))
    return nearest.filter("b.id = b.other").select("type_id", "name", "b.id")


def interface_dispatch(implements: DataFrame, methods: DataFrame, existing: DataFrame) -> DataFrame:
    """``dispatches_to`` (0.9) from an interface's method to its one implementation, where one type implements the interface."""
    sole = unique_match(implements, ["interface_id"], "type_id")
    one = unique_match(methods, ["type_id", "name"])
    decl = one.select(F.col("type_id").alias("interface_id"), "name", F.col("id").alias("source"))
    impl = one.select("type_id", "name", F.col("id").alias("target"))
    found = sole.join(decl, "interface_id").join(impl, ["type_id", "name"])
    return found.join(existing.select("source", "target"), ["source", "target"], "left_anti").select("source", "target", F.lit("dispatches_to").alias("relation"), F.lit(0.9).alias("score"))


def fqn_references(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Type references ``source, name, file`` through ``definitions(fqn, id)`` by the file's imports and package.

    ``references`` carries ``imported`` (the fqn its file imports under the name, or null) and ``package``. The
    imported name wins, then the package's own; what remains unknown points to a stub named after the fqn.
    """
    known = unique_match(definitions, ["fqn"])
    own = F.concat_ws(".", "package", "name")
    r = references.withColumn("local", own)
    a, b = known.select(F.col("fqn").alias("imported"), F.col("id").alias("ia")), known.select(F.col("fqn").alias("local"), F.col("id").alias("ib"))
    r = r.join(a, "imported", "left").join(b, "local", "left")
    target = F.coalesce("ia", F.when(F.col("imported").isNull(), F.col("ib")), F.coalesce("imported", "name"))
    return r.select("source", target.alias("target"), F.lit("references").alias("relation"), (F.col("ia").isNull() & F.col("ib").isNull()).alias("stub"))


def canonicalize_ids(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``id, canonical``: the longest file id ``old`` that prefixes an id is replaced by ``new``."""
    ladder = nodes.select("id", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("id", "_"))), lambda k: F.array_join(F.slice(F.split("id", "_"), 1, k), "_")), lambda p: p != "")).alias("old"))
    hit = ladder.join(files, "old").groupBy("id").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("h"))
    return nodes.select("id").join(hit, "id", "left").select("id", F.coalesce(F.concat("h.new", F.expr("substring(id, length(h.old) + 1)")), "id").alias("canonical"))


def innermost_enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For points ``file, pos`` the innermost span ``file, start, end, id`` around each; spans of a file nest."""
    m = points.join(spans, (points["file"] == spans["file"]) & (F.col("start") <= F.col("pos")) & (F.col("end") >= F.col("pos")))
    return m.groupBy(points["file"], "pos").agg(F.min_by("id", F.struct(F.col("end") - F.col("start"), F.col("id"))).alias("id"))
