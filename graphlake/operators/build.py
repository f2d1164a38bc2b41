"""From extracted rows to a graph: node survivors, aliases, endpoints, stubs, filters, hyperedges, labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.fixed import ACTIVE_DIRS, ARCHIVED_DIRS, BUILD_FAMILIES, FILE_TYPES, IMPORT_RELATIONS
from graphlake.functions.text import normalize_id_ascii, suffix


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def lifecycle_penalty(path: Column) -> Column:
    """0 where a directory says that it is current, else 2 where one says archived, else 1."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.when(F.exists(folders, lambda p: p.isin(*ACTIVE_DIRS)), 0).when(F.exists(folders, lambda p: p.isin(*ARCHIVED_DIRS)), 2).otherwise(1)


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each id.

    Survivor: the node whose file defines the id, then by lifecycle, shorter label, label and reversed
    path. Rows of the survivor's file fill what it lacks, in rank order. ``ord`` is the least of
    the group, so the first-seen place is kept. Types outside the vocabulary become concepts.
    """
    stem = normalize_id_ascii(F.regexp_replace("source_file", r"\.[^./]*$", ""))
    rank = F.struct(
        (~F.coalesce(F.startswith("id", stem), F.lit(False))).cast("int").alias("r0"),
        lifecycle_penalty(F.coalesce("source_file", F.lit(""))).alias("r1"),
        F.length("label").alias("r2"),
        F.col("label").alias("r3"),
        F.reverse(F.split(F.coalesce("source_file", F.lit("")), "/")).alias("r4"),
        F.col("ord").alias("r5"),
    )
    fill = ["label", "file_type", "source_location", "community"]
    ranked = nodes.withColumn("rank", rank)
    best = ranked.groupBy("id").agg(F.min_by(F.coalesce("source_file", F.lit("")), "rank").alias("own"), F.min("ord").alias("first"))
    same = ranked.join(best, "id").filter(F.coalesce("source_file", F.lit("")) == F.col("own"))
    out = same.groupBy("id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c) for c in fill], F.min_by("source_file", "rank").alias("source_file"), F.min("first").alias("ord")
    )
    kind = F.when(F.col("file_type").isin(*FILE_TYPES), F.col("file_type")).otherwise("concept")
    return out.withColumn("file_type", kind).select("id", "label", "file_type", "source_file", "source_location", "community", "ord")


def alias_map(nodes: DataFrame) -> DataFrame:
    """``(alias, id)``: the normalised id, and the dotted method form, where it names one node and is no id itself."""
    forms = nodes.select("id", F.explode(F.array_distinct(F.array(normalize_id_ascii(F.col("id")), F.concat(F.lit("."), F.regexp_extract("id", r"[^_]+$", 0))))).alias("alias"))
    unique = forms.groupBy("alias").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other").drop("other")
    return unique.join(nodes.select(F.col("id").alias("alias")), "alias", "left_anti")


def remap_endpoints(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with ends resolved through aliases, and the stub nodes that missing import targets become.

    A missing target of an import is a stub from the first such edge on in the order
    (source, target, relation); other edges to it stay if they come later, else they are dropped.
    """
    known = nodes.select(F.col("id"))

    def resolve(e: DataFrame, end: str) -> DataFrame:
        k = known.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_known"))
        a = aliases.select(F.col("alias").alias(end), F.col("id").alias(f"{end}_alias"))
        e = e.join(k, end, "left").join(a, end, "left")
        return e.withColumn(f"{end}_id", F.when(F.col(f"{end}_known"), F.col(end)).otherwise(F.coalesce(f"{end}_alias", end))).withColumn(
            f"{end}_ok", F.coalesce(f"{end}_known", F.col(f"{end}_alias").isNotNull())
        )

    e = resolve(resolve(edges, "source"), "target").filter("source_ok")
    place = F.struct("source", "target", "relation")
    stubs = e.filter(~F.col("target_ok") & F.col("relation").isin(*IMPORT_RELATIONS)).groupBy(F.col("target_id").alias("id")).agg(F.min(place).alias("since"))
    e = e.join(stubs.select(F.col("id").alias("target_id"), "since"), "target_id", "left").filter(F.col("target_ok") | (F.col("since").isNotNull() & (place >= F.col("since"))))
    out = e.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])
    return out, stubs.select("id", F.col("id").alias("label"), F.lit("concept").alias("file_type"), F.lit("external").alias("type"))


def drop_cross_language(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop inferred calls between suffixes of different families, and imports and references between known ones.

    For calls an unknown suffix is a family of its own.
    """
    kinds = nodes.select("id", suffix(F.col("source_file")).alias("x")).withColumn("family", F.coalesce(lookup(BUILD_FAMILIES, F.col("x")), F.lit("")))
    s = kinds.select(F.col("id").alias("source"), F.col("x").alias("sx"), F.col("family").alias("sf"))
    t = kinds.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("family").alias("tf"))
    calls = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & (F.col("sx") != "") & (F.col("tx") != "") & (F.col("sf") != F.col("tf"))
    refs = F.col("relation").isin("imports", "imports_from", "references") & (F.col("sf") != "") & (F.col("tf") != "") & (F.col("sf") != F.col("tf"))
    return edges.join(s, "source").join(t, "target").filter(~(calls | refs)).select(edges.columns)


def drop_self_imports(edges: DataFrame) -> DataFrame:
    return edges.filter(~((F.col("source") == F.col("target")) & F.col("relation").isin(*IMPORT_RELATIONS)))


def default_weight(weight: Column) -> Column:
    """Negative weights count as 1."""
    return F.when(weight < 0, 1.0).otherwise(weight)


def remap_hyperedges(hyperedges: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Members resolved through aliases in their order; unknown members go, and hyperedges left without any."""
    m = hyperedges.select("id", F.posexplode("nodes").alias("pos", "member"))
    known = nodes.select(F.col("id").alias("member"), F.lit(True).alias("known"))
    a = aliases.select(F.col("alias").alias("member"), F.col("id").alias("real"))
    m = m.join(known, "member", "left").join(a, "member", "left").withColumn("real", F.when(F.col("known"), F.col("member")).otherwise(F.col("real"))).filter("real is not null")
    members = m.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "real"))), lambda x: x["real"]).alias("nodes"))
    return hyperedges.drop("nodes").join(members, "id")


def file_label_suffixes(nodes: DataFrame) -> DataFrame:
    """File nodes whose name several files share get their shortest unique path suffix: ``id, label``."""
    parts = F.split("source_file", "/")
    files = nodes.filter(F.col("label") == F.element_at(parts, -1)).select("id", "label", parts.alias("parts"))
    shared = files.groupBy("label").agg(F.count_distinct("parts").alias("n")).filter("n > 1").select("label")
    files = files.join(shared, "label", "left_semi")
    ends = files.select("id", "label", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("parts", -k, k), "/").alias("tail")))).alias("x")).select("id", "label", "x.*")
    counts = ends.groupBy("label", "tail").agg(F.count_distinct("id").alias("n"))
    return ends.join(counts, ["label", "tail"]).groupBy("id").agg(F.coalesce(F.min_by("tail", F.when(F.col("n") == 1, F.col("k"))), F.max_by("tail", "k")).alias("label"))


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """File hubs, method stubs and little-used functions."""
    name = F.element_at(F.split(source_file, "/"), -1)
    file_hub = F.coalesce((source_file != "") & ((label == name) | (F.endswith(label, F.concat(F.lit("/"), name)))), F.lit(False))
    method = F.startswith(label, F.lit(".")) & F.endswith(label, F.lit("()"))
    return (label != "") & (file_hub | method | (F.endswith(label, F.lit("()")) & (degree <= 1)))


def is_concept_node(source_file: Column) -> Column:
    return F.coalesce(source_file, F.lit("")).eqNullSafe("") | ~F.contains(F.element_at(F.split(source_file, "/"), -1), F.lit("."))
