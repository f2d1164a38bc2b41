"""The text report: every section as rows ``section, ord, line``, written in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators.build import is_concept_node, is_file_node
from graphlake.operators.graph import node_degrees

#: Members of a community that make it worth showing, and labels shown of it.
LEAST_MEMBERS, SHOWN = 3, 8
#: Isolated nodes named, and the share of ambiguous edges that is a gap of its own.
NAMED, DOUBTFUL_PERCENT = 5, 20

SECTIONS = ("corpus", "summary", "freshness", "hubs", "gods", "surprises", "cycles", "hyperedges", "communities", "ambiguous", "gaps", "questions")


def _lines(rows: DataFrame, section: str, order: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), order.alias("ord"), line.alias("line"))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def real_members(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Members of communities that are no file nodes: ``community, id, label, degree``."""
    n = node_degrees(nodes.drop("community"), edges).join(membership, "id")
    return n.filter(~F.coalesce(is_file_node(F.col("label"), F.col("source_file"), F.col("degree")), F.lit(False))).select("community", "id", "label", "degree")


def thin_communities(real: DataFrame, membership: DataFrame, least: int = LEAST_MEMBERS) -> DataFrame:
    """``community, members, thin``: communities with their real members."""
    every = membership.select("community").distinct()
    size = real.groupBy("community").agg(F.count("*").alias("members"))
    return every.join(size, "community", "left").select("community", F.coalesce("members", F.lit(0)).alias("members")).withColumn("thin", F.col("members") < least)


def corpus_section(files: DataFrame) -> DataFrame:
    """``files``: path, words."""
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("w"))
    return _lines(total, "corpus", F.lit("0"), F.concat(_text("n"), F.lit(" files, about "), thousands(F.col("w")), F.lit(" words")))


def summary_section(nodes: DataFrame, edges: DataFrame, membership: DataFrame, real: DataFrame) -> DataFrame:
    """Counts with thin communities, shares of confidence, and the mean score of inferred edges that have one."""
    thin = thin_communities(real, membership).agg(F.count("*").alias("c"), F.count_if("thin").alias("t"))
    score = F.col("score") if "score" in edges.columns else F.lit(None).cast("double")
    inferred = F.col("confidence") == "INFERRED"
    e = edges.agg(F.count("*").alias("m"), F.count_if(F.col("confidence") == "EXTRACTED").alias("x"), F.count_if(inferred).alias("i"), F.count_if(F.col("confidence") == "AMBIGUOUS").alias("a"), F.avg(F.when(inferred, score)).alias("mean"))
    all_ = nodes.agg(F.count("*").alias("n")).crossJoin(e).crossJoin(thin)
    share = lambda c: F.concat(F.bround(F.col(c) * 100.0 / F.greatest("m", F.lit(1)), 0).cast("int").cast("string"), F.lit("%"))
    counts = F.concat(_text("n"), F.lit(" nodes, "), _text("m"), F.lit(" edges, "), _text("c"), F.lit(" communities"), F.when(F.col("t") > 0, F.concat(F.lit(", "), _text("t"), F.lit(" thin"))).otherwise(""))
    trust = F.concat(F.lit("EXTRACTED "), share("x"), F.lit(", INFERRED "), share("i"), F.lit(", AMBIGUOUS "), share("a"))
    mean = F.concat(F.lit("mean inferred score "), F.format_number("mean", 2))
    return _lines(all_, "summary", F.lit("0"), counts).unionByName(_lines(all_, "summary", F.lit("1"), trust)).unionByName(_lines(all_.filter("mean is not null"), "summary", F.lit("2"), mean))


def freshness_section(spark, commit: str | None) -> DataFrame:
    """The commit the graph was built from, eight characters of it; no line without one."""
    rows = [("freshness", "0", f"built from commit {commit[:8]}")] if commit else []
    return spark.createDataFrame(rows, "section string, ord string, line string")


def hubs_section(names: DataFrame, real: DataFrame) -> DataFrame:
    """Names of communities with a real member: ``community, name``."""
    some = real.select("community").distinct()
    return _lines(names.join(some, "community", "left_semi"), "hubs", F.format_string("%09d", "community"), F.col("name"))


def gods_section(gods: DataFrame) -> DataFrame:
    return _lines(gods, "gods", F.format_string("%012d|%s", 999999999999 - F.col("degree"), F.col("id")), F.concat(F.lit("`"), "label", F.lit("` - "), _text("degree"), F.lit(" edges")))


def surprises_section(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Surprises ``source, target, relation, confidence, score, reasons`` with labels and files."""
    n = nodes.select("id", "label", "source_file")
    s, t = n.toDF("source", "sl", "sf"), n.toDF("target", "tl", "tf")
    rows = found.join(s, "source").join(t, "target")
    similar = F.when(F.col("relation") == "semantically_similar_to", " [semantically similar]").otherwise("")
    line = F.concat(F.lit("`"), "sl", F.lit("` --"), F.coalesce(F.when(F.col("relation") != "", F.col("relation")), F.lit("related_to")), F.lit("--> `"), "tl", F.lit("` ["), "confidence", F.lit("]"), similar, F.lit(" "), F.coalesce("sf", F.lit("")), F.lit(" | "), F.coalesce("tf", F.lit("")))
    return _lines(rows, "surprises", F.format_string("%06d|%s|%s|%s", 999999 - F.col("score"), "source", "target", "relation"), line)


def cycles_section(cycles: DataFrame, top: int = 20) -> DataFrame:
    """Import cycles ``cycle`` (names joined by ``>``) ``, length``: the shortest first."""
    first = cycles.orderBy("length", "cycle").limit(top)
    closed = F.concat(F.replace("cycle", F.lit(">"), F.lit(" -> ")), F.lit(" -> "), F.substring_index("cycle", ">", 1))
    return _lines(first, "cycles", F.format_string("%03d|%s", "length", "cycle"), F.concat(_text("length"), F.lit("-file cycle: "), closed))


def hyperedges_section(hyperedges: DataFrame) -> DataFrame:
    """``id, label, nodes, confidence``; without a label the id stands, without confidence INFERRED."""
    named = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), b)
    return _lines(hyperedges, "hyperedges", F.col("id"), F.concat(named("label", F.col("id")), F.lit(": "), F.array_join("nodes", ", "), F.lit(" ["), named("confidence", F.lit("INFERRED")), F.lit("]")))


def communities_section(real: DataFrame, cohesion: DataFrame, names: DataFrame, least: int = LEAST_MEMBERS, shown: int = SHOWN) -> DataFrame:
    """Each community of enough real members: name, cohesion and its first labels by id."""
    w = Window.partitionBy("community").orderBy("id")
    size = real.groupBy("community").agg(F.count("*").alias("members")).filter(F.col("members") >= least)
    first = real.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= shown).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("x"))
    rows = size.join(first, "community").join(cohesion.select("community", "cohesion"), "community").join(names, "community")
    more = F.when(F.col("members") > shown, F.concat(F.lit(" (+"), (F.col("members") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    labels = F.array_join(F.transform("x", lambda r: r["label"]), ", ")
    return _lines(rows, "communities", F.format_string("%09d", "community"), F.concat(F.lit("Community "), _text("community"), F.lit(' "'), "name", F.lit('", cohesion '), F.format_number("cohesion", 2), F.lit(", "), _text("members"), F.lit(" nodes: "), labels, more))


def ambiguous_section(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("id", "label")
    e = edges.filter("confidence = 'AMBIGUOUS'").join(n.toDF("source", "sl"), "source").join(n.toDF("target", "tl"), "target")
    relation = F.coalesce(F.when(F.col("relation") != "", F.col("relation")), F.lit("unknown"))
    return _lines(e, "ambiguous", F.concat_ws("|", "source", "target", "relation"), F.concat(F.lit("`"), "sl", F.lit("` -> `"), "tl", F.lit("` "), relation))


def gaps_section(nodes: DataFrame, edges: DataFrame, membership: DataFrame, real: DataFrame) -> DataFrame:
    """Isolated symbols (one edge at most), thin communities, and a high share of ambiguous edges."""
    n = node_degrees(nodes, edges).filter("degree <= 1")
    symbol = ~F.coalesce(is_file_node(F.col("label"), F.col("source_file"), F.col("degree")), F.lit(False)) & ~is_concept_node(F.col("source_file")) & (F.col("file_type") != "rationale")
    n = n.withColumn("symbol", symbol)
    total = n.agg(F.count("*").alias("raw"), F.count_if("symbol").alias("k"))
    first = n.filter("symbol").orderBy("id").limit(NAMED).agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("x"))
    alone = total.crossJoin(first).filter("k > 0")
    listed = F.array_join(F.transform("x", lambda r: F.concat(F.lit("`"), r["label"], F.lit("`"))), ", ")
    more = F.when(F.col("k") > NAMED, F.concat(F.lit(" (+"), (F.col("k") - NAMED).cast("string"), F.lit(" more)"))).otherwise("")
    a = _lines(alone, "gaps", F.lit("0"), F.concat(_text("k"), F.lit(" isolated nodes: "), listed, more, F.lit("; "), _text("raw"), F.lit(" with files, concepts and rationales")))
    thin = thin_communities(real, membership).agg(F.count_if("thin").alias("t")).filter("t > 0")
    b = _lines(thin, "gaps", F.lit("1"), F.concat(_text("t"), F.lit(" thin communities")))
    doubt = edges.agg(F.bround(F.count_if(F.col("confidence") == "AMBIGUOUS") * 100.0 / F.greatest(F.count("*"), F.lit(1)), 0).cast("int").alias("p")).filter(F.col("p") > DOUBTFUL_PERCENT)
    return a.unionByName(b).unionByName(_lines(doubt, "gaps", F.lit("2"), F.concat(_text("p"), F.lit("% of edges are AMBIGUOUS"))))


def questions_section(questions: DataFrame) -> DataFrame:
    """``section, subject, detail`` of the analysis as sentences."""
    kind = F.col("section")
    line = (
        F.when(kind == 1, F.concat(F.lit("What relates `"), "subject", F.lit("` and `"), "detail", F.lit("`?")))
        .when(kind == 2, F.concat(F.lit("Why does `"), "subject", F.lit("` join parts of the graph?")))
        .when(kind == 3, F.concat(F.lit("Are the "), "detail", F.lit(" inferred relations of `"), "subject", F.lit("` right?")))
        .when(kind == 4, F.concat(F.lit("What joins `"), "subject", F.lit("` and the other isolated nodes ("), "detail", F.lit(" in all) to the rest?")))
        .otherwise(F.concat(F.lit("Should community "), "subject", F.lit(" of "), "detail", F.lit(" be split?")))
    )
    return _lines(questions, "questions", F.concat_ws("|", kind.cast("string"), "subject", "detail"), line)


def report(nodes: DataFrame, edges: DataFrame, membership: DataFrame, files: DataFrame, hyperedges: DataFrame | None = None, commit: str | None = None) -> DataFrame:
    """All sections of a graph's report; ``files`` are path, words."""
    from graphlake.operators import analyze, cluster
    from graphlake.plans.storage import cut

    real = cut(real_members(nodes, edges, membership))
    names, tight = cut(cluster.label_by_hub(nodes, edges, membership)), cut(cluster.cohesion(membership, edges))
    paths = nodes.filter("source_file <> ''").select("id", "source_file")
    links = edges.filter(F.col("relation").isin("imports", "imports_from", "re_exports"))
    links = links.join(paths.toDF("source", "s"), "source").join(paths.toDF("target", "t"), "target").filter("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct()
    parts = [
        corpus_section(files), summary_section(nodes, edges, membership, real), freshness_section(nodes.sparkSession, commit), hubs_section(names, real), gods_section(analyze.god_nodes(nodes, edges)),
        surprises_section(nodes, analyze.surprises(nodes, edges)), cycles_section(analyze.import_cycles(links)), communities_section(real, tight, names), ambiguous_section(nodes, edges), gaps_section(nodes, edges, membership, real),
        questions_section(analyze.questions(nodes, edges, analyze.node_betweenness(nodes, edges), tight)),
    ]
    if hyperedges is not None:
        parts.append(hyperedges_section(hyperedges))
    return reduce(DataFrame.unionByName, parts)
