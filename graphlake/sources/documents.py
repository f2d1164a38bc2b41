"""Markdown and comment extraction as line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.fixed import RATIONALE_MARKS


def lines(files: DataFrame) -> DataFrame:
    """``path, line, text`` of files ``path, content``, lines from 1."""
    return files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def outside_fences(rows: DataFrame) -> DataFrame:
    """Lines that lie in no fenced block; the fences themselves go too."""
    w = Window.partitionBy("path").orderBy("line")
    fence = F.col("text").rlike(r"^\s*(```|~~~)")
    return rows.withColumn("fence", fence).withColumn("k", F.sum(F.col("fence").cast("int")).over(w)).filter("not fence and k % 2 = 0").drop("fence", "k")


def headings(files: DataFrame) -> DataFrame:
    """``path, line, level, title, parent_line``: the parent is the last earlier heading of a lower level."""
    h = outside_fences(lines(files)).filter(F.col("text").rlike(r"^#{1,6}\s+\S"))
    h = h.select("path", "line", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("text", r"^#+\s+|\s+#*\s*$", "")).alias("title"))
    w = Window.partitionBy("path").orderBy("line")
    parents = [F.last(F.when(F.col("level") == k, F.col("line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"p{k}") for k in range(1, 6)]
    h = h.select("*", *parents)
    above = F.array_max(F.array(*[F.when(F.col("level") > k, F.col(f"p{k}")) for k in range(1, 6)]))
    return h.select("path", "line", "level", "title", above.alias("parent_line"))


def links(files: DataFrame) -> DataFrame:
    """``path, line, kind, target`` of inline, reference and wiki links outside fences; pure anchors are left out."""
    rows = outside_fences(lines(files))
    found = rows.select(
        "path", "line",
        F.explode(
            F.concat(
                F.transform(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)), lambda t: F.struct(F.lit("inline").alias("kind"), t.alias("target"))),
                F.transform(F.regexp_extract_all("text", F.lit(r"^\s*\[[^\]]+\]:\s*(\S+)"), F.lit(1)), lambda t: F.struct(F.lit("reference").alias("kind"), t.alias("target"))),
                F.transform(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), F.lit(1)), lambda t: F.struct(F.lit("wiki").alias("kind"), t.alias("target"))),
            )
        ).alias("x"),
    )
    return found.select("path", "line", "x.kind", F.trim("x.target").alias("target")).filter("target <> '' and target not like '#%'")


def frontmatter(files: DataFrame, most: int = 200) -> DataFrame:
    """``path, key, value`` of scalar keys between a leading ``---`` and the next one, within ``most`` lines."""
    rows = lines(files).filter(F.col("line") <= most)
    bounds = rows.filter("trim(text) = '---'").groupBy("path").agg(F.min("line").alias("a"), F.min(F.when(F.col("line") > 1, F.col("line"))).alias("b")).filter("a = 1 and b is not null")
    keys = rows.join(bounds, "path").filter("line > a and line < b and text rlike '^[A-Za-z_][A-Za-z0-9_-]*:\\\\s*\\\\S'")
    return keys.select("path", F.regexp_extract("text", r"^([A-Za-z0-9_-]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace("text", r"^[^:]+:", "")), "^[\"']|[\"']$", "").alias("value"))


def rationale(files: DataFrame) -> DataFrame:
    """``path, line, kind, note`` of comments that begin with a marker word; generated files have none."""
    rows = lines(files)
    generated = rows.filter("line <= 5").filter(F.lower("text").rlike("generated|do not edit")).select("path").distinct()
    pattern = rf"^\s*(?:#|//|--|;|\*|/\*)+\s*({'|'.join(RATIONALE_MARKS)})\b[:\s-]*(.*?)\s*(?:\*/)?\s*$"
    hit = rows.filter(F.col("text").rlike(pattern)).join(generated, "path", "left_anti")
    return hit.select("path", "line", F.regexp_extract("text", pattern, 1).alias("kind"), F.regexp_extract("text", pattern, 2).alias("note"))


def citations(files: DataFrame) -> DataFrame:
    """``path, line, document`` of decision records and requests for comments that a line names."""
    found = lines(files).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\b((?:ADR|RFC)[- ]?\d+)\b"), F.lit(1))).alias("document"))
    return found.select("path", "line", F.regexp_replace(F.upper("document"), r"^(ADR|RFC)[- ]?0*", "$1-").alias("document")).distinct()


def resolve_links(found: DataFrame, files: DataFrame) -> DataFrame:
    """Inline and reference links ``path, line, kind, target`` with ``file``, the file ``path`` that they lead to.

    A target is taken from its document's folder, or from the root with a leading slash; ``.`` and ``..`` are followed
    and anchors and query parts left out. Links that lead elsewhere than to a file of ``files`` are dropped.
    """
    bare = F.regexp_replace("target", r"[#?].*$", "")
    local = found.filter("kind <> 'wiki'").filter(~F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")).withColumn("bare", bare).filter("bare <> ''")
    folder = F.when(F.startswith("bare", F.lit("/")), F.lit("")).otherwise(F.regexp_replace("path", r"[^/]*$", ""))
    steps = F.filter(F.split(F.concat(folder, "bare"), "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(steps, F.array().cast("array<string>"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).otherwise(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))))
    known = files.select(F.col("path").alias("file"))
    return local.withColumn("file", F.array_join(up, "/")).join(known, "file", "left_semi").select("path", "line", "kind", "target", "file")
