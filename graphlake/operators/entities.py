"""Entity resolution for nodes that are not code: exact label forms, then fuzzy candidates, components, rewiring."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.fixed import ANCHORED_TYPES, STOPWORDS, VARIANT_ENDING
from graphlake.functions.similarity import jaro, jaro_many, jaro_winkler, lsh_pairs, minhash_signature, osa_distance
from graphlake.functions.text import entropy, entropy_in_place, norm_label_ascii
from graphlake.operators.cluster import connected_components
from graphlake.plans.storage import cut

THRESHOLD, ENTROPY = 92.0, 2.5
_VARIANT = re.compile(VARIANT_ENDING)


def _labels(nodes: DataFrame) -> DataFrame:
    return nodes.filter("file_type <> 'code'").withColumn("norm", norm_label_ascii(F.col("label"))).filter("norm <> ''")


def entropy_labels(nodes: DataFrame) -> DataFrame:
    """Non-code nodes with label form and entropy of the form."""
    return _labels(nodes).withColumn("entropy", entropy(F.col("norm")))


def exact_norm_merge(nodes: DataFrame) -> DataFrame:
    """``id, winner`` for nodes of equal label form: within a file always, across files only informative concepts.

    The winner has no ``_cN`` ending, a file, a place, then the shorter id and the first place. Rows are summed up by
    form, file and kind before the entropy of a form is taken.
    """
    rank = F.struct(
        F.col("id").rlike(r"_c\d+$").cast("int").alias("r0"), F.coalesce("source_file", F.lit("")).eqNullSafe("").cast("int").alias("r1"), F.col("source_location").isNull().cast("int").alias("r2"),
        F.length("id").alias("r3"), F.col("ord").alias("r4"), F.col("id").alias("r5"),
    )
    by = ["norm", "file", "concept"]
    keyed = _labels(nodes).select("id", "norm", F.coalesce("source_file", F.lit("")).alias("file"), (F.col("file_type") == "concept").alias("concept"), rank.alias("rank"))
    groups = keyed.groupBy(*by).agg(F.min("rank").alias("rank"), F.count("*").alias("k"))
    scope = F.when(F.col("concept") & (entropy_in_place(F.col("norm")) >= ENTROPY), F.lit("")).otherwise(F.col("file"))
    groups = cut(groups.withColumn("scope", scope))
    best = groups.groupBy("norm", "scope").agg(F.min("rank").alias("best"), F.sum("k").alias("all")).filter("all > 1")
    won = groups.join(best, ["norm", "scope"]).select(*by, F.col("best.r5").alias("winner"))
    return keyed.select("id", *by).join(won, by).filter("id <> winner").select("id", "winner")


def fuzzy_candidates(nodes: DataFrame) -> DataFrame:
    """The first node of each label form with enough entropy, with its MinHash signature."""
    first = _labels(nodes).groupBy("norm").agg(F.min_by(F.struct("id", "file_type", "source_file"), F.struct("ord", "id")).alias("n"))
    first = first.withColumn("entropy", entropy_in_place(F.col("norm"))).filter(F.col("entropy") >= ENTROPY)
    return first.select("n.*", "norm").withColumn("signature", minhash_signature("norm"))


def _numbers(s: str) -> list[str]:
    return sorted(t.lstrip("0") or "0" for t in re.findall(r"\d+", s))


def _same_word(x: str, y: str) -> bool:
    if len(x) == len(y) and osa_distance(x, y) <= 1:
        return True
    return min(len(x), len(y)) >= 6 and jaro_winkler(x, y) * 100 >= THRESHOLD


def should_merge(a: str, b: str, cross_file: bool) -> bool:
    """Whether two label forms name one entity."""
    if not a or not b or a == b and cross_file:
        return False
    longest = max(len(a), len(b))
    score = 100 * (jaro(a, b) if cross_file and longest >= 12 else jaro_winkler(a, b))
    if score < THRESHOLD:
        return False
    if longest < 12:
        va, vb = _VARIANT.match(a), _VARIANT.match(b)
        if a != b and va and vb and va[1] == vb[1] and va[2] != vb[2]:
            return False
        if not (score >= 97 and len(a) == len(b) and osa_distance(a, b) <= 1):
            return False
    short, long = sorted((a, b), key=len)
    if long.startswith(short) and long != short:
        return False
    if a != b and _numbers(a) != _numbers(b):
        return False
    ta, tb = a.split(), b.split()
    return len(ta) != len(tb) or all(x == y or x in STOPWORDS or y in STOPWORDS or _same_word(x, y) for x, y in zip(ta, tb, strict=True))


@F.pandas_udf(T.BooleanType())
def merges(a: pd.Series, b: pd.Series, cross_file: pd.Series) -> pd.Series:
    """:func:`should_merge` of many pairs: scores are taken in columns, the rest is asked only of pairs that reach the threshold."""
    plain = (cross_file & (np.maximum(a.str.len(), b.str.len()) >= 12)).to_numpy(bool)
    score = np.zeros(len(a))
    for mask, winkler in ((plain, False), (~plain, True)):
        score[mask] = jaro_many(a[mask].tolist(), b[mask].tolist(), winkler)
    out = np.zeros(len(a), bool)
    for k in np.flatnonzero(100 * score >= THRESHOLD).tolist():
        out[k] = should_merge(a.iloc[k], b.iloc[k], bool(cross_file.iloc[k]))
    return pd.Series(out)


def _same_numbers(norm: Column) -> Column:
    """Equal texts where :func:`_numbers` of two label forms are equal."""
    plain = F.transform(F.regexp_extract_all(norm, F.lit("([0-9]+)"), F.lit(1)), lambda t: F.regexp_replace(t, "^0+(?=.)", ""))
    return F.array_join(F.array_sort(plain), " ")


def fuzzy_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b`` of entities whose label forms are the same but for small spelling differences.

    Candidates share a MinHash band and their numbers, as forms of other numbers never merge. Length bounds and file
    anchors are checked before the similarity, as cheap columns.
    """
    n = cut(fuzzy_candidates(nodes).withColumn("numbers", _same_numbers(F.col("norm"))))
    pairs = lsh_pairs(n, "id", "signature", "numbers")
    side = n.select("id", "norm", "file_type", F.coalesce("source_file", F.lit("")).alias("file"))
    a, b = side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns]), side.select(*[F.col(c).alias(f"b_{c}") for c in side.columns])
    p = pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id")).withColumn("cross", F.col("a_file") != F.col("b_file"))
    short, long = F.least(F.length("a_norm"), F.length("b_norm")), F.greatest(F.length("a_norm"), F.length("b_norm"))
    bound = (short / long + 2) / 3
    p = p.filter((bound + 0.4 * (1 - bound) >= THRESHOLD / 100) & ~(F.col("cross") & (F.col("a_file_type").isin(*ANCHORED_TYPES) | F.col("b_file_type").isin(*ANCHORED_TYPES))))
    return p.filter(merges("a_norm", "b_norm", "cross")).select("a", "b")


def merge_map(nodes: DataFrame) -> DataFrame:
    """``id, winner`` over exact and fuzzy merges: components of both, won by the best-ranked member.

    Exact merges are stars around their winners, so components are sought only between stars: over fuzzy pairs, and
    over ids that stand in several stars.
    """
    # Many nodes may come from one small file, which is one task: they are dealt over all cores first.
    nodes = cut(nodes.repartition("id"))
    exact = cut(exact_norm_merge(nodes))
    head = exact.withColumnRenamed("winner", "head")
    several = not exact.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    if several:
        head = cut(exact.groupBy("id").agg(F.min("winner").alias("head")))
    links = fuzzy_pairs(nodes)
    for end in ("a", "b"):
        links = links.join(head.withColumnsRenamed({"id": end, "head": f"{end}_head"}), end, "left")
    links = links.select(F.coalesce("a_head", "a").alias("source"), F.coalesce("b_head", "b").alias("target"))
    if several:
        links = links.unionByName(exact.join(head, "id").filter("winner <> head").select(F.col("head").alias("source"), F.col("winner").alias("target")))
    links = links.unionByName(exact.select(F.col("winner").alias("id")).distinct().join(head, "id").select(F.col("id").alias("source"), F.col("head").alias("target")))
    comp = connected_components(links).withColumnRenamed("id", "star")
    rank = F.struct(F.col("id").rlike(r"_c\d+$").cast("int"), F.length("id"), F.col("ord"), F.col("id"))
    members = nodes.select("id", "ord").join(head, "id", "left").withColumn("star", F.coalesce("head", "id")).join(comp, "star", "left")
    members = members.select("id", "ord", F.coalesce("component", "star").alias("component"))
    best = members.groupBy("component").agg(F.min_by("id", rank).alias("winner"))
    return members.join(best, "component").filter("id <> winner").select("id", "winner")


def rewire(nodes: DataFrame, edges: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop merged nodes, move edge ends to the winners and drop loops that this makes."""
    m = merged.select(F.col("id").alias("source"), F.col("winner").alias("sw"))
    t = merged.select(F.col("id").alias("target"), F.col("winner").alias("tw"))
    e = edges.join(m, "source", "left").join(t, "target", "left")
    moved = F.col("sw").isNotNull() | F.col("tw").isNotNull()
    e = e.withColumns({"s2": F.coalesce("sw", "source"), "t2": F.coalesce("tw", "target")}).filter(~(moved & (F.col("s2") == F.col("t2"))))
    e = e.select(F.col("s2").alias("source"), F.col("t2").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])
    return nodes.join(merged.select("id"), "id", "left_anti").select(nodes.columns), e
