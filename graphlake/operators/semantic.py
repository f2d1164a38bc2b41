"""Edges between entities whose embeddings are alike."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.plans.storage import cut

#: Rows of a tile; a group of work is a pair of tiles of one label.
TILE = 1024


def _nearest(rows: pd.DataFrame) -> pd.DataFrame:
    """For each row of a tile pair its most similar row of the other tile: ``id, other, score``; ties go to the least id."""
    rows = rows.sort_values("id", kind="stable")
    x = np.array(rows["vector"].to_list(), np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ids, tile = rows["id"].to_numpy(), rows["tile"].to_numpy()
    first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    out = []
    for own, other in {(first, second), (second, first)}:
        a, b = np.flatnonzero(tile == own), np.flatnonzero(tile == other)
        if not len(a) or not len(b):
            continue
        for lo in range(0, len(a), 256):
            part = a[lo : lo + 256]
            score = np.round(x[part] @ x[b].T, 12)
            score[ids[part][:, None] == ids[b][None]] = -2.0
            best = score.argmax(1)
            out.append(pd.DataFrame({"id": ids[part], "other": ids[b[best]], "score": score[np.arange(len(part)), best]}))
    found = pd.concat(out) if out else pd.DataFrame({"id": ids[:0], "other": ids[:0], "score": np.zeros(0)})
    return found[found["score"] > -2.0]


def semantic_similarity_edges(vectors: DataFrame, least: float = 0.8, tile: int = TILE, nearest: Callable = _nearest) -> DataFrame:
    """``source, target, relation, confidence, score``: each of ``id, label, vector`` and its nearest neighbour of the same label.

    Cosines under ``least`` give no edge; a pair that is nearest from both ends is one edge. Null labels, and null, empty or zero
    vectors have no neighbours. A label is dealt into tiles by hash, so a common one becomes many groups of
    bounded size, which hand on one row for each of theirs.
    """
    v = F.col("vector")
    good = v.isNotNull() & F.col("label").isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    rows = cut(vectors.select("id", "label", v.cast("array<double>").alias("vector")).filter(good))
    tiles = rows.groupBy("label").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    # One row for each label.
    dealt = rows.join(tiles, "label").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    work = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    work = work.select("label", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "id", "vector")
    kind = rows.schema["id"].dataType.simpleString()
    found = work.groupBy("label", "i", "j").applyInPandas(nearest, f"id {kind}, other {kind}, score double")
    # The highest score, then the least id.
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("less"), "other")).alias("b")).filter(-F.col("b.less") >= least)
    pairs = best.groupBy(F.least("id", "b.other").alias("source"), F.greatest("id", "b.other").alias("target")).agg(F.max(-F.col("b.less")).alias("score"))
    return pairs.select("source", "target", F.lit("semantically_similar_to").alias("relation"), F.lit("INFERRED").alias("confidence"), "score")
