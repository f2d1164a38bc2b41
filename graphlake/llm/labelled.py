"""Bounded samples of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str) -> Column:
    """True for the fifth of the ids that no classifier learns from."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, label)`` of at most ``per_class`` labelled ids of each class outside the held-out fold.

    The ids with the least hashes are taken, so the sample is the same on every run. It is
    broadcast: ``2 * per_class`` rows of (long, int) bound its size.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null").filter(~held_out("id"))
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    some = parts[0].union(parts[1]).groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(some), "id")
