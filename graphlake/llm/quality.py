"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent semantic space.

The terms of a text are the shapes of its words (runs of lower case, upper case, digits and each
mark), pairs of successive shapes, and whether a word repeats the one before it. Term
frequencies under a square root and inverse document frequency are projected on the leading
singular vectors of a bounded labelled sample. Every document is compared with all labelled
vectors by blocked cosine products, and its nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._common import Words, byte_table, mixed, released, slim, text_slices
from graphlake.llm.labelled import held_out, training_sample

#: Labelled rows of each class in the model: the bound of what is broadcast.
PER_CLASS = 1500
TERMS, TOPICS, NEIGHBOURS, SHARPNESS = 1024, 32, 25, 4
THRESHOLD = 0.3


def _shapes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[128:] = ord("a")
    return out


_FOLD = _shapes()


def term_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of the hashed terms of each text: texts x TERMS."""
    exact = Words(byte_table(r"\x20\x09-\x0D"), np.arange(256, dtype=np.uint8))
    s, e, first = exact.split(data, off)
    texts = len(off) - 1
    out = np.zeros((texts, TERMS), np.float32)
    if not len(s):
        return out
    word = exact.hashes(data, s, e)
    shape = _FOLD[data]
    new = np.ones(len(data), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[s] = True
    place = np.concatenate([[0], np.cumsum(new)])
    short = shape[new]
    h = Words(byte_table(r"\x20\x09-\x0D"), np.arange(256, dtype=np.uint8)).hashes(short, place[s], place[e])
    text = np.repeat(np.arange(texts), np.diff(first))
    follows = text[1:] == text[:-1]
    pair = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[follows]
    again = follows & (word[1:] == word[:-1])
    key = np.concatenate([h % np.uint64(TERMS - 1), pair % np.uint64(TERMS - 1)]).astype(np.int64)
    rows = np.concatenate([text, text[1:][follows], text[1:][again]])
    key = np.concatenate([key, np.full(int(again.sum()), TERMS - 1)])
    out += np.bincount(rows * TERMS + key, minlength=texts * TERMS).reshape(texts, TERMS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    return np.sqrt(np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)) * idf


class Model:
    """Projection and labelled latent vectors; ``score`` votes."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        x = _weighted(counts, self.idf)
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.topics = np.ascontiguousarray(vectors[:, ::-1][:, :TOPICS]).astype(np.float32)
        self.known = _unit(x @ self.topics)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(counts), 512):
            v = _unit(_weighted(counts[lo : lo + 512], self.idf) @ self.topics)
            cos = v @ self.known.T
            # Of neighbours tied with the last one all vote.
            last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
            w = np.where(cos >= last[:, None], np.maximum(cos, 0), 0) ** SHARPNESS
            total = w.sum(1)
            vote = np.divide(w @ self.labels, total, out=np.full(len(v), self.prior, np.float32), where=total > 0)
            out[lo : lo + 512] = np.clip(vote, 0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``2 * per_class`` labelled texts outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_slices(batch, "text"):
                c = term_counts(data, off)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array([x.tobytes() for x in c], pa.binary())], names=["id", "label", "counts"])

    sample = training_sample(slim(docs), labels, label_col, per_class, id_col, text_col)
    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"id {kind}, label int, counts binary").toArrow().sort_by("id")
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.float32).reshape(-1, TERMS)
    return Model(counts, rows.column("label").to_numpy())


def _scores(model, batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    out = np.empty(batch.num_rows)
    for lo, hi, data, off in text_slices(batch, text_col):
        for a in range(0, hi - lo, 256):
            b = min(hi - lo, a + 256)
            out[lo + a : lo + b] = model.score(term_counts(data[off[a] : off[b]], off[a : b + 1] - off[a]))
    return out


def classify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, scorer: Callable = _scores) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    A null or wordless text scores the share of label 1 in the sample (0.5 without labels). A null id
    counts as not held out. Rows are judged one by one, repeated ones alike. No shuffle.
    """
    shared = slim(docs).sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scorer(shared.value, batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        released()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_rows(docs: DataFrame, model, wanted: int, text_col: str = "text", threshold: float = THRESHOLD, scorer: Callable = _scores) -> DataFrame:
    """The rows of ``docs`` predicted ``wanted``, with all their columns."""
    shared = slim(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array((scorer(shared.value, batch, text_col) >= threshold) == bool(wanted)))
        released()

    return docs.mapInArrow(run, docs.schema)
