"""Near-duplicate embeddings: int8 tile products with rigorous error bounds.

Equal vectors of one label form a class and are compared once. Each class vector, scaled to length 1, is
quantised once as ``s * q`` with int8 ``q``. The classes of a label are dealt by hash into tiles of
about ``TILE`` rows, and every pair of tiles is one group of work, so a hot label becomes many groups
of bounded size. Groups receive ``q``, ``s``, the length of ``s q`` and the length of the error alone:
the product of two tiles in int8 (exact in float arithmetic) gives each cosine up to
``|s q| |e'| + |e|``, where e is each vector's own quantisation error. A group names the rows that
this bound leaves possible partners, never pairs; only those rows' full vectors are sent to the
group again, where the possible pairs are computed in double precision.

A group returns, for each row, its number of linked vectors, and a spanning forest of its links;
never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._common import discard, saved, slim
from graphlake.llm.components import connected_components

TILE = 1024
#: Room for rounding in the products and the bound.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, lengths of ``s * q`` and lengths of the errors, for rows of length 1."""
    scale = np.abs(x).max(1) / 127
    q = np.clip(np.rint(x / scale[:, None]), -127, 127)
    near = q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((near * near).sum(1)), np.sqrt(((x - near) ** 2).sum(1))


def possible(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks ``(first row of a, i, j)`` of the pairs of quantised rows that may reach ``threshold``."""
    (qa, sa, la, ea), (qb, sb, lb, eb) = a, b
    # Products of int8 rows are whole numbers under 2**24 up to 1040 dimensions, so float32 is exact.
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    qb_t = np.ascontiguousarray(qb.T.astype(kind))
    for lo in range(0, len(qa), 256):
        dot = (qa[lo : lo + 256].astype(kind) @ qb_t).astype(np.float64)
        most = dot * sa[lo : lo + 256, None] * sb[None, :] + la[lo : lo + 256, None] * eb[None, :] + ea[lo : lo + 256, None] * (lb + eb)[None, :]
        i, j = np.nonzero(most >= threshold - SLACK)
        yield lo, lo + i, j


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` whose cosine, in double precision, is at least ``threshold``."""
    unit = [x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (a, b)]
    ii, jj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, i, j in possible(quantised(unit[0]), quantised(unit[1]), threshold):
        for c in range(0, len(i), 50_000):
            own, other = i[c : c + 50_000], j[c : c + 50_000]
            x, y = a[own], b[other]
            good = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= threshold
            ii.append(own[good])
            jj.append(other[good])
    return np.concatenate(ii), np.concatenate(jj)


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            out.append((a, b))
    return out


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class vectors with their quantised form."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            q, rest = [], []
            for v in part.column("vector"):
                x = np.frombuffer(v.as_buffer(), np.float64)[None]
                own, scale, length, error = quantised(x / np.sqrt((x * x).sum()))
                q.append(own.tobytes())
                rest.append((scale[0], length[0], error[0]))
            values = np.array(rest, np.float64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("k1", "k2", "label", "dims", "cls", "vec_id", "copies", "vector")], pa.array(q, pa.binary()), *map(pa.array, values)],
                names=["k1", "k2", "label", "dims", "cls", "vec_id", "copies", "vector", "q", "scale", "length", "error"],
            )


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    tile = rows["tile"].to_numpy()
    return np.flatnonzero(tile == first), np.flatnonzero(tile == second), first == second


def _candidates(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The rows of a tile pair that may have a partner in it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(rows)
        q = np.frombuffer(b"".join(rows["q"]), np.int8).reshape(len(rows), -1)
        own = [q, *(rows[c].to_numpy() for c in ("scale", "length", "error"))]
        found = np.zeros(len(rows), bool)
        if len(a) and len(b):
            for _, i, j in possible(tuple(x[a] for x in own), tuple(x[b] for x in own), threshold):
                apart = a[i] != b[j]
                found[a[i[apart]]] = found[b[j[apart]]] = True
        return rows.loc[found, ["g", "i", "j", "tile", "cls"]]

    return run


def _group(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tile", "cls"], kind="stable")
        ids, copies = rows["cls"].to_numpy(), rows["copies"].to_numpy()
        x = np.frombuffer(b"".join(rows["vector"]), np.float64).reshape(len(rows), -1)
        a, b, same = _sides(rows)
        degree = np.zeros(len(rows), np.int64)
        edges: list[tuple[int, int]] = []
        if len(a) and len(b):
            i, j = tile_links(x[a], x[b], threshold)
            i, j = a[i], b[j]
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(degree, i, copies[j])
            np.add.at(degree, j, copies[i])
            edges = _forest(i, j)
        own = np.flatnonzero(degree)
        ends = ids[np.array(edges, np.int64).reshape(-1, 2)]
        return pd.concat(
            [
                pd.DataFrame({"cls": ids[own], "degree": degree[own]}, dtype="Int64"),
                pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]}, dtype="Int64"),
            ]
        ).reindex(columns=["cls", "degree", "a", "b"]).astype("Int64")

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their doubles; -0.0 counts as 0.0, as in comparisons."""
    for batch in batches:
        vectors = [None if v is None else (np.asarray(v, np.float64) + 0.0).tobytes() for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("dims"), pa.array(vectors, pa.binary())], names=["vec_id", "label", "dims", "vector"])


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    Vectors with equal, non-null labels and equal dimensions are linked when their cosine in double
    precision is at least ``threshold``. Null, empty and zero vectors and those with a null or
    non-finite component link with nothing, as do rows with a null id. Rows that repeat an id
    are separate vectors with their own links; equal rows link with each other. Other columns are not read.
    """
    v = F.col("vector")
    rows = slim(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    whole = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    kind = rows.schema["label"].dataType.simpleString()
    packed = rows.filter(whole).withColumn("dims", F.size(v)).mapInArrow(_packed, f"vec_id long, label {kind}, dims int, vector binary")
    # Two 64-bit hashes name a class: one hash of 128 bits.
    keyed = saved(packed.withColumns({"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64(F.lit(1), "vector", "label")}), "vectors")
    classes = keyed.groupBy("k1", "k2", "label", "dims").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    numbered = saved(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    classes = saved(
        numbered.mapInArrow(_quantise, f"k1 long, k2 long, label {kind}, dims int, cls long, vec_id long, copies long, vector binary, q binary, scale double, length double, error double"),
        "quantised",
    )
    # Labels are few or many, and one may hold a third of the rows: counts are salted for the join.
    salts = 32
    counts = classes.groupBy("label", "dims").agg(F.count("*").alias("n")).withColumn("g", F.monotonically_increasing_id())
    counts = saved(counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "counts")
    light = classes.select("label", "dims", "cls", "q", "scale", "length", "error")
    dealt = light.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(salts)).cast("int")).join(counts, ["label", "dims", "salt"])
    dealt = dealt.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("tile", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("tiles")).cast("int"))
    work = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    work = work.select("g", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "cls", "q", "scale", "length", "error")
    # g numbers the labels and dimensions; the work is dealt by tile pair.
    shape = "g long, i int, j int, tile int, cls long"
    some = saved(work.groupBy("g", "i", "j").applyInPandas(_candidates(threshold), shape), "candidates")
    full = some.join(classes.select("cls", "copies", "vector"), "cls")
    found = saved(full.groupBy("g", "i", "j").applyInPandas(_group(threshold), "cls long, degree long, a long, b long"), "links")
    degrees = found.filter("cls is not null").groupBy("cls").agg(F.sum("degree").alias("degree"))
    comp = connected_components(found.filter("a is not null"))
    joined = classes.select("k1", "k2", "cls", "vec_id", "copies").join(degrees, "cls", "left").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    joined = saved(joined.select("k1", "k2", "vec_id", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "cls").alias("comp")), "joined")
    least = joined.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    out = keyed.select("vec_id", "k1", "k2").join(joined.drop("vec_id").join(least, "comp"), ["k1", "k2"])
    out = out.select("vec_id", F.col("links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.filter(~whole).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for done in (numbered, counts, some, found):
        discard(done)
    return out.unionByName(alone)
