"""String similarity and MinHash as Arrow-batched functions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERMS, BANDS, ROWS = 128, 14, 9
_PRIME, _MAX = np.uint64((1 << 61) - 1), np.uint64((1 << 32) - 1)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    if j <= 0.7:
        return j
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1 - j)


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no part edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def _pairwise(fn):
    return lambda a, b: pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)])


#: Longest strings that :func:`jaro_many` compares in columns; longer ones are compared one by one.
_COLUMN_CHARS = 64


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points in columns (place, text), zero beyond a text's end."""
    joined = "".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
    return np.ascontiguousarray(np.frombuffer(joined, np.uint32).reshape(len(texts), width).T)


def jaro_many(a: list[str], b: list[str], winkler: bool) -> np.ndarray:
    """:func:`jaro` or :func:`jaro_winkler` of many pairs: the same steps, each for all pairs of two lengths at once."""
    one = jaro_winkler if winkler else jaro
    out = np.zeros(len(a))
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    shape = np.where((la > _COLUMN_CHARS) | (lb > _COLUMN_CHARS) | (la == 0) | (lb == 0), -1, la * (_COLUMN_CHARS + 1) + lb)
    for key in np.unique(shape).tolist():
        rows = np.flatnonzero(shape == key)
        if key < 0 or len(rows) < 16:
            out[rows] = [one(a[k], b[k]) for k in rows.tolist()]
            continue
        n, m = divmod(key, _COLUMN_CHARS + 1)
        x, y = _codes([a[k] for k in rows.tolist()], n), _codes([b[k] for k in rows.tolist()], m)
        reach = max(0, max(n, m) // 2 - 1)
        used, hit = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
        for i in range(n):
            for j in range(max(0, i - reach), min(m, i + reach + 1)):
                now = (y[j] == x[i]) & ~used[j] & ~hit[i]
                used[j] |= now
                hit[i] |= now
        found = hit.sum(0)
        # The k-th used character of either side stands in column k.
        left, right = np.zeros((min(n, m), len(rows)), np.uint32), np.zeros((min(n, m), len(rows)), np.uint32)
        for text, mark, side in ((x, hit, left), (y, used, right)):
            at = np.zeros(len(rows), np.int64)
            for i in range(len(text)):
                pick = np.flatnonzero(mark[i])
                side[at[pick], pick] = text[i, pick]
                at[pick] += 1
        swaps = (left != right).sum(0) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            j = np.where(found > 0, (found / n + found / m + (found - swaps) / found) / 3, 0.0)
        if n == m:
            j[(x == y).all(0)] = 1.0
        if winkler:
            prefix, going = np.zeros(len(rows)), np.ones(len(rows), bool)
            for i in range(min(4, n, m)):
                going &= x[i] == y[i]
                prefix += going
            j = np.where(j <= 0.7, j, j + prefix * 0.1 * (1 - j))
        out[rows] = j
    return out


def _compared(a: pd.Series, b: pd.Series, winkler: bool) -> pd.Series:
    given = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[given] = jaro_many(a[given].tolist(), b[given].tolist(), winkler)
    return pd.Series(out).astype("Float64").where(pd.Series(given), pd.NA)


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(a, b, False)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(a, b, True)


@F.pandas_udf(T.IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(osa_distance)(a, b).astype("Int32")


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.RandomState(1)
    top = int(_PRIME)
    a = np.array([random.randint(1, top, dtype=np.uint64) for _ in range(PERMS)], np.uint64)
    b = np.array([random.randint(0, top, dtype=np.uint64) for _ in range(PERMS)], np.uint64)
    return a, b


def minhash_of(text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128 least values over the text's character 3-shingles, 32 bits each."""
    shingles = {text[i : i + 3] for i in range(max(1, len(text) - 2))}
    h = np.array([int.from_bytes(hashlib.sha1(s.encode()).digest()[:4], "little") for s in shingles], np.uint64)
    with np.errstate(over="ignore"):
        return (((h[:, None] * a + b) % _PRIME) & _MAX).min(0)


#: Characters of texts whose signatures are made in one step, and permutations of a step: they bound its memory.
_STEP_CHARS, _STEP_PERMS = 1 << 20, 16


def minhash_many(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`minhash_of` of many texts: each distinct shingle of them is hashed once."""
    out = np.zeros((len(texts), PERMS), np.uint64)
    keys, rows = [], []
    for k, text in enumerate(texts):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(c) < 3:
            out[k] = minhash_of(text, a, b)
        else:
            keys.append(np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]))
            rows.append(k)
    if not rows:
        return out
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in keys])[:-1]])
    names = ("".join(map(chr, (x >> 42, (x >> 21) & 0x1FFFFF, x & 0x1FFFFF))) for x in known.tolist())
    h = np.array([int.from_bytes(hashlib.sha1(n.encode("utf-8", "surrogatepass")).digest()[:4], "little") for n in names], np.uint64)
    for lo in range(0, PERMS, _STEP_PERMS):
        with np.errstate(over="ignore"):
            values = (((h[:, None] * a[lo : lo + _STEP_PERMS] + b[lo : lo + _STEP_PERMS]) % _PRIME) & _MAX).astype(np.uint32)
        out[rows, lo : lo + _STEP_PERMS] = np.minimum.reduceat(values[at.reshape(-1)], begin, axis=0)
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash_signature(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    a, b = _coefficients()
    for text in parts:
        given = text[text.notna()]
        made: list[np.ndarray] = []
        held, chars = [], 0
        for s in given:
            held.append(s)
            chars += len(s)
            if chars >= _STEP_CHARS:
                made += list(minhash_many(held, a, b).astype(np.int64))
                held, chars = [], 0
        made += list(minhash_many(held, a, b).astype(np.int64))
        yield pd.Series(pd.Series(made, index=given.index, dtype=object).reindex(text.index).where(text.notna(), None), dtype=object)


def _banded(rows: DataFrame, id_col: str, signature_col: str) -> DataFrame:
    """``id, band, key``: one row for each row and band; equal keys are equal rows of the band."""
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.slice(signature_col, k * ROWS + 1, F.lit(ROWS)).alias("rows"))))
    return rows.select(F.col(id_col).alias("id"), bands.alias("x")).select("id", F.col("x.band").alias("band"), F.sha2(F.array_join(F.col("x.rows").cast("array<string>"), ","), 256).alias("key"))


def lsh_classes(rows: DataFrame, id_col: str, signature_col: str) -> DataFrame:
    """``id, band, class_id, size``: for each band the class of rows that agree on it, named by its least id, where it has two or more.

    Two rows are a pair of :func:`lsh_pairs` if and only if they share a band's class, so no pair is lost; there are
    at most as many rows as there are bands for each row, where the pairs are quadratic in the size of a class.
    """
    keyed = _banded(rows, id_col, signature_col)
    classes = keyed.groupBy("band", "key").agg(F.min("id").alias("class_id"), F.count("*").alias("size")).filter("size > 1")
    return keyed.join(classes, ["band", "key"]).select("id", "band", "class_id", "size")


def lsh_pairs(rows: DataFrame, id_col: str, signature_col: str, same_col: str | None = None) -> DataFrame:
    """Pairs ``(a, b)``, a < b, that agree on all rows of at least one band, and on ``same_col`` where it is named."""
    keyed, on = _banded(rows, id_col, signature_col), ["band", "key"]
    if same_col:
        keyed, on = keyed.join(rows.select(F.col(id_col).alias("id"), F.col(same_col).alias("same")), "id"), [*on, "same"]
    left, right = keyed.withColumnRenamed("id", "a"), keyed.withColumnRenamed("id", "b")
    return left.join(right, on).filter("a < b").select("a", "b").distinct()
