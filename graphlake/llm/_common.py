"""Helpers shared by the corpus operators: tables, shared storage, text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled by one vectorised step of a Python worker; bounds its memory.
SLICE_BYTES = 1 << 20
#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of any case has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def slim(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's bound on Arrow batches where it is larger: long texts else make batches of 64 MB."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(key, None) or "").rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def released() -> None:
    """Give freed memory back to the system at the end of a task: workers are reused."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only under a local master where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`saved` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, end_row, bytes, offsets)`` over a string column, each of about ``limit`` bytes.

    A null counts as the empty text. Rows are never cut, so one long text makes a larger slice.
    """
    col = batch.column(column)
    n = len(col)
    if not n:
        return
    col = pc.fill_null(col, "") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Vectorised splitting of UTF-8 bytes into words with 64-bit word hashes.

    ``is_word`` and ``fold`` are 256-entry tables over bytes. The hash of a word is a
    polynomial over random byte values modulo 2**64, finished with a bit mixer.
    """

    _base = 0x9E3779B97F4A7C13  # 3 modulo 8: powers keep their order
    #: Bytes hashed at a time, which bounds the tables and the running sums.
    _span = 1 << 20
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, is_word: np.ndarray, fold: np.ndarray, seed: int = 20240229):
        self.is_word = is_word
        values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.fold = fold
        self.values = values[fold]

    @classmethod
    def _tables(cls) -> None:
        if len(cls._powers) == 1:
            cls._powers, cls._inverse = cls._series(cls._span)

    @classmethod
    def _series(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The powers of the base and of its inverse up to ``n``."""
        out = []
        for x in (cls._base % 2**64, pow(cls._base, -1, 2**64)):
            steps = np.full(n + 1, x, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        return out[0], out[1]

    def ranges(self, data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """The hash of any byte ranges of ``data`` by running sums that are kept; tables for long data live no longer than it."""
        self._tables()
        powers, inverse = (self._powers, self._inverse) if len(data) <= self._span else self._series(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * powers[: len(data)], out=total[1:])
        return lambda a, b: mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Return word starts, word ends and, for each text, the index of its first word (one more at the end)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        w = self.is_word[data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = w[:-1]
        cut = offsets[:-1][offsets[:-1] < n]
        before[cut] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = w[1:]
        after[cut[cut > 0] - 1] = False
        starts = np.flatnonzero(w & ~before)
        ends = np.flatnonzero(w & ~after) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._tables()
        out = np.zeros(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            begin = starts[lo]
            hi = max(int(np.searchsorted(ends, begin + self._span, "right")), lo + 1)
            a, b = starts[lo:hi] - begin, ends[lo:hi] - begin
            if b[-1] > self._span:
                out[lo] = self._long(data[begin : ends[lo]])
            else:
                total = np.zeros(b[-1] + 1, np.uint64)
                np.cumsum(self.values[data[begin : ends[hi - 1]]] * self._powers[: b[-1]], out=total[1:])
                out[lo:hi] = (total[b] - total[a]) * self._inverse[a]
            lo = hi
        return mixed(out + (ends - starts).astype(np.uint64))

    def _long(self, word: np.ndarray) -> int:
        """The sum of one word beyond the tables, part by part."""
        out, factor, step = 0, 1, pow(self._base, self._span, 2**64)
        for k in range(0, len(word), self._span):
            part = word[k : k + self._span]
            out = (out + factor * int((self.values[part] * self._powers[: len(part)]).sum())) % 2**64
            factor = factor * step % 2**64
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_table(excluded: str) -> np.ndarray:
    """True for every byte but those that the character class ``excluded`` (of ASCII ranges) names."""
    import re

    out = np.ones(256, bool)
    for b in range(128):
        if re.match(f"[{excluded}]", chr(b)):
            out[b] = False
    return out


def ascii_lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


#: Words between ASCII white space, A-Z in lower case.
def spaced_words() -> Words:
    return Words(byte_table(r"\x20\x09-\x0D"), ascii_lower())


#: Runs of letters, digits and bytes beyond ASCII, A-Z in lower case.
def plain_words() -> Words:
    return Words(byte_table(r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"), ascii_lower())
