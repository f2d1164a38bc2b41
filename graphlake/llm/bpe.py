"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text longer than ``CHUNK`` characters is read as chunks that overlap, which ``THREADS`` threads
pre-tokenise in parallel, each from its own start. The pattern only looks ahead, so where the
boundaries of a chunk and of the one before it meet at one place of their overlap, they agree from
there on: the chunks are stitched at that place. If an overlap holds no common boundary it is
doubled. The pieces between stitches are then encoded in parallel, and their ids joined.

A run of white space of ``RUN`` characters or more holds no boundary to stitch at. By the pattern it is one
pre-token, but for its last character where more text follows; so it is cut out by this rule and
encoded as one piece, and the texts before and after it are encoded on their own.
Decoding joins the bytes of the ids; characters cut by id borders come out whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._common import released, slim

CHUNK, OVERLAP, RUN, THREADS = 1 << 14, 256, 1 << 12, 2
#: White space as the pattern has it.
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class ByteBpe:
    """Encoder and decoder over a rank file's vocabulary and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, run: int = RUN):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.runs = regex.compile(f"{_WHITE}{{{run},}}")
        self.chunk, self.overlap = chunk, overlap
        self.pieces = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.vocabulary[i] = token

    def bounds(self, text: str, start: int, end: int) -> np.ndarray:
        """Ends of the pre-tokens from ``start``; the last may be cut at ``end``."""
        found = self.pattern.findall(text, start, end, concurrent=True)
        return start + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))

    def stitches(self, text: str) -> list[int]:
        """Places to cut ``text`` that are pre-token boundaries of the whole."""
        n, chunk, width = len(text), self.chunk, self.overlap
        starts = list(range(0, max(n - width, 1), chunk))
        with ThreadPoolExecutor(THREADS) as pool:
            found = list(pool.map(lambda at: self.bounds(text, at, min(n, at + chunk + width)), starts))
        cuts, known = [0], found[0]
        for at, own in zip(starts[1:], found[1:], strict=True):
            stop, width = min(n, at + self.overlap), self.overlap
            while True:
                common = np.intersect1d(known[(known > at) & (known <= stop - 3)], own, assume_unique=True)
                cut = next((x for x in common.tolist() if self._settled(text, x)), 0)
                if cut or stop == n:
                    break
                width *= 2
                stop = min(n, at + width)
                known = self.bounds(text, cuts[-1], stop)
                own = self.bounds(text, at, max(stop, min(n, at + chunk + self.overlap)))
            if cut:
                cuts.append(cut)
                known = own
        return [*cuts, n]

    @staticmethod
    def _settled(text: str, x: int) -> bool:
        """Whether the piece that ends at ``x`` ends there whatever follows: white space looks ahead.

        The separators U+001C to U+001F are white space to one regex library and not to another.
        """
        return not text[x - 1].isspace() and not "\x1c" <= text[x] <= "\x1f"

    def _joined(self, text: str) -> np.ndarray:
        if len(text) <= self.chunk + self.overlap:
            return np.array(self.pieces.encode_ordinary(text), np.uint32)
        cuts = self.stitches(text)
        parts = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate([np.array(x, np.uint32) for x in self.pieces.encode_ordinary_batch(parts, num_threads=THREADS)])

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.chunk:
            # A run of this length is no strain for the library's own pre-tokenizer.
            return self._joined(text)
        out, place = [], 0
        for run in self.runs.finditer(text):
            a, b = run.span()
            b -= b < len(text)
            # The library's entry for one pre-token as it is.
            out += [self._joined(text[place:a]), np.array(self.pieces._encode_single_piece(text[a:b].encode()), np.uint32)]
            place = b
        return np.concatenate([*out, self._joined(text[place:])])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


def _bytes_of(docs: DataFrame, path: str) -> bytes:
    """A vocabulary file: from the driver's disk, or through Spark where the path is remote."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(docs.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])


def _coder(docs: DataFrame, vocabulary: str, pattern: str) -> Callable[[], ByteBpe]:
    shared = slim(docs).sparkSession.sparkContext.broadcast((_bytes_of(docs, vocabulary), pattern))
    return lambda: _built(*shared.value)


@lru_cache(maxsize=1)
def _built(data: bytes, pattern: str) -> ByteBpe:
    """Built once for each worker process, which many tasks share."""
    return ByteBpe(load_ranks(data), pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """Append ``ids_col`` (array<int>) to every row; null texts count as empty. An existing column of that name is replaced.
    Repeated rows are encoded each on its own; texts of any length, long runs of one character included, are encoded whole.

    With ``check_col``, a boolean column also tells whether the ids decode to the text's bytes.
    The vocabulary file has a fixed size, which bounds the broadcast. No shuffle.
    """
    make = _coder(docs, vocabulary, pattern)
    kept = docs.drop(ids_col, check_col) if check_col else docs.drop(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [x.as_py() or "" for x in part.column(text_col)]
                ids = [coder.encode(x) for x in texts]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                more = [pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))]
                if check_col:
                    more.append(pa.array([coder.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*batch.schema.names, ids_col, *([check_col] if check_col else [])])
        released()

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{ids_col}` array<int>"]
    return kept.mapInArrow(run, ", ".join([*schema, f"`{check_col}` boolean"] if check_col else schema))


def decode(rows: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Append ``bytes_col`` (binary), the joined bytes of the ids; null ids give null, an id outside the vocabulary fails."""
    make = _coder(rows, vocabulary, pattern)
    kept = rows.drop(bytes_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            out = [None if x.as_py() is None else coder.decode(np.asarray(x.as_py(), np.int64)) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, bytes_col])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{bytes_col}` binary"]))


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per row.

    Null and empty texts have no ids and the digests of no bytes. Other columns are not read.
    """
    make = _coder(docs, vocabulary, pattern)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column("text"):
                ids = coder.encode(x.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        released()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
