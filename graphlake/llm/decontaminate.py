"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a slice of a partition's documents. Its suffix array holds the word positions in
the order of the words that follow them; every test suffix (each window of benchmark words)
is binary-searched in it, which gives all places where the window occurs verbatim. Suffixes
are compared to the depth of a window. Positions whose first few words begin no test suffix
cannot lie in an answer and are left out of the array, which keeps it small and loses nothing.
Places found for successive test suffixes of one item at successive words join to longer verbatim
matches; the longest of each document is reported with its places in document and item. Words are
compared by 64-bit hashes of each word, ten words on end for a window.

The benchmark goes to the tasks in blocks of bounded size, one pass for each block; a bitmap
of the words hit so far travels with each document from pass to pass. A block is sent as its word hashes
and the sorted places of its windows, about four times its text. No step shuffles the training text, so
a passage in a third of all documents makes no hot task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._common import mixed, plain_words, released, slim, text_slices

#: Bytes of benchmark text that one pass broadcasts.
BLOCK_BYTES = 4 << 20
#: Leading words that a position must share with some test suffix to enter the suffix array.
LEAD = 3

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _fold(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` words from each position."""
    out = np.full(len(at), length, np.uint64)
    for k in range(length):
        out = mixed(out * _STEP + h[at + k])
    return out


class TestSuffixes:
    """The windows of one block of benchmark items: places in their words, in suffix order, grouped by window length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        words = plain_words()
        texts = [(t or "").encode() for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        s, e, self.first = words.split(data, off)
        self.h = words.hashes(data, s, e)
        n = np.diff(self.first)
        self.names = [str(i) for i, _ in items]
        rank = np.unique(self.h, return_inverse=True)[1].astype(np.int32)
        #: length -> (places of the windows in suffix order, bounds of the places of each distinct window)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({min(window, int(x)) for x in n if x}):
            own = np.flatnonzero((np.minimum(n, window) == length) & (n > 0))
            count = n[own] - length + 1
            end = np.cumsum(count)
            at = np.arange(int(end[-1])) - np.repeat(end - count, count) + np.repeat(self.first[own], count)
            at = at[np.lexsort((at, *(rank[at + k] for k in reversed(range(length)))))]
            new = np.ones(len(at), bool)
            new[1:] = np.any([rank[at[1:] + k] != rank[at[:-1] + k] for k in range(length)], axis=0)
            self.groups[length] = at.astype(np.int32), np.append(np.flatnonzero(new), len(at)).astype(np.int32)
        self._ready: dict[int, tuple] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ready": None}

    def ready(self) -> dict[int, tuple]:
        """length -> (distinct windows as rows of word hashes, all places, bounds, leads, lead length); made once in each worker."""
        if self._ready is None:
            self._ready = {}
            for length, (at, bound) in self.groups.items():
                uniq = self.h[at[bound[:-1]].astype(np.int64)[:, None] + np.arange(length)]
                lead = min(LEAD, length)
                self._ready[length] = uniq, at, bound, np.unique(_fold(uniq.reshape(-1), np.arange(len(uniq)) * length, lead)), lead
        return self._ready

    def items(self, places: np.ndarray) -> np.ndarray:
        """The items that words belong to."""
        return np.searchsorted(self.first, places, "right") - 1


def suffix_order(h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` in the order of the ``length`` words from each, and those words."""
    rows = h[at[:, None] + np.arange(length)]
    order = np.lexsort(rows.T[::-1])
    return at[order], rows[order]


def search(array: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of each row of ``tests`` in the sorted rows ``array``: first and last+1 places."""

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(array), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            x = array[np.minimum(mid, len(array) - 1)]
            differ = x != tests
            col = differ.argmax(1)
            r = np.arange(len(tests))
            less = np.where(differ.any(1), x[r, col] < tests[r, col], after)
            go = (lo < hi) & less
            hi = np.where((lo < hi) & ~less, mid, hi)
            lo = np.where(go, mid + 1, lo)
        return lo

    if not len(array) or not len(tests):
        z = np.zeros(len(tests), np.int64)
        return z, z
    return bound(False), bound(True)


def _member(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(sorted_set & np.uint64(0xFFFFF)).astype(np.int64)] = True
    out = bits[(keys & np.uint64(0xFFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(sorted_set, keys[at]), len(sorted_set) - 1)
    out[at] = sorted_set[place] == keys[at]
    return out


#: The longest verbatim match of a document so far: words, item, place in the item, place in the document.
_NONE = (0, None, None, None)
_BEST = "struct<length:long,item:string,item_start:long,start:long>"


def _longest(places: np.ndarray, window: np.ndarray, tests: TestSuffixes, length: int) -> tuple[int, int, int]:
    """Of a document's hit ``places`` with their windows: words of the longest match, its last window's first word and its place in the tests."""
    _, at, bound, _, _ = tests.ready()[length]
    best, last = (0, 0, 0), -2
    before, run = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p, w in zip(places.tolist(), window.tolist(), strict=True):
        own = np.sort(at[bound[w] : bound[w + 1]])
        now = np.full(len(own), length, np.int64)
        if p == last + 1 and len(before):
            k = np.minimum(np.searchsorted(before, own - 1), len(before) - 1)
            on = (before[k] == own - 1) & (tests.items(own - 1) == tests.items(own))
            now[on] = run[k[on]] + 1
        j = int(now.argmax())
        if now[j] > best[0]:
            best = int(now[j]), p, int(own[j])
        before, run, last = own, now, p
    return best


def _find(h: np.ndarray, first: np.ndarray, tests: TestSuffixes, matches: bool = True) -> tuple[np.ndarray, list[set[int]], list[tuple]]:
    """Which words of a shard are hit, each document's items and, with ``matches``, its longest match."""
    hit = np.zeros(len(h) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(len(first) - 1)]
    best: list[tuple] = [_NONE] * (len(first) - 1)
    n = np.diff(first)
    left = np.repeat(first[1:], n) - np.arange(len(h))  # words up to the end of the document
    leads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length, (uniq, at_test, bound, lead_set, lead) in tests.ready().items():
        if lead not in leads:
            at = np.flatnonzero(left >= lead)
            leads[lead] = at, _fold(h, at, lead)
        at, keys = leads[lead]
        at = at[_member(keys, lead_set)] if len(at) else at
        at = at[left[at] >= length]
        if not len(at):
            continue
        sa, rows = suffix_order(h, at, length)
        lo, hi = search(rows, uniq)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        met = hi[found] - lo[found]
        places = sa[np.arange(int(met.sum())) - np.repeat(np.cumsum(met) - met, met) + np.repeat(lo[found], met)]
        window = np.repeat(found, met)
        np.add.at(hit, places, 1)
        np.add.at(hit, places + length, -1)
        order = np.argsort(places, kind="stable")
        places, window = places[order], window[order]
        doc = np.searchsorted(first, places, "right") - 1
        edge = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            d = int(doc[a])
            for w in np.unique(window[a:b]).tolist():
                items[d].update(tests.items(at_test[bound[w] : bound[w + 1]]).tolist())
            if matches:
                size, p, q = _longest(places[a:b], window[a:b], tests, length)
                if size > best[d][0]:
                    item = int(tests.items(np.array([q]))[0])
                    begin = q + length - size
                    best[d] = size, tests.names[item], begin - int(tests.first[item]), p + length - size - int(first[d])
    return np.cumsum(hit[:-1]) > 0, items, best


def _struct(rows: list[tuple]) -> pa.Array:
    kind = pa.struct([("length", pa.int64()), ("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64())])
    return pa.array([dict(zip(("length", "item", "item_start", "start"), r, strict=True)) for r in rows], kind)


def _pass(tests) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = plain_words()
        ready: TestSuffixes = tests.value
        for batch in batches:
            masks, names, bests = batch.column("mask"), batch.column("items"), batch.column("best")
            for lo, hi, data, off in text_slices(batch, "text"):
                s, e, first = words.split(data, off)
                hit, items, best = _find(words.hashes(data, s, e), first, ready)
                new_masks, new_items, new_best = [], [], []
                for k in range(hi - lo):
                    m = hit[first[k] : first[k + 1]]
                    old = masks[lo + k].as_py()
                    if old:
                        m = m | np.unpackbits(np.frombuffer(old, np.uint8), count=len(m)).astype(bool)
                    new_masks.append(np.packbits(m).tobytes() if m.any() else None)
                    new_items.append((names[lo + k].as_py() or []) + [ready.names[i] for i in items[k]])
                    known = bests[lo + k].as_py()
                    new_best.append(tuple(known.values()) if known and known["length"] >= best[k][0] else best[k])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(new_masks, pa.binary()), pa.array(new_items, pa.list_(pa.string())), _struct(new_best)],
                    names=["doc_id", "text", "mask", "items", "best"],
                )
        released()

    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = plain_words()
    for batch in batches:
        masks, names, bests = batch.column("mask"), batch.column("items"), batch.column("best")
        for lo, hi, data, off in text_slices(batch, "text"):
            s, _, first = words.split(data, off)
            n = np.diff(first)
            n_hit, n_items, digest, spans, best = [], [], [], [], []
            for k in range(hi - lo):
                mask = masks[lo + k].as_py()
                m = np.unpackbits(np.frombuffer(mask, np.uint8), count=int(n[k])) if mask else np.zeros(0, np.uint8)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], m, [0]]).astype(np.int8)))
                own = sorted(set(names[lo + k].as_py() or []))
                n_hit.append(int(m.sum()))
                n_items.append(len(own))
                digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                spans.append([{"start": a, "length": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                best.append(bests[lo + k].as_py() or dict(zip(("length", "item", "item_start", "start"), _NONE, strict=True)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()),
                    pa.array([x["length"] for x in best], pa.int64()), pa.array([x["item"] for x in best], pa.string()), pa.array([x["item_start"] for x in best], pa.int64()), pa.array([x["start"] for x in best], pa.int64()), pa.array(spans, span),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "match_item", "match_item_start", "match_start", "spans"],
            )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + int(total) // block_bytes
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"] or "", r["t"]) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    longest_match, match_item, match_item_start, match_start, spans``. longest_match counts the words of the longest
    verbatim match of a window or more (0 for none), which begins at the given words of item and document; spans
    are the maximal runs of hit words as (start, length) in words.

    A null or wordless document has no words and no hits; a null or wordless item has no windows.
    Items that share an id count once. A null item id is the empty string. Repeated rows are judged
    each on its own. An empty benchmark leaves every document clean.
    """
    state = slim(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns(
        {"mask": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>"), "best": F.lit(None).cast(_BEST)}
    )
    kind = state.schema["doc_id"].dataType.simpleString()
    for block in _blocks(benchmark, item_col, item_text, block_bytes):
        tests = state.sparkSession.sparkContext.broadcast(TestSuffixes(block, window))
        state = state.mapInArrow(_pass(tests), f"doc_id {kind}, text string, mask binary, items array<string>, best {_BEST}")
    return state.mapInArrow(
        _summary,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_item string, match_item_start long, match_start long, spans array<struct<start:long,length:long>>",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark window. No shuffle."""
    window = options.get("window", 10)
    out = slim(docs)
    for block in _blocks(benchmark, options.get("item_col", "item_id"), options.get("item_text", "text"), options.get("block_bytes", BLOCK_BYTES)):
        tests = docs.sparkSession.sparkContext.broadcast(TestSuffixes(block, window))

        def keep(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            words = plain_words()
            for batch in batches:
                good = []
                for lo, hi, data, off in text_slices(batch, text_col):
                    s, e, first = words.split(data, off)
                    hit = _find(words.hashes(data, s, e), first, tests.value, matches=False)[0]
                    total = np.concatenate([[0], np.cumsum(hit)])
                    good += (total[first[1:]] == total[first[:-1]]).tolist()
                if len(good) == batch.num_rows:
                    yield batch.filter(pa.array(good, pa.bool_()))
            released()

        out = out.mapInArrow(keep, docs.schema)
    return out
