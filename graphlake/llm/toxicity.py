"""Toxicity: a lexicon learned from labels, a trie with Levenshtein automata, and context windows.

Terms are words, and stems that toxic texts use with several endings. A term counts by how many
different contexts (neighbour words) it has in toxic texts, so copies of one text teach nothing
new. Its weight is the log ratio of its document rates in toxic and other texts. Unknown
words are walked through a trie of the lexicon by a Levenshtein automaton, which finds terms
within one edit; such a match weighs the less the more clean texts hold forms near its term. Each
match is weighed by its context window: less inside quotation marks or after a word of
reporting, more beside a word that addresses the reader. The weights of a text are summed and
mapped to a score by a logistic fit on the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._common import discard, mixed, plain_words, saved, slim, text_slices
from graphlake.llm.labelled import training_sample

#: Labelled rows of each class that the lexicon and the fit use.
PER_CLASS = 6000
MIN_CONTEXTS, MIN_RATIO, MIN_ENDINGS = 4, 20.0, 3
STEM = range(4, 13)
FUZZY_LENGTH, WINDOW_CHARS = 5, 80
QUOTED, ADDRESSED = 0.4, 1.25
THRESHOLD = 0.5
#: Share of toxic texts for which the point of score 0.5 is chosen.
SHARE = 0.1
#: Share of a term's rate in toxic texts at which they are taken to misspell it.
MISSPELT = 0.1

_QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
_REPORTING = re.compile(r"\b(said|says|quoted?|quoting|wrote|called|the (?:word|term|insult)|sagte|schrieb|zitat|dit|écrit|citation|dijo|escribió|cita)\W*$", re.I)
_ADDRESS = re.compile(r"\b(you|your|you're|u|du|dein|dich|ihr|tu|toi|vous|votre|tú|eres|usted)\b", re.I)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for the letters of two-byte Latin-1; ASCII is folded by the word tables."""
    if len(data) < 2:
        return data
    hit = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    if not len(hit):
        return data
    data = data.copy()
    data[hit] += 0x20
    return data


class Trie:
    """Words in a trie; ``within_one`` intersects it with the automaton of one edit of a word."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within_one(self, word: str) -> str | None:
        """A lexicon word at edit distance of at most 1, the first in trie order; None if there is none.

        A state is (trie node, place in ``word``, edits so far), as in the automaton's position sets.
        """
        best, stack = None, [(self.root, 0, 0)]
        seen = set()
        while stack:
            node, i, edits = stack.pop()
            key = (id(node), i, edits)
            if key in seen:
                continue
            seen.add(key)
            if "" in node and len(word) - i + edits <= 1 and (best is None or node[""] < best):
                best = node[""]
            if i < len(word) and word[i] in node:
                stack.append((node[word[i]], i + 1, edits))
            if edits == 0:
                if i < len(word):
                    stack.append((node, i + 1, 1))
                for c, child in node.items():
                    if c:
                        stack.append((child, i, 1))
                        if i < len(word):
                            stack.append((child, i + 1, 1))
        return best


def _hashed(words, texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    return words.hashes(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:])


class Lexicon:
    """Terms with weights, ready for whole slices of text at once."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], trusted: float = 0.0, clean_near: frozenset[str] = frozenset(), fit: tuple[float, float] = (-3.0, 2.0), misspelt: dict[str, float] | None = None):
        #: ``misspelt`` holds each word's weight when misspelled; without it that is its share ``trusted`` of its own.
        self.misspelt = {w: x * trusted for w, x in words.items()} if misspelt is None else misspelt
        self.words, self.stems, self.clean_near, self.fit = words, stems, clean_near, fit
        self._built = None

    def __getstate__(self):
        return {**self.__dict__, "_built": None}

    def build(self):
        if self._built is None:
            tok = plain_words()
            names = sorted(self.words)
            h = _hashed(tok, names)
            order = np.argsort(h)
            exact = h[order], np.array([self.words[names[i]] for i in order])
            by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for n in sorted({len(s.encode()) for s in self.stems}):
                own = [s for s in self.stems if len(s.encode()) == n]
                hs = _hashed(tok, own)
                o = np.argsort(hs)
                by_length[n] = hs[o], np.array([self.stems[own[i]] for i in o])
            near = [w for w in names if len(w) >= FUZZY_LENGTH]
            heads = np.unique(_hashed(tok, [w.encode()[:2].decode(errors="ignore") for w in near])) if near else np.zeros(0, np.uint64)
            tails = np.unique(_hashed(tok, [w.encode()[-2:].decode(errors="ignore") for w in near])) if near else np.zeros(0, np.uint64)
            self._built = tok, exact, by_length, Trie(near), heads, tails, {len(w) for w in near}, {}
        return self._built

    @staticmethod
    def _lookup(h: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], 0.0)

    def matches(self, data: np.ndarray, off: np.ndarray, fuzzy: bool = True) -> Iterator[tuple[int, int, int, float, str | None]]:
        """``(text, start, end, weight, misspelled term or None)`` of every match; bytes as positions."""
        tok, exact, by_length, trie, heads, tails, sizes, cache = self.build()
        low = lowered(data)
        s, e, first = tok.split(low, off)
        if not len(s):
            return
        hashes = tok.ranges(low)
        h = hashes(s, e)
        weight = self._lookup(h, *exact)
        for n, (keys, values) in by_length.items():
            at = np.flatnonzero(e - s >= n)
            weight[at] = np.maximum(weight[at], self._lookup(hashes(s[at], s[at] + n), keys, values))
        near: dict[int, str] = {}
        if fuzzy and sizes:
            size = e - s
            at = np.flatnonzero((weight == 0) & (size >= min(sizes) - 1) & (size <= max(sizes) + 8))
            ok = np.isin(hashes(s[at], s[at] + 2), heads) & np.isin(hashes(e[at] - 2, e[at]), tails)
            # One edit leaves the first two or the last two letters; with both, the edit lies between. Others are tried too if only one end fits.
            one = np.isin(hashes(s[at], s[at] + 3), self._ends(tok, 3, True)) | np.isin(hashes(e[at] - 3, e[at]), self._ends(tok, 3, False))
            at = at[ok | one]
            uniq, index, inverse = np.unique(h[at], return_index=True, return_inverse=True)
            found = []
            for k, i in enumerate(at[index].tolist()):
                key = int(uniq[k])
                if key not in cache:
                    if len(cache) > 200_000:
                        cache.clear()
                    w = bytes(low[s[i] : e[i]]).decode(errors="ignore").lower()
                    cache[key] = None if w in self.clean_near else trie.within_one(w)
                found.append(cache[key])
            hit = np.array([x is not None for x in found], bool)
            if hit.any():
                for i, k in zip(at.tolist(), inverse.reshape(-1).tolist(), strict=True):
                    if hit[k]:
                        near[i] = found[k]
        for i in sorted({*np.flatnonzero(weight).tolist(), *near}):
            text = int(np.searchsorted(first, i, "right")) - 1
            if i in near:
                yield text, int(s[i]), int(e[i]), self.misspelt[near[i]], near[i]
            else:
                yield text, int(s[i]), int(e[i]), float(weight[i]), None

    def _ends(self, tok, n: int, head: bool) -> np.ndarray:
        key = ("ends", n, head)
        cache = self._built[7]
        if key not in cache:
            raw = [w.encode() for w in self.words if len(w) >= FUZZY_LENGTH]
            parts = [w[:n] if head else w[-n:] for w in raw]
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            cache[key] = np.unique(tok.hashes(np.frombuffer(b"".join(parts), np.uint8), off[:-1], off[1:]))
        return cache[key]

    def strength(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str, str]]]:
        """Summed weights of each text under its context windows, and the misspelled words met."""
        out, near = np.zeros(len(off) - 1), []
        for text, a, b, w, term in self.matches(data, off):
            lo, hi = max(int(off[text]), a - WINDOW_CHARS), min(int(off[text + 1]), b + WINDOW_CHARS)
            out[text] += w * context_factor(bytes(data[lo:a]).decode(errors="ignore"), bytes(data[b:hi]).decode(errors="ignore"))
            if term is not None:
                near.append((text, bytes(lowered(data[a:b])).decode(errors="ignore").lower(), term))
        return out, near

    def score(self, strength: np.ndarray) -> np.ndarray:
        a, b = self.fit
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(strength), -30, 30)))


def context_factor(before: str, after: str) -> float:
    """Less than 1 for quotation or report, more than 1 for address."""
    for opening, closing in _QUOTES.items():
        left = before.count(opening) - (before.count(closing) if opening != closing else 0)
        if (left % 2 == 1 if opening == closing else left > 0) and closing in after:
            return QUOTED
    if _REPORTING.search(before):
        return QUOTED
    return ADDRESSED if _ADDRESS.search(before[-24:]) or _ADDRESS.search(after[:24]) else 1.0


# ------------------------------------------------------------------ learning


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems of toxic texts with bitmaps of their contexts and endings."""
    tok = plain_words()
    for batch in batches:
        for _, _, data, off in text_slices(batch, "text"):
            low = lowered(data)
            s, e, first = tok.split(low, off)
            if not len(s):
                continue
            h = tok.hashes(low, s, e)
            text = np.repeat(np.arange(len(off) - 1), np.diff(first))
            ctx = mixed(np.concatenate([[np.uint64(0)], h[:-1]]) * np.uint64(3) + np.concatenate([h[1:], [np.uint64(0)]])) & np.uint64(63)
            seen: dict[tuple[str, bool], list[int]] = {}
            raw = bytes(low)
            for a, b, c, g, d in zip(s.tolist(), e.tolist(), ctx.tolist(), (h & np.uint64(63)).tolist(), text.tolist(), strict=True):
                w = raw[a:b].decode(errors="ignore").lower()
                for term, stem in [(w, False), *((w[:n], True) for n in STEM if n < len(w))]:
                    x = seen.setdefault((term, stem), [0, 0, 0, -1])
                    x[0] |= 1 << c
                    x[1] |= 1 << g
                    if x[3] != d:
                        x[2] += 1
                        x[3] = d
            signed = lambda v: v - (1 << 64) if v >> 63 else v
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array([signed(v[0]) for v in seen.values()], pa.int64()), pa.array([signed(v[1]) for v in seen.values()], pa.int64()), pa.array([v[2] for v in seen.values()], pa.int64())],
                names=["term", "stem", "contexts", "endings", "docs"],
            )


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge logistic fit of one variable by Newton's method, moved so that 0.5 lies at the best cut."""
    w, m = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    weight = np.where(y > 0, 0.35 / max(1, y.sum()), 0.65 / max(1, (1 - y).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        g = m.T @ (weight * (p - y)) + 1e-2 * w
        hess = (m * (weight * p * (1 - p) + 1e-9)[:, None]).T @ m + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hess, g)
    cut = _cut(x, y) if w[1] > 0 else None
    return (float(w[0]) if cut is None else float(-w[1] * cut)), float(w[1])


def _cut(x: np.ndarray, y: np.ndarray) -> float | None:
    """A third into the widest gap at which the fewest texts are misjudged, were ``SHARE`` of them toxic.

    The gap holds no text of the sample; its upper part is left to texts with one sure term.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    missed = np.cumsum(y) / max(1, y.sum()) * SHARE
    blamed = (1 - np.cumsum(1 - y) / max(1, (1 - y).sum())) * (1 - SHARE)
    gap = np.diff(x)
    if not (gap > 0).any():
        return None
    cost = np.where(gap > 0, (missed + blamed)[:-1], np.inf)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = best[np.argmax(gap[best])]
    return float((2 * x[k] + x[k + 1]) / 3)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Lexicon:
    """Learn the lexicon and the score from at most ``2 * per_class`` labelled texts outside the held-out fold.

    Without toxic labels the lexicon is empty and every score is near 0. The driver receives, for each text of the
    sample, its sum of sure matches and its distinct near ones: bounded by the sample and the words of its texts.
    """
    # The bounded sample is read four times below, the documents once.
    sample = saved(training_sample(slim(docs), labels, label_col, per_class, id_col, text_col), "sample")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    nt, nc = size.get(1, 0), size.get(0, 0)
    if not nt:
        return Lexicon({}, {}, fit=(-5.0, 1.0))
    form = "term string, stem boolean, contexts long, endings long, docs long"
    terms = (
        sample.filter("label = 1").select("text").mapInArrow(_terms_of, form)
        .groupBy("term", "stem").agg(F.bit_count(F.bit_or("contexts")).alias("contexts"), F.bit_count(F.bit_or("endings")).alias("endings"), F.sum("docs").alias("docs"))
        .filter(f"contexts >= {MIN_CONTEXTS} and (not stem or endings >= {MIN_ENDINGS})")
    )
    clean = sample.filter("label = 0").select("text").mapInArrow(_terms_of, form).groupBy("term", "stem").agg(F.sum("docs").alias("n"))
    ratio = (F.col("docs") / (nt + 1)) / ((F.coalesce("n", F.lit(0)) + 0.5) / (nc + 1))
    # Contexts beyond what the clean rate explains; copies of one text have one context.
    surprise = F.least("contexts", "docs") * F.log(F.greatest("ratio", F.lit(1e-9)) * max(1.0, nt / max(1, nc)))
    need = math.log(max(2, terms.count()))
    terms = terms.join(clean, ["term", "stem"], "left").withColumn("ratio", ratio).filter((F.col("ratio") >= MIN_RATIO) & (surprise > need + 5)).collect()
    weights: dict[bool, dict[str, float]] = {False: {}, True: {}}
    for r in sorted(terms, key=lambda r: (r["term"], r["stem"])):
        weights[r["stem"]][r["term"]] = math.log(r["ratio"])
    first = Lexicon(weights[False], weights[True], trusted=1.0)
    trial = docs.sparkSession.sparkContext.broadcast(first)

    def trials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_slices(batch, "text"):
                sure = np.zeros(hi - lo)
                near: list[list[str]] = [[] for _ in range(hi - lo)]
                for text, a, b, w, term in trial.value.matches(data, off):
                    left, right = max(int(off[text]), a - WINDOW_CHARS), min(int(off[text + 1]), b + WINDOW_CHARS)
                    if term is None:
                        sure[text] += w * context_factor(bytes(data[left:a]).decode(errors="ignore"), bytes(data[b:right]).decode(errors="ignore"))
                    else:
                        near[text].append(bytes(lowered(data[a:b])).decode(errors="ignore").lower() + " " + term)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array(sure), pa.array([sorted(set(x)) for x in near], pa.list_(pa.string()))], names=["label", "sure", "near"])

    rows = sample.select("label", "text").mapInArrow(trials, "label int, sure double, near array<string>").toArrow().to_pylist()
    discard(sample)
    rows.sort(key=lambda r: (r["label"], r["sure"], r["near"]))  # the halves below depend on no order of tasks
    texts = [[x.split(" ") for x in r["near"]] for r in rows if not r["label"]]
    clean_near = frozenset(w for near in texts for w, _ in near)
    # A misspelling weighs the log ratio of its rates, as a term does: in toxic texts MISSPELT of the term's own rate is
    # taken for granted; in clean texts the forms near it are counted that the other half of them does not know.
    half = frozenset(w for near in texts[1::2] for w, _ in near)
    odd = Counter(t for near in texts[::2] for t in {t for w, t in near if w not in half})
    rate = {r["term"]: MISSPELT * r["docs"] / (nt + 1) for r in terms if not r["stem"]}
    misspelt = {t: max(0.0, min(x, math.log(rate[t] / ((odd[t] + 0.5) / (len(texts[::2]) + 1))))) for t, x in weights[False].items()}
    y = np.array([r["label"] for r in rows], float)
    x = np.log1p(np.array([r["sure"] for r in rows], float))
    return Lexicon(weights[False], weights[True], clean_near=clean_near, fit=_logistic(x, y), misspelt=misspelt)


def scores(lexicon: Lexicon, batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    out = np.zeros(batch.num_rows)
    for lo, hi, data, off in text_slices(batch, text_col):
        out[lo:hi] = lexicon.score(lexicon.strength(data, off)[0])
    return out
