"""Token-id files: blocks of ids under an adaptive context-mixing range coder.

A block holds whole documents (or a part of one very long document) and is coded on its own: its
models start empty and its header carries a checksum of the ids and of the coded bytes, so blocks
can be written, read and repaired in any order. A block is cut into up to ``STRANDS`` equal runs that
are coded side by side and learn from each other.

For each id the contexts of the last two ids and of the last one guess the id that followed them last,
with a level of trust that grows with each right guess. Both levels, and whether the guesses agree,
select the mixed shares of "the order-2 guess", "the order-1 guess" and "neither", which follow what
such guesses came to in the block so far. In the last case the id follows under the order-0 shares of
the ids that no guess named so far; an id that has none follows as plain bits. All shares are
renewed ever more seldom, at steps that grow threefold.

Many strands of many blocks are coded in lockstep as lanes of numpy arrays. Whole-number arithmetic
keeps writers and readers equal on all machines.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._common import Words, discard, released, saved, slim, text_slices

#: Ids after which a block is closed, most ids of a block, its strands, and blocks coded at a time.
TARGET, LIMIT, STRANDS, BLOCKS_AT_ONCE = 12288, 16384, 32, 256
MAGIC = b"GLT2"
_HEAD = struct.Struct("<4sBII")  # magic, bytes of an id, ids, crc32 of the ids; then bytes of each strand
#: Bits of the shares of guesses and of order 0; ids that order 0 may list.
_GUESS, _SLOT = 10, 12
_ONE, _SLOTS = 1 << _GUESS, 1 << _SLOT
_LISTED = 2048
#: The range lies in 2**32 to 2**48; below, 16 bits are shifted out.
_LEAST, _TOP = 1 << 32, 1 << 48
#: Hash bits of the contexts of one and of two ids, and the states of their two levels of trust.
_SH1, _SH2, _STATES = 10, 12, 32
_TABLE = _SLOTS + 1


def _first_shares() -> np.ndarray:
    """Shares of the two guesses before anything is known, by state: order-2 trust, order-1 trust, agreement."""
    s = np.arange(_STATES)
    by2 = np.array([0, 300, 600, 800])[s >> 3]
    by1 = np.array([0, 100, 250, 500])[(s >> 1) & 3] * (1 - (s & 1))
    return np.stack([by2, by1 * (1000 - by2) // 1000, 1000 - by2 - by1 * (1000 - by2) // 1000], 1)


_PRIOR = _first_shares()


def _strands(n: int) -> int:
    """Strands of a block of ``n`` ids: short blocks have fewer."""
    return min(STRANDS, 1 + n // 512)


def _plain(digits: int) -> list[tuple[int, int]]:
    """Bits and shifts in which an id of ``digits`` bytes is written as plain bits."""
    return [(min(16, left), left - min(16, left)) for left in range(8 * digits, 0, -16)]


class Lanes:
    """The strands of some blocks, longest first, and the models they share block by block."""

    def __init__(self, sizes: list[int]):
        self.blocks = len(sizes)
        steps = np.array([-(-n // _strands(n)) for n in sizes], np.int64)
        begin = np.minimum(np.arange(STRANDS)[None, :] * steps[:, None], np.array(sizes, np.int64).reshape(-1, 1))
        length = np.minimum(begin + steps[:, None], np.array(sizes, np.int64).reshape(-1, 1)) - begin
        lanes = np.argsort(-length.ravel(), kind="stable")
        self.n = int((length > 0).sum())
        lanes = lanes[: self.n]
        self.block, self.strand = lanes // STRANDS, lanes % STRANDS
        self.begin, self.length = begin.ravel()[lanes], length.ravel()[lanes]
        self.steps = int(self.length.max(initial=0))
        self.active = np.searchsorted(-self.length, -np.arange(self.steps), "left").tolist()
        self.at1, self.at2 = self.block << _SH1, self.block << _SH2
        self.states, self.row = (self.block * _STATES), self.block * _TABLE
        self.heard1, self.heard2 = np.zeros(self.blocks << _SH1, np.int32), np.zeros(self.blocks << _SH2, np.int32)
        self.last, self.before = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.seen = np.zeros((self.blocks, _STATES, 4), np.int64)
        self.state = np.zeros((self.steps, self.n), np.uint8)
        self.kind = np.full((self.steps, self.n), 3, np.uint8)  # 0 and 1: the guesses; 2: neither; 3: past the strand's end
        self.named, self.counts = np.zeros(0, np.int64), np.zeros((self.blocks, 0), np.int64)
        self._settle_shares()
        # Order 0: for each block and slot the id plus 1 (0: none of those listed), its first slot and its slots.
        self.table = np.zeros((self.blocks, _TABLE), np.int64)
        self.table[:, :_SLOTS] = _SLOTS
        self.table[:, _SLOTS] = _SLOTS

    def _settle_shares(self) -> None:
        hits = self.seen[:, :, :3] + _PRIOR[None] * 3 / 1000
        part = hits / hits.sum(2, keepdims=True)
        f2 = np.clip((part[:, :, 0] * _ONE).astype(np.int64), 1, _ONE - 64)
        f1 = np.clip((part[:, :, 1] * _ONE).astype(np.int64), 1, _ONE - 32 - f2)
        self.share2, self.both = f2.ravel(), (f2 + f1).ravel()

    def chances(self, step: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What orders 2 and 1 heard last in the contexts (id plus 1, times 4, plus trust), the share of the first, and of both."""
        h = self.last[:m] * 0x9E3779B1
        self.k1 = ((h >> (32 - _SH1)) & ((1 << _SH1) - 1)) + self.at1[:m]
        h += self.before[:m]
        h &= 0x7FFFFFFF
        h *= 0x85EBCA6B
        h >>= 32 - _SH2
        h &= (1 << _SH2) - 1
        h += self.at2[:m]
        self.k2 = h
        e1, e2 = self.heard1[self.k1].astype(np.int64), self.heard2[h].astype(np.int64)
        state = (e2 & 3) << 3
        state |= (e1 & 3) << 1
        state |= (e1 ^ e2) < 4
        self.state[step, :m] = state
        state += self.states[:m]
        return e2, e1, self.share2[state], self.both[state]

    def learn(self, m: int, named: np.ndarray, e2: np.ndarray, e1: np.ndarray) -> None:
        """``named`` is the id plus 1."""
        fresh = (named << 2) + 1
        most = fresh + 2
        self.heard1[self.k1] = np.where((e1 ^ most) < 4, np.minimum(e1 + 1, most), fresh)
        self.heard2[self.k2] = np.where((e2 ^ most) < 4, np.minimum(e2 + 1, most), fresh)
        self.before[:m] = self.last[:m]
        self.last[:m] = named

    def renew(self, ids: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Take steps ``lo`` to ``hi`` of ``ids`` (steps x lanes) into the shares; returns order 0 as keys, first slots and slots."""
        kind = self.kind[lo:hi]
        cell = self.state[lo:hi].astype(np.int64)
        cell += self.states
        cell <<= 2
        cell |= kind
        self.seen += np.bincount(cell.ravel(), minlength=self.blocks * _STATES * 4).reshape(self.seen.shape)
        self._settle_shares()
        missed = np.flatnonzero(kind.ravel() == 2)
        new = ids[lo:hi].ravel()[missed].astype(np.int64)
        if not len(new) and not len(self.named):
            return None
        there = np.zeros(1 + max(int(new.max(initial=0)), int(self.named.max(initial=0))), bool)
        there[new] = there[self.named] = True
        named = np.flatnonzero(there)
        rank = np.cumsum(there) - 1
        width = len(named)
        cell = rank[new] + (self.block * width)[missed % self.n]
        counts = np.bincount(cell, minlength=self.blocks * width).reshape(self.blocks, width)
        counts[:, rank[self.named]] += self.counts
        self.named, self.counts = named, counts
        cell = np.flatnonzero(counts)
        total = counts.reshape(-1)[cell]
        block = cell // width
        keep, least = np.ones(len(cell), bool), 1
        while True:
            many = np.bincount(block[keep], minlength=self.blocks) > _LISTED
            if not many.any():
                break
            least += 1
            keep &= ~(many[block] & (total < least))
        mass = np.bincount(block, total, self.blocks)
        stray = np.bincount(block, np.where(keep & (total > 1), 0, np.where(keep, 1, total)), self.blocks)
        cell, block, total = cell[keep], block[keep], total[keep]
        own = np.bincount(block, minlength=self.blocks)
        spare = np.clip((stray * (_SLOTS - own) / np.maximum(mass, 1)).astype(np.int64), 16, _SLOTS // 2)
        held = np.bincount(block, total, self.blocks).astype(np.int64)
        slots = 1 + total * (_SLOTS - own - spare)[block] // np.maximum(held, 1)[block]
        end = np.cumsum(slots)
        used = np.bincount(block, slots, self.blocks).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(used)[:-1]])
        first = end - slots - base[block]
        entry = ((named[cell % width] + 1) << 32) | (first << 16) | slots
        rest = (used << 16) | (_SLOTS - used)
        table = np.repeat(rest[:, None], _TABLE, 1)
        table[:, _SLOTS] = _SLOTS
        where = np.repeat(block * _TABLE + first, slots) + np.arange(int(slots.sum())) - np.repeat(end - slots, slots)
        table.reshape(-1)[where] = np.repeat(entry, slots)
        self.table = table
        return cell, entry, rest


#: The shares are renewed at this step and whenever the steps have grown by this factor.
_FIRST, _GROWTH = 8, 3


def encode_blocks(blocks: list[np.ndarray], digits: int = 2) -> list[bytes]:
    """Coded blocks with their headers, in the order given."""
    out: list[bytes] = []
    for lo in range(0, len(blocks), BLOCKS_AT_ONCE):
        out += _encode([np.asarray(b) for b in blocks[lo : lo + BLOCKS_AT_ONCE]], digits)
    return out


def _encode(blocks: list[np.ndarray], digits: int) -> list[bytes]:
    lanes = Lanes([len(b) for b in blocks])
    n, steps, plain = lanes.n, lanes.steps, _plain(digits)
    ids = np.zeros((n, steps), np.int32)
    for k in range(n):
        ids[k, : lanes.length[k]] = blocks[lanes.block[k]][lanes.begin[k] : lanes.begin[k] + lanes.length[k]]
    ids, most = np.ascontiguousarray(ids.T), int(ids.max(initial=0))
    low, size = np.zeros(n, np.int64), np.full(n, _TOP, np.int64)
    # A word may hold a carry in its bit 16 until all is coded.
    width = steps + 64
    words = np.zeros((n, width), np.uint32)
    flat, used = words.reshape(-1), np.arange(n) * width

    def settle(m: int) -> None:
        at = np.flatnonzero(size[:m] < _LEAST)
        while len(at):
            l, place = low[at], used[at]
            flat[place] = l >> 32
            l &= _LEAST - 1
            l <<= 16
            low[at] = l
            place += 1
            used[at] = place
            r = size[at]
            r <<= 16
            size[at] = r
            at = at[r < _LEAST]

    lo = 0
    while lo < steps:
        order0 = lanes.renew(ids, lo // _GROWTH if lo > _FIRST else 0, lo) if lo else None
        hi = min(steps, _GROWTH * lo if lo else _FIRST)
        # First slots and slots of all ids of these steps at once.
        if order0 is None:
            entry = np.full((hi - lo, n), _SLOTS, np.int64)
        else:
            cell, listed, rest = order0
            dense = np.repeat(rest[:, None], len(lanes.named) + 1, 1)
            dense[cell // len(lanes.named), cell % len(lanes.named)] = listed
            rank = np.full(most + 1, len(lanes.named))
            rank[lanes.named] = np.arange(len(lanes.named))
            entry = dense.reshape(-1)[rank[ids[lo:hi]] + lanes.block * (len(lanes.named) + 1)]
        room = int((used - np.arange(n) * width).max(initial=0)) + 3 * (hi - lo) + 8
        if room > width:
            words = np.concatenate([words, np.zeros((n, room - width), np.uint32)], 1)
            used += np.arange(n) * (room - width)
            flat, width = words.reshape(-1), room
        for step in range(lo, hi):
            m = lanes.active[step]
            x = ids[step, :m].astype(np.int64)
            named = x + 1
            e2, e1, f2, both = lanes.chances(step, m)
            miss2 = (e2 >> 2) != named
            miss = miss2 & ((e1 >> 2) != named)
            kind = lanes.kind[step, :m]
            np.add(miss2.view(np.uint8), miss.view(np.uint8), out=kind)
            r = size[:m] >> _GUESS
            a, b = r * f2, r * both
            low[:m] += np.where(miss, b, a * miss2)
            w = np.where(miss, size[:m] - b, np.where(miss2, b - a, a)) >> _SLOT
            own = np.where(miss, entry[step - lo, :m], _SLOTS)
            low[:m] += w * ((own >> 16) & 0xFFFF)
            size[:m] = w * (own & 0xFFFF)
            bare = np.flatnonzero((own < 1 << 32) & miss)
            settle(m)
            if len(bare):
                for bits, shift in plain:
                    r = size[bare] >> bits
                    low[bare] += r * ((x[bare] >> shift) & ((1 << bits) - 1))
                    size[bare] = r
                    settle(m)
            lanes.learn(m, named, e2, e1)
        lo = hi
    for _ in range(3):
        flat[used] = low >> 32
        low = (low & (_LEAST - 1)) << 16
        used += 1
    used -= np.arange(n) * width
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:, :-1] += carry[:, 1:]
    words = words.astype("<u2")
    bodies: list[list[bytes]] = [[b""] * _strands(len(b)) for b in blocks]
    for k in range(n):
        bodies[lanes.block[k]][lanes.strand[k]] = words[k, : used[k]].tobytes()
    out = []
    for ids_, body in zip(blocks, bodies, strict=True):
        head = _HEAD.pack(MAGIC, digits, len(ids_), zlib.crc32(ids_.astype("<u4").tobytes())) + np.array([len(x) for x in body], "<u4").tobytes()
        whole = head + b"".join(body)
        out.append(whole + struct.pack("<I", zlib.crc32(whole)))
    return out


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """The ids of coded blocks; a block that fails a checksum raises ValueError."""
    out: list[np.ndarray] = []
    for lo in range(0, len(data), BLOCKS_AT_ONCE):
        out += _decode(data[lo : lo + BLOCKS_AT_ONCE])
    return out


def _decode(data: list[bytes]) -> list[np.ndarray]:
    heads, bodies = [], []
    for x in data:
        if len(x) < _HEAD.size + 8 or x[:4] != MAGIC or zlib.crc32(memoryview(x)[:-4]) != struct.unpack("<I", x[-4:])[0]:
            raise ValueError("token block is damaged")
        heads.append(_HEAD.unpack_from(x))
        own = _strands(heads[-1][2])
        bodies.append(np.cumsum([_HEAD.size + 4 * own, *np.frombuffer(x, "<u4", own, _HEAD.size).tolist()]))
    kinds = {h[1] for h in heads}
    if len(kinds) > 1:
        # Blocks of narrow and of wide ids are decoded apart.
        parts = {k: iter(_decode([x for x, h in zip(data, heads, strict=True) if h[1] == k])) for k in kinds}
        return [next(parts[h[1]]) for h in heads]
    if not data:
        return []
    plain = _plain(kinds.pop())
    lanes = Lanes([h[2] for h in heads])
    n, steps = lanes.n, lanes.steps
    ids = np.zeros((steps, n), np.int32)
    longest = max((int(np.diff(b).max()) for b in bodies), default=0) // 2
    words = np.zeros((n, longest + 8), np.int64)
    for k in range(n):
        b, s = lanes.block[k], lanes.strand[k]
        begin, end = int(bodies[b][s]), int(bodies[b][s + 1])
        words[k, : (end - begin) // 2] = np.frombuffer(data[b], "<u2", (end - begin) // 2, begin)
    size = np.full(n, _TOP, np.int64)
    # What the coded number exceeds the bottom of the range by.
    over = (words[:, 0].astype(np.int64) << 32) | (words[:, 1].astype(np.int64) << 16) | words[:, 2]
    flat, used = words.reshape(-1), np.arange(n) * words.shape[1] + 3

    def settle(m: int) -> None:
        at = np.flatnonzero(size[:m] < _LEAST)
        while len(at):
            place = used[at]
            o = over[at]
            o <<= 16
            o |= flat[place]
            over[at] = o
            place += 1
            used[at] = place
            r = size[at]
            r <<= 16
            size[at] = r
            at = at[r < _LEAST]

    lo = 0
    while lo < steps:
        if lo:
            lanes.renew(ids, lo // _GROWTH if lo > _FIRST else 0, lo)
        table = lanes.table.reshape(-1)
        hi = min(steps, _GROWTH * lo if lo else _FIRST)
        for step in range(lo, hi):
            m = lanes.active[step]
            e2, e1, f2, both = lanes.chances(step, m)
            r = size[:m] >> _GUESS
            a, b = r * f2, r * both
            o = over[:m]
            miss2, miss = o >= a, o >= b
            np.add(miss2.view(np.uint8), miss.view(np.uint8), out=lanes.kind[step, :m])
            o -= np.where(miss, b, a * miss2)
            w = np.where(miss, size[:m] - b, np.where(miss2, b - a, a)) >> _SLOT
            # Both are under 2**48 and the quotient under 2**13: its whole part is exact in floating point.
            slot = np.minimum((o / w).astype(np.int64), _SLOTS - 1)
            entry = table[np.where(miss, slot, _SLOTS) + lanes.row[:m]]
            o -= w * ((entry >> 16) & 0xFFFF)
            size[:m] = w * (entry & 0xFFFF)
            named = np.where(miss, entry >> 32, np.where(miss2, e1, e2) >> 2)
            bare = np.flatnonzero(named == 0)
            settle(m)
            if len(bare):
                value = np.zeros(len(bare), np.int64)
                for bits, _ in plain:
                    r = size[bare] >> bits
                    v = np.minimum(over[bare] // r, (1 << bits) - 1)
                    over[bare] -= r * v
                    size[bare] = r
                    value = (value << bits) | v
                    settle(m)
                named[bare] = value + 1
            ids[step, :m] = named - 1
            lanes.learn(m, named, e2, e1)
        lo = hi
    ids = np.ascontiguousarray(ids.T)
    out = [np.zeros(h[2], np.uint32) for h in heads]
    for k in range(n):
        out[lanes.block[k]][lanes.begin[k] : lanes.begin[k] + lanes.length[k]] = ids[k, : lanes.length[k]]
    for got, h in zip(out, heads, strict=True):
        if zlib.crc32(got.astype("<u4").tobytes()) != h[3]:
            raise ValueError("token block does not decode to its checksum")
    return out


# ------------------------------------------------------------------ CRC-32 of joined parts


def _times(op: list[int], v: int) -> int:
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= op[k]
        v >>= 1
        k += 1
    return out


_ZEROS: list[list[int]] = []


def _zeros(k: int) -> list[int]:
    """The effect on a CRC-32 of 2**k zero bytes, as a matrix over bits."""
    if not _ZEROS:
        one = [0xEDB88320, *(1 << i for i in range(31))]
        for _ in range(3):
            one = [_times(one, c) for c in one]
        _ZEROS.append(one)
    while len(_ZEROS) <= k:
        _ZEROS.append([_times(_ZEROS[-1], c) for c in _ZEROS[-1]])
    return _ZEROS[k]


def crc32_join(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings joined, from their own and the second's length."""
    k = 0
    while size:
        if size & 1:
            first = _times(_zeros(k), first)
        size >>= 1
        k += 1
    return first ^ second


# ------------------------------------------------------------------ the tokenizer

#: Bytes of a slice of texts that is cut into pieces at a time, and pieces and bytes of pieces a worker remembers.
PIECE_SLICE, PIECES, PIECE_BYTES = 2 << 20, 1 << 21, 64 << 20
_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = 1, 2, 3, 4, 0


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    return out


def _stored(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``store`` with ``more`` after its ``used`` values, grown where it must."""
    if used + len(more) > len(store):
        store = np.concatenate([store, np.zeros(max(len(store), len(more)), store.dtype)])
    store[used : used + len(more)] = more
    return store


class Tokenizer:
    """Ids of the tokenizers library for whole texts, ``add_special_tokens=False``; added tokens in a text count.

    For plain byte-level BPE files the texts of a slice are cut into the pieces that the library's own
    pre-tokenizer makes, and the library's model encodes every distinct piece once. What counts as
    letter, number or white space is asked of the library, once for each character. Texts that hold an
    added token, and all texts of other files, are encoded by the library as they are.
    """

    _PROBE = "Ab's  c9\n\n d é世界!? \t'll 12.5　x ''re 'T's 'ver   z\x1c a  \n 'd" + "".join(map(chr, range(32, 400))) + " \n"

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_str(data.decode())
        spec = json.loads(data)
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.model = self.library.model
        self.hash = Words(np.ones(256, bool), np.arange(256, dtype=np.uint8))
        self.kinds = np.zeros(0x110000, np.uint8)
        self.forget()
        pre = spec.get("pre_tokenizer") or {}
        plain = (
            (spec["model"].get("type") or "BPE") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
        )
        self.pieces = bool(plain) and self._agrees()
        self.size = self.library.get_vocab_size()

    def _agrees(self) -> bool:
        off, ids = self._by_pieces(self._PROBE.encode(), np.array([0, len(self._PROBE.encode())]))
        return ids.tolist() == self.plain(self._PROBE) and len(off) == 2

    def forget(self) -> None:
        #: A hash table of pieces, and for each numbered piece its bytes and its ids as ranges of two stores.
        self.keys, self.numbers = np.zeros(2 * PIECES, np.uint64), np.zeros(2 * PIECES, np.int32)
        self.bytes, self.flat = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int32)
        self.from_byte, self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _piece(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize("".join([self.letters[b] for b in piece]))]

    def plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kind = self.kinds[points]
        if not kind.all():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[kind == _UNKNOWN]).tolist():
                x = chr(c)
                if len(cut("\t" + x)) == 1:
                    self.kinds[c] = _SPACE
                elif len(cut("a" + x)) == 1:
                    self.kinds[c] = _LETTER
                elif len(cut("1" + x)) == 1:
                    self.kinds[c] = _NUMBER
                else:
                    self.kinds[c] = _OTHER
            kind = self.kinds[points]
        return kind

    def bounds(self, data: bytes, off: np.ndarray) -> np.ndarray:
        """Byte places where the pieces of the texts ``data[off[k]:off[k + 1]]`` begin, and the end of all."""
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(1, np.int64)
        chars = None
        points, edge = raw, off[:-1][off[:-1] < n]
        if int(raw.max()) >= 128:
            points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
            chars = np.flatnonzero((raw & 0xC0) != 0x80)
            edge = np.searchsorted(chars, edge)
            n = len(points)
        kind = self._kinds(points)
        begin = np.zeros(n + 4, bool)
        begin[edge] = True
        begin[n:] = True
        first = begin[:n].copy()
        cut = np.ones(n + 4, bool)
        cut[1:n] = kind[1:] != kind[:-1]
        cut[:n] |= first
        space = kind == _SPACE
        # The last of a run of white space stands apart where more follows, and a blank then joins what follows.
        last = space[:-1] & ~space[1:] & ~first[1:]
        cut[: n - 1][last] = True
        cut[1:n][last & (points[:-1] == 32)] = False
        mark = np.flatnonzero(points == 39)
        mark = mark[cut[mark]]
        if len(mark):
            ahead = np.zeros((len(mark), 2), np.int64)
            for k in (1, 2):
                at = mark + k
                inside = at < n
                inside[inside] = ~first[at[inside]] if k == 1 else ~(first[at[inside]] | first[at[inside] - 1])
                ahead[inside, k - 1] = points[at[inside]]
            one = np.isin(ahead[:, 0], [115, 116, 109, 100])
            two = np.isin((ahead[:, 0] << 8) | ahead[:, 1], [(ord(a) << 8) | ord(b) for a, b in ("re", "ve", "ll")])
            cut[mark[one | two] + 1] = False
            cut[mark[one] + 2] = True
            cut[mark[two] + 2] = False
            cut[mark[two] + 3] = True
        at = np.flatnonzero(cut[:n])
        return np.append(at if chars is None else chars[at], len(raw))

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands in the table, or the empty place where it would."""
        at = (h >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)
        left = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            k = self.keys[at[left]]
            left = left[(k != h[left]) & (k != 0)]
        return at

    def _remember(self, data: bytes, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode pieces of new hashes and enter them."""
        pieces = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        parts = [self._piece(x) for x in pieces]
        first, last = self.count, self.count + len(parts)
        if last >= len(self.start):
            self.start, self.from_byte = (np.concatenate([x, np.zeros(max(len(x), len(parts)), np.int64)]) for x in (self.start, self.from_byte))
        self.from_byte[first + 1 : last + 1] = self.from_byte[first] + np.cumsum(end - begin)
        self.start[first + 1 : last + 1] = self.start[first] + np.cumsum([len(x) for x in parts])
        self.bytes = _stored(self.bytes, int(self.from_byte[first]), np.frombuffer(b"".join(pieces), np.uint8))
        self.flat = _stored(self.flat, int(self.start[first]), np.array([i for x in parts for i in x], np.int32))
        self.count, number = last, np.arange(first, last)
        while len(h):
            # Of those that look for one place the first takes it.
            at = self._places(h)
            taken = np.unique(at, return_index=True)[1]
            self.keys[at[taken]], self.numbers[at[taken]] = h[taken], number[taken]
            left = np.ones(len(h), bool)
            left[taken] = False
            h, number = h[left], number[left]

    def _by_pieces(self, data: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = self.bounds(data, off)
        if len(bounds) < 2:
            return np.zeros(len(off), np.int64), np.zeros(0, np.int32)
        raw, begin, end = np.frombuffer(data, np.uint8), bounds[:-1], bounds[1:]
        h = self.hash.hashes(raw, begin, end) | np.uint64(1)
        at = self._places(h)
        new = np.flatnonzero(self.keys[at] == 0)
        if len(new):
            new = new[np.unique(h[new], return_index=True)[1]]
            if self.count + len(new) > PIECES or len(self.bytes) > PIECE_BYTES:
                self.forget()
                new = np.unique(h, return_index=True)[1]
            if len(new) > PIECES:
                return self._joined([self.plain(data[a:b].decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            self._remember(data, h[new], begin[new], end[new])
            at = self._places(h)
        number = self.numbers[at]
        # Equal hashes are not taken for equal pieces: their bytes are compared.
        width = end - begin
        same = self.from_byte[number + 1] - self.from_byte[number] == width
        if same.all():
            same = self.bytes[np.arange(len(raw)) + np.repeat(self.from_byte[number] - begin, width)] == raw
        if not same.all():
            return self._joined([self.plain(data[a:b].decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        size = self.start[number + 1] - self.start[number]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(int(total[-1])) + np.repeat(self.start[number] - total[:-1], size)]
        return total[np.searchsorted(bounds, off)], ids

    def encode_slice(self, data: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts joined, and where each text's begin in them."""
        if not self.pieces:
            return self._joined([self.plain(data[a:b].decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        if not any(t in data for t in self.added):
            return self._by_pieces(data, off)
        parts = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            text = data[a:b]
            named = any(t in text for t in self.added)
            parts.append(self.plain(text.decode()) if named else self._by_pieces(text, np.array([0, len(text)]))[1])
        return self._joined(parts)

    @staticmethod
    def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        return off, np.concatenate([np.asarray(x, np.int32) for x in parts]) if parts else np.zeros(0, np.int32)

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        return self.encode_slice(data, np.array([0, len(data)]))[1].tolist()


@lru_cache(maxsize=1)
def _tokenizer(data: bytes) -> Tokenizer:
    """Built once for each worker process, which many tasks share."""
    return Tokenizer(data)


# ------------------------------------------------------------------ tables of blocks

_PART = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("whole", pa.bool_())])
BLOCKS = "part int, block long, start long, n int, docs array<struct<doc_id:long,row:long,n:int,whole:boolean>>, data binary"


def write_blocks(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and return the blocks in ascending order of ids, by part and block.

    ``start`` counts the ids before the block in its part. Null texts count as empty; null ids come
    first; rows that repeat an id follow in the order of their texts.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = slim(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        digits = 2 if max(tokenizer.size, end_id + 1) <= 1 << 16 else 3
        part = TaskContext.get().partitionId()
        place = block = row = 0
        blocks: list[np.ndarray] = []
        tables: list[list[dict]] = []
        open_ids: list[np.ndarray] = []
        open_docs: list[dict] = []
        held = 0

        def close() -> None:
            nonlocal open_ids, open_docs, held
            if open_ids:
                blocks.append(np.concatenate(open_ids))
                tables.append(open_docs)
                open_ids, open_docs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal place, block, blocks, tables
            n = np.array([len(b) for b in blocks], np.int64)
            start = place + np.concatenate([[0], np.cumsum(n)[:-1]])
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(block + np.arange(len(n))), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(tables, pa.list_(_PART)), pa.array(encode_blocks(blocks, digits), pa.binary())],
                names=["part", "block", "start", "n", "docs", "data"],
            )
            place += int(n.sum())
            block += len(n)
            blocks, tables = [], []
            return out

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, _, data, off in text_slices(batch, "text", PIECE_SLICE):
                begin, flat = tokenizer.encode_slice(data.tobytes(), off)
                for k in range(len(off) - 1):
                    ids = np.append(flat[begin[k] : begin[k + 1]], np.int32(end_id))
                    if held + len(ids) > LIMIT:
                        close()
                    whole = len(ids) <= LIMIT
                    for lo in range(0, len(ids), LIMIT):
                        piece = ids[lo : lo + LIMIT]
                        open_ids.append(piece)
                        open_docs.append({"doc_id": names[first + k], "row": row, "n": len(piece), "whole": whole})
                        held += len(piece)
                        if held >= TARGET or not whole:
                            close()
                    row += 1
                    if len(blocks) >= BLOCKS_AT_ONCE:
                        yield flush()
        close()
        if blocks:
            yield flush()
        released()

    return rows.mapInArrow(run, BLOCKS)


def read_documents(blocks: DataFrame) -> DataFrame:
    """Decode a table of blocks: ``doc_id, start, n_tokens, ids_crc32`` for each document row."""
    spark = blocks.sparkSession
    # One row for each part: as many as the writing job had tasks.
    sizes = blocks.groupBy("part").agg(F.sum(F.col("n").cast("long")).alias("n")).orderBy("part").collect()
    bases, total = [], 0
    for r in sizes:
        bases.append((r["part"], total))
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []

        def flush() -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("part", "row", "doc_id", "at", "n", "crc", "whole")}
            for r, ids in zip(waiting, decode_blocks([r["data"] for r in waiting]), strict=True):
                raw, place = ids.astype("<u4").tobytes(), 0
                for d in r["docs"]:
                    out["part"].append(r["part"])
                    out["row"].append(d["row"])
                    out["doc_id"].append(d["doc_id"])
                    out["at"].append(r["start"] + place)
                    out["n"].append(d["n"])
                    out["crc"].append(zlib.crc32(raw[4 * place : 4 * (place + d["n"])]))
                    out["whole"].append(d["whole"])
                    place += d["n"]
            waiting.clear()
            kinds = {"part": pa.int32(), "whole": pa.bool_()}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

        for batch in batches:
            for r in batch.to_pylist():
                waiting.append(r)
                if len(waiting) >= BLOCKS_AT_ONCE:
                    yield flush()
        if waiting:
            yield flush()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for pieces in batch.column("pieces").to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = crc32_join(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("part", "doc_id", "at", "n")], pa.array(crcs, pa.int64())], names=["part", "doc_id", "at", "n", "crc"])

    pieces = saved(blocks.select("part", "start", "docs", "data").mapInArrow(run, "part int, row long, doc_id long, at long, n long, crc long, whole boolean"), "pieces")
    whole = pieces.filter("whole").select("part", "doc_id", "at", "n", "crc")
    # A very long document spans blocks: one row for each LIMIT ids of it.
    split = (
        pieces.filter("not whole").groupBy("part", "row")
        .agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))
        .mapInArrow(joined, "part int, doc_id long, at long, n long, crc long")
    )
    base = spark.createDataFrame(bases, "part int, base long")
    out = whole.unionByName(split).join(F.broadcast(base), "part")
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as a table of blocks in the shared folder and read its documents back."""
    return read_documents(saved(write_blocks(docs, vocabulary, end_id), "tokens"))
