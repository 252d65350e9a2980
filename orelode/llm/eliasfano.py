"""Elias-Fano sequences and an n-gram trie in memory-mapped levels.

A monotone sequence keeps its low bits packed and its high bits in unary; every
64-bit word of the unary part has the number of zeros before it. All look-ups
are vectorised: a value's bucket is found by selecting zeros, then its low bits
by binary search inside the bucket.

The trie has three levels. Level one holds context words; level two, for each
context word, its successors; beside them stand the words before the context
word, and level three holds the successors of each such pair of words, not by
word but by place among the context word's successors. Places are found by
successor search relative to the context; the pointers between levels are
monotone sequences too. Every n-gram and every context carries one byte, a
quantised smoothed probability.
"""

from __future__ import annotations

import io
import tempfile

import numpy as np

_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each word."""
    at = np.zeros(len(word), np.int64)
    word, k = word.copy(), k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & _U((1 << width) - 1)).astype(np.int64)
        go = k >= low
        k -= np.where(go, low, 0)
        word = np.where(go, word >> _U(width), word)
        at += np.where(go, width, 0)
    return at


class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    FIELDS = ("meta", "low", "high", "zeros")

    def __init__(self, meta, low, high, zeros):
        self.meta, self.low, self.high, self.zeros = meta, low, high, zeros
        self.n, self.bits, self.base, self.top = int(meta[0]), int(meta[1]), int(meta[2]), int(meta[3])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, _U)
        n = len(values)
        base = int(values[0]) if n else 0
        v = values - _U(base)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n and top >= n else 0
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits and n:
            part = v & _U((1 << bits) - 1)
            at = np.arange(n, dtype=_U) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, part << shift)
            spill = shift + _U(bits) > _U(64)
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (_U(64) - shift[spill]))
        places = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        size = (top >> bits) + 1 + n
        unary = np.zeros((-(-(size + 1) // 64) + 1) * 64, np.uint8)  # a word of zeros to end with
        unary[places] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])[:-1]
        return cls(np.array([n, bits, base, top], _U), low, high, before.astype(np.uint32 if size < 1 << 32 else np.int64))

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word].astype(np.int64))

    def _select1(self, k: np.ndarray) -> np.ndarray:
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, k, side="right") - 1
        return word * 64 + _select_in_word(np.asarray(self.high[word]), k - ones[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        value = self.low[word] >> shift
        spill = shift + _U(self.bits) > _U(64)
        value[spill] |= self.low[word[spill] + 1] << (_U(64) - shift[spill])
        return value & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, np.int64)
        return ((self._select1(i) - i).astype(_U) << _U(self.bits)) + self._low(i) + _U(self.base)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it doesn't occur."""
        values = np.asarray(values, _U)
        out = np.full(len(values), -1, np.int64)
        ok = np.flatnonzero((values >= _U(self.base)) & (values - _U(self.base) <= _U(self.top))) if self.n else np.zeros(0, np.int64)
        if not len(ok):
            return out
        x = values[ok] - _U(self.base)
        bucket, part = (x >> _U(self.bits)).astype(np.int64), x & _U((1 << self.bits) - 1)
        at = np.zeros(len(ok), np.int64)  # the bucket's ones begin behind the zero that ends the bucket before
        later = bucket > 0
        at[later] = self._select0(bucket[later] - 1) + 1
        word, shift = at >> 6, (at & 63).astype(_U)
        run = self.high[word] >> shift
        cut = shift > 0
        run[cut] |= self.high[word[cut] + 1] << (_U(64) - shift[cut])
        gap = ~run
        ones = np.bitwise_count((gap & (~gap + _U(1))) - _U(1)).astype(np.int64)
        start = at - bucket
        end = start + ones
        long = np.flatnonzero(gap == 0)
        end[long] = self._select0(bucket[long]) - bucket[long]
        stop, live = end.copy(), np.flatnonzero(start < end)
        while len(live):  # least place in the bucket whose low bits aren't smaller
            mid = (start[live] + stop[live]) >> 1
            less = self._low(mid) < part[live]
            start[live] = np.where(less, mid + 1, start[live])
            stop[live] = np.where(less, stop[live], mid)
            live = live[start[live] < stop[live]]
        inside = np.flatnonzero(start < end)
        hit = inside[self._low(start[inside]) == part[inside]]
        out[ok[hit]] = start[hit]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as bytes: 0 for zero, else 1 + 254 steps of the logarithm from 1 down to 2^-31."""
    out = np.zeros(len(p), np.uint8)
    some = p > 0
    out[some] = 1 + np.clip(np.rint(-np.log2(p[some]) * 8), 0, 254).astype(np.uint8)
    return out


DEQUANTISE = np.concatenate([[0.0], 2.0 ** (-np.arange(255) / 8)])


class NgramTrie:
    """Context words, their successors, and successors of pairs; see the module's text."""

    SEQUENCES = ("contexts", "first_successor", "successors", "pairs", "first_place", "places")
    BYTES = ("p2", "p3", "left3")

    def __init__(self, seqs: dict[str, EliasFano], levels: dict[str, np.ndarray]):
        self.seqs, self.levels = seqs, levels

    @classmethod
    def build(cls, ctx, suc_ctx, suc, suc_n, pair_ctx, pair, tri_pair, tri_suc, tri_n) -> NgramTrie:
        """From counted n-grams in order.

        ctx: context keys; suc_ctx, suc, suc_n: successors by context; pair_ctx,
        pair: words before a context; tri_pair, tri_suc, tri_n: the pair and the
        successor (both as numbers in their lists) of every trigram.
        """
        nc, npair = len(ctx), len(pair)
        first = np.searchsorted(suc_ctx, np.arange(nc + 1))
        total2, kinds2 = np.bincount(suc_ctx, suc_n, nc), np.diff(first)
        width = kinds2[pair_ctx] if npair else np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum(width)]).astype(_U)
        place = base[tri_pair] + (tri_suc - first[pair_ctx[tri_pair]]).astype(_U) if len(tri_pair) else np.zeros(0, _U)
        total3, kinds3 = np.bincount(tri_pair, tri_n, npair), np.bincount(tri_pair, minlength=npair)
        seqs = {
            "contexts": ctx,
            "first_successor": first,
            "successors": (suc_ctx.astype(_U) << _U(32)) | suc,
            "pairs": (pair_ctx.astype(_U) << _U(32)) | pair,
            "first_place": base,
            "places": place,
        }
        levels = {
            "p2": quantise(suc_n / np.maximum(total2 + kinds2, 1)[suc_ctx]),
            "p3": quantise(tri_n / np.maximum(total3 + kinds3, 1)[tri_pair]),
            "left3": quantise(kinds3 / np.maximum(total3 + kinds3, 1)),
            "total2": total2.astype(np.int64),
            "kinds2": kinds2.astype(np.int64),
        }
        return cls({k: EliasFano.build(v) for k, v in seqs.items()}, levels)

    def dump(self, file: io.BufferedIOBase) -> list[tuple[str, str, int, int]]:
        """Writes all arrays; returns where each begins."""
        index = []
        arrays = [(f"{k}.{f}", getattr(s, f)) for k, s in self.seqs.items() for f in EliasFano.FIELDS] + list(self.levels.items())
        for name, a in arrays:
            file.write(b"\0" * (-file.tell() % 8))
            index.append((name, a.dtype.str, file.tell(), len(a)))
            file.write(np.ascontiguousarray(a).tobytes())
        return index

    @classmethod
    def mapped(cls, path: str, index: list[tuple[str, str, int, int]]) -> NgramTrie:
        """The trie of a dumped file, its levels mapped into memory."""
        whole = np.memmap(path, np.uint8, "r")
        got = {name: whole[at : at + n * np.dtype(kind).itemsize].view(kind) for name, kind, at, n in index}
        seqs = {k: EliasFano(*[got[f"{k}.{f}"] for f in EliasFano.FIELDS]) for k in cls.SEQUENCES}
        return cls(seqs, {k: v for k, v in got.items() if "." not in k})

    def through_file(self) -> NgramTrie:
        """Itself, from an unlinked scratch file of this task instead of the heap."""
        with tempfile.NamedTemporaryFile(suffix=".trie") as f:
            index = self.dump(f)
            f.flush()
            return NgramTrie.mapped(f.name, index)

    def context(self, keys: np.ndarray) -> np.ndarray:
        return self.seqs["contexts"].find(keys)

    def successor(self, ctx: np.ndarray, words: np.ndarray) -> np.ndarray:
        return self._relative("successors", ctx, words)

    def pair(self, ctx: np.ndarray, words: np.ndarray) -> np.ndarray:
        return self._relative("pairs", ctx, words)

    def _relative(self, name: str, ctx: np.ndarray, words: np.ndarray) -> np.ndarray:
        out, ok = np.full(len(ctx), -1, np.int64), np.flatnonzero(ctx >= 0)
        out[ok] = self.seqs[name].find((ctx[ok].astype(_U) << _U(32)) | words[ok])
        return out

    def starts(self, name: str, at: np.ndarray) -> np.ndarray:
        """Pointers at places, 0 where there is none."""
        out, ok = np.zeros(len(at), np.int64), np.flatnonzero(at >= 0)
        out[ok] = self.seqs[name].get(at[ok])
        return out

    def trigram(self, ctx: np.ndarray, pair: np.ndarray, suc: np.ndarray) -> np.ndarray:
        out, ok = np.full(len(pair), -1, np.int64), np.flatnonzero((pair >= 0) & (suc >= 0))
        place = suc[ok] - self.starts("first_successor", ctx[ok])
        out[ok] = self.seqs["places"].find((self.starts("first_place", pair[ok]) + place).astype(_U))
        return out
