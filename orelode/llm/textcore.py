"""Vectorised text primitives over Arrow string columns.

Everything here works on the UTF-8 bytes of a whole Arrow batch at once: no
Python object is made for a text or a word unless an operator asks for it.
Nulls count as empty texts. Memory is bounded by handling a batch in runs of
documents of about ``RUN_BYTES`` (a longer single document is a run by itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

#: Fixed value: the bytes that part words, U+0020 and U+0009 to U+000D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def utf8_column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the n+1 offsets of the texts in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def runs(offs: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n+1 offsets of the documents' words."""
    word = ~IS_SPACE[buf]
    cut = offs[:-1][offs[:-1] < len(buf)]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[cut] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U))]) for b in (_BASE, _INV)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class SpanHasher:
    """64-bit hashes of byte spans of one buffer; they depend on the spans' bytes alone."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _power_tables(len(buf))
        self.sums = np.empty(len(buf) + 1, _U)
        self.sums[0] = 0
        np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(buf).of(starts, ends)


def text_hash(data: bytes) -> int:
    """The hash that span_hashes gives these bytes."""
    buf = np.frombuffer(data, np.uint8)
    return int(span_hashes(buf, np.array([0]), np.array([len(buf)]))[0])


def segment_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values over [offs[i], offs[i+1]); empty segments give zero."""
    shape = (len(offs) - 1, *values.shape[1:])
    if not len(values):
        return np.zeros(shape, values.dtype)
    out = np.zeros(shape, values.dtype)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offs[:-1][full], axis=0)
    return out


def one_spaced(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space between their words and one after the last, and their offsets."""
    word = ~IS_SPACE[buf]
    keep = word.copy()
    keep[1:] |= word[:-1]
    first = offs[:-1][offs[:-1] < len(buf)]
    keep[first] = word[first]
    glued = first[first > 0]
    glued = glued[word[glued - 1]]  # a text that ends in a word has no space of its own
    sums = np.concatenate([[0], np.cumsum(keep)])
    out = np.where(word, buf, np.uint8(32))[keep]
    at = sums[offs]
    if not len(glued):
        return out, at
    out = np.insert(out, sums[glued], np.uint8(32))
    return out, at + np.searchsorted(glued, offs, side="right")


#: The five constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Spans of more bytes go to the library one by one, as hardly two of them have one length.
_LONG_SPAN = 255


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of byte spans, all spans of one length at once."""
    from xxhash import xxh64_intdigest

    out = np.empty(len(starts), _U)
    length = np.minimum(ends - starts, _LONG_SPAN + 1).astype(np.uint16)
    order = np.argsort(length, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(length, minlength=_LONG_SPAN + 2))])
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at8, at4 = (np.ndarray((len(buf) + 1,), kind, padded.data, strides=(1,)) for kind in ("<u8", "<u4"))
    with np.errstate(over="ignore"):
        for n in np.flatnonzero(np.diff(cuts)):
            which = order[cuts[n] : cuts[n + 1]]
            if n > _LONG_SPAN:
                out[which] = [xxh64_intdigest(buf[a:z].tobytes(), seed) for a, z in zip(starts[which], ends[which])]
            else:
                out[which] = _xxh64_of(starts[which], int(n), seed, padded, at8, at4)
    return out


def _xxh64_of(at: np.ndarray, n: int, seed: int, at1: np.ndarray, at8: np.ndarray, at4: np.ndarray) -> np.ndarray:
    """XXH64 of the spans of n bytes that begin at these places."""
    seed = _U(seed)
    k = 0
    if n >= 32:
        lanes = [np.full(len(at), x) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while k + 32 <= n:
            lanes = [_turn(v + at8[at + (k + 8 * i)] * _P2, 31) * _P1 for i, v in enumerate(lanes)]
            k += 32
        h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for v in lanes:
            h = (h ^ (_turn(v * _P2, 31) * _P1)) * _P1 + _P4
    else:
        h = np.full(len(at), seed + _P5)
    h += _U(n)
    while k + 8 <= n:
        h = _turn(h ^ (_turn(at8[at + k] * _P2, 31) * _P1), 27) * _P1 + _P4
        k += 8
    if k + 4 <= n:
        h = _turn(h ^ (at4[at + k].astype(_U) * _P1), 23) * _P2 + _P3
        k += 4
    while k < n:
        h = _turn(h ^ (at1[at + k].astype(_U) * _P5), 11) * _P1
        k += 1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    return h ^ (h >> _U(32))
