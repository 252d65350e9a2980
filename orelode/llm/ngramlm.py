"""N-gram language model scoring over a sharded Elias-Fano trie (operator 6).

A trigram model with Witten-Bell smoothing: a pair of words, then the last word,
then all training tokens stand in for each other, and a token never seen in
training is one further type. Documents are read in parts. A part's words go to
the shards of their hashes, which sum their training counts and number them, so
every word has one exact number, small where it is frequent. Then a part's
distinct trigrams, with their counts in the part's training documents, go to the
shards of their contexts. A shard sums the counts of all parts, builds its trie
in memory-mapped levels, looks all parts' trigrams up in it, and answers in
quantised bytes in the order it was asked. The part then scores its documents.

Nothing is held that grows with the corpus: shards and parts grow in number with
the bytes of text, and context words of more than ``HOT_TOKENS`` training tokens
are dealt over sub-contexts of about so many, their trigrams by the word before
them (so pairs stay whole) and their bigrams by successor. A part that uses such
a word also asks each of its sub-contexts how many successors it has, so their
sum is exact. Which words are hot follows from their counts alone: scores are a
function of the table, exact up to the quantisation of probabilities to an
eighth of a binary order of magnitude.

A part's tokens are kept in a file of the shared folder named by its place and
its content, so a repeated task writes the same file, and equal parts are two;
a part whose answers are incomplete raises. The files are deleted once all
scores are checkpointed.

Cases: null texts are empty: the end token alone. Without training documents
every probability is 1 and scores are 0. Null ids count as the empty text for
the fold. Repeated rows are scored and counted once each, and have equal scores;
ties don't arise. Texts are whole, whatever their length. An empty table gives
no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import crc_mod, cut_lineage, delete_folder, partitions, release_memory, shared_dir, table
from orelode.llm.eliasfano import DEQUANTISE, NgramTrie
from orelode.llm.textcore import LOWER, mix, runs, span_hashes, text_hash, utf8_column, word_spans
from orelode.llm.warc import file_system

PART_TOKENS = 2_400_000
#: Bytes of text for each shard, and the training tokens of a context from which it is dealt over sub-contexts.
SHARD_BYTES = 5_000_000
HOT_TOKENS = 50_000
_U = np.uint64
#: Words hold no space, so these two can't be words.
END, BEGIN = _U(text_hash(b" end")), _U(text_hash(b" begin"))


def pack(arrays: list[np.ndarray], level: int = 1) -> bytes:
    """Unsigned integer or float arrays, each in its least width, compressed."""
    slim = []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a):
            top = int(a.max())
            a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
        slim.append(np.ascontiguousarray(a))
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(slim, protocol=5))


def unpack(blob: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def planes(values: np.ndarray) -> list[np.ndarray]:
    """The bytes of whole numbers apart, lowest first: their number, then so many arrays."""
    n = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 0
    cut = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)
    return [np.array([n], np.uint8), cut.ravel()]


def from_planes(n: np.ndarray, cut: np.ndarray) -> np.ndarray:
    width = int(n[0])
    out = np.zeros((len(cut) // width if width else 0, 8), np.uint8)
    out[:, :width] = cut.reshape(width, -1).T if width else 0
    return out.view("<u8").ravel()


def steps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ascending numbers of each group as differences; the first of a group stays."""
    out = values.astype(_U)
    out[1:] -= values[:-1].astype(_U)
    first = (np.cumsum(counts) - counts)[counts > 0]
    out[first] = values[first]
    return out


def from_steps(out: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(out, dtype=_U)
    some = counts > 0
    first = (np.cumsum(counts) - counts)[some]
    return total - np.repeat(total[first] - out[first], counts[some])


class Part:
    """Tokens of some documents, as numbers in a list of words; first in order of their hashes, then of their ids."""

    def __init__(self, ids: list, train: np.ndarray, lens: np.ndarray, words: np.ndarray, token: np.ndarray):
        self.ids, self.train, self.lens, self.words, self.token = ids, train, lens, words, token

    @classmethod
    def of(cls, ids: list, train: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> Part:
        words, at = np.unique(np.append(hashes, [END, BEGIN]), return_inverse=True)
        return cls(ids, train, lens, words, at[:-2].astype(np.int32))

    def dump(self) -> bytes:
        """Compressed, with words numbered by frequency and the numbers' bytes apart."""
        order = np.argsort(-np.bincount(self.token, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        planes = rank[self.token].astype("<u4").view(np.uint8).reshape(-1, 4).T
        return pack([np.frombuffer(pickle.dumps(self.ids), np.uint8), self.train.astype(np.uint8), self.lens, self.words[order], *planes], level=3)

    @classmethod
    def load(cls, raw: bytes) -> Part:
        ids, train, lens, words, *planes = unpack(raw)
        order = np.argsort(words)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        number = np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()
        return cls(pickle.loads(ids.tobytes()), train.astype(bool), lens.astype(np.int64), words[order].astype(_U), rank[number])

    def number(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Takes each word's id and its count in all training documents; words are in order of ids from here."""
        order = np.argsort(ids)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.begin, self.end = (int(rank[np.searchsorted(self.words, x)]) for x in (BEGIN, END))
        self.words, self.total, self.token = ids[order], counts[order], rank[self.token]

    def counts(self) -> np.ndarray:
        return np.bincount(self.token, np.repeat(self.train, self.lens), len(self.words)).astype(np.int64)

    def trigrams(self, place: np.ndarray, inverse: bool = False):
        """Distinct trigrams (context word, word, word before the context) in order of the contexts' places, and their training counts; with the number of each token's."""
        w = self.token.astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(self.lens)])[:-1]
        p1 = np.concatenate([np.array([self.begin], np.int32), w[:-1]])
        p1[starts] = self.begin
        p2 = np.concatenate([np.array([self.begin], np.int32), p1[:-1]])
        p2[starts] = self.begin
        order, first = ordered(len(self.words).bit_length(), place[p1], w, p2)
        at = np.flatnonzero(first)
        pick = order[at]
        n = np.add.reduceat(np.repeat(self.train, self.lens)[order], at, dtype=np.int64)
        which = None
        if inverse:
            which = np.empty(len(w), np.int32)
            which[order] = np.cumsum(first, dtype=np.int32) - 1
        return p1[pick], w[pick], p2[pick], n, which


def ordered(bits: int, *levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by all levels, and where the sorted rows begin a new value; all levels but the first are under 2^bits."""
    top = int(levels[0].max()).bit_length() if len(levels[0]) else 0
    if top + bits * (len(levels) - 1) <= 64:
        key = levels[0].astype(_U)
        for level in levels[1:]:
            key <<= _U(bits)
            key |= level.astype(_U)
        order = np.argsort(key, kind="stable")
        key = key[order]
        return order, np.append(True, key[1:] != key[:-1])[: len(key)]
    order = np.lexsort(levels[::-1])
    change = np.zeros(max(len(order) - 1, 0), bool)
    for level in levels:
        change |= np.diff(level[order]) != 0
    return order, np.append(True, change)[: len(order)]


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each context."""
    return hash_shard(mix(keys.astype(_U) + _U(1)), shards)


class Hot:
    """The context words that are dealt over sub-contexts, whose keys follow those of all words.

    Each has as many sub-contexts for its trigrams, dealt by the word before, as
    for its bigrams, dealt by successor; these keys come after those.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, above: int, tokens: int):
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(_U), counts[order]
        self.split = np.maximum(2, -(-counts // tokens)).astype(np.int64)
        self.first = above + np.cumsum(2 * self.split) - 2 * self.split

    def index(self, ids: np.ndarray) -> np.ndarray:
        """The place of each word among the hot ones, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1, np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)


class Asked:
    """One sorted block of (context key, word, word before, count) rows, its grouping, and contexts of which only the kinds are asked."""

    def __init__(self, key, word, before, n, bare):
        change = np.append(True, key[1:] != key[:-1])[: len(key)]
        self.ctx = np.cumsum(change) - 1
        self.keys = key[change]
        change2 = change | np.append(True, word[1:] != word[:-1])[: len(key)]
        self.suc = np.cumsum(change2) - 1
        self.words, self.suc_ctx = word[change2], self.ctx[change2]
        order, first = ordered(max(1, int(before.max()).bit_length()) if len(before) else 1, self.ctx, before)
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(first) - 1
        self.befores, self.pair_ctx = before[order][first], self.ctx[order][first]
        self.n, self.bare = n, bare

    def arrays(self) -> list[np.ndarray]:
        nc = len(self.keys)
        first = np.searchsorted(self.pair_ctx, np.arange(nc))
        n_suc, n_pair = np.bincount(self.suc_ctx, minlength=nc), np.bincount(self.pair_ctx, minlength=nc)
        whole = np.array([nc])
        return [
            *planes(steps(self.keys, whole)), n_suc, *planes(steps(self.words, n_suc)), np.bincount(self.suc, minlength=len(self.words)),
            n_pair, *planes(steps(self.befores, n_pair)), self.pair - first[self.ctx], self.n, *planes(steps(self.bare, np.array([len(self.bare)]))),
        ]


def asked_from(arrays: list[np.ndarray]):
    """(keys, suc_ctx, words, tri_suc, pair_ctx, befores, tri_pair, n, bare) of a packed block."""
    k1, k2, n_suc, w1, w2, n_tri, n_pair, b1, b2, rank, n, o1, o2 = arrays
    keys, bare = (from_steps(x, np.array([len(x)])) for x in (from_planes(k1, k2), from_planes(o1, o2)))
    n_suc, n_tri, n_pair = (x.astype(np.int64) for x in (n_suc, n_tri, n_pair))
    words, befores = from_steps(from_planes(w1, w2), n_suc), from_steps(from_planes(b1, b2), n_pair)
    suc_ctx = np.repeat(np.arange(len(keys)), n_suc)
    tri_suc = np.repeat(np.arange(len(words)), n_tri)
    pair_ctx = np.repeat(np.arange(len(keys)), n_pair)
    first = np.concatenate([[0], np.cumsum(n_pair)])
    return keys, suc_ctx, words, tri_suc, pair_ctx, befores, first[suc_ctx[tri_suc]] + rank, n.astype(np.int64), bare


class Blocks:
    """A part's trigrams in the order in which they are asked, by shard: plain contexts, then hot ones."""

    def __init__(self, part: Part, hot: Hot, shards: int, inverse: bool = False):
        ids = part.words
        home = shard_of(ids, shards)
        place = np.empty(len(ids), np.int64)
        place[np.argsort(home, kind="stable")] = np.arange(len(ids))
        p1, w, p2, n, self.which = part.trigrams(place, inverse)
        of_word = hot.index(ids)
        is_hot = of_word[p1] >= 0
        self.p1, self.w = p1, w
        self.plain, self.hot = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
        a, h = self.plain, self.hot
        plain = ids[p1[a]], ids[w[a]], ids[p2[a]], n[a]
        change = np.append(True, (p1[h][1:] != p1[h][:-1]) | (w[h][1:] != w[h][:-1]))[: len(h)]
        self.bigram = np.cumsum(change) - 1  # of each hot trigram
        b = h[change]
        n2 = np.add.reduceat(n[h], np.flatnonzero(change)) if len(h) else np.zeros(0, np.int64)

        # all sub-contexts of the hot words in use, in order of shard and key
        self.used = np.unique(of_word[p1[h]])
        split = hot.split[self.used]
        start = np.cumsum(2 * split) - 2 * split
        keys = (np.repeat(hot.first[self.used] - start, 2 * split) + np.arange(int(2 * split.sum()))).astype(_U)
        spot = np.lexsort((keys, shard_of(keys, shards)))
        turn = np.empty(len(keys), np.int64)
        turn[spot] = np.arange(len(keys))
        local = np.full(len(hot.ids) + 1, -1, np.int64)
        local[self.used] = np.arange(len(self.used))
        self.place_of_word = local[of_word]
        at1, at2 = local[of_word[p1[h]]], local[of_word[p1[b]]]
        slot1 = start[at1] + (mix(ids[p2[h]]) % split[at1].astype(_U)).astype(np.int64)
        slot2 = start[at2] + split[at2] + (mix(ids[w[b]]) % split[at2].astype(_U)).astype(np.int64)
        slot, word = np.concatenate([slot1, slot2]), np.concatenate([w[h], w[b]])
        before = np.concatenate([p2[h], np.zeros(len(b), p2.dtype)])
        order, _ = ordered(len(ids).bit_length(), turn[slot], word, before)
        self.hot_row = np.empty(len(order), np.int64)
        self.hot_row[order] = np.arange(len(order))
        both = plain, (keys[slot[order]], ids[word[order]], ids[before[order]], np.concatenate([n[h], n2])[order])
        by_successor = spot[np.isin(spot, np.concatenate([np.zeros(0, np.int64), *(np.arange(s + k, s + 2 * k) for s, k in zip(start, split))]))]
        self.bare, self.bare_of = keys[by_successor], np.repeat(np.arange(len(self.used)), 2 * split)[by_successor]
        self.cuts = [np.searchsorted(shard_of(x, shards), np.arange(shards + 1)) for x in (both[0][0], both[1][0], self.bare)]
        self.blocks = both

    def shards(self) -> np.ndarray:
        """The shards that are asked anything."""
        return np.flatnonzero(sum(np.diff(c) for c in self.cuts))

    def asked(self, shard: int) -> Asked:
        (a, z), (b, y), (c, x) = ((cut[shard], cut[shard + 1]) for cut in self.cuts)
        plain, hot = self.blocks
        return Asked(*(np.concatenate([p[a:z], q[b:y]]) for p, q in zip(plain, hot)), self.bare[c:x])


def word_slices(part: Part, shards: int) -> np.ndarray:
    return np.searchsorted(hash_shard(part.words, shards), np.arange(shards + 1))


def _read(fs, path: str) -> bytes:
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _write(fs, path: str, raw: bytes) -> None:
    """Whole or not at all: attempts of one task write the same."""
    scratch = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(scratch, compression=None) as f:
        f.write(raw)
    fs.move(scratch, path)


def write_parts(docs: DataFrame, folder: str, shards: int, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Rows (shard, part, blob) of word counts; the parts' tokens go to files of the folder. docs: doc_id, text, train."""

    def flush(held: list, ordinal: int) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        part = Part.of([x for h in held for x in h[0]], *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)))
        raw = part.dump()
        name = f"{TaskContext.get().partitionId()}-{ordinal}-{hashlib.sha1(raw).hexdigest()}"
        _write(fs, f"{root}/{name}", raw)
        cut, counts = word_slices(part, shards), part.counts()
        some = np.flatnonzero(np.diff(cut))
        blobs = [pack([part.words[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]]]) for s in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([name] * len(some)), pa.array(blobs, pa.binary())], names=["shard", "part", "blob"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, ordinal = [], 0, 0
        for b in batches:
            ids, train = b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            buf, offs = utf8_column(b.column(1))
            for i, j in runs(offs):
                text = LOWER[buf[offs[i] : offs[j]]]
                starts, ends, at = word_spans(text, offs[i : j + 1] - offs[i])
                hashes = np.full(len(starts) + j - i, END)
                hashes[np.arange(len(starts)) + np.repeat(np.arange(j - i), np.diff(at))] = span_hashes(text, starts, ends)
                held.append((ids[i:j], train[i:j].astype(bool), np.diff(at) + 1, hashes))
                tokens += len(hashes)
                if tokens >= part_tokens:
                    yield from flush(held, ordinal)
                    held, tokens, ordinal = [], 0, ordinal + 1
        if held:
            yield from flush(held, ordinal)

    return docs.mapInArrow(split, "shard int, part string, blob binary")


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], list[bytes], int]:
    parts, blobs, shard = [], [], -1
    for b in batches:
        parts += b.column("part").to_pylist()
        blobs += b.column("blob").to_pylist()
        shard = b.column("shard")[0].as_py() if b.num_rows else shard
    return parts, blobs, shard


ANSWER = "part string, kind int, shard int, blob binary"


def count_words(hot_tokens: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's exact counts and its numbers of the words, most frequent first, for every part that asked, and a row of totals and hot words."""
        parts, blobs, shard = _gather(batches)
        if not parts:
            return
        got = [unpack(b) for b in blobs]
        size = [len(w) for w, _ in got]
        words, at = np.unique(np.concatenate([w.astype(_U) for w, _ in got]), return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, at, np.concatenate([n.astype(np.int64) for _, n in got]))
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(words))
        ends = np.cumsum(size)
        often = total >= hot_tokens
        marks = {name: (int(rank[i]), int(total[i])) for name, mark in (("begin", BEGIN), ("end", END)) if (i := int(np.searchsorted(words, mark))) < len(words) and words[i] == mark}
        summary = pickle.dumps((int(total.sum()), int((total > 0).sum()), len(words), rank[often], total[often], marks))
        out = [pack([total[at[e - s : e]], *planes(rank[at[e - s : e]])]) for s, e in zip(size, ends)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array([*parts, None], pa.string()), pa.array([0] * n + [2], pa.int32()), pa.array([shard] * (n + 1), pa.int32()), pa.array([*out, summary], pa.binary())], names=["part", "kind", "shard", "blob"])

    return count


class Questions:
    """The blocks of all parts that a shard got, and their distinct n-grams."""

    def __init__(self, blocks: list):
        size = np.array([[len(b[k]) for k in (0, 1, 4, 3, 8)] for b in blocks])  # contexts, successors, pairs, trigrams, bare contexts
        self.at = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(size, axis=0)])
        cat = lambda k, level: np.concatenate([b[k] + self.at[i, level] for i, b in enumerate(blocks)])
        all_of = lambda k: np.concatenate([b[k] for b in blocks])
        self.ctx, of = np.unique(np.concatenate([all_of(0), all_of(8)]), return_inverse=True)
        self.ctx_of, self.bare_of = of[: self.at[-1, 0]], of[self.at[-1, 0] :]
        word, before = all_of(2), all_of(5)
        if max((int(x.max()) for x in (word, before) if len(x)), default=0) >> 32:  # the words of a shard are always fewer
            word, before = np.split(np.unique(np.concatenate([word, before]), return_inverse=True)[1].astype(_U), [len(word)])
        self.suc, self.suc_of = np.unique(self._under(self.ctx_of[cat(1, 0)], word), return_inverse=True)
        self.pair, self.pair_of = np.unique(self._under(self.ctx_of[cat(4, 0)], before), return_inverse=True)
        self.tri, self.tri_of = np.unique(self._under(self.pair_of[cat(6, 2)], self.suc_of[cat(3, 1)].astype(_U)), return_inverse=True)
        self.n = np.bincount(self.tri_of, all_of(7), len(self.tri))

    @staticmethod
    def _under(parent: np.ndarray, item: np.ndarray) -> np.ndarray:
        return (parent.astype(_U) << _U(32)) | item

    @staticmethod
    def _split(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (code >> _U(32)).astype(np.int64), code & _U(0xFFFFFFFF)

    def trie(self) -> NgramTrie:
        """The trie of the n-grams that occur in training."""
        seen = self.n > 0
        pair, suc = self._split(self.tri[seen])
        suc, n = suc.astype(np.int64), self.n[seen]
        suc_n, pair_n = np.bincount(suc, n, len(self.suc)), np.bincount(pair, n, len(self.pair))
        (suc_ctx, word), (pair_ctx, before) = self._split(self.suc), self._split(self.pair)
        ctx_n = np.bincount(suc_ctx, suc_n, len(self.ctx))
        place = lambda count: np.cumsum(count > 0) - 1  # noqa: E731  numbers among those that occur
        c, s, p = place(ctx_n), place(suc_n), place(pair_n)
        ks, kp = suc_n > 0, pair_n > 0
        return NgramTrie.build(self.ctx[ctx_n > 0], c[suc_ctx[ks]], word[ks], suc_n[ks], c[pair_ctx[kp]], before[kp], p[pair], s[suc], n)

    def answers(self, trie: NgramTrie) -> list[np.ndarray]:
        """What the trie has of the distinct contexts, successors, pairs and trigrams: totals and kinds, then bytes."""
        (suc_ctx, word), (pair_ctx, before), (tri_pair, tri_suc) = (self._split(x) for x in (self.suc, self.pair, self.tri))
        ctx = trie.context(self.ctx)
        suc, pair = trie.successor(ctx[suc_ctx], word), trie.pair(ctx[pair_ctx], before)
        tri = np.full(len(self.tri), -1, np.int64)
        tri_suc = tri_suc.astype(np.int64)
        ok = np.flatnonzero((pair[tri_pair] >= 0) & (suc[tri_suc] >= 0))
        place = suc - trie.starts("first_successor", ctx)[suc_ctx]  # among the context's successors
        tri[ok] = trie.seqs["places"].find((trie.starts("first_place", pair)[tri_pair[ok]] + place[tri_suc[ok]]).astype(_U))

        def values(name: str, at: np.ndarray, other) -> np.ndarray:
            out = np.full(len(at), other, trie.levels[name].dtype)
            out[at >= 0] = trie.levels[name][at[at >= 0]]
            return out

        return [values("total2", ctx, 0), values("kinds2", ctx, 0), values("p2", suc, 0), values("left3", pair, 1), values("p3", tri, 0)]

    def of_block(self, i: int, found: list[np.ndarray]) -> list[np.ndarray]:
        """The answers to a block, the kinds of its bare contexts last."""
        ctx, suc, pair, tri, bare = (x[self.at[i, k] : self.at[i + 1, k]] for k, x in enumerate((self.ctx_of, self.suc_of, self.pair_of, self.tri_of, self.bare_of)))
        return [found[0][ctx], found[1][ctx], found[2][suc], found[3][pair], found[4][tri], found[1][bare]]


def answer_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds a shard's trie and answers all parts."""
    parts, blobs, shard = _gather(batches)
    if not parts:
        return
    asked = Questions([asked_from(unpack(b)) for b in blobs])
    del blobs
    found = asked.answers(asked.trie().through_file())
    for k, part in enumerate(parts):
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard], pa.int32()), pa.array([pack(asked.of_block(k, found))], pa.binary())], names=["part", "shard", "blob"])
    del asked, found
    release_memory()


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score_part(part: Part, blocks: Blocks, answers: dict[int, bytes], n: int, v: int) -> pa.RecordBatch:
    """Scores of a part's documents, from the counts of its words and the shards' answers."""
    total2, kinds2, p2 = ([np.zeros(len(r[0])) for r in blocks.blocks] for _ in range(3))
    left3, p3 = ([np.ones(len(r[0])) for r in blocks.blocks] for _ in range(2))
    kinds_of = np.zeros(len(blocks.used))  # distinct successors of the hot words over all data
    for shard, blob in answers.items():
        got, asked = unpack(blob), blocks.asked(shard)
        per_row = got[0][asked.ctx], got[1][asked.ctx], DEQUANTISE[got[2]][asked.suc], DEQUANTISE[got[3]][asked.pair], DEQUANTISE[got[4]]
        cut = blocks.cuts[0][shard + 1] - blocks.cuts[0][shard]
        for to, row in zip((total2, kinds2, p2, left3, p3), per_row):
            for k, rows in enumerate((row[:cut], row[cut:])):
                to[k][blocks.cuts[k][shard] : blocks.cuts[k][shard + 1]] = rows
        np.add.at(kinds_of, blocks.bare_of[blocks.cuts[2][shard] : blocks.cuts[2][shard + 1]], got[5].astype(np.float64))
    size = len(blocks.p1)
    near, back2, a3, back3 = np.zeros(size), np.ones(size), np.zeros(size), np.ones(size)
    pl, ht, nh = blocks.plain, blocks.hot, len(blocks.hot)
    near[pl], a3[pl], back3[pl] = p2[0], p3[0], left3[0]
    whole = total2[0] + kinds2[0]
    back2[pl] = np.where(whole > 0, kinds2[0] / np.maximum(whole, 1), 1)
    counts = part.total
    if nh:
        t, b = blocks.hot_row[:nh], blocks.hot_row[nh:]
        a3[ht], back3[ht] = p3[1][t], left3[1][t]
        first = np.flatnonzero(np.append(True, np.diff(blocks.bigram) != 0))
        word = blocks.p1[ht[first]]  # the context word of each hot bigram
        seen = p2[1][b] * (total2[1][b] + kinds2[1][b])
        kinds = kinds_of[blocks.place_of_word[word]]
        of_word = np.where(word == part.begin, counts[part.end], counts[word]).astype(np.float64)
        whole = np.maximum(of_word + kinds, 1)
        near[ht], back2[ht] = (np.minimum(seen, of_word) / whole)[blocks.bigram], np.where(of_word + kinds > 0, kinds / whole, 1)[blocks.bigram]
    c = counts[blocks.w]
    p1 = np.where(c > 0, c, v) / (n + v) if n else np.ones(size)
    p = a3 + back3 * (near + back2 * p1)
    lens = np.concatenate([[0], np.cumsum(part.lens)])[:-1]
    of_token = counts[part.token]
    sums = lambda x: np.add.reduceat(x, lens) if len(lens) else x[:0]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part.ids, pa.int64()), pa.array(~part.train), pa.array(part.lens), pa.array(sums((of_token > 0).astype(np.int64))),
            pa.array(sums(np.log10((of_token + 1) / (n + v + 1)))), pa.array(sums(np.log10(np.minimum(p, 1))[blocks.which])),
        ],
        names=[x.split()[0] for x in SCORES.split(", ")],
    )


def shards_for(docs: DataFrame) -> int:
    """Shards in proportion to the bytes of all texts, and enough for every task."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // SHARD_BYTES))


def score_documents(docs: DataFrame, shards: int | None = None, part_tokens: int = PART_TOKENS, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """Scores of docs (doc_id, text, train), learned from those with train."""
    spark = docs.sparkSession
    shards = shards or shards_for(docs)
    folder = f"{shared_dir(spark).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    words = write_parts(docs, folder, shards, part_tokens)
    counted = cut_lineage(words.repartitionById(shards, F.col("shard")).mapInArrow(count_words(hot_tokens), ANSWER))
    totals = [(r["shard"], pickle.loads(r["blob"])) for r in counted.where("kind = 2").select("shard", "blob").collect()]
    n, v = sum(t[0] for _, t in totals), sum(t[1] for _, t in totals)
    above = shards * max((t[2] for _, t in totals), default=0)
    marks = {name: (rank * shards + k, total) for k, t in totals for name, (rank, total) in t[5].items()}
    ids = [np.zeros(0, np.int64), *(t[3] * shards + k for k, t in totals)]
    often = [np.zeros(0, np.int64), *(t[4] for _, t in totals)]
    if marks and marks["end"][1] >= hot_tokens:  # a text's begin is as frequent as its end
        ids.append(np.array([marks["begin"][0]]))
        often.append(np.array([marks["end"][1]]))
    hot = Hot(np.concatenate(ids), np.concatenate(often), above, hot_tokens)

    def by_part(rows: DataFrame, per_part, schema: str) -> DataFrame:
        """per_part(file system, folder, name, {shard: blob}) for every part of rows (part, shard, blob)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = file_system(folder)
            name, got = None, {}
            for b in batches:
                for p, shard, blob in zip(*(b.column(c).to_pylist() for c in ("part", "shard", "blob"))):
                    if p != name:
                        if name is not None:
                            yield from per_part(fs, root, name, got)
                            release_memory()
                        name, got = p, {}
                    got[shard] = blob
            if name is not None:
                yield from per_part(fs, root, name, got)
            del got
            release_memory()

        dealt = rows.select("part", "shard", "blob").repartition(shards, F.xxhash64("part")).sortWithinPartitions("part", "shard")
        return dealt.mapInArrow(run, schema)

    def send(fs, root: str, name: str, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        part = Part.load(_read(fs, f"{root}/{name}"))
        if set(got) != set(np.flatnonzero(np.diff(word_slices(part, shards))).tolist()):
            raise RuntimeError(f"answers to part {name} are incomplete")
        of_words = [unpack(got[s]) for s in sorted(got)]
        counts = np.concatenate([x[0].astype(np.int64) for x in of_words])
        numbers = np.concatenate([from_planes(*x[1:]) * _U(shards) + _U(s) for s, x in zip(sorted(got), of_words)])
        _write(fs, f"{root}/{name}.words", pack([counts, *planes(numbers)]))
        part.number(numbers, counts)
        blocks = Blocks(part, hot, shards)
        for s in blocks.shards():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([name]), pa.array([pack(blocks.asked(s).arrays())], pa.binary())], names=["shard", "part", "blob"])

    def finish(fs, root: str, name: str, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        part = Part.load(_read(fs, f"{root}/{name}"))
        counts, *numbers = unpack(_read(fs, f"{root}/{name}.words"))
        part.number(from_planes(*numbers), counts.astype(np.int64))
        blocks = Blocks(part, hot, shards, inverse=True)
        if set(got) != set(blocks.shards().tolist()):
            raise RuntimeError(f"answers to part {name} are incomplete")
        yield score_part(part, blocks, got, n, v)

    sent = by_part(counted.where("kind = 0"), send, "shard int, part string, blob binary")
    answers = sent.repartitionById(shards, F.col("shard")).mapInArrow(answer_trigrams, "part string, shard int, blob binary")
    scored = cut_lineage(by_part(answers, finish, SCORES))
    delete_folder(spark, folder)
    return scored.withColumn("train_tokens", F.lit(n).cast("bigint"))


def op6_ngramlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every whole document; fold 2 of 7 is held out."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod("doc_id", 7) != 2).alias("train"))
    return score_documents(rows).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
