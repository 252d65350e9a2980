"""BPE encoding and decoding with a contiguous rank array (operator 5).

A word is held as two parallel arrays: its parts, and the merge rank of every
adjacent pair. The smallest rank is searched by a scan, its boundary deleted,
and the two neighbouring ranks refreshed, until no pair can merge. Words of like
length are stacked, so one step scans and merges all of them. A scan of a short
array costs less than any queue; words of more than ``SCAN_LIMIT`` parts go
through a heap of ranks instead, so very long words stay near linear.

White space parts words in every case, so a text is cut at white space and each
chunk's tokens come from a bounded cache; chunks that it lacks are normalised,
cut by the tokenizer's pattern and merged together.

Cases: a null or empty text gives no ids and an empty decoded text. Special
tokens written out in a text are recognised, as the tokenizer file declares.
Bytes that the vocabulary lacks are left out, as the file has no unknown token.
Of pairs of equal rank the leftmost merges first. Repeated rows are encoded each,
with equal results. Texts are encoded whole, whatever their length. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import release_memory, table
from orelode.llm.textcore import runs, utf8_column

SCAN_LIMIT = 64
#: Chunks in a task's cache, and words merged at a time.
CACHE_ENTRIES = 300_000
STACK = 4096
_NONE = 1 << 60
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters at which str.split parts and the tokenizer's white space does not.
_ONLY_PYTHON_SPACE = "\x1c\x1d\x1e\x1f"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BpeCodec:
    """Encodes and decodes as the tokenizer file at ``path`` says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        letters = _byte_letters()
        self.inner = [vocab.get(letters[b]) for b in range(256)]
        self.last = [vocab.get(letters[b] + self.suffix) for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        pairs = np.array(sorted((a << 32 | b, rank, whole) for (a, b), (rank, whole) in self.merge.items()), np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_ranks = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.whole = np.zeros(len(spec["model"]["merges"]) + 1, np.int64)
        self.whole[pairs[:, 1]] = pairs[:, 2]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", _SPACE)).findall
        self.ascii_pieces = re.compile(split.replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "A-Za-z0-9").replace(r"\s", "\t-\r ")).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.space = regex.compile(f"[{_SPACE}]+").split

    def word_parts(self, word: bytes) -> list[int]:
        """Ids of a word's bytes, the last with the end-of-word form."""
        parts = [i for b in word[:-1] if (i := self.inner[b]) is not None]
        if word and (i := self.last[word[-1]]) is not None:
            parts.append(i)
        return parts

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out = [self.word_parts(w) for w in words]
        top = 4
        while top <= SCAN_LIMIT:  # stacks of like length
            stack = [k for k, p in enumerate(out) if (top >> 1 if top > 4 else 1) < len(p) <= top]
            for k in range(0, len(stack), STACK):
                for at, ids in zip(stack[k : k + STACK], self._scan([out[i] for i in stack[k : k + STACK]])):
                    out[at] = ids
            top *= 2
        return [self._heap(p) if len(p) > SCAN_LIMIT else p for p in out]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def _scan(self, words: list[list[int]]) -> list[list[int]]:
        """The contiguous rank arrays of a stack of words, a merge of each at a step."""
        length = np.array([len(w) for w in words])
        width = int(length.max(initial=2))
        parts = np.full((len(words), width), -1, np.int64)
        parts[np.arange(width) < length[:, None]] = [i for w in words for i in w]
        ranks = np.where(np.arange(1, width) < length[:, None], self._ranks(parts[:, :-1], np.maximum(parts[:, 1:], 0)), _NONE)
        live, cols = np.arange(len(words)), np.arange(width)
        while len(live):
            r = ranks[live]
            at = r.argmin(axis=1)
            best = r[np.arange(len(live)), at]
            live, at, best, r = (x[best != _NONE] for x in (live, at, best, r))
            if not len(live):
                break
            rows, n = np.arange(len(live)), length[live] - 1
            p = parts[live]
            p[rows, at] = self.whole[best]
            p = np.take_along_axis(p, np.minimum(cols + (cols > at[:, None]), width - 1), axis=1)
            r = np.take_along_axis(r, np.minimum(cols[:-1] + (cols[:-1] >= at[:, None]), width - 2), axis=1)
            r[:, -1] = _NONE
            after = np.flatnonzero(at < n - 1)
            r[after, at[after]] = self._ranks(p[after, at[after]], p[after, at[after] + 1])
            before = np.flatnonzero(at > 0)
            r[before, at[before] - 1] = self._ranks(p[before, at[before] - 1], p[before, at[before]])
            parts[live], ranks[live], length[live] = p, r, n
        return [row[:n] for row, n in zip(parts.tolist(), length.tolist())]

    def _heap(self, parts: list[int]) -> list[int]:
        """The same merges for long words: ranks in a heap, parts in a linked list."""
        look, n = self.merge.get, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := look((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = look((a, b))[1], False, right[j]
            if right[i] < n:
                left[right[i]] = i
                if m := look((parts[i], parts[right[i]])):
                    heapq.heappush(heap, (m[0], i, parts[i], parts[right[i]]))
            if (h := left[i]) >= 0 and (m := look((parts[h], parts[i]))):
                heapq.heappush(heap, (m[0], h, parts[h], parts[i]))
        return [p for p, live in zip(parts, alive) if live]

    def _cut(self, chunk: str) -> list[str | int]:
        """Pieces of a text without white space, and the ids of special tokens in it."""
        out: list[str | int] = []
        for k, part in enumerate(self.cut(chunk) if self.cut and "<" in chunk else [chunk]):
            if k % 2:
                out.append(self.special[part])
            elif part.isascii():
                out += self.ascii_pieces(part.lower())
            else:
                out += self.pieces(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def chunk_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of texts without white space."""
        number: dict[str, int] = {}
        count = number.setdefault
        cut: list[list | int] = []  # the number of the one piece, or a list of numbers and, as negatives, of special ids
        for c in chunks:
            if c.isascii() and c.isalpha():
                cut.append(count(c.lower(), len(number)))
            else:
                cut.append([-p - 1 if isinstance(p, int) else count(p, len(number)) for p in self._cut(c)])
        ids = self.merge_words([p.encode() for p in number])
        return [ids[c] if isinstance(c, int) else [i for k in c for i in (ids[k] if k >= 0 else (-k - 1,))] for c in cut]

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in _ONLY_PYTHON_SPACE):
            return [x for x in self.space(text) if x]
        return text.split()

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.chunk_ids(self.chunks(text or "")) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))


class _Cache:
    """Packed ids of chunks; emptied when it is full."""

    def __init__(self, codec: BpeCodec):
        self.codec, self.packed = codec, {}

    def learn(self, chunks: set[str]) -> None:
        if len(self.packed) > CACHE_ENTRIES:
            self.packed.clear()
        new = list(chunks.difference(self.packed))
        ids = self.codec.chunk_ids(new)
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64) * 4
        raw = np.fromiter(itertools.chain.from_iterable(ids), "<u4").tobytes()
        self.packed.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))


_caches: dict[str, _Cache] = {}


def _encode_batch(texts: pa.Array, cache: _Cache) -> list[pa.Array]:
    """Numbers of tokens, packed ids and decoded texts."""
    words = [cache.codec.chunks(t or "") for t in texts.to_pylist()]
    cache.learn(set().union(*words))
    packed = [b"".join(map(cache.packed.__getitem__, w)) for w in words]
    decoded = [cache.codec.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
    counts = pa.array([len(p) // 4 for p in packed], pa.int64())
    return [counts, pa.array(packed, pa.binary()), pa.array(decoded, pa.string())]


def bpe(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded) of every row.

    ids holds little-endian unsigned 32-bit integers; decoded is the text that
    the ids decode to. Null texts count as empty. Results leave in batches of a
    few megabytes, however long the texts are that came in.
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _caches:
            _caches[tokenizer] = _Cache(BpeCodec(tokenizer))
        for batch in batches:
            for i, j in runs(utf8_column(batch.column(1))[1]):
                coded = _encode_batch(batch.column(1).slice(i, j - i), _caches[tokenizer])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *coded], names=[key, "n_tokens", "ids", "decoded"])
        _caches[tokenizer].packed.clear()
        release_memory()

    return rows.mapInArrow(encode, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids binary, decoded string")


def encode_documents(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The documents' ids and their tokens and digests, one row per row of docs."""
    coded = bpe(docs, tokenizer or default_tokenizer(), text=text)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of every whole document, as digests, with the decoded text's digest."""
    return encode_documents(table(spark, sf_dir, "documents"))
