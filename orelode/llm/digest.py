"""Document fingerprints from improbable features (operator 2).

Every window of 32 bytes has an entropy. Windows are ranked by how rare their
entropy is in the corpus: a histogram over all windows of all documents gives
the order, rarest first; windows of very low entropy are left out. In each run
of 32 successive windows the leftmost of lowest rank scores a point. Points of
equal windows of a document add up, so that texts of short period have features
too, and windows with enough points are its features, each once. Texts with fewer
than ``FEW`` of them also have fine features of 8 bytes, found alike. Features are
hashed and inserted, in order of first place, in a chain of Bloom filters of 2048
bits, five bits a feature, 160 features a filter; each kind has a chain of its own.

Two chains of a kind are compared filter by filter: the overlap of two filters'
bits, less the overlap expected by chance, over the most that it could be; each
filter of the chain with fewer features counts with its best partner. Kinds that
both texts have weigh as the fewer of the two texts' features of them.

Entropies slide in integers: the number of equal bytes before and behind every
byte, within a window, gives the change of the sum of c log c by one step, so
all windows of a batch take a few dozen vectorised passes.

Cases: null texts are empty; an empty text has no features, equals other empty
texts (likeness 1) and is unlike all others (0). Texts without any feature, of low
entropy throughout, take every winner of 8 bytes whatever its entropy; those under
8 bytes have one feature, the whole text. Texts are read
whole, whatever their length. Rows of equal id are in order of their texts'
hashes, then of their texts; a null id comes first. Repeated rows follow each
other. A single row is its own next; an empty table gives no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import partitions, table
from orelode.llm.textcore import SpanHasher, mix, runs, utf8_column

FILTER_BITS = 2048
FILTER_FEATURES = 160
PROBES = 5
LEVELS = 1000
#: Texts with fewer coarse features also have fine ones.
FEW = 16
RUN = 1 << 18
_U = np.uint64
_NEVER = np.int64(1) << 62


@dataclass(frozen=True)
class Scale:
    """Size of the windows, of the runs in which they compete, the points that a feature needs, and the least entropy level."""

    window: int
    popular: int
    points: int
    least: int

    @cached_property
    def clogc(self) -> np.ndarray:
        """c log c of counts, in integers."""
        return np.array([0] + [round(c * np.log2(c) * 4096) for c in range(1, self.window + 1)], np.int32)


COARSE, FINE = Scale(32, 32, 8, 200), Scale(8, 8, 2, 300)
SCALES = (COARSE, FINE)
#: For texts that have no feature otherwise; ranks are those of FINE, low levels included.
LOOSE = Scale(8, 8, 1, 0)


def entropy_levels(buf: np.ndarray, scale: Scale = COARSE) -> np.ndarray:
    """Entropy of every window of the buffer, 0 to LEVELS."""
    n, size, clogc = len(buf), scale.window, scale.clogc
    step = np.diff(clogc)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, size):
        same = (buf[:-d] == buf[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    total = np.empty(n - size + 1, np.int32)
    total[0] = clogc[np.bincount(buf[:size])].sum()
    total[1:] = step[behind[size:]] - step[ahead[: n - size]]
    np.cumsum(total, out=total)
    return (clogc[size] - total) * LEVELS // clogc[size]


def histograms(texts: pa.Array) -> np.ndarray:
    """Windows of each scale and entropy level."""
    out = np.zeros((len(SCALES), LEVELS + 1), np.int64)
    buf, offs = utf8_column(texts)
    for i, j in runs(offs, RUN):
        b = buf[offs[i] : offs[j]]
        for k, scale in enumerate(SCALES):
            if len(b) >= scale.window:
                out[k] += np.bincount(entropy_levels(b, scale)[_inside(offs[i : j + 1] - offs[i], len(b), scale.window)], minlength=LEVELS + 1)
    return out


def _inside(offs: np.ndarray, n: int, window: int) -> np.ndarray:
    """Starts of windows that lie in one text."""
    good = np.ones(n - window + 1, bool)
    for e in offs[1:-1]:
        good[max(0, e - window + 1) : e] = False
    return np.flatnonzero(good)


def ranks_from(counts: np.ndarray, scale: Scale = COARSE) -> np.ndarray:
    """Rank of each entropy level, rarest first; -1 for levels that are left out."""
    order = np.argsort(counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    rank[: scale.least] = -1
    return rank


def features(buf: np.ndarray, offs: np.ndarray, rank: np.ndarray, scale: Scale = COARSE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every feature, in order of first place."""
    n, length = len(buf), np.diff(offs)
    if n < scale.window or (length < scale.window).all():
        return np.zeros(0, np.int64), np.zeros(0, _U)
    r = rank[entropy_levels(buf, scale)]
    key = np.full(n, _NEVER)
    at = _inside(offs, n, scale.window)
    at = at[r[at] >= 0]
    key[at] = (r[at] << 40) | at
    least = key.copy()
    step = 1
    while step < scale.popular:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    windows = length - scale.window + 1
    turns = np.maximum(windows - scale.popular + 1, 0)
    turn_at = np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(turns)[:-1]]), turns) + np.arange(turns.sum())
    won = least[turn_at]
    short = np.flatnonzero((windows > 0) & (turns == 0))
    if len(short):
        bounds = np.stack([offs[short], offs[short] + windows[short]], axis=1).ravel()
        won = np.concatenate([won, np.minimum.reduceat(np.append(key, _NEVER), bounds)[::2]])
    place, points = np.unique(won[won != _NEVER] & ((1 << 40) - 1), return_counts=True)
    doc = np.searchsorted(offs, place, side="right") - 1
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, scale.window)[place]).view("<u8")
    hashes = np.zeros(len(place), _U)
    for k in range(words.shape[1]):
        hashes = mix(hashes + words[:, k] + _U(scale.window + k))
    if not len(place):
        return doc, hashes
    order = np.lexsort((hashes, doc))  # equal windows of a text stay in order of place
    first = np.flatnonzero(np.append(True, (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])))
    points, order = np.add.reduceat(points[order], first), order[first]
    order = np.sort(order[points >= np.minimum(scale.points, np.maximum(turns[doc[order]], 1))])
    return doc[order], hashes[order]


def _features_of(texts: np.ndarray, buf: np.ndarray, offs: np.ndarray, rank: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """Features of those texts that a mask picks."""
    length = np.diff(offs)
    at = np.flatnonzero(texts)
    doc, hashes = features(buf[np.repeat(texts, length)], np.concatenate([[0], np.cumsum(length[at])]), rank, scale)
    return at[doc], hashes


def all_features(buf: np.ndarray, offs: np.ndarray, ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coarse and fine features, each in order of texts."""
    length = np.diff(offs)
    coarse = features(buf, offs, ranks[0], COARSE)
    n = np.bincount(coarse[0], minlength=len(length))
    fine = [_features_of(n < FEW, buf, offs, ranks[1], FINE)]
    bare = (length > 0) & (n + np.bincount(fine[0][0], minlength=len(length)) == 0)
    fine.append(_features_of(bare, buf, offs, ranks[2], LOOSE))
    bare[fine[1][0]] = False
    rest = np.flatnonzero(bare)
    if len(rest):
        fine.append((rest, mix(SpanHasher(buf).of(offs[rest], offs[rest + 1]))))
    doc, hashes = (np.concatenate(x) for x in zip(*fine))
    order = np.argsort(doc, kind="stable")
    return [coarse, (doc[order], hashes[order])]


class Chains:
    """Chains of Bloom filters of one kind of features, end to end."""

    def __init__(self, doc: np.ndarray, h: np.ndarray, texts: int):
        self.n = np.bincount(doc, minlength=texts)
        first = np.concatenate([[0], np.cumsum(self.n)])
        self.filters = -(-self.n // FILTER_FEATURES)
        self.at = np.concatenate([[0], np.cumsum(self.filters)])
        where = self.at[doc] + (np.arange(len(doc)) - first[doc]) // FILTER_FEATURES
        bits = np.zeros((int(self.at[-1]), FILTER_BITS), np.uint8)
        for k in range(PROBES):
            bits[where, ((h >> _U(11 * k)) & _U(FILTER_BITS - 1)).astype(np.int64)] = 1
        self.words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        self.ones = np.bitwise_count(self.words).sum(axis=1).astype(np.float64)

    def text(self, i: int) -> str:
        return f"{self.n[i]}:" + base64.b64encode(self.words[self.at[i] : self.at[i + 1]].tobytes()).decode()

    def likeness(self, rows: np.ndarray, other: Chains, others: np.ndarray) -> np.ndarray:
        """Likeness of pairs of chains, 0 to 1; 0 where one has no features."""
        out = np.zeros(len(rows))
        fa, fb = self.filters[rows], other.filters[others]
        one = np.flatnonzero((fa == 1) & (fb == 1))
        a, b = self.at[rows[one]], other.at[others[one]]
        both = np.bitwise_count(self.words[a] & other.words[b]).sum(axis=1)
        out[one] = _normalised(both, self.ones[a], other.ones[b])
        for k in np.flatnonzero((fa > 0) & (fb > 0) & ((fa > 1) | (fb > 1))):
            p, q = (self, rows[k]), (other, others[k])
            if p[0].n[p[1]] > q[0].n[q[1]]:
                p, q = q, p
            x, y = (slice(d.at[i], d.at[i + 1]) for d, i in (p, q))
            best = [_normalised(np.bitwise_count(w & q[0].words[y]).sum(axis=1), o, q[0].ones[y]).max() for w, o in zip(p[0].words[x], p[0].ones[x])]
            weight = np.full(len(best), FILTER_FEATURES)
            weight[-1] = p[0].n[p[1]] - FILTER_FEATURES * (len(best) - 1)
            out[k] = np.average(best, weights=weight)
        return out


class Digests:
    """Digests of a batch of texts: a chain of filters for each kind of features."""

    def __init__(self, texts: pa.Array, ranks: np.ndarray):
        buf, offs = utf8_column(texts)
        found = [([np.zeros(0, np.int64)], [np.zeros(0, _U)]) for _ in SCALES]
        for i, j in runs(offs, RUN):
            for (docs, hashes), (d, h) in zip(found, all_features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ranks)):
                docs.append(d + i)
                hashes.append(h)
        self.kinds = [Chains(np.concatenate(docs), np.concatenate(hashes), len(texts)) for docs, hashes in found]

    def text(self, i: int) -> str:
        return "/".join(kind.text(i) for kind in self.kinds)

    def likeness(self, rows: np.ndarray, other: Digests, others: np.ndarray) -> np.ndarray:
        """Likeness of pairs of digests, 0 to 1."""
        weights = [np.minimum(a.n[rows], b.n[others]) for a, b in zip(self.kinds, other.kinds)]
        total = sum(w * a.likeness(rows, b, others) for w, a, b in zip(weights, self.kinds, other.kinds))
        empty = sum(a.n[rows] + b.n[others] for a, b in zip(self.kinds, other.kinds)) == 0
        return np.where(empty, 1.0, total / np.maximum(sum(weights), 1))


def _normalised(both, ones_a, ones_b):
    chance = ones_a * ones_b / FILTER_BITS
    return np.clip((both - chance) / (np.minimum(ones_a, ones_b) - chance), 0, 1)


def all_ranks(counts: np.ndarray) -> np.ndarray:
    return np.stack([*(ranks_from(c, s) for c, s in zip(counts, SCALES)), ranks_from(counts[1], LOOSE)])


def corpus_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of both scales, and of the loose one, from the entropy histograms of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SCALES), LEVELS + 1), np.int64)
        for b in batches:
            total += histograms(b.column(0))
        scale, level = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"scale": scale.astype(np.int32), "level": level.astype(np.int32), "n": total[scale, level]})

    got = docs.select(F.col(text).cast("string")).mapInArrow(count, "scale int, level int, n bigint").groupBy("scale", "level").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(SCALES), LEVELS + 1), np.int64)
    counts[got.column("scale").to_numpy(), got.column("level").to_numpy()] = got.column("n").to_numpy()
    return all_ranks(counts)


@dataclass(frozen=True)
class Cuts:
    """Keys (id present, id, hash of the text) that occur, in order, each the first of a range."""

    known: np.ndarray
    ids: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, keys: list[tuple[bool, int | None, int]]) -> Cuts:
        keys = sorted({(k, i or 0, h) for k, i, h in keys})
        known, ids, hashes = zip(*keys) if keys else ((), (), ())
        return cls(np.array(known, bool), np.array(ids, np.int64), np.array(hashes, np.int64))

    def place(self, known: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and whether the row is a first one of it."""
        nulls = int((~self.known).sum())
        mine = self.ids[nulls:]
        low = np.where(known, nulls + np.searchsorted(mine, ids), 0)
        high = np.where(known, nulls + np.searchsorted(mine, ids, side="right"), nulls)
        at = low - 1
        for a in np.unique(low[high > low]):  # cuts of one id
            rows = np.flatnonzero((low == a) & (high > low))
            at[rows] += np.searchsorted(self.hashes[a : high[rows[0]]], hashes[rows], side="right")
        return at, (at >= low) & (self.hashes[np.maximum(at, 0)] == hashes)


def beside_next(docs: DataFrame, each: int = 64) -> DataFrame:
    """Rows (bucket, helper, doc_id, hash, text) in which every row is followed by its next.

    Rows are dealt in ranges of id and text, which are cut at keys that occur, at
    even steps through those that a hash picks, about ``each`` for a range. Rows of
    one id, or without one, are cut like others. The first row of a range also
    goes, as a helper, to the range before; that of the first range to the last.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")
    parts = partitions(spark)
    n = rows.count()
    picked = rows.select(key.alias("k")).where(F.pmod(F.xxhash64("k", F.lit(3)), F.lit(max(1, n // (each * parts)))) == 0).distinct()
    found = sorted((k["known"], k["doc_id"] or 0, k["hash"]) for (k,) in picked.collect())
    first = rows.agg(F.min(key).alias("k")).first()["k"]
    cuts = Cuts.of([*(found[k * len(found) // parts] for k in range(1, parts) if found), *([tuple(first)] if first else [])])
    total = max(1, len(cuts.ids))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column(0), b.column(1).to_numpy()
            at, opens = cuts.place(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), hashes)
            extra = np.flatnonzero(opens)
            take = pa.array(np.concatenate([np.arange(len(at)), extra]))
            bucket = np.concatenate([at, (at[extra] - 1) % total]).astype(np.int32)
            helper = np.arange(len(bucket)) >= len(at)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(helper), *(c.take(take) for c in b.columns)], names=["bucket", "helper", "doc_id", "hash", "text"])

    dealt = rows.mapInArrow(deal, "bucket int, helper boolean, doc_id bigint, hash bigint, text string")
    return dealt.repartitionById(total, F.col("bucket")).sortWithinPartitions("bucket", "helper", "doc_id", "hash", "text").drop("hash")


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Digests of every text and of its edited form, and their likeness."""
    ranks = corpus_ranks(docs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks().to_batches()[0]
                if (out := _compare(rows, ranks)) is not None:
                    yield out
                held = rows.slice(rows.num_rows - 1)

    return beside_next(docs).mapInArrow(compare, OUT)


def _compare(rows: pa.RecordBatch, ranks: np.ndarray) -> pa.RecordBatch | None:
    """Results of all rows but the last, which comes again with the rows after it."""
    bucket, helper = rows.column(0).to_numpy(), rows.column(1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(~helper[:-1] & (bucket[:-1] == bucket[1:]))
    if not len(own):
        return None
    texts = rows.column(3).to_pylist()
    edited = []
    for i in own:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    a, e = Digests(rows.column(3), ranks), Digests(pa.array(edited, pa.string()), ranks)
    every = np.arange(len(own))
    return pa.RecordBatch.from_arrays(
        [
            rows.column(2).take(pa.array(own)),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([a.text(i) for i in own]),
            pa.array([e.text(i) for i in every]),
            pa.array(a.likeness(own, e, every)),
            pa.array(a.likeness(own, a, own + 1)),
        ],
        names=[c.split()[0] for c in OUT.split(", ")],
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improbable-feature digests of every whole document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
