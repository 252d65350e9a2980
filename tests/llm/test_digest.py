import base64
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from orelode.llm import digest
from orelode.llm.textcore import mix, text_hash
from tests.llm.conftest import odd_documents, prose


@pytest.mark.parametrize("scale", digest.SCALES)
@settings(max_examples=50, deadline=None)
@given(data=st.binary(min_size=32, max_size=120))
def test_entropy_slides(scale, data):
    size = scale.window
    for i, level in enumerate(digest.entropy_levels(np.frombuffer(data, np.uint8), scale)):
        c = Counter(data[i : i + size]).values()
        want = 1000 * (1 - sum(n * math.log2(n) for n in c) / (size * math.log2(size)))
        assert abs(level - want) <= 1.5


def plain_features(data, rank, scale):
    """Places of the features of one text, window by window."""
    levels = digest.entropy_levels(np.frombuffer(data, np.uint8), scale)
    keys = [(rank[q], i) if rank[q] >= 0 else None for i, q in enumerate(levels)]
    turns = [keys[i : i + scale.popular] for i in range(max(1, len(keys) - scale.popular + 1))]
    points, first = Counter(), {}
    for t in turns:
        if any(t):
            i = min(k for k in t if k)[1]
            points[data[i : i + scale.window]] += 1
            first.setdefault(data[i : i + scale.window], i)
    return sorted(first[w] for w, n in points.items() if n >= min(scale.points, len(turns)))


@pytest.mark.parametrize("scale", digest.SCALES)
def test_features_by_place(scale):
    rank = digest.ranks_from(np.random.default_rng(1).integers(0, 1000, digest.LEVELS + 1), scale)
    texts = [prose("en", n, n).encode() for n in (3, 8, 9, 12, 40, 200)] + [b"", b"short", b"a" * 100]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    docs, hashes = digest.features(buf, offs, rank, scale)
    for k, t in enumerate(texts):
        assert (docs == k).sum() == (len(plain_features(t, rank, scale)) if len(t) >= scale.window else 0)
        alone = digest.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), rank, scale)[1]
        assert alone.tolist() == hashes[docs == k].tolist()
    coarse, fine = digest.all_features(buf, offs, np.stack([rank, rank, rank]))
    assert set(coarse[0]) | set(fine[0]) == {k for k, t in enumerate(texts) if t}


def test_likeness():
    rank = digest.all_ranks(np.stack([np.arange(digest.LEVELS + 1)] * 2))
    a, b = prose("en", 3000, 1), prose("de", 3000, 2)
    d = digest.Digests(pa.array([a, a, b, a[: len(a) // 2] + b[: len(b) // 2], "", None]), rank)
    at = lambda x, y: d.likeness(np.array([x]), d, np.array([y]))[0]
    assert at(0, 1) == 1 and at(4, 5) == 1 and at(0, 4) == 0 and at(0, 2) < 0.15 and 0.35 < at(0, 3) < 0.7
    assert d.text(0) == d.text(1) != d.text(2)


def test_short_texts():
    rank = digest.all_ranks(np.stack([np.arange(digest.LEVELS + 1)] * 2))
    texts = [prose("en", 15, k) for k in range(40)]
    edited = [t[: len(t) - len(t) // 2] + texts[(k + 1) % 40][: len(t) // 2] for k, t in enumerate(texts)]
    a, e, at = digest.Digests(pa.array(texts), rank), digest.Digests(pa.array(edited), rank), np.arange(40)
    assert a.likeness(at, e, at).mean() > 0.3 > 3 * a.likeness(at, a, (at + 1) % 40).mean()


def test_no_length_changes_likeness():
    """A byte more lowers likeness no further around 512 bytes, or around FEW coarse features, than at 300 bytes; texts of short period are alike too."""
    texts = [prose(lang, 300, k) for k in range(12) for lang in ("en", "de")] + [w * 300 for w in ("abc ", "tick tock ", "a", "no")]
    buf = pa.array(texts)
    rank = digest.all_ranks(digest.histograms(buf))

    def least(lengths):
        d = digest.Digests(pa.array([t[:n] for t in texts for n in lengths]), rank)
        at = np.arange(len(texts) * len(lengths) - 1)
        at = at[(at + 1) % len(lengths) > 0]
        return d.likeness(at, d, at + 1).min()

    usual = least(range(296, 306))
    assert usual > 0.8 and least(range(500, 525)) >= usual - 0.02
    assert min(least(range(n, n + 100)) for n in range(400, 1200, 100)) >= usual - 0.1
    edited = digest.Digests(pa.array([t[:600] + texts[0][:600] for t in texts[-4:-2]]), rank)
    whole = digest.Digests(pa.array(texts[-4:-2]), rank)
    assert (whole.likeness(np.arange(2), edited, np.arange(2)) > 0.5).all()


def in_order(rows):
    """By id, null first, then by the signed hash of the text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + 2**63) % 2**64))


@pytest.mark.parametrize("each", [8, 64])
def test_hot_ids_are_cut(spark, each):
    """Most rows have no id or one id: each row is followed by its next, and no range holds them all."""
    rows = [(None, f"n{k}") for k in range(150)] + [(7, f"s{k}") for k in range(150)] + [(k, f"o{k}") for k in range(20)] + [(7, "s3")] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = defaultdict(list)
    for r in digest.beside_next(df, each).collect():
        got[r["bucket"]].append(r)
    follows = Counter((a["doc_id"], a["text"], b["text"]) for g in got.values() for a, b in zip(g, g[1:]) if not a["helper"])
    ordered = in_order(rows)
    assert follows == Counter((a[0], a[1], b[1]) for a, b in zip(ordered, [*ordered[1:], ordered[0]]))
    assert len(got) >= 4 and max(map(len, got.values())) < 0.6 * len(rows)


def test_query(spark, tables):
    rows = [(k, prose("en", 5 + 9 * k, k), "en", "s") for k in range(40)] + odd_documents()
    got = digest.op2_fingerprint(spark, tables(documents=rows)).collect()
    ordered = in_order(rows)
    texts = [t or "" for _, t, _, _ in ordered]
    want = []
    for i, (r, t) in enumerate(zip(ordered, texts)):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]
        want.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {}
    for r in got:
        text = {i: t or "" for i, t, _, _ in rows if i is not None}.get(r["doc_id"])
        assert r["doc_id"] is None or prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def plain_levels(data, scale):
    """Entropy of every window, by counting its bytes."""
    top = int(scale.clogc[scale.window])
    return [(top - sum(int(scale.clogc[c]) for c in Counter(data[i : i + scale.window]).values())) * digest.LEVELS // top for i in range(len(data) - scale.window + 1)]


def plain_features_of(data, rank, scale):
    """Hashes of the features of one text, window by window."""
    if len(data) < scale.window:
        return []
    keys = [(rank[q], i) if rank[q] >= 0 else None for i, q in enumerate(plain_levels(data, scale))]
    turns = [keys[i : i + scale.popular] for i in range(max(1, len(keys) - scale.popular + 1))]
    points = Counter()
    for t in turns:
        if any(t):
            i = min(x for x in t if x)[1]
            points[data[i : i + scale.window]] += 1
    hashes = []
    for piece in (w for w, n in points.items() if n >= min(scale.points, len(turns))):
        h = np.zeros(1, np.uint64)
        for w in range(scale.window // 8):
            h = mix(h + np.frombuffer(piece[8 * w : 8 * w + 8], "<u8") + np.uint64(scale.window + w))
        hashes.append(int(h[0]))
    return hashes


def plain_digest(data, ranks):
    """For coarse and fine features: their number, and the chain of Bloom filters as sets of bits."""
    coarse = plain_features_of(data, ranks[0], digest.COARSE)
    fine = plain_features_of(data, ranks[1], digest.FINE) if len(coarse) < digest.FEW else []
    if data and not coarse and not fine:
        fine = plain_features_of(data, ranks[2], digest.LOOSE) or [int(mix(np.array([text_hash(data)], np.uint64))[0])]
    size = digest.FILTER_FEATURES
    chain = lambda hashes: [{h >> (11 * k) & (digest.FILTER_BITS - 1) for h in hashes[a : a + size] for k in range(digest.PROBES)} for a in range(0, len(hashes), size)]
    return [(len(h), chain(h)) for h in (coarse, fine)]


def plain_likeness(a, b):
    if not any(n for n, _ in a) and not any(n for n, _ in b):
        return 1.0
    weights = [min(x[0], y[0]) for x, y in zip(a, b)]
    return sum(w * plain_chains(x, y) for w, x, y in zip(weights, a, b) if w) / max(1, sum(weights))


def plain_chains(a, b):
    if a[0] > b[0] and max(len(a[1]), len(b[1])) > 1:
        a, b = b, a

    def one(x, y):
        chance = len(x) * len(y) / digest.FILTER_BITS
        return min(1, max(0, (len(x & y) - chance) / (min(len(x), len(y)) - chance)))

    size = digest.FILTER_FEATURES
    parts = [min(size, a[0] - size * k) for k in range(len(a[1]))]
    return sum(n * max(one(x, y) for y in b[1]) for n, x in zip(parts, a[1])) / a[0]


def test_fingerprints_by_brute_force(spark, tables):
    """Ranks from all windows, features, filters and likeness by plain loops."""
    rows = [(k, prose("en", n, k), "en", "s") for k, n in enumerate([3, 8, 20, 60, 90, 400, 700, 2500])] + [(20, "aaaa" * 30, None, None), (21, "", None, None), (22, None, None, None), (23, "zz", None, None), (24, "over and " * 90, None, None)]
    texts = [(t or "").encode() for _, t, _, _ in rows]
    ranks = []
    for scale in (*digest.SCALES, digest.LOOSE):
        n = Counter(q for t in texts for q in plain_levels(t, scale))
        order = sorted(range(digest.LEVELS + 1), key=lambda q: (n[q], q))
        rank = {q: i for i, q in enumerate(order)}
        ranks.append([rank[q] if q >= scale.least else -1 for q in range(digest.LEVELS + 1)])
    own = [plain_digest(t, ranks) for t in texts]
    got = {r["doc_id"]: r for r in digest.op2_fingerprint(spark, tables(documents=rows)).collect()}
    for k, (i, *_) in enumerate(rows):
        after = (k + 1) % len(rows)
        half = len(texts[k]) // 2
        edited = plain_digest(texts[k][: len(texts[k]) - half] + texts[after][:half], ranks)
        for name, kinds in (("fingerprint", own[k]), ("edited_fingerprint", edited)):
            bits = [(n, b"".join(sum(1 << b for b in f).to_bytes(digest.FILTER_BITS // 8, "little") for f in chain)) for n, chain in kinds]
            assert got[i][name] == "/".join(f"{n}:{base64.b64encode(b).decode()}" for n, b in bits)
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(own[k], edited))
        assert got[i]["near_next"] == pytest.approx(plain_likeness(own[k], own[after]))


def test_one_and_none(spark, tables):
    one = digest.fingerprint_documents(spark.createDataFrame([(5, "abcd" * 40)], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abcd" * 40).hexdigest()
    assert digest.op2_fingerprint(spark, tables(documents=[])).count() == 0
