import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from orelode.llm import textcore as T
from orelode.llm.common import Forest
from orelode.llm.eliasfano import EliasFano, NgramTrie

texts = st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="ab \n\té", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_word_spans(rows):
    buf, offs = T.utf8_column(pa.array(rows, pa.string()))
    starts, ends, at = T.word_spans(buf, offs)
    got = [[bytes(buf[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(at, at[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    hashes = T.span_hashes(buf, starts, ends)
    by = {}
    for s, e, h in zip(starts, ends, hashes):
        assert by.setdefault(bytes(buf[s:e]), h) == h == T.text_hash(bytes(buf[s:e]))
    assert len(set(map(int, by.values()))) == len(by)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=12), st.integers(1, 30))
def test_runs_cover(sizes, limit):
    offs = np.concatenate([[0], np.cumsum(np.array(sizes, int))]).astype(int)
    spans = list(T.runs(offs, limit))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(sizes)))
    assert all(b == a + 1 or offs[b] - offs[a] <= limit for a, b in spans)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=60), st.lists(st.integers(0, 2**63), max_size=10), st.integers(0, 50))
def test_elias_fano(values, others, shift):
    values = np.unique(np.array(values, np.uint64) >> np.uint64(shift))
    e = EliasFano.build(values)
    assert (e.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, np.array(others, np.uint64) >> np.uint64(shift)])
    place = {int(v): i for i, v in enumerate(values)}
    assert e.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


def test_elias_fano_dense_and_flat():
    for values in (np.arange(5000), np.repeat(7, 3), np.concatenate([np.zeros(300), [2**40]])):
        values = values.astype(np.uint64)
        assert (EliasFano.build(values).get(np.arange(len(values))) == values).all()
    e = EliasFano.build(np.arange(5000, dtype=np.uint64) * np.uint64(3))
    assert e.find(np.array([0, 3, 4, 14997, 15000], np.uint64)).tolist() == [0, 1, -1, 4999, -1]


def test_trie_through_file():
    u, i = (lambda *x: np.array(x, np.uint64)), (lambda *x: np.array(x))
    trie = NgramTrie.build(u(5, 9), i(0, 0, 1), u(3, 8, 3), i(2, 1, 4), i(0, 1, 1), u(1, 1, 2), i(0, 0, 1, 2), i(0, 1, 2, 2), i(2, 1, 1, 3)).through_file()
    assert trie.context(u(9, 5, 6)).tolist() == [1, 0, -1]
    assert trie.successor(i(0, 0, 1, -1), u(8, 4, 3, 3)).tolist() == [1, -1, 2, -1]
    assert trie.pair(i(1, 0), u(2, 2)).tolist() == [2, -1]
    assert trie.trigram(i(0, 1, 1), i(0, 2, 0), i(1, 2, -1)).tolist() == [1, 3, -1]


@pytest.mark.parametrize("seed", range(5))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    f = Forest(60)
    f.link(a[:20], b[:20])
    f.link(a[20:], b[20:])
    label = list(range(60))
    for _ in range(60):
        for x, y in zip(a, b):
            label[x] = label[y] = min(label[x], label[y])
    assert f.label.tolist() == label


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=70), max_size=12), st.integers(0, 2**64 - 1))
def test_xxh64(parts, seed):
    parts = [*parts, b"", b"x" * 255, b"yz" * 128, b"q" * 1000]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert T.xxh64_spans(buf, starts, ends, seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \t\n", max_size=9), max_size=7))
def test_one_spaced(texts):
    buf, offs = T.utf8_column(pa.array(texts, pa.string()))
    out, at = T.one_spaced(buf, offs)
    starts, ends, words = T.word_spans(out, at)
    got = [out[starts[a] : ends[z - 1]].tobytes().decode() if z > a else "" for a, z in zip(words, words[1:])]
    assert got == [" ".join(t.split()) for t in texts]
