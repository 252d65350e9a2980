import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orelode.llm import bpe
from tests.llm.conftest import odd_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
library, codec = tokenizers.Tokenizer.from_file(PATH), bpe.BpeCodec(PATH)


def agrees(text: str) -> bool:
    want = library.encode(text, add_special_tokens=False).ids
    return codec.encode(text) == want and codec.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeEÉß ΣI'sStT\n\t\x1c\x85 12²-!_|<>é́ñ中文😀​", max_size=40))
def test_as_the_library(text):
    assert agrees(text)


@pytest.mark.parametrize("text", ["", "it's I'LL", "<|endoftext|>x<|startoftext|>", "a" * 700, "ab" * 400, "ΑΣ ΣΑΣ", "ﬁ Ǆ İ", "the " * 500])
def test_cases(text):
    assert agrees(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcnth", min_size=1, max_size=90))
def test_scan_equals_heap(word):
    parts = codec.word_parts(word.encode())
    assert codec._scan([list(parts), [5], list(parts)]) == [codec._heap(list(parts)), [5], codec._heap(list(parts))]


def test_query(spark, tables):
    rows = [(1, "Hello, world's end", "en", "a"), *odd_documents()]
    got = bpe.op5_bpe(spark, tables(documents=rows)).collect()
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
