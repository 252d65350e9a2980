import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, component string, u double"
WORDS = {
    "en": "the of and to in is that was with for from this river mountain thing which have been other water".split(),
    "fr": "le la les des une est dans pour avec sur que être rivière montagne chose mais nous vous".split(),
    "de": "der die das und nicht mit für von auf ist eine fluß gebirge über wir auch schon".split(),
}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", "er", "en", "ing"]) for _ in range(n))


#: Texts that every operator must take: null, empty, blank, no letters, one letter, odd characters, and a very long one.
ODD = [None, "", " \n\t ", "12 34 !!", "a", "É😀\x1cß\x85x ́", "word " * 30_000, "x" * 20_000, "<|endoftext|>", "A\x00B"]


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables and gives the folder; documents as (doc_id, text, lang, source)."""

    def write(documents=None, pages=None, embeddings=None, labels=None) -> str:
        if documents is not None:
            rows = [(i, t, lang, s, None if t is None else len(t), 0.5, "x", None, 1.0) for i, t, lang, s in documents]
            spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        if pages is not None:
            spark.createDataFrame(pages, "page_id bigint, url string, html string, digest string, record_type string").write.parquet(f"{tmp_path}/pages.parquet")
        if embeddings is not None:
            spark.createDataFrame(embeddings, "vec_id bigint, embedding array<float>, label int, key string, cid int").write.parquet(f"{tmp_path}/embeddings.parquet")
        if labels is not None:
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def odd_documents(first: int = 10_000):
    rows = [(first + k, t, "en" if k % 2 else None, "s" if k % 3 else None) for k, t in enumerate(ODD)]
    return [*rows, rows[4], rows[4], (None, "null id", None, None), (None, None, None, None)]
