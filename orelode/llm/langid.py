"""Language identification with error-correcting output codes (operator 1).

Every language gets a codeword of bits. One binary classifier over hashed byte
n-grams predicts each bit: its weights are the log ratios of smoothed n-gram
frequencies between the languages whose bit is set and the others, so its margin
for a text is a sum over all the text's n-grams. Decoding compares the margins
with every codeword under a logistic loss, each bit weighted by how well its
classifier separates the training windows, and takes the codeword of least loss.
Small distance between the two best codewords flags a text as ambiguous.

Training reads a documented bounded sample: about ``max_docs`` labelled rows in
all, equally many for each language, picked by a hash of the row. N-gram counts
of the sample are summed on the executors; the driver gets those that occur.

Cases: null texts and texts without a letter are ``und`` with score 0. Without
any labelled row, and so in an empty table, every text is ``und``. A single
learned language is predicted for every text with letters. Of codewords of equal
loss the first language by name is taken. Repeated rows get equal results. Texts
are processed whole, whatever their length; letters outside A-Z count as their
UTF-8 bytes. Other columns, whatever their names, are kept by keep_identified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import crc_mod, release_memory, table
from orelode.llm.textcore import LOWER, runs, segment_sums, utf8_column

BUCKET_BITS = 16
GRAMS = (2, 3, 4)
UND = "und"
#: Overlapping n-grams repeat each other's evidence; margins are scaled by this.
TEMPERATURE = 0.25
#: What every n-gram counts in every language beside the sample.
SMOOTH = 0.02
_MULT = np.uint32(0x9E3779B1)

_is_letter_byte = np.zeros(256, bool)
_is_letter_byte[ord("a") : ord("z") + 1] = True
_is_letter_byte[0x80:] = True


def _fold(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of each text between single spaces, and the texts' offsets."""
    import pyarrow.compute as pc

    buf, offs = utf8_column(pc.utf8_lower(col.cast(pa.large_string())))
    letter = _is_letter_byte[buf]
    out = np.where(letter, LOWER[buf], np.uint8(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    sums = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], sums[offs]


def gram_buckets(buf: np.ndarray, n: int) -> np.ndarray:
    """Hashed n-grams by start; the last n-1 starts are missing."""
    if len(buf) < n:
        return np.zeros(0, np.int64)
    code = np.full(len(buf) - n + 1, n, np.uint32)
    for k in range(n):
        code = code * np.uint32(257) + buf[k : len(buf) - n + 1 + k]
    return ((code * _MULT) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _within(offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-grams that don't cross a text's end: first and past-the-last of each text."""
    return offs[:-1], np.maximum(offs[1:] - (n - 1), offs[:-1])


def codewords(n: int) -> np.ndarray:
    """n rows of -1/+1: all columns for few languages, else a seeded code with spread rows."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cols = [[1 if (c >> i) & 1 else -1 for i in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(cols, np.int8).T
    rng, width, best = np.random.default_rng(7), max(15, math.ceil(10 * math.log2(n))), None
    for _ in range(max(1, min(200, 2 * 10**10 // (n * n * width)))):
        m = rng.choice(np.array([-1, 1], np.int8), (n, width))
        x, alike = m.astype(np.float32), -width
        for a in range(0, n, 1024):
            same = x[a : a + 1024] @ x.T
            same[np.arange(len(same)), np.arange(a, a + len(same))] = -width
            alike = max(alike, same.max())
        useful = np.abs(m.sum(axis=0, dtype=np.int64)).max() < n
        if useful and (best is None or alike < best[0]):
            best = (alike, m)
    return best[1] if best else codewords_by_number(n)


def codewords_by_number(n: int) -> np.ndarray:
    """Each row the bits of its number, three times over."""
    bits = np.arange(n)[:, None] >> np.arange(max(1, (n - 1).bit_length())) & 1
    return np.tile((2 * bits - 1).astype(np.int8), 3)


@dataclass
class LanguageModel:
    """Codewords, bit weights and the bits' n-gram weights; small enough for a closure."""

    langs: list[str] = field(default_factory=list)
    code: np.ndarray | None = None
    bit_weight: np.ndarray | None = None
    weights: np.ndarray | None = None  # buckets x bits, float32

    def margins(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offs) - 1, self.weights.shape[1]), np.float64)
        for n in GRAMS:
            buckets = gram_buckets(buf, n)
            first, last = _within(offs, n)
            if not len(buckets):
                continue
            rows = self.weights[buckets]
            ends = np.stack([first, last], axis=1).ravel()
            ends = np.minimum(ends, len(rows))
            total += segment_sums(rows, np.concatenate([ends, ends[-1:]]))[::2][: len(total)]
        return total * TEMPERATURE

    def losses(self, margins: np.ndarray) -> np.ndarray:
        loss = np.empty((len(margins), len(self.langs)))
        for i, word in enumerate(self.code):
            loss[:, i] = (np.logaddexp(0, -np.clip(margins * word, -50, 50)) * self.bit_weight).sum(axis=1)
        return loss

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the two best codewords are about as near."""
        n = len(texts)
        lang, score, unsure = [UND] * n, np.zeros(n), np.ones(n, bool)
        if not self.langs:
            return lang, score, unsure
        import pyarrow.compute as pc

        lettered = pc.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
        offs = utf8_column(texts)[1]
        for i, j in runs(offs):
            loss = self.losses(self.margins(*_fold(texts.slice(i, j - i))))
            order = np.argsort(loss, axis=1, kind="stable")
            rows = np.arange(len(loss))
            share = np.exp(loss[rows, order[:, 0], None] - loss).sum(axis=1)
            gap = loss[rows, order[:, 1]] - loss[rows, order[:, 0]] if len(self.langs) > 1 else np.full(len(loss), np.inf)
            for k in np.flatnonzero(lettered[i:j]):
                lang[i + k] = self.langs[order[k, 0]]
            score[i:j], unsure[i:j] = 1 / share, gap < math.log(1.5)
        score[~lettered], unsure[~lettered] = 0.0, True
        return lang, score, unsure


def fit(train: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = 4000) -> LanguageModel:
    """A model from labelled rows; ``max_docs`` bounds the expected size of the sample it reads."""
    rows = train.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    count = {r["lang"]: r["count"] for r in train.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).count().collect()}
    if not count:
        return LanguageModel()
    langs, each = sorted(count), max(1, max_docs // len(count))
    lines = train.sparkSession.createDataFrame([(k, i, min(1.0, each / count[k])) for i, k in enumerate(langs)], "lang string, l int, share double")
    picked = rows.join(F.broadcast(lines), "lang").where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy().astype(np.int64)
            for i, j in runs(utf8_column(batch.column(0))[1]):
                buf, offs = _fold(batch.column(0).slice(i, j - i))
                codes, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
                for n in GRAMS:
                    first, last = _within(offs, n)
                    m = last - first
                    doc = np.repeat(np.arange(j - i), m)
                    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m)
                    codes.append(label[i + doc] << BUCKET_BITS | gram_buckets(buf, n)[at])
                    weights.append(1 / np.sqrt(m)[doc])  # a text's n-grams weigh as their share's root, so that long texts don't rule
                code, which = np.unique(np.concatenate(codes), return_inverse=True)
                yield pa.RecordBatch.from_pydict({"code": code, "n": np.bincount(which, np.concatenate(weights), len(code))})

    found = picked.select("text", "l").repartition(8).mapInArrow(count_grams, "code bigint, n double").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    grams, n = found.column("code").to_numpy(), found.column("n").to_numpy()
    label, bucket = grams >> BUCKET_BITS, grams & ((1 << BUCKET_BITS) - 1)
    whole = np.bincount(label, n, len(langs)) + SMOOTH * (1 << BUCKET_BITS)
    code = codewords(len(langs))
    sides = [(code == side) / np.maximum((code == side).sum(axis=0), 1) / whole[:, None] for side in (1, -1)]  # a language's part in the mean of its side
    order = np.argsort(bucket, kind="stable")
    weights, apart = np.zeros((1 << BUCKET_BITS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    for a in range(0, 1 << BUCKET_BITS, 1 << 12):
        part = order[slice(*np.searchsorted(bucket[order], [a, a + (1 << 12)]))]
        p, q = (np.full((1 << 12, code.shape[1]), SMOOTH) * side.sum(axis=0) for side in sides)
        for mean, side in ((p, sides[0]), (q, sides[1])):
            np.add.at(mean, bucket[part] - a, n[part, None] * side[label[part]])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where((p > 0) & (q > 0), np.log(p / q), 0.0)
        weights[a : a + (1 << 12)] = ratio
        apart += 0.5 * ((p - q) * ratio).sum(axis=0)  # symmetric divergence: how well the bit is told
    apart = np.where((code == code[0]).all(axis=0), 1.0, apart)
    return LanguageModel(langs, code, apart / apart.sum() * len(apart), weights)


def predict(text: Column, model: LanguageModel) -> Column:
    """struct<lang, score, ambiguous> of a text column."""

    @F.arrow_udf("struct<lang string, score double, ambiguous boolean>")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lang, score, unsure = model.predict(texts)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["lang", "score", "ambiguous"])
            release_memory()

    return decode(text)


def learn_from(docs: DataFrame, max_docs: int = 4000) -> LanguageModel:
    """The model of the registered query: rows of fold 2 of 4 are held out."""
    return fit(docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull()), max_docs=max_docs)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    coded = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), predict(F.col("text").cast("string"), model).alias("p"))
    return coded.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.ambiguous").alias("ambiguous"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_from(docs))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.34) -> DataFrame:
    """The documents in which a language can be told, with all their columns.

    Rejected are texts without a letter and those whose best codeword is no
    likelier than ``least``.
    """
    name = "__lang"
    while name in docs.columns:
        name = f"_{name}"
    marked = docs.withColumn(name, predict(F.col("text").cast("string"), model))
    return marked.where((F.col(f"{name}.lang") != UND) & (F.col(f"{name}.score") >= least)).drop(name)
