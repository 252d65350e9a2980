"""Toxicity by weak supervision (operator 8).

Many weak voters look at a text. Lexicon voters fire on a word or a word stem;
they come from a seed list and from the labelled training rows, where stems that
occur nearly only in toxic texts are found. Pattern voters fire on shouting,
runs of exclamation marks, masked letters and drawn-out letters. A generative
label model estimates by EM how often each voter fires on toxic and on clean
texts and how far voters still fire together within a class; a voter's word is
discounted by its correlations, so that a group counts about once, and both are
estimated in turn. The posteriors it gives are
the labels of a logistic classifier over the votes, kept near the label model's
own log ratios where there are few examples. The classifier scores every text.

Training reads a documented bounded sample: at most about ``max_toxic`` toxic and
``max_clean`` clean labelled rows, picked by a hash of the id, handled in one task
of an executor. Scoring reads whole texts.

Cases: a null or empty text has no votes and gets the score of such texts.
Without labelled rows of both classes, as in empty tables, only the seed lexicon
and the patterns vote. Labels that are null are not used. Repeated rows get equal
scores; if a document is labelled twice, each label is an example. A score of
exactly 0.5 is predicted toxic. Texts are read whole, whatever their length.
Other columns, whatever their names, are kept by keep_civil.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import crc_mod, release_memory, table
from orelode.llm.langid import _fold
from orelode.llm.textcore import SpanHasher, mix, runs, segment_sums, text_hash, utf8_column, word_spans

#: Mild insults that vote before anything is learned.
SEED_LEXICON = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting",
    "clown", "imbecile", "cretin", "vermin", "filth", "dimwit", "halfwit", "lowlife", "scumbag", "bastard",
    "dummkopf", "trottel", "abschaum", "versager", "widerlich", "crétin", "abruti", "imbécile", "connard", "ordure",
    "idiota", "imbécil", "estúpido", "basura", "escoria", "inútil",
)
STEMS = (4, 5, 6, 7, 8)
PATTERNS = 4
#: How often the label model takes a training label to be right, and the log odds by which silence of the whole lexicon speaks for clean.
GOLD_ACCURACY = 0.9
SILENT_ODDS = 4.0
_STEM_SALT = np.uint64(0x5851F42D4C957F2D)


def word_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words and of their stems, with the text that each is in."""
    starts, ends, at = word_spans(buf, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    hasher = SpanHasher(buf)
    keys, docs = [hasher.of(starts, ends)], [doc]
    for k in STEMS:
        longer = np.flatnonzero(ends - starts > k)
        keys.append(mix(hasher.of(starts[longer], starts[longer] + k) ^ _STEM_SALT))
        docs.append(doc[longer])
    return np.concatenate(keys), np.concatenate(docs)


def patterns(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts x PATTERNS booleans over the raw bytes."""
    n = len(offs) - 1
    if not len(buf):
        return np.zeros((n, PATTERNS), bool)
    inside = np.ones(len(buf), bool)
    inside[offs[1:-1][offs[1:-1] < len(buf)] - 1] = False
    inside[-1] = False
    nxt = np.append(buf[1:], np.uint8(0))
    third = np.append(nxt[1:], np.uint8(0))
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    signs = np.stack([upper, lower, inside & (buf == 33) & (nxt == 33), inside & lower & (nxt == 42), inside & np.append(inside[1:], False) & lower & (buf == nxt) & (buf == third)], axis=1)
    c = segment_sums(signs.astype(np.int32), offs)
    return np.stack([c[:, 0] > 0.6 * np.maximum(c[:, 0] + c[:, 1], 12), c[:, 2] > 2, c[:, 3] > 0, c[:, 4] > 0], axis=1)


@dataclass
class ToxicityModel:
    """Sorted voter keys and the classifier's weights; a few kilobytes."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(PATTERNS))  # of keys, then of patterns
    bias: float = 0.0
    accuracy: np.ndarray | None = None
    correlated: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def votes(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and voter that fired, each once."""
        width, k = len(self.weights), len(self.keys)
        keys, docs = word_keys(*_fold(col))
        may = np.flatnonzero(self.near[(keys >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.keys, keys[may])
        at[at == k] = 0
        hit = self.keys[at] == keys[may] if k else np.zeros(0, bool)
        code = np.unique(docs[may][hit] * width + at[hit])
        doc, pat = np.nonzero(patterns(*utf8_column(col)))
        code = np.concatenate([code, doc * width + k + pat])
        return code // width, code % width

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j in runs(utf8_column(texts)[1]):
            doc, voter = self.votes(texts.slice(i, j - i))
            out[i:j] = np.bincount(doc, self.weights[voter], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def copy_groups(buf: np.ndarray, offs: np.ndarray, salts: int = 3) -> np.ndarray:
    """For each text and salt, the smallest salted hash of its word pairs: copies mostly share them."""
    starts, ends, at = word_spans(buf, offs)
    h = SpanHasher(buf).of(starts, ends)
    pair = h.copy()
    pair[:-1] ^= mix(h[1:] + np.uint64(1))
    out = np.zeros((len(offs) - 1, salts), np.uint64)
    full = np.flatnonzero(at[1:] > at[:-1])
    for s in range(salts if len(full) else 0):
        out[full, s] = np.minimum.reduceat(mix(pair + np.uint64(s)), at[:-1][full])
    return out


def find_voters(texts: pa.Array, toxic: np.ndarray, least: int = 3, precision: float = 0.9) -> np.ndarray:
    """Keys of words and stems that occur nearly only in toxic texts.

    Copies of a text count once. A word needs support of ``least`` toxic texts that
    differ, or of as many more as keep the expected number of words that are found
    by chance under one half. All keys of that support and precision are taken.
    """
    total, base = Tally(), toxic.mean()

    def pairs_of(part: pa.Array, among: np.ndarray | None = None):
        """Keys, texts and the texts' copy groups; of clean texts only keys that may be found, as theirs are most."""
        keys, docs, groups, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.uint64)], 0
        for i, j in runs(utf8_column(part)[1]):
            folded = _fold(part.slice(i, j - i))
            key, doc = _unique_pairs(*word_keys(*folded))
            total.add(key)
            if among is not None:
                kept = np.isin(key, among)
                key, doc = key[kept], doc[kept]
            keys.append(key)
            docs.append(doc + first)
            groups.append(copy_groups(*folded))
            first += j - i
        return np.concatenate(keys), np.concatenate(docs), np.concatenate(groups)

    def support(key: np.ndarray, doc: np.ndarray, group: np.ndarray, texts_of: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys that so many texts hold, and in how many texts that differ."""
        found, n = np.unique(key, return_counts=True)
        found = found[n >= texts_of]
        held = np.isin(key, found)
        key, doc = key[held], doc[held]
        counts = [np.bincount(np.searchsorted(found, _unique_pairs(key, group[doc, s])[0]), minlength=len(found)) for s in range(group.shape[1])]
        return found, np.median(counts, axis=0)

    found, count = support(*pairs_of(texts.filter(pa.array(toxic))), least)
    found, count = found[count >= least], count[count >= least]
    others, often = support(*pairs_of(texts.filter(pa.array(~toxic)), found), 1)
    texts_with = total.counts()
    while (texts_with >= least).sum() * base**least > 0.5:
        least += 1
    clean = np.zeros(len(found))
    clean[np.searchsorted(found, others)] = often
    good = count >= least
    found, count, clean = found[good], count[good], clean[good]
    ratio = max(1.0, toxic.sum() / max(1, (~toxic).sum()))
    good = count / (count + clean * ratio + 0.25) >= precision
    found, count = found[good], count[good]
    return found[np.argsort(-count, kind="stable")]


class Tally:
    """How often each key was added; additions wait until they are as many as the keys."""

    def __init__(self):
        self.keys, self.n, self.waiting, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size > max(len(self.keys), 1 << 20):
            self.counts()

    def counts(self) -> np.ndarray:
        """The count of each distinct key, in order of keys."""
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        keys = np.union1d(self.keys, new)
        total = np.zeros(len(keys), np.int64)
        total[np.searchsorted(keys, self.keys)] = self.n
        total[np.searchsorted(keys, new)] += n
        self.keys, self.n = keys, total
        return total


def _unique_pairs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[first], doc[first]


def label_model(fires: np.ndarray, start: np.ndarray, gold: np.ndarray, prior: float, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Posteriors, the voters' log ratios after discounts, and the correlated groups.

    fires: texts x voters, the patterns last; start: first guess of the
    posteriors; gold: the training labels, one more voter of fixed accuracy. A
    voter that is silent abstains; a text on which no lexicon voter fires is
    taken for clean more often than not.
    """
    said = np.where(gold, 1, -1) * np.log(GOLD_ACCURACY / (1 - GOLD_ACCURACY))
    silent = ~fires[:, : fires.shape[1] - PATTERNS].any(axis=1)
    x, post = fires.astype(np.float64), start.astype(np.float64)
    weight, groups, ratio = np.ones(x.shape[1]), [], np.zeros(x.shape[1])
    for step in range(rounds):
        on = (x * post[:, None]).sum(axis=0) + 0.5
        off = (x * (1 - post[:, None])).sum(axis=0) + 0.05
        ratio = np.log(on / (post.sum() + 1)) - np.log(off / ((1 - post).sum() + 1))
        if step >= rounds // 2 and not step % 2:  # correlations that the class doesn't explain, in turn with the accuracies
            left = (x - np.outer(post, on / (post.sum() + 1)) - np.outer(1 - post, off / ((1 - post).sum() + 1))).astype(np.float32)
            scale = np.sqrt((left**2).sum(axis=0)) + 1e-9
            corr = (left.T @ left) / np.outer(scale, scale)
            weight = 1 / np.maximum(1, np.where(corr > 0.5, corr, 0).sum(axis=1))
            groups = [g.tolist() for row in corr > 0.5 if len(g := np.flatnonzero(row)) > 1]
        logit = x @ (ratio * weight) + said + np.log(prior / (1 - prior)) - SILENT_ODDS * silent
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, ratio * weight, groups


def logistic(x: np.ndarray, y: np.ndarray, around: np.ndarray, ridge: float = 0.05, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic fit to soft labels, shrunk towards ``around``, by damped Newton steps."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    centre = np.append(around, -2.0)
    w, pull = centre.copy(), np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        grad = xb.T @ (p - y) + pull * (w - centre)
        hess = (xb * (p * (1 - p))[:, None]).T @ xb + np.diag(pull + 1e-6)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 4 / (np.abs(move).max() + 1e-9))
    return w[:-1], float(w[-1])


def train(texts: pa.Array, toxic: np.ndarray) -> ToxicityModel:
    """Voters, label model and classifier from a sample."""
    seeds = np.array([text_hash(w.encode()) for w in SEED_LEXICON], np.uint64)
    both = toxic.any() and not toxic.all()
    mined = find_voters(texts, toxic) if both else np.zeros(0, np.uint64)
    keys = np.unique(np.concatenate([mined, seeds]))
    probe = ToxicityModel(keys, np.zeros(len(keys) + PATTERNS))
    fires = np.zeros((len(texts), len(probe.weights)), bool)
    for i, j in runs(utf8_column(texts)[1]):
        doc, voter = probe.votes(texts.slice(i, j - i))
        fires[doc + i, voter] = True
    if not both:
        return ToxicityModel(keys, np.append(np.full(len(keys), 3.0), np.zeros(PATTERNS)), -2.0)
    start = np.where(fires[:, :-PATTERNS].any(axis=1), 0.95, 0.05)
    post, ratio, groups = label_model(fires, start, toxic, prior=float(np.clip(toxic.mean(), 0.05, 0.5)))
    silent = ~fires.any(axis=0)
    around = np.where(silent, np.append(np.full(len(keys), 3.0), np.zeros(PATTERNS)), np.clip(ratio, -6, 6))
    w, b = logistic(fires.astype(np.float64), post, around)
    return ToxicityModel(keys, w, b, accuracy=ratio, correlated=groups)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 4500) -> ToxicityModel:
    """A model from labelled rows; the two numbers bound the expected size of the sample."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, (max_toxic if k else max_clean) / v) for k, v in count.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20))
    picked = known.where(draw < F.when(F.col("toxic"), share.get(True, 0.0)).otherwise(share.get(False, 0.0)) * (1 << 20))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.bool_())]))
        order = pc.sort_indices(got, [("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
        got = got.take(order).combine_chunks()
        texts = got.column("text").combine_chunks().cast(pa.large_string()) if got.num_rows else pa.array([], pa.large_string())
        model = train(texts, got.column("toxic").to_numpy().astype(bool) if got.num_rows else np.zeros(0, bool))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    one = rows.select(F.col("doc_id").cast("bigint"), "text", "toxic").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(one[0]["model"]) if one else train(pa.array([], pa.large_string()), np.zeros(0, bool))


def score(text: Column, model: ToxicityModel) -> Column:
    """Toxicity of a text column, 0 to 1."""

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(texts.cast(pa.large_string())))
            release_memory()

    return rate(text)


def learn_from(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the registered query: labels of fold 0 of 5 are held out."""
    return fit(docs, labels.where(crc_mod("doc_id", 5) != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = learn_from(docs, table(spark, sf_dir, "labels"))
    rated = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), score(F.col("text").cast("string"), model).alias("score"))
    return rated.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """The documents scored under ``limit``, with all their columns."""
    name = "__toxicity"
    while name in docs.columns:
        name = f"_{name}"
    return docs.withColumn(name, score(F.col("text").cast("string"), model)).where(F.col(name) < limit).drop(name)
