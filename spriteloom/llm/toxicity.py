"""Toxicity by weak supervision (operator 10).

Voters are lexicon entries (words, and stems of 4 to 6 letters that words begin
with) and patterns (shouting, exclamation marks, masked letters).  The lexicon is
mined from labelled training rows by log-odds.  A generative model then treats the
label as hidden: by expectation-maximisation it estimates the class prior and, for
every voter, how often it fires on either class; the correlations of the voters
given the class are estimated as well, and voters that say the same thing share
one vote.  The training labels are one more voter, trusted but not certain.  The
posterior labels train a linear classifier over the corpus vocabulary, whose scores
are calibrated (Platt) across folds of the training rows.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1, and of
those from at most ``SAMPLE`` in hash order; every row's whole text is scored.
Labels, lang, source and doc_id are no inputs of a score.

Scale.  The sample's ids are broadcast (their number is bounded), its texts stay
on the executors: the driver gets sorted 20-bit feature numbers.  Scoring is one
map over the texts with a broadcast table of at most ``FEATURES`` weights.

Edge cases: null and empty texts have no features and get the score of an empty
text; rows without a label are scored like others; of several labels of a document
the highest counts; a null doc_id is not held out and never trained on; without
labels of both classes every score is 0; repeated rows are each scored; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, platt

SAMPLE = 12_000
VOTERS = 200
FEATURES = 4000
#: G statistics (chi-square with one degree of freedom) from which a feature votes, and enters the classifier.
SURE, USEFUL = 15.0, 8.0
STEMS = (4, 5, 6)
BUCKETS = 1 << 20
THRESHOLD = 0.7
SEED = 10
WORD = re.compile(r"[^\W\d_]+")
#: Feature numbers of the patterns; words and stems lie above them.
PATTERNS = ("shouting", "exclaiming", "masked")
LONGEST_WORD = 64


def word_features(word: str) -> list[int]:
    """Feature numbers of a lower-case word and its stems."""
    forms = [word] + [word[:k] + "*" for k in STEMS if len(word) > k]
    return [len(PATTERNS) + zlib.crc32(f.encode("utf-8", "surrogatepass")) % (BUCKETS - len(PATTERNS)) for f in forms]


def pattern_features(text: str, words: list[str]) -> list[int]:
    out = []
    if len(words) >= 3 and 2 * sum(map(str.isupper, words)) > len(words):
        out.append(0)
    if text.count("!") * 40 > max(len(text), 80):
        out.append(1)
    if re.search(r"[A-Za-z][*#@$%]+[A-Za-z]", text):
        out.append(2)
    return out


class Features(dict):
    """Word -> its feature numbers (only wanted ones, if given); forgets when it has grown large."""

    def __init__(self, wanted: frozenset[int] | None = None, most: int = 500_000):
        super().__init__()
        self.wanted, self.most = wanted, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.most:
            self.clear()
        found = word_features(word)
        out = tuple(found if self.wanted is None else [f for f in found if f in self.wanted])
        if len(word) <= LONGEST_WORD:  # longer ones are not worth the memory
            self[word] = out
        return out

    def of(self, text: str) -> set[int]:
        words = WORD.findall(text)
        found = set(pattern_features(text, words))
        for word in set(map(str.lower, words)):
            found.update(self[word])
        return found if self.wanted is None else found & self.wanted


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, trust: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of ``votes`` (rows x voters, 0/1), rates on either class, and each voter's share after its correlations.

    The given labels are one voter among the others, of accuracy ``trust``; they keep the hidden classes from changing their meaning.
    """
    n = len(votes)
    given = np.where(labels, 1, -1) * np.log(trust / (1 - trust))
    q = np.where(labels, trust, 1 - trust)
    share = np.ones(votes.shape[1])
    hit = miss = None
    for step in range(rounds):
        hit, miss = (votes.T @ q + 0.5) / (q.sum() + 1), (votes.T @ (1 - q) + 0.5) / (n - q.sum() + 1)
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        if step % 5 == 0:
            rest = votes - (np.outer(q, hit) + np.outer(1 - q, miss))
            spread = np.sqrt((rest**2).mean(0)) + 1e-6
            like = (rest.T @ rest) / n / np.outer(spread, spread)
            np.fill_diagonal(like, 0)
            share = 1 / (1 + np.where(like > 0.1, like, 0).sum(1))
        z = np.log(prior / (1 - prior)) + given + votes @ (share * np.log(hit / miss)) + (1 - votes) @ (share * np.log((1 - hit) / (1 - miss)))
        q = sigmoid(z)
    return q, hit, miss, share


def logistic(rows: list[np.ndarray], target: np.ndarray, width: int, steps: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier on 0/1 features, by Adam on the whole batch."""
    index = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(width + 1), 0.0
    m, s = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[index], len(rows)) + w[width]
        d = (sigmoid(z) - target) / len(rows)
        g = np.bincount(index, d[row], width + 1) + penalty * w
        g[width] = d.sum()
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    b = float(w[width])
    return w[:width], b


def information(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's log-odds, and the G statistic of its association with the label."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    n, seen = n_pos + n_neg, pos + neg
    g = np.zeros(len(pos))
    for count, total, side in ((pos, n_pos, seen), (neg, n_neg, seen), (n_pos - pos, n_pos, n - seen), (n_neg - neg, n_neg, n - seen)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(count > 0, 2 * count * np.log(count * n / (total * side)), 0)
    return odds, g


def learn(rows: list[np.ndarray], toxic: np.ndarray, voters: int, features: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, weights and bias of a linear classifier trained on the label model's posterior."""
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, y in zip(rows, toxic, strict=True):  # a row names each feature once
        (pos if y else neg)[r] += 1
    odds, g = information(pos, neg, int(toxic.sum()), int((~toxic).sum()))
    ranked = np.lexsort((np.arange(BUCKETS), -g))
    sure = (pos >= 3) & (odds > 1) & (g >= SURE)
    lexicon = np.union1d(ranked[sure[ranked]][:voters], np.arange(len(PATTERNS)))
    place = np.full(BUCKETS, -1)
    place[lexicon] = np.arange(len(lexicon))
    votes = np.zeros((len(rows), len(lexicon)), np.float32)
    for i, r in enumerate(rows):
        at = place[r]
        votes[i, at[at >= 0]] = 1
    posterior, *_ = label_model(votes, toxic)
    useful = (pos + neg >= 3) & (g >= USEFUL)
    chosen = np.union1d(ranked[useful[ranked]][:features], lexicon)
    place[:] = -1
    place[chosen] = np.arange(len(chosen))
    w, b = logistic([p[p >= 0] for p in (place[r] for r in rows)], posterior, len(chosen))
    return chosen, w, b


def fit(rows: list[np.ndarray], toxic: np.ndarray, voters: int = VOTERS, features: int = FEATURES, folds: int = 3, seed: int = SEED) -> dict | None:
    """The weights of the calibrated classifier by feature number, or None without both classes.

    The calibration uses scores that rows get from classifiers trained on the other folds.
    """
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        return None
    chosen, w, b = learn(rows, toxic, voters, features)
    fold = np.random.default_rng(seed).permutation(len(rows)) % folds
    out = np.zeros(len(rows))
    weight = np.zeros(BUCKETS)
    for k in range(folds):
        own = fold != k
        if toxic[own].any() and not toxic[own].all():
            some, v, c = learn([r for r, o in zip(rows, own, strict=True) if o], toxic[own], voters, features)
        else:
            some, v, c = chosen, w, b
        weight[:] = 0
        weight[some] = v
        for i in np.flatnonzero(~own):
            out[i] = weight[rows[i]].sum() + c
    a, c = platt(out, toxic.astype(float))
    return {"weights": {int(f): float(a * v) for f, v in zip(chosen, w, strict=True) if abs(v) > 1e-6}, "bias": a * b + c}


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """The features and labels of the sampled training rows."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(remainder() != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = bounded_sample(known, ["doc_id"], sample, SEED).collect()
    if not ids:
        return [], np.empty(0)
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in ids], "__id long, toxic int")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [np.array(sorted(features.of(t.as_py() or "")), np.int32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "toxic", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic").mapInArrow(kernel, "doc_id long, toxic int, features binary")
    got = sorted((r["doc_id"], r["toxic"], bytes(r["features"])) for r in rows.collect())
    return [np.frombuffer(f, np.int32) for _, _, f in got], np.array([t for _, t, _ in got])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    rows, toxic = training_rows(docs, labels, sample)
    model = fit(rows, toxic) if len(toxic) else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(frozenset(model["weights"])) if model else None
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if model:
                weight = model["weights"]
                z = [sum(weight[f] for f in sorted(features.of(t.as_py() or ""))) + model["bias"] for t in batch.column(1)]
                scores = sigmoid(np.array(z))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(kernel, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
