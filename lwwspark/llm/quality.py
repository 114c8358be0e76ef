"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the whole corpus is unlabelled web text, a mixture in which the share of
positives is the class prior. A linear model z of style and content features is fitted by minimising the non-negative
unbiased risk of the logistic loss, ``prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0))``.
As log(1 + e^-z) = log(1 + e^z) - z, that is the larger of two convex functions, ``prior * R(positives as 1)`` and
``E_unlabelled log(1 + e^z) - prior * E_positives z``: Newton's method finds the minimum of a mixture of both, and the
mixture is all of the second unless its negative part were below zero there, else bisection finds the one where it is zero.

The prior is estimated from the data by best-bin estimation: a classifier tells positives from unlabelled text; where its
highest scores lie, nearly all unlabelled documents are positives too, and the ratio of both sets' shares above a score,
at the score where its confidence bound is lowest, less one standard error, is the prior. It is fitted on one half and read off the other.

Fitting uses every row: features are written once, and each step of Newton's method sums them up where they are (one row
of sums a partition, added up in two rounds). No row is sampled. Rows whose crc32(id) mod 5 is 0 are never learned from,
nor are rows without an id. Labels, lang, source and id are never inputs of a score, and texts are read whole.

Defined results: a null text counts as empty, and a text without words scores 0. Without any trusted positive every other
text scores 0.5. Repeated rows get equal results. A document with several labels is a positive if one of them is 1; labels
whose quality is null don't count. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_small_batches, cut, fold_of, forget, fresh

THRESHOLD = 0.3
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GRAMS = 64
STYLE = ("repeats", "variety", "capitals", "digits", "foreign", "length", "lines", "words", *MARKS)
NAMES = (*STYLE, *(f"gram{i}" for i in range(GRAMS)))
WIDTH = len(NAMES)
#: Weights of the squares of weights (style, content), Newton steps and mixtures at most, how near zero
#: the negative part must come, bins of the prior's estimate and
#: partitions whose sums the driver adds up itself.
STYLE_DECAY, CONTENT_DECAY, STEPS, MIXTURES, CLOSE, BINS, SUMS = 0.01, 0.3, 25, 20, 1e-3, 256, 64
_DECAY = np.array([STYLE_DECAY] * len(STYLE) + [CONTENT_DECAY] * GRAMS + [0.0])
_MARK = np.frombuffer(MARKS.encode(), np.uint8)


def features(text: str | None) -> np.ndarray:
    """Style of a text, and shares of its hashed letter trigrams (bytes, A-Z lower-cased); zeros if it has no words."""
    out = np.zeros(WIDTH)
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if n:
        at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, lower, foreign = at[65:91].sum(), at[97:123].sum(), at[128:].sum()
        letters = upper + lower + foreign + 1
        out[0] = sum(map(operator.eq, words, words[1:])) / n
        out[1] = len(set(words)) / n
        out[2] = upper / letters
        out[3] = at[48:58].sum() / n
        out[4] = foreign / letters
        out[5] = np.log1p(letters / n)
        out[6] = at[10] / n
        out[7] = np.log1p(n) / 10
        out[8 : len(STYLE)] = np.minimum(at[_MARK] / n, 4)
        b = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
        if len(b) > 2:
            hashed = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(26)
            out[len(STYLE) :] = np.bincount(hashed, minlength=GRAMS) / len(hashed)
        out[:5] = np.sqrt(out[:5])
        out[8:] = np.sqrt(out[8:])
    return out


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias
    prior: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and a one."""
        return np.column_stack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0 for texts without words."""
        return np.where(x.any(axis=1), 1 / (1 + np.exp(-np.clip(self.rows(x) @ self.weights, -60, 60))), 0.0)


def matrix(column: pa.Array) -> np.ndarray:
    """Packed features, none null, as rows."""
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros((0, WIDTH))
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.float32).astype(np.float64).reshape(-1, WIDTH)


class Rows:
    """Training rows (positive, half, x), and sums over them."""

    def __init__(self, frame: DataFrame):
        self.frame, self.deep = frame, frame.rdd.getNumPartitions() > SUMS

    def summed(self, sums_of, width: int) -> np.ndarray:
        """2 x width: sums of ``sums_of(x, half)`` over the rows that aren't positives, and over those that are."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, width))
            for batch in batches:
                positive, half, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), matrix(batch.column(2))
                for k in (0, 1):
                    at = positive == bool(k)
                    if at.any():
                        total[k] += sums_of(x[at], half[at])
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * width)
            for batch in batches:
                total += batch.column(0).flatten().to_numpy().reshape(-1, 2 * width).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = self.frame.mapInArrow(partial, "sums array<double>")
        if self.deep:
            parts = parts.repartition(SUMS).mapInArrow(added, "sums array<double>")
        return np.sum([r[0] for r in parts.collect()] or [np.zeros(2 * width)], axis=0).reshape(2, width)


def soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Means:
    """What the losses need of one set of rows at some weights: means of log(1 + e^z), z, and their derivatives."""

    soft: float
    linear: float
    soft_gradient: np.ndarray
    mean: np.ndarray
    curvature: np.ndarray


def means_at(rows: Rows, scorer: Scorer, w: np.ndarray, of_half: int | None) -> tuple[Means, Means]:
    """(of unlabelled, of positives)."""
    d = len(w)

    def sums_of(x, half):
        if of_half is not None:
            x = x[half == of_half]
        x = scorer.rows(x)
        z = x @ w
        s = sigmoid(z)
        return np.concatenate([[len(x), soft(z).sum(), z.sum()], x.T @ s, x.sum(axis=0), ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

    def means(t):
        n = max(1.0, t[0])
        return Means(t[1] / n, t[2] / n, t[3 : 3 + d] / n, t[3 + d : 3 + 2 * d] / n, t[3 + 2 * d :].reshape(d, d) / n)

    total = rows.summed(sums_of, 3 + 2 * d + d * d)
    return means(total[0]), means(total[1])


def minimise(rows: Rows, scorer: Scorer, a: float, b: float, c: float, start: np.ndarray, of_half: int | None = None) -> tuple[np.ndarray, Means, Means]:
    """The minimum of a E_p log(1 + e^-z) + b E_u log(1 + e^z) - c E_p z + decay, by Newton's method with halved steps."""
    def at(w):
        u, p = means_at(rows, scorer, w, of_half)
        value = a * (p.soft - p.linear) + b * u.soft - c * p.linear + (_DECAY * w * w).sum() / 2
        return value, a * (p.soft_gradient - p.mean) + b * u.soft_gradient - c * p.mean + _DECAY * w, a * p.curvature + b * u.curvature + np.diag(_DECAY + 1e-9), u, p

    w, now = start, at(start)
    for _ in range(STEPS):
        move, size = np.linalg.solve(now[2], now[1]), 1.0
        while (new := at(w - size * move))[0] > now[0] + 1e-12 and size > 1e-3:
            size /= 2
        if new[0] <= now[0] + 1e-12:
            w, now = w - size * move, new
        if np.abs(size * move).max() < 1e-3:
            break
    return w, now[3], now[4]


def fit(rows: Rows, scorer: Scorer, prior: float) -> np.ndarray:
    """Weights at the minimum of the non-negative risk."""
    start = np.append(np.zeros(WIDTH), np.log(prior / (1 - prior)))

    def solved(t, w):  # the mixture of both functions with weight t on the second
        w, u, p = minimise(rows, scorer, (1 - t) * prior, t, t * prior, w)
        return w, u.soft - prior * p.soft

    w, negative = solved(1.0, start)
    # The negative part falls as t grows: false position, with halved ends, finds where it is zero.
    low, high, at_low, at_high = 0.0, 1.0, -negative, negative
    for _ in range(MIXTURES if negative < -CLOSE else 0):
        t = (low * at_high - high * at_low) / (at_high - at_low)
        w, here = solved(t, w)
        if abs(here) < CLOSE:
            break
        if here > 0:
            low, at_low, at_high = t, here, at_high / 2
        else:
            high, at_high, at_low = t, here, at_low / 2
    return w


def best_bin(positives: np.ndarray, unlabelled: np.ndarray, gamma: float = 0.01, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from both sets' counts in bins of ascending score.

    Less one standard error: the estimate errs upward, and a prior that is too high has negatives learned as positives.
    """
    n_p, n_u = positives.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    q_p, q_u = positives[::-1].cumsum() / n_p, unlabelled[::-1].cumsum() / n_u
    slack = (1 + gamma) * (np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p))
    there = q_p > 0
    best = np.argmin((q_u[there] + slack) / q_p[there])
    u, p = q_u[there][best], q_p[there][best]
    error = np.sqrt(u * (1 - u) / n_u + (u / p) ** 2 * p * (1 - p) / n_p) / p
    return float(np.clip(u / p - error, 0.02, 0.98))


def estimated_prior(rows: Rows, scorer: Scorer) -> float:
    w, _, _ = minimise(rows, scorer, 0.5, 0.5, 0.0, np.zeros(WIDTH + 1), of_half=0)

    def sums_of(x, half):
        z = scorer.rows(x[half == 1]) @ w
        return np.bincount(np.clip((z + 8) * (BINS / 16), 0, BINS - 1).astype(np.int64), minlength=BINS).astype(float)

    unlabelled, positives = rows.summed(sums_of, BINS)
    return best_bin(positives, unlabelled)


def _packed(text):
    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).astype(np.float32).tobytes() for t in batch], pa.binary())

    return run(text)


def score_of(scorer: Scorer, text):
    """Score of a text column."""

    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        rows = [features(t.as_py()).astype(np.float32) for t in batch]
        return pa.array(scorer.scores(np.array(rows, np.float64)) if rows else [], pa.float64())

    return run(text)


def _score_of_packed(scorer: Scorer, x):
    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array(scorer.scores(matrix(batch)), pa.float64())

    return run(x)


def featured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, learns (whether the row may be learned from), x (features as 32-bit numbers), written once."""
    learns = F.coalesce(fold_of(doc_id, 5) != 0, F.lit(False))
    return cut(by_small_batches(docs).select(F.col(doc_id).alias("doc_id"), learns.alias("learns"), _packed(F.col(text)).alias("x")))


def training_rows(table: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> tuple[DataFrame, DataFrame]:
    """(positive, half, x: every row that may be learned from as unlabelled, and the trusted positives once more; these alone)."""
    good = labels.where(F.col(label) == 1).select(F.col(doc_id).alias("of")).distinct()
    rows = table.where("learns").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    trusted = cut(rows.join(good, F.col("doc_id") == F.col("of"), "left_semi").select(F.lit(True).alias("positive"), "half", "x"))
    return rows.select(F.lit(False).alias("positive"), "half", "x").unionByName(trusted), trusted


def learn_from(rows: Rows) -> Scorer:
    """Fits the scorer to training rows."""
    first = rows.summed(lambda x, half: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 1 + 2 * WIDTH)
    n, n_p = first[0, 0], first[1, 0]
    if not n_p or not n:
        return Scorer(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), 0.5)
    mean = first[0, 1 : 1 + WIDTH] / n
    scorer = Scorer(mean, np.sqrt(np.maximum(first[0, 1 + WIDTH :] / n - mean * mean, 0)) + 0.02, np.zeros(WIDTH + 1), 0.5)
    scorer.prior = estimated_prior(rows, scorer)
    scorer.weights = fit(rows, scorer, scorer.prior)
    return scorer


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Scorer:
    """Fits the scorer; ``labels`` has the ids and 1 for good documents, anything else for others."""
    table = featured(docs, doc_id, text)
    rows, trusted = training_rows(table, labels, doc_id)
    scorer = learn_from(Rows(rows))
    forget(table, trusted)
    return scorer


def classify_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``THRESHOLD`` up) for every document."""
    table = featured(docs, doc_id, text)
    rows, trusted = training_rows(table, labels, doc_id)
    scorer = learn_from(Rows(rows))
    forget(trusted)
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    out = table.select("doc_id", held_out.alias("held_out"), _score_of_packed(scorer, F.col("x")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted 1. Columns stay."""
    mark = fresh(docs, "quality_score")
    marked = docs.withColumn(mark, score_of(learn(docs, labels), F.col("text")))
    return marked.where(F.col(mark) >= THRESHOLD).drop(mark)
