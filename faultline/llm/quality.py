"""Quality of texts by positive-unlabelled learning.

Trusted texts of good quality are the positives, all documents are unlabelled:
a mixture of good and bad texts in unknown shares.  With a class prior p the
risk of a classifier f on good and bad texts can be written with these two
alone, p E+[l(f)] + max(0, E[l(-f)] - p E+[l(-f)]): the difference is the risk
on bad texts, unbiased and kept from going below zero.  With the logistic loss
and a linear f it is convex, and a Newton step needs only sums over documents,
which every partition adds up for itself; so all documents take part in every
step and the driver sees a vector and a matrix of fixed size.

The prior is estimated first: a classifier of positives against unlabelled
texts ranks all of them, and among its top shares the smallest ratio of
unlabelled to positive texts is the share of good texts, since the top of the
ranking holds hardly any bad ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.language import fold
from faultline.llm.shared import bounded_batches, discard, release, slices, table, text_buffer, written
from faultline.llm.words import word_hashes

_CLASSES = np.zeros(256, np.int64)  # 0: anything else
_CLASSES[97:123] = 1
_CLASSES[65:91] = 2
_CLASSES[48:58] = 3
_CLASSES[[9, 11, 12, 13, 32]] = 4
_CLASSES[10] = 5
_CLASSES[[46, 44]] = 6
_CLASSES[[33, 63, 59, 58, 39, 34, 40, 41, 45]] = 7
_CLASSES[[35, 36, 37, 38, 42, 64, 94, 126, 43, 61, 95]] = 8
_CLASSES[[124, 60, 62, 91, 93, 123, 125, 47, 92]] = 9
_CLASSES[128:] = 10
_N_CLASSES = 11
#: shares count as they are and, as small ones matter too, saturated at this
SMALL = 0.02
#: bytes of text looked at together
SLICE = 4 << 20
#: most steps of Newton's method and the change of the risk that ends them; a
#: ridge, and what few positives need more of it in the ranking
STEPS, SETTLED, RIDGE, FEW = 14, 1e-6, 1e-4, 8
#: bins of the ranking, least share of positives in its top for an estimate,
#: deviations by which a share of few positives may stray
BINS, LEAST_TOP, DEVIATIONS = 2048, 0.5, 3.0


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a buffer, the first of them 1."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    of = np.repeat(np.arange(n), sizes)
    counts = np.bincount(of * _N_CLASSES + _CLASSES[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES).astype(float)
    words, first, starts, ends = word_hashes(data, offsets)
    number = np.diff(first).astype(float)
    text = np.repeat(np.arange(n), np.diff(first))
    at_least = np.maximum(number, 1)
    # distinct words and the most frequent one, by runs of equal (text, word)
    order = np.lexsort((words, text))
    w, t = words[order], text[order]
    new = np.append(True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])) if len(w) else np.zeros(0, bool)
    runs = np.diff(np.append(np.flatnonzero(new), len(w)))
    most = np.zeros(n)
    np.maximum.at(most, t[new], runs)
    distinct = np.bincount(t[new], minlength=n)
    # neighbours that are equal, words that end in no letter or digit, capitals
    again = np.bincount(text[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])], minlength=n) if len(words) > 1 else np.zeros(n)
    last = _CLASSES[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    marked = np.bincount(text[np.isin(last, (0, 7, 8, 9))], minlength=n)
    lone = np.bincount(text[(ends - starts == 1) & np.isin(last, (0, 6, 7, 8, 9))], minlength=n)
    capital = np.bincount(text[_CLASSES[data[starts]] == 2], minlength=n) if len(starts) else np.zeros(n)
    length = np.bincount(text, ends - starts, minlength=n) / at_least
    shares = [counts[:, k] / np.maximum(sizes, 1) for k in range(_N_CLASSES)]
    shares += [most / at_least, again / at_least, marked / at_least, lone / at_least, capital / at_least]
    # fewer words are more often distinct: against the square root of their number
    spread = distinct / np.sqrt(at_least)
    columns = [np.ones(n), number == 0, np.log1p(number), np.minimum(number, 50) / 50, np.minimum(number, 200) / 200, distinct / at_least, np.log1p(spread), np.minimum(length, 20) / 10, np.log1p(np.abs(length - 6))]
    return np.column_stack(columns + shares + [np.minimum(s, SMALL) / SMALL for s in shares])


FEATURES = text_features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]

_UNLABELLED, _POSITIVE = 0, 1


def _featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): a row of features for each row of documents."""
    bounded_batches(docs.sparkSession)

    def emit(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                x = text_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).astype(np.float32)
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), x], names=["doc_id", "x"])
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(emit, "doc_id long, x array<float>")


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * f))


def softplus(f: np.ndarray) -> np.ndarray:
    return np.maximum(f, 0) + np.log1p(np.exp(-np.abs(f)))


def newton_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, losses against either class, sum of x, gradient and curvature
    of the loss against the bad class, one after the other."""
    f = x @ w
    s = sigmoid(f)
    curve = (x * (s * (1 - s))[:, None]).T @ x
    return np.concatenate(([len(x), softplus(-f).sum(), softplus(f).sum()], x.sum(axis=0), s @ x, curve.ravel()))


class _Sums:
    """Means over a set of documents of what ``newton_sums`` adds up."""

    def __init__(self, total: np.ndarray):
        self.n = total[0]
        total = total / max(self.n, 1)
        self.as_good, self.as_bad = total[1], total[2]
        self.x, self.gradient = total[3 : 3 + FEATURES], total[3 + FEATURES : 3 + 2 * FEATURES]
        self.curve = total[3 + 2 * FEATURES :].reshape(FEATURES, FEATURES)


def _added(rows: DataFrame, sums, width: int) -> list[np.ndarray]:
    """What ``sums`` gives for matrices of features, added up for unlabelled
    and positive rows.  A task sends ``width`` numbers of each; they are added
    in Spark, so the driver gets as many whatever the number of tasks."""

    def emit(batches):
        total = np.zeros((2, width))
        for batch in batches:
            x, positive = _matrix(batch), batch.column("positive").to_numpy()
            for kind in np.unique(positive):
                total[kind] += sums(x[positive == kind])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "value"])

    out = np.zeros(2 * width)
    for at, value in rows.mapInArrow(emit, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return list(out.reshape(2, width))


def prior_of(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """Share of good texts among unlabelled ones from the two histograms of a
    ranking: the least ratio of the shares that lie in a top part of it, where
    a part with few positives has to be lower by what chance allows."""
    u, p = (np.cumsum(x[::-1]) / max(x.sum(), 1) for x in (unlabelled, positive))
    top = p >= min(LEAST_TOP, p.max())
    ratio = u[top] / p[top]
    stray = DEVIATIONS * ratio * np.sqrt((1 - p[top]) / (p[top] * max(positive.sum(), 1)))
    return float(min(max(ratio[np.argmin(ratio + stray)], 0.01), 0.99))


def _descend(sums_at, risk) -> np.ndarray:
    """Damped Newton: ``risk`` gives value, gradient and curvature of sums or
    None where the risk on bad texts would be negative; such a step and one
    that doesn't lower the risk is halved."""
    w, step = np.zeros(FEATURES), np.zeros(FEATURES)
    best, value = w, np.inf
    for _ in range(STEPS):
        now = risk(w, *sums_at(w))
        if now is None or not now[0] < value:
            step = step / 2
            w = best + step
            continue
        settled = value - now[0] < SETTLED * abs(now[0])
        best, value = w, now[0]
        if settled:
            break
        step = -np.linalg.solve(now[2], now[1])
        w = best + step
    return best


class Quality:
    """Weights of the features, and the estimated share of good texts."""

    def __init__(self, weights: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights)


def fit(rows: DataFrame) -> Quality:
    """Fits on all rows (x, positive: 1, or 0 for unlabelled).  Without rows of
    either kind every text scores 0.5."""
    width = 3 + 2 * FEATURES + FEATURES * FEATURES
    seen: dict[str, float] = {}

    def sums_at(w: np.ndarray) -> list[_Sums]:
        return [_Sums(x) for x in _added(rows, lambda x: newton_sums(x, w), width)]

    def ranking(w, u, p):  # positives against unlabelled texts, of equal weight
        seen.update(u=u.n, p=p.n)
        if not u.n or not p.n:
            return 0.0, np.zeros(FEATURES), np.eye(FEATURES)
        ridge = RIDGE + FEW / p.n
        value = (p.as_good + u.as_bad) / 2 + ridge * (w @ w) / 2
        return value, (u.gradient + p.gradient - p.x) / 2 + ridge * w, (u.curve + p.curve) / 2 + ridge * np.eye(FEATURES)

    against = _descend(sums_at, ranking)
    if not seen["u"] or not seen["p"]:
        return Quality(np.zeros(FEATURES), 0.5)
    u, p = _added(rows, lambda x: np.bincount(np.minimum((sigmoid(x @ against) * BINS).astype(int), BINS - 1), minlength=BINS), BINS)
    prior = prior_of(u, p)

    def risk(w, u, p):
        bad = u.as_bad - prior * p.as_bad
        if bad < 0:
            return None
        ridge = RIDGE + 1 / p.n
        # the loss against good less that against bad is -f: linear on positives
        return prior * p.as_good + bad + ridge * (w @ w) / 2, u.gradient - prior * p.x + ridge * w, u.curve + ridge * np.eye(FEATURES)

    return Quality(_descend(sums_at, risk), prior)


def score_quality(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents.

    Positives are the documents with a label of quality 1 outside the held-out
    fold, a document that has several labels being one if any of them says so;
    unlabelled are all documents.  Null texts are empty, an empty text has its
    features like any other; rows that repeat an id count each; a null id has
    no label and is in no fold.  Without positives every score is 0.5; without
    documents there is no row.  Whole texts are read however long; other
    columns, whatever their names, are ignored.
    """
    featured = written(_featured(docs), "quality-features")
    trusted = labels.where((F.col("quality") == 1) & (fold("doc_id", folds) != held_out)).select(F.col("doc_id").cast("long"))
    positives = written(featured.join(trusted, "doc_id", "left_semi").select("x"), "quality-positives")
    rows = featured.select("x", F.lit(_UNLABELLED).alias("positive")).union(positives.select("x", F.lit(_POSITIVE).alias("positive")))
    model = fit(rows)
    discard(positives)

    def emit(batches):
        for batch in batches:
            score = model.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = featured.mapInArrow(emit, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out
    fold (see ``score_quality`` for nulls, repeated rows and empty tables)."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
