"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

#: Classes of a UTF-8 byte: 0 blank, 1 line end, 2 digit, 3 upper, 4 lower, 5 sentence mark, 6 beyond ASCII, 7 other mark.
KIND = np.full(256, 7, np.uint8)
KIND[[9, 11, 12, 32]] = 0
KIND[[10, 13]] = 1
KIND[48:58] = 2
KIND[65:91] = 3
KIND[97:123] = 4
KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
KIND[128:] = 6
KINDS = 8
MARKS = np.flatnonzero((KIND == 7) | (KIND == 5))
HASHED = 32
WIDTH = KINDS + KINDS * KINDS + HASHED + 10


def features(text: str | None) -> np.ndarray:
    """What the classifier sees of a whole text: shares of character classes, of their successions and of marks, and repetition.

    All zeros for null and empty texts.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    x = np.zeros(WIDTH, np.float32)
    if not raw:
        return x
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = KIND[data]
    n = len(data)
    x[:KINDS] = np.bincount(KIND, counts, KINDS) / n
    at = KINDS
    x[at : at + KINDS * KINDS] = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) / n
    at += KINDS * KINDS
    np.add.at(x[at : at + HASHED], MARKS % HASHED, counts[MARKS] / n)
    at += HASHED
    words, lines = raw.split(), [line for line in raw.split(b"\n") if line]
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    x[at:] = (
        np.log1p(n) / 12, np.log1p(k) / 12, lengths.mean() / 10, lengths.std() / 10, lengths.max() / 100,
        len(set(words)) / k, sum(map(bytes.__eq__, words, words[1:])) / k, len(set(zip(words, words[1:]))) / k,
        len(set(lines)) / max(len(lines), 1), np.log1p(k / max(len(lines), 1)) / 6,
    )
    return x


@dataclass
class Scorer:
    """A network of one hidden layer on standardised features; prior is the class prior that it was trained with."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 40, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Scorer:
    """Minimise the non-negative unbiased risk of a logistic loss.

    Risk: prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]), l(g) = log(1 + exp(-g)). Where the second term of
    a batch is below 0, its gradient is taken with the opposite sign.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate((positive, unlabelled)).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((v - mean) / scale, -8, 8) for v in (positive, unlabelled))
    d = p.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    steps = max(1, len(u) // batch)
    for step in range(epochs * steps):
        i, j = rng.integers(0, len(p), batch), rng.integers(0, len(u), batch)
        x = np.concatenate((p[i], u[j]))
        h = np.tanh(x @ theta[0] + theta[1])
        g = h @ theta[2] + theta[3][0]
        gp, gu = g[:batch], g[batch:]
        negative = softplus(gu).mean() - prior * softplus(gp).mean()
        if negative >= 0:
            dg = np.concatenate((-prior * sigmoid(-gp) - prior * sigmoid(gp), sigmoid(gu))) / batch
        else:
            dg = np.concatenate((prior * sigmoid(gp), -sigmoid(gu))) / batch
        dh = np.outer(dg, theta[2]) * (1 - h * h)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ dg, np.array([dg.sum()])]
        pace = rate * (1 - step / (epochs * steps)) + 1e-5
        for k, (t, grad) in enumerate(zip(theta, grads)):
            grad = grad + decay * t
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            t -= pace * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.999 ** (step + 1))) + 1e-8)
    return Scorer(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """The share of positives among the unlabelled: the least ratio of unlabelled to positive mass above a threshold.

    Above a threshold where hardly a negative scores, unlabelled mass = prior * positive mass. A first network, trained
    on one half to tell the positives from the unlabelled, scores the other half; thresholds that keep less than a
    quarter of the positives are too noisy to count.
    """
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    first = fit(positive[p[::2]], unlabelled[u[::2]], 0.5, epochs=15, seed=seed)
    sp, su = np.sort(first.margin(positive[p[1::2]])), np.sort(first.margin(unlabelled[u[1::2]]))
    at = np.quantile(sp, np.linspace(0.02, 0.75, 60))
    above_p = 1 - np.searchsorted(sp, at) / len(sp)
    above_u = 1 - np.searchsorted(su, at) / len(su)
    return float(np.clip((above_u / above_p).min(), 0.05, 0.98))


def feature_rows(docs: DataFrame) -> DataFrame:
    """(u, x): the features of each text, beside the number _u that the row was drawn by."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"u": frame["_u"], "x": [features(t).tolist() for t in frame["text"]]})

    return docs.select("_u", "text").mapInPandas(of, "u double, x array<float>")


def train(docs: DataFrame, positive_ids: DataFrame, eligible: Column, positives: int = 6000, unlabelled: int = 12000, prior: float | None = None) -> Scorer | None:
    """Fit a scorer on bounded samples: at most the given numbers of rows of trusted positives and of unlabelled documents.

    positive_ids: doc_id of the trusted documents. Only documents for which eligible holds are used. Both samples are
    those of smallest hash of doc_id, so reruns agree. None where either has fewer than 10.
    """
    u = unit_hash(F.col("doc_id"), 41)

    def share(n: int, want: int) -> float:
        return 1.0 if n <= want else 1.2 * want / n

    ids = positive_ids.where(eligible).select("doc_id").distinct()
    few = ids.where(u < share(ids.count(), positives)).orderBy(u, "doc_id").limit(positives)  # bounded, so it may be broadcast
    pool = docs.where(eligible)
    some = pool.where(u < share(pool.count(), unlabelled))

    def sampled(rows: DataFrame, n: int) -> np.ndarray:
        got = feature_rows(rows.withColumn("_u", u)).limit(2 * n).toArrow()  # some 1.2 n rows at most, unless ids repeat
        x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        return x[np.argsort(got["u"].to_numpy(), kind="stable")[:n]]

    p, q = sampled(pool.join(F.broadcast(few), "doc_id", "left_semi"), positives), sampled(some, unlabelled)
    if min(len(p), len(q)) < 10:
        return None
    return fit(p, q, prior or estimate_prior(p, q))


def score(docs: DataFrame, scorer: Scorer | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of each row of docs, in one pass over whole texts; without a scorer every score is 0.5.

    Null and empty texts are scored as texts without any feature. Nothing but the text enters the score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for frame in frames:
            x = np.array([features(t) for t in frame["text"]], np.float32).reshape(len(frame), WIDTH)
            s = model.score(x) if model else np.full(len(frame), 0.5)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": s})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(of, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, scorer: Scorer | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least threshold, with the columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def of(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], np.float32).reshape(len(texts), WIDTH)
        return pd.Series(sent.value.score(x) if sent.value else np.full(len(texts), 0.5))

    return docs.where(F.pandas_udf(of, "double")("text") >= threshold)
