"""Operator 1: a quality classifier learnt from positives and unlabelled text.

Non-negative positive-unlabelled learning: a one-hidden-layer network minimises

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

with the logistic loss, so its sigmoid estimates the probability that a text is good. Negatives are
never read. The class prior is estimated first, from a positive-versus-unlabelled classifier's
scores on a held-back half (the smallest ratio of unlabelled to positive mass above a threshold).

Unlabelled texts are drawn from all texts outside the held-out fold, whether or not a label says more of them: so
they stand for the whole, as the risk needs it, and tables with few or only labelled texts are no special case.

Only the fit is bounded (FIT_POSITIVES and FIT_UNLABELLED rows, chosen by a hash of the key);
every text is scored whole. Of rows with one key the smallest text is learnt from.

Defined cases: a null text counts as empty; an empty text gets the score of its (zero) statistics;
repeated rows are each scored; null keys are scored, and are in the held-out fold that crc32 of the
empty string gives; labels with null quality are ignored; without any positive label outside the held-out fold
there is nothing to learn from, and every score is 0.5; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fold, small_batches, table

FIT_POSITIVES, FIT_UNLABELLED = 6000, 12000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 200, 512, 3e-3, 1e-3, 20
KEEP_FROM = 0.3
MARKS = string.punctuation.encode()
ENDS = re.compile(r"[^\w\s]+$", re.M)


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; none depends on its key, language or source."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(data))
    seen = np.bincount(data, minlength=256)
    said = text.split()
    k = max(1, len(said))
    often = Counter(said)
    lines = [x for x in text.split("\n") if x.strip()]
    rows = max(1, len(lines))
    lengths = np.fromiter(map(len, said), np.int64, len(said))
    marked = sum(not w[-1].isalnum() for w in said)
    strange = sum(not (w[0].isalnum() or w[-1].isalnum()) for w in said)
    same = sum(a == b for a, b in zip(said, said[1:]))
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    per_word = lambda c: float(np.log1p(100 * seen[ord(c)] / k))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(said))), float(lengths.mean()) if len(said) else 0.0, float(lengths.std()) if len(said) else 0.0,
        seen[65:91].sum() / letters, seen[48:58].sum() / n, seen[128:].sum() / n, seen[MARKS_AT].sum() / n, seen[10] / n * 10,
        len(often) / k, max(often.values(), default=0) / k, same / k, marked / k, strange / k, len(set(lines)) / rows, float(np.log1p(len(said) / rows)),
        sum(x[-1] in ".!?" for x in lines) / rows, sum(w.isupper() for w in said) / k,
        *(per_word(c) for c in "!#$%&*,.|<>\"'-:;?@_=+/()"),
    ]


MARKS_AT = list(MARKS)
WIDTH = len(statistics("a"))


def features(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, WIDTH)


@dataclass
class Network:
    """Standardised statistics, one tanh layer and a logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -30, 30)))


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk, with loss(f) = log(1 + exp(-f)): of the positives, and of the negatives, which the unlabelled
    without their positives estimate and which counts as zero where it falls below."""
    return prior * float(np.logaddexp(0, -fp).mean()), float(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())


def slopes(fp: np.ndarray, fu: np.ndarray, prior: float | None) -> np.ndarray:
    """Of the risk by each logit. Where the negatives' part is below zero, those of that part with its sign turned: a step back
    up. prior None: of the ordinary logistic loss."""
    if prior is None:
        return np.concatenate([-sigmoid(-fp) / len(fp), sigmoid(fu) / len(fu)])
    if risk(fp, fu, prior)[1] >= 0:
        return np.concatenate([prior * (-sigmoid(-fp) - sigmoid(fp)) / len(fp), sigmoid(fu) / len(fu)])
    return np.concatenate([prior * sigmoid(fp) / len(fp), -sigmoid(fu) / len(fu)])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Network:
    """prior None: an ordinary positive-versus-unlabelled fit, for estimating the prior."""
    rng = np.random.default_rng(SEED)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    shape = (WIDTH, HIDDEN)
    theta = [rng.normal(0, 1 / np.sqrt(WIDTH), shape), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], 0
    for _ in range(EPOCHS):
        up, uu = rng.permutation(len(p)), rng.permutation(len(u))
        for at in range(0, len(u), BATCH):
            iu = uu[at : at + BATCH]
            ip = up[np.arange(at, at + BATCH) % len(up)]
            x = np.concatenate([p[ip], u[iu]])
            hidden = np.tanh(x @ theta[0] + theta[1])
            f = hidden @ theta[2] + theta[3]
            slope = slopes(f[: len(ip)], f[len(ip) :], prior)
            back = np.outer(slope, theta[2]) * (1 - hidden**2)
            grads = [x.T @ back + DECAY * theta[0], back.sum(0), hidden.T @ slope + DECAY * theta[2], np.array([slope.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                theta[i] = theta[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior or 0.5)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good texts in the unlabelled: the least ratio of mass above a threshold, with a margin for few rows."""
    net = fit(positive[::2], unlabelled[::2], None)
    behind = lambda x: x[1::2] if len(x) > 1 else x
    sp, su = np.sort(net.logit(behind(positive))), np.sort(net.logit(behind(unlabelled)))
    cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1 - np.searchsorted(su, cuts) / len(su)
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((qu + margin) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Fits on at most FIT_POSITIVES positives and FIT_UNLABELLED texts, all outside the held-out fold."""
    d = docs.select("doc_id", "text")
    keyed = labels.select("doc_id", "quality").where("quality is not null")
    chosen = (
        keyed.where((F.col("quality") == 1) & (fold(F.col("doc_id")) != 0)).select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_POSITIVES).withColumn("positive", F.lit(True))
    )
    free = (
        d.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(FIT_UNLABELLED).withColumn("positive", F.lit(False))
    )
    ids = chosen.unionByName(free)  # at most FIT_POSITIVES + FIT_UNLABELLED keys, so it may be broadcast

    def rows(batches):
        for b in batches:
            yield pd.DataFrame({"positive": b.positive, "x": list(features(b.text))})

    picked = d.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    got = picked.select("text", "positive").mapInPandas(rows, "positive boolean, x array<double>").toPandas()
    x = np.array(got.x.tolist(), np.float64).reshape(-1, WIDTH)
    order = np.lexsort(x.T)  # the rows come in any order
    x, positive = x[order], got.positive.to_numpy(bool)[order]
    mix = np.random.default_rng(SEED).permutation(len(x))
    x, positive = x[mix], positive[mix]
    if not positive.any() or positive.all():
        return None
    prior = estimate_prior(x[positive], x[~positive])
    return fit(x[positive], x[~positive], prior)


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and score of every row."""

    def rows(batches):
        for b in batches:
            s = net.score(features(b.text)) if net else np.full(len(b), 0.5)
            yield pd.DataFrame({"doc_id": b.doc_id, "score": s})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInPandas(rows, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier keeps, with the columns that docs has."""
    net = train(docs, labels)

    def rows(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array((net.score(features(pd.Series(texts, dtype=object))) if net else np.full(len(texts), 0.5)) >= KEEP_FROM))

    return small_batches(docs).mapInArrow(rows, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
