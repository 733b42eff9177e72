"""Quality classifier by positive-unlabelled learning.

The model is trained on trusted positives and on unlabelled documents; negative labels are never training examples. It
minimises the non-negative unbiased risk  p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])  with the sigmoid loss;
where the bracket falls below zero the step goes against its gradient, which is what keeps a flexible model from
overfitting the unlabelled part. The class prior p is estimated from positives and unlabelled documents alone: on the half
of both that a first model wasn't fitted on, it is the least ratio, over thresholds, of the unlabelled share above the
threshold to the positives' share, each with its confidence bound. Rows labelled 0 are never read.

Features describe the form of a whole text: frequencies of character-class pairs, repetition, compressibility, shape of
words and lines. Samples for training are bounded by parameters; every document is scored.

Defined results: null and empty texts get the score of the empty text; repeated rows get equal rows; ids may be null;
without usable labels every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import own_columns
from lattica.llm.labelled import fold, sampled

FOLDS, HELD = 3, 1
POSITIVES, UNLABELLED = 4000, 8000
KINDS = 10
HIDDEN = 16


def _kinds() -> np.ndarray:
    kind = np.full(256, 8, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 0, 1, 2
    for c in b" \t\x0b\x0c\r":
        kind[c] = 3
    kind[10] = 4
    kind[ord("|")] = 5
    for c in b"#*$%&<>":
        kind[c] = 6
    for c in b"!?":
        kind[c] = 7
    kind[128:] = 9
    return kind


KIND = _kinds()


def features(text: bytes | None) -> np.ndarray:
    """Features of one UTF-8 text, all of it."""
    text = text or b""
    codes = KIND[np.frombuffer(text, np.uint8)].astype(np.intp)
    n = len(codes)
    pairs = np.bincount(codes[:-1] * KINDS + codes[1:], minlength=KINDS * KINDS) if n > 1 else np.zeros(KINDS * KINDS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w, kinds = max(len(words), 1), set(words)
    windows = {hash(x) for x in zip(words, words[1:], words[2:], strict=False)}
    packed = len(zlib.compress(text, 1)) if n else 0
    shape = [
        np.log1p(len(words)), np.log1p(len(lines)), n / w, len(kinds) / w, len(windows) / max(len(words) - 2, 1), packed / max(n, 1),
        len(set(lines)) / max(len(lines), 1), sum(map(bytes.isupper, kinds)) / max(len(kinds), 1), max(map(len, lines), default=0) / max(n, 1),
        float(len(words) < 20), float(len(words) < 50), np.log1p(max(map(len, kinds), default=0)),
    ]
    return np.concatenate([np.sqrt(pairs / max(n - 1, 1)), shape]).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Model:
    """One hidden layer of tanh units over standardised features."""

    def __init__(self, mean, scale, prior: float, weights: list[np.ndarray]):
        self.mean, self.scale, self.prior, self.weights = mean, scale, prior, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.prior)
        a, b, c, d = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(np.tanh(z @ a + b) @ c + d)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 120, batch: int = 1024, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Model:
    """Non-negative risk minimisation by Adam; both samples are dealt into as many batches."""
    if not len(positive) or not len(unlabelled):
        return Model(None, None, prior, [])
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    dim = p.shape[1]
    w = [rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    steps = max(1, -(-len(u) // batch))
    for _ in range(epochs):
        for pi, ui in zip(np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps), strict=True):
            if not len(pi) or not len(ui):
                continue
            x = np.concatenate([p[pi], u[ui]])
            h = np.tanh(x @ w[0] + w[1])
            s = _sigmoid(h @ w[2] + w[3])  # the loss of g is 1 - s, that of -g is s
            slope = s * (1 - s)
            k = len(pi)
            negative = s[k:].mean() - prior * s[:k].mean()
            grad = np.concatenate([-prior * slope[:k] / k, np.zeros(len(ui))])
            if negative >= 0:
                grad += np.concatenate([-prior * slope[:k] / k, slope[k:] / len(ui)])
            else:
                grad = -np.concatenate([-prior * slope[:k] / k, slope[k:] / len(ui)])
            back = np.outer(grad, w[2]) * (1 - h * h)
            t += 1
            for i, g in enumerate((x.T @ back + decay * w[0], back.sum(0), h.T @ grad + decay * w[2], np.array([grad.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, prior, w)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, seed: int = 7) -> float:
    """The share of positives among the unlabelled, from held-out scores; 0.5 if there is too little to tell."""
    if len(positive) < 20 or len(unlabelled) < 20:
        return 0.5
    rng = np.random.default_rng(seed)
    p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    model = fit(p[::2], u[::2], 0.5, epochs=60)
    sp, su = np.sort(model.score(p[1::2])), np.sort(model.score(u[1::2]))
    above = lambda s: 1 - np.searchsorted(s, sp, side="left") / len(s)  # noqa: E731  of each threshold
    share_p, share_u = above(sp), above(su)
    slack = np.sqrt(np.log(4 / delta) / (2 * len(sp))) + np.sqrt(np.log(4 / delta) / (2 * len(su)))
    best = np.argmin((share_u + slack) / np.maximum(share_p, 1e-9))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(x.as_py()).tobytes() for x in b.column(2)], pa.binary())], ["part", "id", "x"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("part", F.col("_id").alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"part int, id {kind}, x binary")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from at most `positives` trusted and `unlabelled` other documents of the training folds.

    Trusted are ids with a label 1. Of texts that share an id the least features count.
    """
    known = own_columns(labels, doc_id="doc_id", label="quality").filter("label = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = sampled(known.filter(~fold(F.col("doc_id"), FOLDS, HELD)), positives, 1).withColumn("part", F.lit(1))
    free = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), FOLDS, HELD))
    web = sampled(free.distinct(), unlabelled, 2).withColumn("part", F.lit(0))
    chosen = F.broadcast(trusted.unionByName(web).withColumnRenamed("doc_id", "_id"))  # positives + unlabelled rows at most
    found = _featured(docs.join(chosen, F.col("doc_id") == F.col("_id")))
    rows = found.groupBy("part", "id").agg(F.min("x").alias("x")).orderBy("part", "id").collect()  # one a part and id
    x = [np.array([np.frombuffer(r.x, np.float32) for r in rows if r.part == k]) for k in (1, 0)]
    return fit(*x, class_prior(*x))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of `docs` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 512):
                out.append(model.score(np.array([features(x.as_py()) for x in b.column(1).slice(i, 512)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    own = docs.select("doc_id", "text")
    scored = score_quality(own, train(own, labels, positives, unlabelled))
    return scored.select("doc_id", fold(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
