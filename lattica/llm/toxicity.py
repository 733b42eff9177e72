"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel counts common subsequences of three characters, each discounted by the stretch it spans, so that an insult
with gaps or inserted characters stays near the plain one. A sentence is scored by its most toxic token: tokens are
runs without white space less outer punctuation, the same with inner punctuation taken out, and rows of single letters
joined, each with a mark for its start. Kernel values to the landmarks, whitened by the landmarks' own kernel matrix,
are the features of a token. Landmarks are beginnings of tokens that are far likelier in toxic documents, unlike each
other, and random other tokens.

The machine's examples are labelled sentences, as bags of tokens: a negative sentence is one whose tokens are all
negative, a positive sentence is represented by its most toxic token, which is settled again in rounds with the trained
machine. Labels come by document: all sentences of documents not labelled toxic are negative, those of toxic documents
are positive where they hold a token that is likelier there. A document's score is a logistic function, fitted on
training documents, of its three highest tokens and how many it has: one doubtful token tells more about a short text
than about a long one.

Samples for training are bounded by parameters (documents, and characters of a training document, which bound the
driver's memory); every document is scored over its whole text. Long tokens are scored in overlapping pieces, never cut
short.

Defined results: null and empty texts have no sentence and get the score of a document without toxic tokens; repeated
rows get equal rows; ids may be null; without labelled documents of both kinds every score is 0; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.labelled import fold, one_label, sampled

FOLDS, HELD = 5, 0
#: Documents to train on: toxic ones, others, and the most characters of one that is trained on.
TOXIC, CLEAN, LONGEST = 1500, 3000, 50_000
LANDMARKS = 40
DECAY = 0.7
PIECE = 24
#: Margins below it tell nothing about a document.
FLOOR = -0.5
#: Scores of tokens that a worker remembers.
CACHE = 200_000

TOKEN = re.compile(r"\w(?:\S*\w)?")
INNER = re.compile(r"[\W_]+")
LETTERS = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_]){2,}(?![^\W_])")  # marks and letters share no character


def tokens(text: str) -> set[str]:
    """What of `text` the kernel compares; "^" marks the start of a token, pieces of a long token overlap by half."""
    text = text.lower()
    found = set(TOKEN.findall(text))
    found |= {INNER.sub("", t) for t in found if not t.isalnum()}
    found |= {INNER.sub("", x) for x in LETTERS.findall(text)}
    out = set()
    for t in found:
        if 3 <= len(t) < PIECE:
            out.add("^" + t)
        elif len(t) >= PIECE:
            t = "^" + t
            out.update(t[i : i + PIECE] for i in range(0, len(t) - PIECE // 2, PIECE // 2))
    return out


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if s]


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, a row a word; -1 fills rows up."""
    data = "".join(words) if len(words[0]) == width and len({*map(len, words)}) == 1 else "".join(w.ljust(width, "\0") for w in words)
    out = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(words), width).copy()
    out[out == 0] = -1
    return out


def _kernel(words: list[str], others: list[str], paired: bool) -> np.ndarray:
    """Gap-weighted kernel of length 3 between words of one length: each with each of `others`, or paired with its own."""
    s, t = _codes(words, len(words[0])), _codes(others, max(map(len, others)))
    t[t < 0] = -2  # fillers match nothing
    n, m = s.shape[1], t.shape[1]
    shape = (len(words),) if paired else (len(words), len(others))
    lam, lam2 = np.float32(DECAY), np.float32(DECAY**2)
    ones = np.ones(shape, np.float32)
    # before[i][k]: K'_i of s[:j], t[:k]
    before = [[ones] * (m + 1), [np.zeros(shape, np.float32) for _ in range(m + 1)], [np.zeros(shape, np.float32) for _ in range(m + 1)]]
    total = np.zeros(shape, np.float32)
    for j in range(n):
        same = [(s[:, j] == t[:, k]) if paired else (s[:, j : j + 1] == t[None, :, k]) for k in range(m)]
        hits = [x.astype(np.float32) * lam2 for x in same]
        fresh = [before[0], [before[1][0]], [before[2][0]]]
        for i in (1, 2):
            run = None
            for k in range(m):
                gain = hits[k] * before[i - 1][k] if i > 1 else hits[k]
                run = gain if run is None else run * lam + gain
                fresh[i].append(before[i][k + 1] * lam + run)
        for k in range(m):
            total += hits[k] * before[2][k]
        before = fresh
    return total


class Kernel:
    """Normalised kernel values of words to fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.norm = np.sqrt(self._self(landmarks))

    def part(self, chosen: np.ndarray) -> "Kernel":
        out = Kernel([])
        out.landmarks, out.norm = [m for m, c in zip(self.landmarks, chosen, strict=True) if c], self.norm[chosen]
        return out

    @staticmethod
    def _self(words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.float32)
        for at in _by_length(words):
            own = [words[i] for i in at]
            out[at] = _kernel(own, own, True)
        return np.maximum(out, 1e-12)

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not self.landmarks:
            return out
        for at in _by_length(words):
            own = [words[i] for i in at]
            out[at] = _kernel(own, self.landmarks, False)
        return out / np.sqrt(self._self(words))[:, None] / self.norm[None, :]


def _by_length(words: list[str], most: int = 4096) -> list[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return [at[i : i + most] for at in groups.values() for i in range(0, len(at), most)]


class Model:
    """`weights` and `bias` give a token's margin, `outer` the log-odds of a document from its summary."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, bias: float):
        self.kernel, self.weights, self.bias, self.outer = kernel, weights, bias, np.zeros(7)
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        """Margins, exact where they reach FLOOR; below, a bound that doesn't reach it either.

        Kernel values aren't negative, so landmarks of positive weight bound a margin from above; the others are only
        computed for the few words whose bound reaches FLOOR.
        """
        for_it = self.weights > 0
        out = self.kernel.part(for_it).values(words) @ self.weights[for_it] + self.bias
        close = np.flatnonzero(out >= FLOOR)
        if len(close):
            out[close] += self.kernel.part(~for_it).values([words[i] for i in close]) @ self.weights[~for_it]
        return out

    def summaries(self, bags: list[set[str]]) -> np.ndarray:
        """Per bag of tokens: how far its three largest margins are above FLOOR (0 where none is), its size, products, a one."""
        cache = self.cache
        new = list(set().union(*bags).difference(cache)) if bags else []
        if new:
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = list(set().union(*bags))
            cache.update(zip(new, self.margins(new).tolist(), strict=True))
        out = np.empty((len(bags), 7))
        for i, b in enumerate(bags):
            found = list(map(cache.__getitem__, b))
            best = nlargest(3, found) if found and max(found) > FLOOR else []
            top = [max(0.0, min(x, 1.5) - FLOOR) for x in best] + [0.0] * 3
            size = math.log1p(len(b))
            out[i] = (*top[:3], size, top[0] * size, top[1] * size, 1.0)
        if len(cache) > CACHE:
            cache.clear()
        return out

    def probability(self, summary: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * (summary @ self.outer)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the examples inside the margin (only these are held in double)."""
    w = np.zeros(x.shape[1] + 1)
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        inside = y * (x @ w[:-1].astype(np.float32) + np.float32(w[-1])) < 1
        a = np.column_stack([x[inside], np.ones(np.count_nonzero(inside))]).astype(np.float64) if w.any() else None
        if a is None:  # the first step takes all examples, in pieces
            gram, target = np.zeros((len(w), len(w))), np.zeros(len(w))
            for i in range(0, len(x), 1 << 15):
                z = np.column_stack([x[i : i + (1 << 15)], np.ones(len(x[i : i + (1 << 15)]))]).astype(np.float64)
                c = weight[i : i + (1 << 15)]
                gram, target = gram + (z * c[:, None]).T @ z, target + (z * c[:, None]).T @ y[i : i + (1 << 15)]
        else:
            c = weight[inside]
            gram, target = (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[inside]
        new = np.linalg.solve(gram + ridge, target)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(z: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Log-odds weights of P(y = 1 | z) by Newton steps; the ridge keeps separable data finite."""
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 0.5 * (1 + np.tanh(0.5 * (z @ w)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) + ridge * w)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w


def _beginnings(token: str) -> set[str]:
    return {token[:k] for k in range(5, 9) if len(token) >= k} if token[0] == "^" else set()


def _telling(a: int, n: int, b: int, m: int) -> float:
    """The likelihood-ratio statistic of a token in a of n toxic and b of m other documents."""
    both = (a + b) / (n + m)
    return sum(k * math.log(k / t / p) for k, t, p in ((a, n, both), (n - a, n, 1 - both), (b, m, both), (m - b, m, 1 - both)) if k)


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, rounds: int = 3, seed: int = 11) -> Model | None:
    """A machine from whole texts of toxic and other documents."""
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(seed)
    bags, others, said = [[tokens(s) for s in sentences(t)] for t in toxic], [], Counter()
    for t in clean:
        own = [tokens(s) for s in sentences(t)]
        others.append(set().union(*own))
        said.update(w for s in own for w in s)  # in how many negative sentences
    whole = [set().union(*b) for b in bags]
    hot, cold = Counter(w for b in whole for w in b), Counter(w for b in others for w in b)
    stems, usual_stems = (Counter(x for b in docs for x in {y for w in b for y in _beginnings(w)}) for docs in (whole, others))
    odds = {w: (n + 0.5) / (len(toxic) + 1) / ((usual_stems[w] + 0.5) / (len(clean) + 1)) for w, n in stems.items() if n >= 3}
    likely = sorted((w for w, x in odds.items() if x >= 4), key=lambda w: (-_telling(stems[w], len(toxic), usual_stems[w], len(clean)), -len(w), w))
    chosen: list[str] = []
    for w in likely:  # different from each other
        if len(chosen) < landmarks * 3 // 5 and (not chosen or Kernel(chosen).values([w]).max() < 0.6):
            chosen.append(w)
    usual = sorted(w for w in cold if not _beginnings(w) & odds.keys())
    if not chosen or not usual:
        return None
    marks = chosen + [str(w)[:8] for w in rng.choice(usual, min(landmarks - len(chosen), len(usual)), replace=False)]
    kernel = Kernel(marks)
    value, vector = np.linalg.eigh(kernel.values(marks).astype(np.float64))
    whiten = ((vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T).astype(np.float32)
    negative, every = sorted(cold), sorted(hot)
    low, high = kernel.values(negative) @ whiten, kernel.values(every) @ whiten
    rates = np.array([said[w] for w in negative]) / len(clean)
    place = {w: i for i, w in enumerate(every)}
    positive, model = {w for w in every if _beginnings(w) & set(chosen)}, None
    worth = {w: max((odds.get(x, 0.0) for x in _beginnings(w)), default=0.0) for w in positive}
    for _ in range(rounds):
        found = [s & positive for b in bags for s in b]
        at = [place[max(f, key=lambda w: (worth[w], w))] for f in found if f]  # a positive sentence is its most toxic token
        if not at:
            break
        x, y = np.concatenate([high[at], low]), np.concatenate([np.ones(len(at), np.float32), -np.ones(len(low), np.float32)])
        w, bias = _svm(x, y, np.concatenate([np.full(len(at), 1 / len(toxic)), rates]))
        model = Model(kernel, (whiten @ w).astype(np.float32), bias)
        margin = high @ w + bias
        positive = {t for t, m in zip(every, margin, strict=True) if m > 0 and hot[t] / len(toxic) > cold[t] / len(clean)}
        worth = {t: float(m) for t, m in zip(every, margin, strict=True) if t in positive}
    if model is None:
        return None
    model.outer = _logistic(model.summaries(whole + others), np.concatenate([np.ones(len(whole)), np.zeros(len(others))]))
    model.cache.clear()
    return model


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, longest: int = LONGEST) -> Model | None:
    """A machine from at most `toxic` and `clean` labelled documents of the training folds, of at most `longest` characters.

    Of texts that share an id the least one counts.
    """
    known = one_label(labels, "toxic").filter(~fold(F.col("doc_id"), FOLDS, HELD))
    chosen = sampled(known.filter("label = 1"), toxic, 3).unionByName(sampled(known.filter("label = 0"), clean, 4)).withColumnRenamed("doc_id", "_id")
    own = docs.filter(F.char_length("text") <= longest).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # toxic + clean rows at most
    rows = own.groupBy("_id").agg(F.min(F.struct("text", "label")).alias("x")).select("x.label", "x.text").orderBy("text").collect()  # one an id
    return fit([r.text for r in rows if r.label == 1], [r.text for r in rows if r.label == 0])


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for every row of `docs` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros(0)]
            for i in range(0, b.num_rows, 256):
                texts = [x.as_py() or "" for x in b.column(1).slice(i, 256)]
                out.append(model.probability(model.summaries([tokens(t) for t in texts])) if model else np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    own = docs.select("doc_id", "text")
    scored = score_toxicity(own, train(own, labels, toxic, clean))
    return scored.select("doc_id", fold(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
