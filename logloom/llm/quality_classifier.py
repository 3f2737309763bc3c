"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(score - threshold_k), with one weight vector over hashed words shared by all grades and ordered
thresholds. A text's score is the sum of the weights of its distinct words (lower case, hashed to ``2**BITS``
weights) plus weights of a few dense measures. The expected grade is the sum of the
tail probabilities; a text is selected if its tail probability at the wanted grade reaches a limit.

The model is fitted on a bounded sample of the rated rows: about ``sample`` rows at most, chosen by a hash of doc_id
(all of them where there are fewer), on the driver over the whole sample at once from a fixed start. Every row is scored, over its
whole text; the weights are a broadcast variable of fixed size.

Defined cases: a null or empty text has no words and gets the score of its dense measures (zeros); rows without rating or doc_id aren't
learned from; several ratings of a document count each; with fewer than two grades rated, every text gets the
probability 0.5 per threshold; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, WHITE, Words, chunks

BITS = 17
DENSE = 5


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: the numbers of its distinct hashed words, and its dense measures."""
    w = Words(texts, ALNUM, latin=True)
    buckets = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    for i, t in enumerate(texts):
        own = np.unique(buckets[w.first[i] : w.last[i]])
        n = int(w.last[i] - w.first[i])
        bare = t.translate(None, WHITE)
        marks = sum(bare.count(x) for x in b"#*$%&|<>!")
        letters = len(bare.translate(None, bytes(range(65)) + bytes(range(91, 256))))
        size = max(1, len(bare))
        yield own, np.array([min(1.0, 8 * marks / size), min(1.0, 4 * letters / size), len(own) / max(1, n), min(1.0, n / 50), min(3.0, size / max(1, n) / 5)], np.float64) if n else np.zeros(DENSE)


class Ordinal:
    """The model: hashed weights, dense weights, ordered thresholds, and the grades in order."""

    def __init__(self, grades: list[int]):
        self.grades = grades
        self.words = np.zeros(1 << BITS)
        self.dense = np.zeros(DENSE)
        self.thresholds = np.linspace(-0.5, 0.5, max(0, len(grades) - 1)) if len(grades) > 2 else np.zeros(max(0, len(grades) - 1))

    def score(self, own: np.ndarray, dense: np.ndarray) -> float:
        return float(self.words[own].sum() + dense @ self.dense)

    def tails(self, score: float) -> np.ndarray:
        """P(grade is above the k-th), for each k but the last."""
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -60, 60)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], ranks: np.ndarray, sparse: float = 0.17, ridge: float = 1e-4, rounds: int = 300) -> Ordinal:
        """Maximum likelihood, rated grades weighted evenly, in two steps: proximal gradients with an L1 penalty (``sparse`` over the root
        of the number of rows) find the words that tell, then their weights are fitted again with a light ridge."""
        k = len(self.thresholds)
        if not rows or not k:
            return self
        data = _Data(rows, ranks, k)
        chosen = np.flatnonzero(_select(data, sparse / np.sqrt(data.n), rounds))
        kept = np.zeros(1 << BITS, bool)
        kept[chosen] = True
        data = data.only(kept)
        params = [np.zeros(1 << BITS), np.zeros(DENSE), np.array([-0.5]), np.zeros(k - 1)]
        adam = _Adam(params, 0.05)
        for _ in range(rounds):
            g, d_theta = data.slopes(params[0], params[1], _theta(params))
            adam.step([data.to_words(g) + ridge * params[0], data.dense.T @ g + ridge * params[1], *_theta_slopes(d_theta, params)])
        self.words, self.dense, self.thresholds = params[0], params[1], _theta(params)
        return self


def _theta(params: list[np.ndarray]) -> np.ndarray:
    """Ordered thresholds: the first, and the logarithms of the gaps."""
    return params[-2][0] + np.concatenate([[0.0], np.cumsum(np.exp(params[-1]))])


def _theta_slopes(d_theta: np.ndarray, params: list[np.ndarray]) -> list[np.ndarray]:
    return [np.array([d_theta.sum()]), np.array([d_theta[j + 1 :].sum() for j in range(len(params[-1]))]) * np.exp(params[-1])]


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.first, self.second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, slopes: list[np.ndarray]) -> None:
        self.t += 1
        for x, d, m, v in zip(self.params, slopes, self.first, self.second, strict=True):
            m *= 0.9
            m += 0.1 * d
            v *= 0.999
            v += 0.001 * d * d
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class _Data:
    """Rated rows as flat arrays."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], ranks: np.ndarray, k: int):
        self.n, self.k, self.ranks = len(rows), k, ranks
        self.at = np.repeat(np.arange(self.n), [len(o) for o, _ in rows])
        self.flat = np.concatenate([o for o, _ in rows])
        self.dense = np.stack([d for _, d in rows])
        weight = (1.0 / np.maximum(1, np.bincount(ranks, minlength=k + 1)))[ranks]
        self.weight = weight / weight.sum()

    def only(self, kept: np.ndarray) -> _Data:
        out = object.__new__(_Data)
        out.__dict__.update(self.__dict__)
        here = kept[self.flat]
        out.at, out.flat = self.at[here], self.flat[here]
        return out

    def to_words(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, g[self.at], minlength=1 << BITS)

    def slopes(self, words: np.ndarray, dense: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of the loss by each row's score, and by the thresholds."""
        i, ranks = np.arange(self.n), self.ranks
        s = np.bincount(self.at, words[self.flat], minlength=self.n) + self.dense @ dense
        above = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -60, 60)))
        padded = np.concatenate([np.ones((self.n, 1)), above, np.zeros((self.n, 1))], axis=1)
        slope = padded * (1 - padded)
        p = np.maximum(padded[i, ranks] - padded[i, ranks + 1], 1e-9)
        up, down = slope[i, ranks] / p, slope[i, ranks + 1] / p
        d_theta = np.zeros(self.k + 2)
        np.add.at(d_theta, ranks, self.weight * up)
        np.add.at(d_theta, ranks + 1, -self.weight * down)
        return -self.weight * (up - down), d_theta[1:-1]

    def steepness(self, rounds: int = 12) -> float:
        """The greatest curvature of the loss by the word weights, by power iteration."""
        v, size = np.ones(1 << BITS), 1.0
        for _ in range(rounds):
            v /= np.linalg.norm(v)
            v = self.to_words(self.weight * np.bincount(self.at, v[self.flat], minlength=self.n))
            size = np.linalg.norm(v)
        return 0.25 * max(size, 1e-9)


def _select(data: _Data, sparse: float, rounds: int) -> np.ndarray:
    """Word weights under an L1 penalty (accelerated proximal gradients)."""
    words = np.zeros(1 << BITS)
    ahead, t, step = words, 1.0, 1 / data.steepness()
    params = [np.zeros(DENSE), np.array([-0.5]), np.zeros(data.k - 1)]
    adam = _Adam(params, 0.05)
    for _ in range(rounds):
        g, d_theta = data.slopes(ahead, params[0], _theta(params))
        new = ahead - step * data.to_words(g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * sparse, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, words = new + (before - 1) / t * (new - words), new
        adam.step([data.dense.T @ g, *_theta_slopes(d_theta, params)])
    return words


def fit(rated: DataFrame, sample: int = 10_000) -> Ordinal:
    """The model from rated rows (doc_id, text, grade). The sample bounds what the driver gets."""
    rated = rated.select("doc_id", "text", F.col("grade").cast("int").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
    total = rated.count()
    point = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rated.where(point < min(1.0, sample / max(1, total)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches, "text"):
            found = list(features(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([o.astype("<i4").tobytes() for o, _ in found], pa.binary()), pa.array([d.tobytes() for _, d in found], pa.binary())], names=["doc_id", "grade", "words", "dense"])

    kind = rated.schema["doc_id"].dataType.simpleString()
    rows = chosen.mapInArrow(run, f"doc_id {kind}, grade int, words binary, dense binary").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    given = rows.column("grade").to_pylist()
    grades = sorted(set(given))
    parts = [(np.frombuffer(w, "<i4").astype(np.int64), np.frombuffer(d, np.float64)) for w, d in zip(rows.column("words").to_pylist(), rows.column("dense").to_pylist(), strict=True)]
    return Ordinal(grades).fit(parts, np.array([grades.index(x) for x in given], np.int64))


def predict(documents: DataFrame, model: Ordinal, wanted: int, limit: float = 0.4) -> DataFrame:
    """doc_id, expected_grade, tail (probability of at least the grade ``wanted``) and selected, of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        grades = np.array(m.grades, np.float64)
        for b, texts in chunks(batches, "text"):
            expected, tail = [], []
            for own, dense in features(texts):
                t = m.tails(m.score(own, dense))
                expected.append(float(grades[0] + t @ np.diff(grades)) if len(t) else 0.5)
                k = int(np.searchsorted(grades, wanted))
                tail.append(0.5 if not len(t) else 1.0 if k == 0 else 0.0 if k > len(t) else float(t[k - 1]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([x >= limit for x in tail], pa.bool_())], names=["doc_id", "expected_grade", "tail", "selected"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail double, selected boolean")


def grade_of(quality: Column, toxic: Column) -> Column:
    """Ratings in one order: 0 for toxic texts, 1 for low quality, 2 for good ones."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


WANTED = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions for all documents from the ratings of four fifths; ``held_out`` marks the fifth that is never learned from."""
    rated = documents.select("doc_id", "text").join(labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")), "doc_id").where(~held_out(F.col("doc_id")))
    return predict(documents, fit(rated), WANTED).withColumn("held_out", held_out(F.col("doc_id")))
