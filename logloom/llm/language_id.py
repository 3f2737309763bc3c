"""Language identification by words first, with backoff to ever shorter character n-grams.

A word that was seen in training adds, for every language, the log of its relative frequency there. An unseen word
is scored by its character n-grams of the longest length that training saw (5, 4, 3, 2, then 1), averaged over the
word and weighted down by length. The language of the highest sum wins; ``score`` is the softmax of the sums per word.

The classifier is fitted on a bounded sample of labelled rows: at most about ``sample_per_lang`` texts of each
language, chosen by a hash of doc_id (all of them where there are fewer); this bounds the model that is sent to the executors. All languages are
learned, so its size grows with their number. ``max_words`` and ``max_grams`` prune it further (to the most frequent words, and n-grams of each
length, of a language); by default nothing is pruned.

Defined cases: a null text or one without letters gets ``und`` and score 0; without any training row every text gets
``und``; ties go to the language that is first by name; repeated rows are predicted each; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
GRAM_LENGTHS = (5, 4, 3, 2, 1)
#: With more languages the model holds only the tokens that each of them has.
DENSE_LANGS = 16
_word = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: (lang, length, token, n); length 0 for words. Added up by Spark."""
    words: dict[str, Counter] = {}

    def out():
        rows = []
        for lang, c in words.items():
            rows += [(lang, 0, w, n) for w, n in c.items()]
            for k in GRAM_LENGTHS:
                grams: Counter = Counter()
                for w, n in c.items():
                    for g in grams_of(w, k):
                        grams[g] += n
                rows += [(lang, k, g, n) for g, n in grams.items()]
        words.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "length", "token", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, words.values())) > 200_000:
            yield from out()
    yield from out()


def fit(rows: DataFrame, sample_per_lang: int = 3_000, max_words: int | None = None, max_grams: int | None = None) -> dict:
    """The model from labelled rows (doc_id, text, lang)."""
    from pyspark.sql import Window

    rows = rows.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"langs": []}
    share = F.broadcast(rows.sparkSession.createDataFrame([(lang, min(1.0, sample_per_lang / n)) for lang, n in sizes.items()], "lang string, share double"))
    point = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(share, "lang").where(point < F.col("share")).select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, length int, token string, n long").groupBy("lang", "length", "token").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "length").orderBy(F.desc("n"), "token"))
    kept = counts.withColumn("rank", rank).withColumn("total", F.sum("n").over(Window.partitionBy("lang", "length")))
    most = {0: max_words, **dict.fromkeys(GRAM_LENGTHS, max_grams)}
    for k, n in most.items():
        if n is not None:
            kept = kept.where((F.col("length") != k) | (F.col("rank") <= n))
    kept = kept.drop("rank")
    table = kept.toArrow()
    langs = sorted(sizes)
    if len(langs) > DENSE_LANGS:
        return {"langs": langs, "sparse": sparse_tables(table, langs)}
    at = {x: i for i, x in enumerate(langs)}
    totals: dict[int, np.ndarray] = {k: np.ones(len(langs)) for k in (0, *GRAM_LENGTHS)}
    seen: dict[int, dict[str, np.ndarray]] = {k: {} for k in (0, *GRAM_LENGTHS)}
    for lang, k, token, n, total in zip(*(table.column(x).to_pylist() for x in ("lang", "length", "token", "n", "total")), strict=True):
        totals[k][at[lang]] = total
        seen[k].setdefault(token, np.zeros(len(langs), np.float64))[at[lang]] = n
    logs = {}
    for k, tokens in seen.items():
        names = sorted(tokens)
        counts_of = np.array([tokens[x] for x in names]).reshape(len(names), len(langs))
        logs[k] = (names, (np.log(counts_of + 0.5) - np.log(totals[k] + 0.5 * max(1, len(names)))).astype(np.float32))
    return {"langs": langs, "logs": logs}


def sparse_tables(table: pa.Table, langs: list[str]) -> dict:
    """By length: tokens, the range of each one's entries, their languages and gains over an unseen token, and the unseen token's logs."""
    lang_at = pc.index_in(table["lang"].combine_chunks(), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False).astype(np.int32)
    length, n, total = (table[x].to_numpy() for x in ("length", "n", "total"))
    out = {}
    for k in (0, *GRAM_LENGTHS):
        at = np.flatnonzero(length == k)
        codes = table["token"].take(pa.array(at)).combine_chunks().dictionary_encode()
        ids, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
        order = np.argsort(ids, kind="stable")
        totals = np.ones(len(langs))
        totals[lang_at[at]] = total[at]
        ranges = np.searchsorted(ids[order], np.arange(len(names) + 1))
        unseen = np.log(0.5) - np.log(totals + 0.5 * max(1, len(names)))
        out[k] = names, ranges, lang_at[at][order], (np.log(n[at][order] + 0.5) - np.log(0.5)).astype(np.float32), unseen
    return out


class _Index(dict):
    """Word to row; a word that isn't there is added."""

    def __missing__(self, word: str) -> int:
        return self.add(word)


class Predictor:
    """Scores texts in a worker. The row of each unseen word is found once and kept, up to ``limit`` of them beside those of the known words."""

    def __init__(self, model: dict, limit: int = 400_000):
        self.langs, self.limit = model["langs"], limit
        names, rows = model["logs"][0]
        self.index = _Index(zip(names, range(len(names)), strict=True))
        self.index.add = self.add
        self.known = self.used = len(names)
        self.rows = np.zeros((self.known + 4096, len(self.langs)), np.float32)
        self.rows[: self.known] = rows
        self.grams = [(k, {g: i for i, g in enumerate(model["logs"][k][0])}, model["logs"][k][1]) for k in GRAM_LENGTHS]

    def reset(self) -> None:
        """Forgets the unseen words, which are the last of the index."""
        for _ in range(self.used - self.known):
            self.index.popitem()
        self.used = self.known

    def unseen(self, word: str) -> np.ndarray:
        for k, index, rows in self.grams:
            found = [index[g] for g in grams_of(word, k) if g in index]
            if found:
                return rows[found].mean(axis=0) * (k + 1) / 6
        return np.zeros(len(self.langs), np.float32)

    def add(self, word: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used] = self.unseen(word)
        self.index[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words:
            if not text or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0
            words = ["".join(filter(str.isalpha, text.lower()))]
        mean = self.total(words) / len(words) * min(len(words), 20)
        p = np.exp(mean - mean.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])

    def total(self, words: list[str]) -> np.ndarray:
        """The sums of the words' rows."""
        if self.used - self.known > self.limit:
            self.reset()
        ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.rows.take(ids, axis=0).sum(axis=0, dtype=np.float64)


class SparsePredictor(Predictor):
    """The same scores for many languages: a word holds only the languages that have it."""

    def __init__(self, model: dict, limit: int = 50_000):
        self.langs, self.limit = model["langs"], limit
        self.tables = {k: ({x: i for i, x in enumerate(t[0])}, *t[1:]) for k, t in model["sparse"].items()}
        self.rows = {}

    def row(self, word: str) -> tuple[int, float, np.ndarray, np.ndarray] | None:
        """Length, weight, languages and gains of a word."""
        for k in (0, *GRAM_LENGTHS):
            index, ranges, langs, gains, _ = self.tables[k]
            found = [index[x] for x in (grams_of(word, k) if k else [word]) if x in index]
            if found:
                weight = (k + 1) / 6 if k else 1.0
                parts = [slice(ranges[i], ranges[i + 1]) for i in found]
                return k, weight, np.concatenate([langs[x] for x in parts]), np.concatenate([gains[x] for x in parts]) * (weight / len(found))
        return None

    def total(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > self.limit:
            self.rows.clear()
        out = np.zeros(len(self.langs))
        weights: Counter = Counter()
        for word, n in Counter(words).items():
            if word not in self.rows:
                self.rows[word] = self.row(word)
            if (row := self.rows[word]) is not None:
                weights[row[0]] += n * row[1]
                out += np.bincount(row[2], row[3] * n, len(out))
        for k, weight in weights.items():
            out += self.tables[k][-1] * weight
        return out


def predict(documents: DataFrame, model: dict, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. The model is a broadcast variable of bounded size."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        p = (SparsePredictor if "sparse" in m else Predictor)(m) if m["langs"] else None
        for b in batches:
            got = [p.predict(t) if p else (UNKNOWN, 0.0) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Predictions for all documents from a model that never sees those held out: crc32(doc_id as text) mod 3 = 1."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return predict(documents, fit(documents.where(~held)), held)
