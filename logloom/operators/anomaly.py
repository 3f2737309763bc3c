"""Anomaly models, their combination and what is said about a record."""

import json
from typing import Iterator, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import PERCENTILES

WEIGHTS = {"isolation": 0.4, "statistical": 0.3, "neural": 0.3}
ALERT = 0.8
NAMES = [f"p{round(100 * q):02d}" for q in PERCENTILES]


# --- statistical model ---------------------------------------------------------------------------------------------------


def long_form(df: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    return df.select(*ids, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))).alias("f")).select(*ids, "f.feature", "f.value").where("value is not null")


def train_statistical(long: DataFrame) -> DataFrame:
    """feature, mean, sd and seven percentiles. One row per feature: small whatever the data."""
    out = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.percentile("value", list(PERCENTILES)).alias("p"))
    return out.select("feature", "mean", "sd", *(F.col("p")[i].alias(n) for i, n in enumerate(NAMES)))


def statistical_value_score(v: Column) -> Column:
    z = F.abs(F.try_divide(v - F.col("mean"), F.col("sd")))
    by_z = F.when(z > 3, 0.95).when(z > 2, 0.8).when(z > 1.5, 0.6).when(z > 1, 0.4).otherwise(0.1)
    outside = lambda a, b: (v < F.col(a)) | (v > F.col(b))
    by_p = F.when(outside("p01", "p99"), 0.9).when(outside("p05", "p95"), 0.7).when(outside("p25", "p75"), 0.3).otherwise(0.1)
    return F.greatest(by_z, by_p)


def score_statistical(long: DataFrame, model: DataFrame, ids: list[str]) -> DataFrame:
    """The greatest score of a record's features. The model has a row per feature, so it is broadcast."""
    return long.join(F.broadcast(model), "feature").groupBy(*ids).agg(F.max(statistical_value_score(F.col("value"))).alias("score"))


def model_json(model: DataFrame) -> str:
    return json.dumps([r.asDict() for r in model.orderBy("feature").collect()])


def model_from_json(spark, text: str) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(json.loads(text)))


# --- isolation forest ----------------------------------------------------------------------------------------------------


def _path_constant(n: int) -> float:
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0 if n == 2 else 0.0


class IsolationForest:
    """Random trees over a bounded sample; all nodes in flat arrays, so that a batch walks down all trees at once."""

    def __init__(self, trees: int = 100, sample: int = 256, depth: int = 10, seed: int = 0):
        self.trees, self.sample, self.depth, self.seed = trees, sample, depth, seed

    def fit(self, x: np.ndarray) -> "IsolationForest":
        rng = np.random.default_rng(self.seed)
        feature, split, left, right, length, self.roots = [], [], [], [], [], []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(feature)
            feature.append(-1), split.append(0.0), left.append(-1), right.append(-1), length.append(float(level))
            spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(x.shape[1])
            able = np.flatnonzero(spread > 0)
            if level >= self.depth or len(rows) <= 1 or not len(able):
                return me
            f = int(rng.choice(able))
            at = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            feature[me], split[me] = f, at
            left[me], right[me] = grow(rows[rows[:, f] < at], level + 1), grow(rows[rows[:, f] >= at], level + 1)
            return me

        for _ in range(self.trees if len(x) else 0):
            self.roots.append(grow(x[rng.choice(len(x), min(self.sample, len(x)), replace=False)], 0))
        self.feature, self.split, self.left, self.right, self.length = np.array(feature, int), np.array(split), np.array(left, int), np.array(right, int), np.array(length)
        self.norm = _path_constant(min(self.sample, max(2, len(x))))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean depth / normal depth); 0.5 for a forest without trees."""
        if not self.roots:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth + 1):
                f = self.feature[at]
                go = f >= 0
                if not go.any():
                    break
                less = x[np.arange(len(x)), np.maximum(f, 0)] < self.split[at]
                at = np.where(go, np.where(less, self.left[at], self.right[at]), at)
            total += self.length[at]
        return 2.0 ** (-(total / len(self.roots)) / self.norm)

    def to_json(self) -> str:
        arrays = {k: getattr(self, k).tolist() for k in ("feature", "split", "left", "right", "length")}
        return json.dumps(arrays | {"roots": self.roots, "norm": self.norm, "depth": self.depth, "trees": self.trees, "sample": self.sample, "seed": self.seed})

    @classmethod
    def from_json(cls, text: str) -> "IsolationForest":
        d = json.loads(text)
        out = cls(d["trees"], d["sample"], d["depth"], d["seed"])
        out.roots, out.norm = d["roots"], d["norm"]
        for k in ("feature", "left", "right"):
            setattr(out, k, np.array(d[k], int))
        out.split, out.length = np.array(d["split"]), np.array(d["length"])
        return out


class Autoencoder:
    """One hidden sigmoid layer that rebuilds all (scaled) features; the score is the squashed reconstruction error."""

    def __init__(self, hidden: int = 20, rate: float = 0.01, epochs: int = 100, seed: int = 0):
        self.hidden, self.rate, self.epochs, self.seed = hidden, rate, epochs, seed

    def fit(self, x: np.ndarray) -> "Autoencoder":
        rng = np.random.default_rng(self.seed)
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.clip((x - self.mean) / self.sd, -10, 10)
        d = z.shape[1]
        self.w1, self.b1 = rng.normal(0, 0.3, (d, self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, 0.3, (self.hidden, d)), np.zeros(d)
        for _ in range(self.epochs):
            h = 1 / (1 + np.exp(-(z @ self.w1 + self.b1)))
            e = h @ self.w2 + self.b2 - z
            g2 = h.T @ e / len(z)
            back = e @ self.w2.T * h * (1 - h)
            self.w2 -= self.rate * g2
            self.b2 -= self.rate * e.mean(axis=0)
            self.w1 -= self.rate * (z.T @ back / len(z))
            self.b1 -= self.rate * back.mean(axis=0)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -10, 10)
        h = 1 / (1 + np.exp(-(z @ self.w1 + self.b1)))
        return 1 / (1 + np.exp(-((h @ self.w2 + self.b2 - z) ** 2).mean(axis=1)))


def training_sample(df: DataFrame, names: list[str], order: Column, size: int = 10_000) -> np.ndarray:
    """The last records by ``order``, at most ``size`` of them, on the driver: the training buffer."""
    rows = df.orderBy(order.desc()).limit(size).select(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names))
    return rows.toPandas().to_numpy(dtype=float)


def with_model_score(df: DataFrame, model, names: list[str], out: str) -> DataFrame:
    """Scores of a model of bounded size, in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            x = np.stack([c.fillna(0.0).to_numpy(float) for c in cols], axis=1)
            yield pd.Series(shared.value.score(x))

    return df.withColumn(out, score(*(F.col(n).cast("double") for n in names)))


# --- combination and explanation --------------------------------------------------------------------------------------


def combine(scores: dict[str, Column], weights: dict[str, float] | None = None, how: str = "weighted") -> Column:
    """weighted or plain mean of the scores that are there, or majority: 1 if more than half exceed 0.5."""
    weights = weights or WEIGHTS
    has = {k: c.isNotNull() for k, c in scores.items()}
    n = sum((h.cast("double") for h in has.values()), F.lit(0.0))
    if how == "majority":
        return F.when(n > 0, F.when(sum((F.coalesce((c > 0.5).cast("double"), F.lit(0.0)) for c in scores.values()), F.lit(0.0)) > n / 2, 1.0).otherwise(0.0))
    w = {k: (weights.get(k, 0.0) if how == "weighted" else 1.0) for k in scores}
    top = sum((F.coalesce(c * w[k], F.lit(0.0)) for k, c in scores.items()), F.lit(0.0))
    return F.try_divide(top, sum((h.cast("double") * w[k] for k, h in has.items()), F.lit(0.0)))


def listed(message: Column, score: Column, black: list[str] = (), white: list[str] = ()) -> Column:
    """Black patterns give 1, then white ones 0, else the score."""
    hit = lambda ps: sum((message.rlike(p).cast("int") for p in ps), F.lit(0)) > 0
    return F.when(hit(black), 1.0).when(hit(white), 0.0).otherwise(score)


def confidence(scores: list[Column]) -> Column:
    a = F.filter(F.array(*scores), lambda x: x.isNotNull())
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    sd = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    return F.when(n <= 1, 0.5).otherwise(1.0 - F.least(sd * 2, F.lit(1.0)))


def severity(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("none")


#: What is said of a feature: (part of its name, above or below, limit, text). The first that holds counts.
SAYS = (
    ("text_message_length", ">", 1000, "unusually long message (%.0f chars, expected <1000)"),
    ("text_message_length", ">", 500, "abnormally long message (%.0f chars)"),
    ("text_entropy", ">", 4.5, "high entropy text detected (%.2f), possible encrypted/random data"),
    ("text_entropy", "<", 2.0, "low entropy text (%.2f), highly repetitive content"),
    ("text_digit_ratio", ">", 0.5, "excessive numeric content"),
    ("text_special_ratio", ">", 0.3, "unusual character distribution"),
    ("statistical_events_per_minute", ">", 100, "extreme event rate spike (%.0f events/min)"),
    ("statistical_events_per_minute", ">", 50, "high event frequency (%.0f events/min)"),
    ("statistical_message_duplicate_count", ">", 10, "excessive message repetition (%.0f duplicates)"),
    ("statistical_message_duplicate_count", ">", 5, "repeated messages detected (%.0f times)"),
    ("temporal_current_interval", "<", 0.1, "burst activity detected (%.3fs between events)"),
    ("temporal_current_interval", ">", 60, "unusual gap in activity (%.0fs since last event)"),
    ("temporal_regularity_score", "<", 0.3, "irregular timing pattern (regularity: %.2f)"),
    ("pattern_error_pattern_score", ">=", 3, "multiple error indicators found (%.0f patterns matched)"),
    ("pattern_error_pattern_score", ">=", 1, "error pattern detected in message"),
    ("pattern_security_pattern_score", ">=", 2, "security-related keywords detected (%.0f patterns)"),
    ("pattern_security_pattern_score", ">=", 1, "potential security event (auth/access related)"),
    ("pattern_level_severity", ">=", 5, "ERROR/FATAL level log detected"),
    ("pattern_level_severity", ">=", 4, "WARNING level anomaly"),
    ("pattern_performance_pattern_score", ">=", 3, "performance metrics anomaly (%.0f indicators)"),
)
RECOMMENDATIONS = {
    "critical": ("Immediate investigation required", "Consider isolating affected systems", "Review security logs"),
    "high": ("Investigate within 1 hour", "Check system resources", "Review recent deployments"),
    "medium": ("Monitor for pattern continuation", "Check application health"),
    "low": ("Log for trend analysis",),
}


def explain_feature(name: Column, value: Column) -> Column:
    out = None
    for part, op, limit, text in SAYS:
        hit = F.contains(name, F.lit(part)) & {">": value > limit, "<": value < limit, ">=": value >= limit}[op]
        said = F.format_string(text, value) if "%" in text else F.lit(text)
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return out.when(value > 10, F.format_string("%s shows unusual high value (%.2f)", name, value))


def top_features(features: Column, n: int = 3) -> Column:
    """The entries of a map with the greatest values; ties by name."""
    pairs = F.transform(F.map_entries(features), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("name")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda e: F.struct(e["name"].alias("name"), (-e["v"]).alias("value")))


def reason(score: Column, features: Column, threshold: float = ALERT) -> Column:
    top = top_features(features)
    said = F.array_compact(F.transform(top, lambda e: explain_feature(e["name"], e["value"])))
    first = F.try_element_at(top, F.lit(1))
    return F.when(score < threshold, "normal behavior detected").when(F.size(said) > 0, F.array_join(said, "; ")).when(first.isNotNull(), F.format_string("anomalous patterns detected in %s (value: %.2f)", first["name"], first["value"])).otherwise("anomalous behavior detected")


def recommendations(severity_: Column, is_anomaly: Column) -> Column:
    table = F.create_map(*(x for k, v in RECOMMENDATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.when(is_anomaly, F.coalesce(table[severity_], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def verdict(df: DataFrame, scores: dict[str, Column], features: Column, threshold: float = ALERT) -> DataFrame:
    score = combine(scores)
    out = df.withColumn("anomaly_score", score)
    s = F.col("anomaly_score")
    return out.withColumns({"is_anomaly": s > threshold, "severity": severity(s), "confidence": confidence(list(scores.values())), "reason": reason(s, features, threshold)}).withColumn("recommendations", recommendations(F.col("severity"), F.col("is_anomaly")))


def training_buffer(df: DataFrame, ts: str, keys: list[str] = (), size: int = 10_000) -> DataFrame:
    """The newest records; per key by rank, over all by a top-k."""
    if not keys:
        return df.orderBy(F.desc(ts)).limit(size)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))).where(F.col("__r") <= size).drop("__r")


def similar(queries: DataFrame, buffer: DataFrame, names: list[str], ident: str = "id", k: int = 3, least: float = 0.8) -> DataFrame:
    """Up to ``k`` newest records of the training buffer that resemble each query: same source type and level, mean closeness over ``least``.

    The buffer is bounded by its size (10 000 records), so it is broadcast, as one list, newest first, for each source type
    and level; a query looks through its list, without a row a pair. A different level gives 0.5 and never passes.
    """
    entry = F.struct(F.col("timestamp").alias("t"), F.col(ident).alias("i"), *(F.col(n).alias(f"v{j}") for j, n in enumerate(names)))
    lists = buffer.groupBy("source_type", "level").agg(F.sort_array(F.collect_list(entry), asc=False).alias("__buffer"))

    def alike(x: Column) -> Column:
        close = sum((1.0 - F.least(F.abs(F.col(n) - x[f"v{j}"]), F.lit(1.0)) for j, n in enumerate(names)), F.lit(0.0)) / float(len(names))
        return (x["i"] != F.col(ident)) & (close > least)

    found = F.slice(F.filter("__buffer", alike), 1, k)
    rows = queries.join(F.broadcast(lists), ["source_type", "level"]).select(ident, F.transform(found, lambda x: x["i"]).alias("similar"))
    return rows.where(F.size("similar") > 0)
