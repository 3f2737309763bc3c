"""Quality rules with adaptive thresholds.

Each text is measured once. The measures go into mergeable quantile sketches per (lang, source): counts of
log-linear buckets, which add up over any partitioning, so that the result doesn't depend on how rows are dealt.
Upper fences replace fixed cutoffs: the ninth decile plus ``reach`` times its distance from the median, all read from the
sketches. A group's fence is weighed by its number of texts against that of its language, and that against the one of all texts
(each prior weighs as much as ``prior`` texts), so a small group leans on the larger ones without a switch. Fences are joined
to the measures and the texts filtered.

Shares of symbols, equal lines and repeated words are taken from the count less twice its square root: what a text has
beyond the noise of a small count. So a fence at zero (most texts of a group have none) doesn't reject a text for a symbol or two.

Defined cases: a null or empty text has no words and fails the base rules; null lang or source is a group of its
own; repeated rows are measured and returned each; a value equal to its fence is kept; an empty table gives an empty result; other
columns pass through ``filter_documents`` untouched, whatever their names are (the operator's own columns get names that the input lacks).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, as_bytes, free_name, materialize, tidy

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SCHEMA = ", ".join(f"{x} long" for x in MEASURES)


def measure(b: bytes) -> tuple[int, int, int, int, int, int]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = b.split()  # for bytes: exactly x20 and x09 to x0D
    n = len(words)
    bare = b.translate(None, WHITE)
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8"))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        first: dict[tuple, int] = {}
        last = -1  # words up to here are counted
        spans: list[int] = []
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            for i, x in enumerate(windows):
                if (j := first.setdefault(x, i)) != i:
                    spans += (j, i)
            for i in sorted(set(spans)):
                repeat += i + 3 - max(i, last + 1)
                last = i + 2
    return n, chars, symbols, dup, repeat, len(lines)


def with_measures(documents: DataFrame, keep: list[str], text: str = "text", name: str = "measures") -> DataFrame:
    """The columns ``keep`` and a struct column ``name`` of the measures of column ``text``."""
    fields = documents.select(*(F.col(f"`{c}`") for c in keep)).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{name}` struct<{_SCHEMA.replace(' long', ':bigint')}>"])
    kind = pa.struct([(x, pa.int64()) for x in MEASURES])
    carried = keep if text in keep else [*keep, text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = list(zip(*map(measure, as_bytes(part.column(part.schema.get_field_index(text)))), strict=True))
                columns = [pa.array(x, pa.int64()) for x in rows] if rows else [pa.array([], pa.int64()) for _ in MEASURES]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in keep), pa.StructArray.from_arrays(columns, fields=list(kind))], names=[*keep, name])

    return documents.select(*(F.col(f"`{c}`") for c in carried)).mapInArrow(tidy(run), schema)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


#: What thresholds are set on.
FEATURES = ("symbols", "dup_lines", "repeats", "word_length")


def features(m: Column) -> dict[str, Column]:
    """``FEATURES`` as whole numbers (shares per 10,000, characters per 1,000 words); high values are bad in each."""
    n = F.greatest(m["n_words"], F.lit(1))

    def share(count: Column, of: Column) -> Column:
        return F.greatest(F.floor((count - 2 * F.sqrt(count)) * 10_000 / of), F.lit(0)).cast("long")

    return {
        "symbols": share(m["n_symbols"], n),
        "dup_lines": share(m["n_dup_lines"], F.greatest(m["n_lines"], F.lit(1))),
        "repeats": share(m["n_repeat_words"], n),
        "word_length": F.floor(m["word_chars"] * 1_000 / n),
    }


def bucket(x: Column) -> Column:
    """Log-linear bucket of a non-negative whole number: exact below 128, else its seven leading bits; relative error under 1/64."""
    shift = F.greatest(F.length(F.conv(x.cast("string"), 10, 2)) - 7, F.lit(0))
    return F.when(x < 128, x).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)).cast("long")


def sketches(measured: DataFrame, name: str = "measures") -> DataFrame:
    """One row per (lang, source, feature, bucket) with its count; the base rules' rejects don't count."""
    m = F.col(name)
    pairs = F.array(*(F.struct(F.lit(k).alias("feature"), bucket(v).alias("bucket")) for k, v in features(m).items()))
    return measured.where(~base_failed(m)).select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", F.col("p.feature").alias("feature"), F.col("p.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Fence and number of texts per key and feature, from the buckets of one key and feature (a bounded number)."""
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "feature").orderBy("bucket")
    ranked = merged.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda tenths: F.min(F.when(F.col("upto") * 10 >= F.col("total") * tenths, F.col("bucket")))
    found = ranked.groupBy(*keys, "feature").agg(F.max("total").alias("size"), at(5).alias("q5"), at(9).alias("q9"))
    return found.select(*keys, "feature", "size", (F.col("q9") + (F.col("q9") - F.col("q5")) * reach).alias("fence"))


def thresholds(sketch: DataFrame, prior: int = 100, reach: float = 8.0) -> DataFrame:
    """(lang, source) -> upper fence of each feature, weighed against those of the language and of all texts."""
    group = _fences(sketch, ["lang", "source"], reach)
    lang = _fences(sketch, ["lang"], reach).toDF("lang_", "feature_", "lang_size", "lang_fence")
    everything = _fences(sketch, [], reach).toDF("feature__", "all_size", "all_fence")
    joined = group.join(lang, group.lang.eqNullSafe(F.col("lang_")) & (F.col("feature") == F.col("feature_"))).join(F.broadcast(everything), F.col("feature") == F.col("feature__"))
    of_lang = (F.col("lang_fence") * F.col("lang_size") + F.col("all_fence") * prior) / (F.col("lang_size") + prior)
    weighed = (F.col("fence") * F.col("size") + of_lang * prior) / (F.col("size") + prior)
    return joined.select("lang", "source", "feature", weighed.alias("fence")).groupBy("lang", "source").pivot("feature", list(FEATURES)).agg(F.first("fence"))


#: Threshold rows that may be broadcast (some hundred bytes each); more are joined by a shuffle, which AQE splits where a group is hot.
BROADCAST_ROWS = 50_000


def judged(measured: DataFrame, limits: DataFrame, name: str = "measures", verdict: str = "verdict") -> DataFrame:
    """``measured`` with booleans ``base_failed`` and ``kept`` in a struct column ``verdict``; both names must be free."""
    lang, source, fences = (free_name(f"limit_{x}", [*measured.columns, name, verdict]) for x in ("lang", "source", "fences"))
    limits = materialize(limits.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*FEATURES).alias(fences)), "thresholds")
    side = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    m, t = F.col(name), F.col(fences)
    beyond = F.lit(False)
    for k, v in features(m).items():
        beyond = beyond | F.coalesce(v > t[k], F.lit(False))
    failed = base_failed(m)
    joined = measured.join(side, measured["lang"].eqNullSafe(F.col(lang)) & measured["source"].eqNullSafe(F.col(source)), "left")
    return joined.withColumn(verdict, F.struct(failed.alias("base_failed"), (~failed & ~beyond).alias("kept"))).drop(lang, source, fences)


def score_documents(documents: DataFrame, prior: int = 100, reach: float = 8.0) -> DataFrame:
    """One row per document: its measures and verdict. The measures are taken once and written to the shared folder."""
    measured = materialize(with_measures(documents, ["doc_id", "lang", "source"]), "measures")
    out = judged(measured, thresholds(sketches(measured), prior, reach))
    return out.select("doc_id", *(F.col("measures")[x].alias(x) for x in MEASURES[:5]), F.col("verdict.base_failed").alias("base_failed"), F.col("verdict.kept").alias("kept"))


def filter_documents(documents: DataFrame, prior: int = 100, reach: float = 8.0) -> DataFrame:
    """The documents that the rules keep, with all their columns. Texts are read twice and never shuffled."""
    limits = thresholds(materialize(sketches(with_measures(documents, ["lang", "source"])), "sketches"), prior, reach)
    name, verdict = (free_name(x, documents.columns) for x in ("measures", "verdict"))
    measured = with_measures(documents, documents.columns, name=name)
    return judged(measured, limits, name, verdict).where(F.col(verdict)["kept"]).select(*(F.col(f"`{c}`") for c in documents.columns))
