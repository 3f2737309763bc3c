"""The registered queries of this package: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join_documents

    return join_documents(_table(spark, sf_dir, "documents"))


def ngram_join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as op1, with every shingle of the exact prefix sent."""
    from .ngram_join import join_documents

    return join_documents(_table(spark, sf_dir, "documents"), certainty=None)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_turns, read_back

    said = "</s>[INST] ok [/INST]"
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(table.unionByName(extra)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup

    out = dedup(_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    return out.withColumn("n_removed", F.size("removed").cast("long"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import digest

    return digest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_html_extraction, op3_packing, op4_decontamination, op5_chat_formatting, op6_quality_rules, op7_quality_classifier, op8_language_id, op9_substring_dedup, op10_token_output, ngram_join_exact)}
