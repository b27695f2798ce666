"""The registered queries of the subpackage: op<N>_<name> on its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.attention_lm import score_texts
from panelspark.llm.chat import rotate
from panelspark.llm.common import table
from panelspark.llm.decontaminate import contamination
from panelspark.llm.divergence import divergence
from panelspark.llm.near_dups import near_duplicates
from panelspark.llm.neighbours import neighbours
from panelspark.llm.packing import pack
from panelspark.llm.quality import score_quality
from panelspark.llm.robust_rules import judge_quality
from panelspark.llm.secrets import with_secrets
from panelspark.llm.toxicity import score_toxicity
from panelspark.llm.url_filter import judge
from panelspark.llm.whitening import whitened


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitened(table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").cast("long"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_quality_ranking, op2_decontaminate, op3_attention_lm, op4_best_fit_packing, op5_posting_lists, op6_near_duplicates,
            op7_secret_scans, op8_url_filter, op9_toxicity, op10_perspectives, op11_robust_outliers, op12_exact_whitening, op13_source_divergence,
        )
    }


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB, one file per query that SQL can express."""
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "sql").glob("*.sql"))}
