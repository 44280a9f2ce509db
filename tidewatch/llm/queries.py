"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import sql
from tidewatch.llm.convrepair import repair_report
from tidewatch.llm.decontaminate import decontaminate
from tidewatch.llm.htmltext import extract
from tidewatch.llm.jaccardjoin import near_duplicates
from tidewatch.llm.langid import predict_language
from tidewatch.llm.licenses import scan_licenses
from tidewatch.llm.linededup import drop_repeated_lines
from tidewatch.llm.lm import language_scores
from tidewatch.llm.mixing import mix
from tidewatch.llm.quality import fit_on_labels, score_quality
from tidewatch.llm.qualityrank import classify_quality
from tidewatch.llm.text import table
from tidewatch.llm.tokenalign import align
from tidewatch.llm.tokenfiles import token_rows


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and the smallest id its near duplicates reach."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts, the trees' score and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score_quality(docs, fit_on_labels(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark passages."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines before and the text after repeated lines went."""
    done = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its unigram score and that of the automaton of order 3 with all its n-grams."""
    return language_scores(table(spark, sf_dir, "documents"), order=3, min_count=1)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    rows, order = mix(table(spark, sf_dir, "documents"))
    key = ("_id", "_row", "source")
    uses = order.groupBy(*[F.col(k).alias(f"u{k}") for k in key]).agg(F.count(F.lit(1)).alias("uses"), F.min("position").alias("first_position"))
    equal = rows.groupBy(*key, "size", "source_size", "target").agg(F.count(F.lit(1)).alias("copies"))
    same = F.col("_id").eqNullSafe(F.col("u_id")) & (F.col("_row") == F.col("u_row")) & F.col("source").eqNullSafe(F.col("usource"))
    # equal rows share their uses out, each gets whole ones
    share = F.expr("uses div copies") + F.when(F.col("copy") <= F.col("uses") % F.col("copies"), 1).otherwise(0)
    return (
        equal.join(uses, same, "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(F.col("_id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), F.coalesce(share * F.col("size"), F.lit(0)).cast("long").alias("taken"), F.round("first_position", 6).alias("first_position"))
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the token files and a checksum of what they hold of it."""
    return token_rows(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence phrases and labels."""
    done = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).cast("long").alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "host", "path")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    return predict_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and its cheapest repair."""
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the groups and links of its tokens under two tokenizers."""
    found, _ = align(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score from pairwise ranking."""
    done = classify_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_quality_rules,
        op3_benchmark_decontamination,
        op4_line_dedup,
        op5_language_model_scores,
        op6_source_mixing,
        op7_token_files,
        op8_license_scan,
        op9_html_extraction,
        op10_language_id,
        op11_conversation_repair,
        op12_token_alignment,
        op13_quality_classifier,
    )
}
ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": sql.OP1, "op3_benchmark_decontamination": sql.OP3, "op4_line_dedup": sql.OP4, "op6_source_mixing": sql.OP6}
