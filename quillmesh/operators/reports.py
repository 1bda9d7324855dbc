"""Run report counters and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonempty, text_of


def run_counters(articles: DataFrame) -> DataFrame:
    """One row: records, abstracts, enriched, low confidence, failed, warnings."""
    conf, notes = F.coalesce("confidence", F.lit(0.0)), F.size("notes") > 0
    return articles.agg(
        F.count("*").alias("captured"), F.count_if(text_of("abstract") != "").alias("with_abstract"), F.count_if((text_of("title") != "") & (conf >= 0.65)).alias("enriched"), F.count_if(conf < 0.6).alias("low_confidence"),
        F.count_if(notes | (conf < 0.5)).alias("failed"), F.coalesce(F.sum(F.size("metadata_warnings")), F.lit(0)).alias("warnings"),
    )


def abstract_source_counts(articles: DataFrame) -> DataFrame:
    rows = articles.filter(text_of("abstract") != "")
    return rows.groupBy(F.coalesce(nonempty(text_of("abstract_source")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def list_source_counts(articles: DataFrame, column: str) -> DataFrame:
    """Counts of the exploded provenance list, such as keywords_source."""
    return articles.select(F.explode(column).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def pdf_counts(articles: DataFrame) -> DataFrame:
    """(kind, value, n): status, source of downloads, and errors."""
    entries = F.array_compact(F.array(
        F.struct(F.lit("status").alias("kind"), F.coalesce(nonempty(text_of("pdf_status")), F.lit("unknown")).alias("value")),
        F.when(F.col("pdf_status") == "downloaded", F.struct(F.lit("source").alias("kind"), F.coalesce(nonempty(text_of("pdf_source")), F.lit("none")).alias("value"))),
        F.when(text_of("pdf_error") != "", F.struct(F.lit("error").alias("kind"), text_of("pdf_error").alias("value"))),
    ))
    return articles.select(F.explode(entries).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))


def pdf_manifest(articles: DataFrame) -> DataFrame:
    ok = F.col("pdf_status") == "downloaded"
    return articles.agg(F.count("*").alias("total_articles"), F.count_if(ok).alias("downloaded"), F.count_if(~ok).alias("failed"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
