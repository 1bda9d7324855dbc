"""Federated search and candidate selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import int_or_zero, match_key, nonempty, normalize_doi
from .resolve import best_by_doi


def union_sources(*sources: DataFrame, per_source: int | None = None) -> DataFrame:
    """Hits of all sources in source order; at most ``per_source`` of each, where that is wanted."""
    rows = reduce(DataFrame.unionByName, sources)
    if per_source is not None:
        w = Window.partitionBy("src_rank").orderBy("pos")
        rows = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_source).drop("_n")
    return rows


def year_in_range(year, year_from: int = 0, year_to: int = 0, unknown_passes: bool = True) -> Column:
    """Inclusive range, 0 is open. Unknown years pass, or fail a lower bound when they may not."""
    y = int_or_zero(year)
    low, high = (y >= year_from) if year_from else F.lit(True), (y <= year_to) if year_to else F.lit(True)
    return (y == 0) | (low & high) if unknown_passes else low & high


def search_top(hits: DataFrame, total: int, doi: Column | None = None) -> DataFrame:
    """Best hit per DOI, by citations and year; the first ``total`` with their number."""
    best = best_by_doi(hits, normalize_doi("doi") if doi is None else doi)
    top = best.orderBy(F.desc("citations"), F.desc("year"), "src_rank", "pos").limit(total)
    return top.withColumn("number", F.row_number().over(Window.orderBy(F.desc("citations"), F.desc("year"), "src_rank", "pos")))


def select_candidates(scored: DataFrame, count: int, score: str = "score") -> DataFrame:
    """By score, year and title, the first of each title, ``count`` of them with their number."""
    order = (F.desc(score), int_or_zero("year").desc(), F.asc("title"), F.asc("pos"))
    keyed = scored.withColumn("_key", F.coalesce(nonempty(match_key("title")), F.concat(F.lit("row:"), F.col("pos").cast("string"))))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_n = 1").drop("_n", "_key")
    return first.orderBy(*order).limit(count).withColumn("number", F.row_number().over(Window.orderBy(*order)))


def in_requested_order(items: DataFrame, dois: list[str], pos: str = "pos") -> DataFrame:
    """Items of the requested DOIs in the order asked for; of repeated ones the last counts."""
    spark = items.sparkSession
    wanted = spark.createDataFrame(list(enumerate(dict.fromkeys(dois))), "asked int, d string").select("asked", normalize_doi("d").alias("_d"))
    last = items.withColumn("_d", normalize_doi("doi")).withColumn("_n", F.row_number().over(Window.partitionBy("_d").orderBy(F.desc(pos)))).filter("_n = 1")
    return wanted.join(last, "_d").drop("_d", "_n")
