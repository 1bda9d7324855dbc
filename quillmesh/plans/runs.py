"""Whole runs composed of operators: capture, federated search, selection, network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import relevance
from ..operators.enrich import enrich, open_access_candidates, rank_lookup
from ..operators.extract import initial_candidates
from ..operators.incremental import numbered
from ..operators.network import build_nodes, tag_terms, term_set_links, term_sets, top_terms
from ..operators.resolve import dedupe_articles
from ..operators.search import search_top, select_candidates, union_sources, year_in_range


def capture(pages: DataFrame, key: str = "page_id", year_from: int = 0, year_to: int = 0, snapshots: dict | None = None) -> DataFrame:
    """Pages to merged articles: extract, merge by DOI, enrich from snapshots, merge again, filter years."""
    found = initial_candidates(pages, key)
    ranked = numbered(found, key, "branch", "found_at").withColumn("pos", F.col("number").cast("long")).drop("branch", "found_at", key, "number")
    merged = dedupe_articles(ranked).drop("n_merged")
    if snapshots:
        merged = dedupe_articles(enrich(merged, **snapshots)).drop("n_merged")
    return open_access_candidates(merged).filter(year_in_range("year", year_from, year_to))


def federated_search(sources: list[DataFrame], total: int, ranks: DataFrame | None = None, aliases: DataFrame | None = None, per_source: int | None = None) -> DataFrame:
    top = search_top(union_sources(*sources, per_source=per_source), total)
    return top if ranks is None else rank_lookup(top, "venue", ranks, aliases, alias_first=False)


def discover(hits: DataFrame, count: int, year_now: int, **vocabulary) -> DataFrame:
    score, priority, reasons = relevance(year_now, **vocabulary)
    return select_candidates(hits.withColumns({"score": score, "priority_hits": priority, "reasons": reasons}), count)


def network(articles: DataFrame, rules, fields=("title", "abstract"), key: str = "pos") -> dict[str, DataFrame]:
    """Terms, nodes, relations and top terms of a corpus.

    Relations are between sets of terms; ``sets`` says which articles have which, so that pairs of
    articles follow by joining the two and no frequent term makes a product.
    """
    terms = tag_terms(articles, rules, fields, key)
    return {"terms": terms, "nodes": build_nodes(terms, articles, key), "sets": term_sets(terms, key), "relations": term_set_links(terms, key), "top_terms": top_terms(terms, key=key)}
