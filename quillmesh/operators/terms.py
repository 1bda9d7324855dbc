"""Canonical terms in titles, abstracts, keywords and concepts, and records that they enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import folded
from ..functions.scores import abstract_warnings
from ..functions.text import distinct_ci, nonempty, text_of
from ..sources.records import canonicalize
from .network import once
from .vocabulary import CANONICAL_RULES

#: Provenance of what the rules add; a fixed value.
BY_RULES = "conservative-text-rules"


def canonical_names(text: Column, low: Column, rules=CANONICAL_RULES) -> Column:
    """Names of the rules that match, in rule order. Both texts should be plain columns; ``low`` is ``folded``."""
    return F.array_compact(F.array(*[F.when(r.found_in(text, low), r.name) for r in rules]))


def with_canonical_terms(articles: DataFrame, rules=CANONICAL_RULES, name: str = "canonical_terms") -> DataFrame:
    """``articles`` with the canonical terms of their title, abstract, keywords and concepts, searched once as one text."""
    parts = [nonempty(text_of("title")), nonempty(text_of("abstract")), *(nonempty(F.array_join(c, " ")) for c in ("keywords", "concepts"))]
    joined = articles.withColumn("_text", F.concat_ws("\n", *parts))
    found = joined.withColumn("_low", folded(F.col("_text")))
    made = found.select(*articles.columns, once(canonical_names(F.col("_text"), F.col("_low"), rules)).alias(name))
    return made


def enriched(articles: DataFrame, rules=CANONICAL_RULES) -> DataFrame:
    """Canonical article records whose keywords and concepts carry the canonical terms, with provenance.

    Terms follow the record's own, agreeing ones (in lower case) once; where there are any, the rules are
    named among the sources of keywords, concepts and enrichment. The sources of the abstract, keywords and
    concepts are sources of enrichment too, and warnings about the abstract join the record's.
    """
    df = with_canonical_terms(canonicalize(articles), rules, "_found")
    some = F.size("_found") > 0
    none = F.array().cast("array<string>")
    by_rules = F.when(some, F.array(F.lit(BY_RULES))).otherwise(none)
    df = df.withColumns({c: distinct_ci(F.concat(c, "_found")) for c in ("keywords", "concepts")} | {f"{c}_source": distinct_ci(F.concat(f"{c}_source", by_rules)) for c in ("keywords", "concepts")})
    origin = F.when(text_of("abstract_source") != "", F.array("abstract_source")).otherwise(none)
    sources = distinct_ci(F.concat("enrichment_sources", by_rules, origin, "keywords_source", "concepts_source"))
    warnings = distinct_ci(F.concat("metadata_warnings", abstract_warnings("abstract", "title", "abstract_source")))
    return df.withColumns({"enrichment_sources": sources, "metadata_warnings": warnings}).drop("_found")
