"""Scores and labels of records: abstract quality, source priority, candidate relevance, PDF priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, int_or_zero, match_key, normalize_doi_casekeep, text_of, title_key

ACCESS_TEXT = r"(?i)\b(?:privacy policy|cookie policy|subscribe to read|access through your institution|purchase this article|read the full article)\b"
DESCRIPTION_SOURCES = ("dc.description", "og:description", "html-meta:description")
ACCESS_SOURCES = ("crossref", "openalex", "pubmed", "arxiv")
#: Source name part to rank of a full-text candidate; fixed values.
PDF_PRIORITY = (("citation_pdf_url", 10), ("json-ld", 20), ("arxiv", 30), ("europepmc", 40), ("pubmed central", 40), ("openalex", 50), ("unpaywall", 60), ("publisher", 70))


def has_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def abstract_warnings(text, title, source) -> Column:
    """Names of what is odd about an abstract: markup, fragment, duplicates_title, repeats_title, access_text."""
    t, k, a = text_of(text), title_key(title), title_key(text)
    start = F.when(t.rlike(r"^[)\]}>;,.:]"), "fragment").when(t.rlike(r"^[a-z][a-z-]*\s"), "lowercase")
    same = F.when((k != "") & (a == k), "duplicates_title").when((k != "") & a.startswith(F.concat(k, F.lit(" "))) & (F.length(a) < F.length(k) * 2), "repeats_title")
    found = F.array_compact(F.array(F.when(t.rlike(r"<[^>]+>"), "markup"), start, same, F.when(t.rlike(ACCESS_TEXT), "access_text")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(found)


def abstract_score(text, title, source) -> Column:
    """Quality of an abstract; null when there is none."""
    t, s = text_of(text), F.lower(text_of(source))
    base = F.least(F.length(t), F.lit(4000)) / 20.0 + F.least(F.regexp_count(t, F.lit(r"[.!?](?:\s|$)")), F.lit(12)) * 12
    bonus = F.when(F.contains(s, F.lit("citation_abstract")), 35).when(has_any(s, ACCESS_SOURCES), 25).when(F.contains(s, F.lit("json-ld")), 15).otherwise(0)
    low = F.when(has_any(s, DESCRIPTION_SOURCES), 35).otherwise(0)
    return F.when(t != "", (base - 75 * F.size(abstract_warnings(text, title, source)) + bonus - low).cast("double"))


def abstract_priority(source) -> Column:
    s = F.lower(text_of(source))
    return F.when(has_any(s, DESCRIPTION_SOURCES), 1).when(s != "", 2).otherwise(0)


def pdf_priority(source) -> Column:
    s, out = F.lower(text_of(source)), None
    for part, rank in PDF_PRIORITY:
        out = (F if out is None else out).when(F.contains(s, F.lit(part)), rank)
    return out.otherwise(90)


def _hit(text: Column, term: str, synonyms: dict[str, tuple[str, ...]]) -> Column:
    return has_any(text, (term, *synonyms.get(term, ())))


def relevance(year_now: int, priority_terms=(), query_terms=(), penalties=(), synonyms=None, fields=("title", "abstract", "venue", "source", "oa_url"), doi="doi", oa_url="oa_url", citations="citations", year="year"):
    """(score, priority hits, reasons) of a candidate; all vocabularies are parameters.

    ``query_terms``: (label, needles, points). ``penalties``: (label, needles, unless, points).
    ``synonyms``: match key of a priority term to further needles.
    """
    from pyspark.sql import functions as f

    text = match_key(f.concat_ws(" ", *[text_of(c) for c in fields]))
    y, c = int_or_zero(year), int_or_zero(citations)
    has_doi, has_oa = normalize_doi_casekeep(doi) != "", text_of(oa_url) != ""
    score = f.when(has_doi, 30.0).otherwise(0.0) + f.when(has_oa, 8.0).otherwise(0.0) + f.least(c, f.lit(500)) / 20.0
    score = score + f.when(y != 0, f.greatest(f.lit(0), 8 - f.greatest(f.lit(0), f.lit(year_now) - y)).cast("double")).otherwise(0.0)
    reasons = [f.when(has_doi, "has DOI"), f.when(has_oa, "has OA URL"), f.when((y != 0) & (f.lit(year_now) - y <= 5), "recent")]
    hits = []
    for term in priority_terms:
        hit = _hit(text, term.lower(), synonyms or {})
        score = score + f.when(hit, 20.0).otherwise(0.0)
        hits.append(f.when(hit, term))
        reasons.append(f.when(hit, f"priority term: {term}"))
    for label, needles, points in query_terms:
        hit = has_any(text, needles)
        score = score + f.when(hit, float(points)).otherwise(0.0)
        reasons.append(f.when(hit, f"query match: {label}"))
    for label, needles, unless, points in penalties:
        hit = has_any(text, needles) & (~has_any(text, unless) if unless else f.lit(True))
        score = score - f.when(hit, float(points)).otherwise(0.0)
        reasons.append(f.when(hit, f"penalty: {label}"))
    none = f.array().cast("array<string>")
    return f.bround(score, 3), f.array_compact(f.array(*hits)) if hits else none, f.array_distinct(f.array_compact(f.array(*reasons)))


def weighted_score(parts: dict[str, float]) -> Column:
    """Sum of columns with weights, for prose-defined rankings."""
    out = F.lit(0.0)
    for name, weight in parts.items():
        out = out + F.coalesce(col(name).cast("double"), F.lit(0.0)) * weight
    return out
