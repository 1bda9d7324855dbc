"""Schemas of the records this library works on, as Spark DDL."""

from __future__ import annotations

ARTICLE = """title STRING, authors ARRAY<STRING>, year STRING, journal STRING, volume STRING, issue STRING,
pages STRING, doi STRING, url STRING, pdf_url STRING, pdf_path STRING, pdf_error STRING,
oa_status STRING, license STRING, source_page STRING, metadata_source STRING,
abstract STRING, abstract_source STRING, keywords ARRAY<STRING>, keywords_source ARRAY<STRING>,
concepts ARRAY<STRING>, concepts_source ARRAY<STRING>, enrichment_sources ARRAY<STRING>,
metadata_warnings ARRAY<STRING>, citation_count BIGINT,
journal_rank STRUCT<source:STRING,tier:STRING,level:STRING,impact_factor:STRING,jcr:STRING,cas:STRING,cas_top:STRING,citescore:STRING>,
confidence DOUBLE, pmid STRING, arxiv_id STRING, pdf_status STRING, pdf_source STRING, pdf_file STRING,
pdf_candidates ARRAY<STRUCT<url:STRING,source:STRING,license:STRING,oa_status:STRING>>, notes ARRAY<STRING>"""

PUBLIC_FIELDS = 27
SEARCH_HIT = "title STRING, authors STRING, year INT, venue STRING, doi STRING, citations INT, source STRING, oa_url STRING"
RANK = "name STRING, tier STRING, level STRING, impact_factor DOUBLE"
ALIAS = "alias STRING, name STRING"
TASK = "state STRING, type STRING, doi STRING, zoteroKey STRING, status STRING, createdAt STRING, updatedAt STRING, title STRING, pos BIGINT"
CROSSREF_WORK = """title ARRAY<STRING>, `container-title` ARRAY<STRING>, author ARRAY<STRUCT<given:STRING,family:STRING>>,
`published-print` STRUCT<`date-parts`:ARRAY<ARRAY<INT>>>, `published-online` STRUCT<`date-parts`:ARRAY<ARRAY<INT>>>, published STRUCT<`date-parts`:ARRAY<ARRAY<INT>>>,
volume STRING, issue STRING, page STRING, DOI STRING, URL STRING, abstract STRING, subject ARRAY<STRING>, `is-referenced-by-count` BIGINT"""
OPENALEX_WORK = """id STRING, doi STRING, title STRING, publication_year INT, cited_by_count BIGINT, abstract_inverted_index MAP<STRING,VARIANT>,
concepts ARRAY<STRUCT<display_name:STRING>>, topics ARRAY<STRUCT<display_name:STRING>>, keywords ARRAY<STRUCT<display_name:STRING>>,
authorships ARRAY<STRUCT<author:STRUCT<display_name:STRING>>>,
primary_location STRUCT<pdf_url:STRING,license:STRING,source:STRUCT<display_name:STRING>>, best_oa_location STRUCT<pdf_url:STRING,license:STRING>,
open_access STRUCT<is_oa:BOOLEAN,oa_status:STRING,oa_url:STRING>, biblio STRUCT<volume:STRING,issue:STRING,first_page:STRING,last_page:STRING>"""
UNPAYWALL = """doi STRING, oa_status STRING, best_oa_location STRUCT<url_for_pdf:STRING,license:STRING>,
oa_locations ARRAY<STRUCT<url_for_pdf:STRING,license:STRING>>"""
EUROPEPMC = "resultList STRUCT<result:ARRAY<STRUCT<isOpenAccess:STRING,pmcid:STRING,license:STRING>>>"
