"""Registered queries of mappings from service payloads: records are written in a service's form, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _ABSTRACT, DOI, LIT, lit, query
from .catalog import _stripped
from .functions import text as T
from .operators import enrich as E
from .operators import research as G
from .operators import search as Q
from .sources import derived as D
from .sources import records as M
from .sources import schemas

_CITED = {"title": _stripped("title"), "doi": DOI}
_YEAR = "coalesce(try_cast(year as int), 0)"


def _json(rows, schema: str, *extra: str, **fields):
    """Records as a service's JSON, parsed by ``schema``."""
    text = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return M.parsed(rows.select("pos", *extra, text.alias("j")), "j", schema).select("pos", *extra, "w")


def _openalex(spark, sf):
    rows = lit(spark, sf)
    place = F.struct(F.struct(F.col("journal").alias("display_name")).alias("source"), F.lit("cc-by").alias("license"))
    return _json(
        rows, schemas.OPENALEX_WORK, id=F.concat(F.lit("W"), "pos"), doi=F.col("doi"), title=F.col("title"), publication_year=F.col("year").try_cast("int"), cited_by_count=F.col("citations"), primary_location=place,
        authorships=F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))), open_access=F.struct(F.lit("gold").alias("oa_status"), F.col("url").alias("oa_url")),
        concepts=F.transform("keywords", lambda k: F.struct(k.alias("display_name"))), biblio=F.struct(F.col("k").cast("string").alias("first_page"), F.when(F.expr("pos % 2 = 0"), F.col("pos").cast("string")).alias("last_page")),
    )


@query(f"""with {LIT} select pos, {_CITED['title']} as title, {DOI} as doi, coalesce(cast(try_cast(year as int) as varchar), '') as year, journal, array_to_string(authors, '|') as authors, case when lower(url) like '%.pdf' then url else '' end as pdf_url, citations as citation_count, case when {DOI} <> '' then 0.9 else 0.68 end as confidence,
concat_ws('-', cast(k as varchar), case when pos % 2 = 0 then cast(pos as varchar) end) as pages, case when lower(keywords[1]) = lower(keywords[2]) then keywords[1] else keywords[1] || '|' || keywords[2] end as concepts, 'cc-by' as license, 'gold' as oa_status from lit""")
def openalex_mapped(spark, sf):
    a = M.openalex_articles(_openalex(spark, sf))
    return a.select("pos", "title", "doi", "year", "journal", F.array_join("authors", "|").alias("authors"), "pdf_url", "citation_count", "confidence", "pages", F.array_join("concepts", "|").alias("concepts"), "license", "oa_status")


@query(f"""with {LIT} select pos, {_CITED['title']} as title, array_to_string(authors, '; ') as authors, {_YEAR} as year, journal as venue, {DOI} as doi, cast(coalesce(citations, 0) as int) as citations, 'openalex' as source, case when lower(url) like '%.pdf' then url else '' end as oa_url, 0 as src_rank from lit""")
def openalex_search_hits(spark, sf):
    return M.search_hits(M.openalex_articles(_openalex(spark, sf)), "openalex", 0)


def _crossref(spark, sf):
    rows = lit(spark, sf)
    people = F.transform("authors", lambda a: F.struct(F.split_part(a, F.lit(" "), F.lit(1)).alias("given"), F.split_part(a, F.lit(" "), F.lit(2)).alias("family")))
    dated = F.when(F.col("year") != "", F.struct(F.array(F.array(F.col("year").cast("int"))).alias("date-parts")))
    return _json(
        rows, schemas.CROSSREF_WORK + ", type STRING", title=F.array("title"), author=people, published=dated, DOI=F.col("doi"), URL=F.col("url"), abstract=F.col("abstract"), volume=F.col("k").cast("string"),
        type=F.when(F.expr("pos % 6 = 0"), "book").otherwise("journal-article"), subject=F.col("keywords"), **{"container-title": F.when(F.expr("pos % 4 <> 0"), F.array("journal")), "is-referenced-by-count": F.col("citations")},
    )


@query(f"""with {LIT} select pos, {_CITED['title']} as title, array_to_string(authors, '|') as authors, year, case when pos % 4 <> 0 then journal else '' end as journal, cast(k as varchar) as volume, {DOI} as doi, url, {_ABSTRACT} as abstract, case when {_ABSTRACT} <> '' then 'crossref' else '' end as abstract_source,
citations as citation_count, case when {DOI} <> '' then 0.95 else 0.7 end as confidence from lit""")
def crossref_mapped(spark, sf):
    a = M.crossref_articles(_crossref(spark, sf))
    return a.select("pos", "title", F.array_join("authors", "|").alias("authors"), "year", "journal", "volume", "doi", "url", "abstract", "abstract_source", "citation_count", "confidence")


@query(f"""with {LIT} select pos, title, 'Fam' || (pos % 23) || ', A; Lee' || (pos % 5) || ', B' as authors, {_YEAR} as year, case when pos % 4 <> 0 then journal else 'N/A' end as venue, doi, cast(coalesce(citations, 0) as int) as citations, 'crossref' as source
from lit where pos % 6 <> 0 and abstract <> '' and title <> '' and {_YEAR} between 2000 and 2015""")
def crossref_filtered(spark, sf):
    """Journal articles with an abstract and a title within the years."""
    return M.crossref_hits(_crossref(spark, sf), year_from=2000, year_to=2015).select("pos", "title", "authors", "year", "venue", "doi", "citations", "source")


@query(f"""with {LIT} select pos, cast(pos as varchar) as id, title, array_to_string(authors, '; ') as authors, {_YEAR} as year, case when pos % 3 = 0 then 'N/A' else journal end as venue, replace(doi, 'doi: ', '') as doi from lit where pos % 5 <> 2""")
def pubmed_two_step(spark, sf):
    """Found ids looked up among summaries that lack a fifth of them."""
    rows = lit(spark, sf)
    ids = rows.select("pos", F.col("pos").cast("string").alias("id"))
    authors = F.transform("authors", lambda a: F.struct(a.alias("name")))
    dated = F.when(F.col("year") != "", F.concat("year", F.lit(" Mar")))
    detail = F.struct("title", dated.alias("pubdate"), authors.alias("authors"), F.when(F.expr("pos % 3 <> 0"), F.col("journal")).alias("source"), F.col("doi").alias("elocationid"))
    return M.pubmed_hits(ids, rows.filter("pos % 5 <> 2").select(F.col("pos").cast("string").alias("id"), detail.alias("d"))).select("pos", "id", "title", "authors", "year", "venue", "doi")


def _tag(name: str, value, attributes: str = ""):
    return F.concat(F.lit(f"<{name}{attributes}>"), T.text_of(value), F.lit(f"</{name}>"))


@query(f"""with {LIT} select pos, 'On ' || journal as title, array_to_string(authors, '|') as authors, year, journal, cast(k as varchar) as volume, {DOI} as doi, cast(pos as varchar) as pmid, 'https://pubmed.ncbi.nlm.nih.gov/' || pos || '/' as url, 'Aim. Result ' || pos as abstract,
case when {DOI} <> '' then 0.9 else 0.78 end as confidence from lit""")
def pubmed_mapped(spark, sf):
    rows = lit(spark, sf)
    people = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<Author><LastName>"), F.split_part(a, F.lit(" "), F.lit(2)), F.lit("</LastName><ForeName>"), F.split_part(a, F.lit(" "), F.lit(1)), F.lit("</ForeName></Author>"))), "")
    date = F.when(F.expr("pos % 2 = 0"), _tag("Year", "year")).otherwise(_tag("MedlineDate", F.concat("year", F.lit(" Jan-Feb"))))
    xml = F.concat(
        F.lit("<PubmedArticle>"), _tag("PMID", F.col("pos")), _tag("ArticleTitle", F.concat(F.lit("On "), "journal")), people, F.lit("<Journal>"), _tag("Title", "journal"), F.lit("<JournalIssue>"), _tag("Volume", F.col("k")), F.lit("<PubDate>"), date,
        F.lit("</PubDate></JournalIssue></Journal><AbstractText>Aim.</AbstractText>"), _tag("AbstractText", F.concat(F.lit("Result "), F.col("pos"))), _tag("ArticleId", "doi", " IdType='doi'"), F.lit("</PubmedArticle>"),
    )
    a = M.pubmed_articles(rows.select("pos", xml.alias("xml")))
    return a.select("pos", "title", F.array_join("authors", "|").alias("authors"), "year", "journal", "volume", "doi", "pmid", "url", "abstract", "confidence")


def _atom(spark, sf):
    rows = lit(spark, sf)
    people = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name>"), a, F.lit("</name></author>"))), "")
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/2101."), F.lpad(F.col("pos").cast("string"), 9, "0"), F.lit("v2</id>"), _tag("title", F.concat(F.lit("On\n "), "journal")), people, _tag("published", F.concat(F.coalesce(T.nonempty("year"), F.lit("1990")), F.lit("-01-02"))), _tag("summary", F.repeat(F.concat("journal", F.lit(" ")), 30)), F.lit("<category term='cs.LG'/></entry>"))
    return rows.select("pos", F.concat(F.lit("<feed>"), entry, F.lit("</feed>")).alias("xml"))


_ARX = "'2101.' || lpad(cast(pos as varchar), 9, '0')"
_AYEAR = "coalesce(nullif(year, ''), '1990')"


@query(f"""with {LIT} select pos, 'On ' || journal as title, array_to_string(authors, '|') as authors, {_AYEAR} as year, {_ARX} as arxiv_id, 'https://arxiv.org/pdf/' || {_ARX} as pdf_url, 'cs.LG' as concepts, trim(repeat(journal || ' ', 30)) as abstract, 0.86 as confidence from lit""")
def arxiv_mapped(spark, sf):
    a = M.arxiv_articles(_atom(spark, sf))
    return a.select("pos", "title", F.array_join("authors", "|").alias("authors"), "year", "arxiv_id", "pdf_url", F.array_join("concepts", "|").alias("concepts"), "abstract", "confidence")


@query(f"""with {LIT} select 'On ' || journal as title, array_to_string(authors, '; ') as authors, cast({_AYEAR} as int) as year, 'http://arxiv.org/abs/' || {_ARX} || 'v2' as oa_url, 'arXiv' as venue, 'arxiv' as source from lit""")
def arxiv_feed_hits(spark, sf):
    return M.arxiv_hits(_atom(spark, sf)).select("title", "authors", "year", "oa_url", "venue", "source")


@query(f"""with {LIT} select 'On ' || journal as title, substr(trim(repeat(journal || ' ', 30)), 1, 200) as summary, count(*) as n from lit group by 1, 2""")
def arxiv_feed_summaries(spark, sf):
    return M.arxiv_summaries(_atom(spark, sf)).groupBy("title", "summary").agg(F.count("*").alias("n"))


@query(f"""with {LIT} select pos, title, array_to_string(authors, '; ') as authors, {_YEAR} as year, journal as venue, doi, 'wanfang' as source, case when doi <> '' then 'https://doi.org/' || doi else 'https://d.wanfangdata.com.cn/periodical/id' || pos end as oa_url from lit""")
def journal_service_hits(spark, sf):
    r = F.struct(F.col("title").alias("Title"), F.col("authors").alias("Author"), F.col("year").alias("Year"), F.col("journal").alias("PeriodicalName"), F.col("doi").alias("Doi"), F.concat(F.lit("id"), "pos").alias("ObjectId"))
    return M.journal_hits(lit(spark, sf).select("pos", r.alias("r"))).drop("citations")


# --- open access ----------------------------------------------------------------------------------

_UNPAYWALL = "[{'u': 'https://u.org/' || k, 's': 'unpaywall'}, {'u': 'https://u.org/' || k, 's': 'unpaywall'}, {'u': case when pos % 2 = 0 then '' else 'https://v.org/' || pos end, 's': 'unpaywall'}]"
_PLACES = "[{'u': 'https://b.org/' || k, 's': 'openalex'}, {'u': case when pos % 3 = 0 then 'https://u.org/' || k else '' end, 's': 'openalex'}]"
_EUROPE = "case when pos % 4 = 1 then [{'u': 'https://europepmc.org/articles/P' || pos || '?pdf=render', 's': 'europepmc'}] else [] end"


@query(f"""with {LIT}, c as (select pos, list_concat([{{'u': url, 's': case when pos % 5 = 0 then 'arXiv' else 'publisher-provided PDF link' end}}, {{'u': case when pos % 5 = 0 then 'https://arxiv.org/pdf/' || pos else '' end, 's': 'arXiv'}}], {_UNPAYWALL}, {_PLACES}, {_EUROPE}) as cs from lit),
e as (select pos, unnest(cs) as c, generate_subscripts(cs, 1) as i from c), f as (select pos, c.u as url, min(i) as i, arg_min(c.s, i) as source from e where c.u <> '' group by 1, 2)
select pos, string_agg(source || ' ' || url, '|' order by i) as candidates from f group by 1""")
def open_access_merged(spark, sf):
    """Links of the record, arXiv and three services in their order, each address once."""
    rows = lit(spark, sf)
    up = F.struct(F.lit("gold").alias("oa_status"), F.struct(F.concat(F.lit("https://u.org/"), "k").alias("url_for_pdf"), F.lit("cc").alias("license")).alias("best_oa_location"),
                  F.array(F.struct(F.concat(F.lit("https://u.org/"), "k").alias("url_for_pdf"), F.lit("cc").alias("license")), F.struct(F.when(F.expr("pos % 2 = 0"), "").otherwise(F.concat(F.lit("https://v.org/"), "pos")).alias("url_for_pdf"), F.lit("cc").alias("license"))).alias("oa_locations"))
    place = lambda u: F.struct(u.alias("pdf_url"), F.lit("cc").alias("license"))
    oa = F.struct(place(F.concat(F.lit("https://b.org/"), "k")).alias("best_oa_location"), place(F.when(F.expr("pos % 3 = 0"), F.concat(F.lit("https://u.org/"), "k")).otherwise("")).alias("primary_location"), F.struct(F.lit("green").alias("oa_status")).alias("open_access"))
    ep = F.struct(F.struct(F.array(F.struct(F.when(F.expr("pos % 4 = 1"), "Y").otherwise("N").alias("isOpenAccess"), F.concat(F.lit("P"), "pos").alias("pmcid"), F.lit("cc").alias("license"))).alias("result")).alias("resultList"))
    payloads = rows.select("pos", F.col("url").alias("pdf_url"), F.when(F.expr("pos % 5 = 0"), F.col("pos").cast("string")).otherwise("").alias("arxiv_id"), F.to_json(up).alias("up"), F.to_json(oa).alias("oa"), F.to_json(ep).alias("ep"))
    a = M.canonicalize(payloads)
    found = E.open_access_candidates(a, M.unpaywall_candidates(F.from_json("up", schemas.UNPAYWALL)), M.openalex_candidates(F.from_json("oa", schemas.OPENALEX_WORK)), M.europepmc_candidates(F.from_json("ep", schemas.EUROPEPMC)))
    return found.select("pos", F.array_join(F.transform("pdf_candidates", lambda c: F.concat_ws(" ", c["source"], c["url"])), "|").alias("candidates"))


# --- ranks, columns -------------------------------------------------------------------------------


@query(f"""with {LIT}, {D.RANK_SQL}, a as (select distinct case when pos % 2 = 0 then 'journal' else 'issn' end as kind, case when pos % 2 = 0 then journal else '1234-000' || (pos % 12) end as value from lit), r as (select *, '1234-000' || regexp_extract(name, '\\d+') as issn from ranks),
j as (select a.*, case when kind = 'issn' then (select min(name) from r where issn = value) else value end as journal from a),
k as (select j.*, regexp_replace(lower(trim(journal)), '^the\\s+', '') as jk from j), al as (select regexp_replace(lower(alias), '^the\\s+', '') as a, min(regexp_replace(lower(name), '^the\\s+', '')) as t from aliases group by 1),
d as (select regexp_replace(lower(name), '^the\\s+', '') as d, name from ranks)
select kind, value, coalesce(v.name, d.name) as rank_name, case when coalesce(v.name, d.name) is null then 'not_found' else 'offline' end as rank_source from k left join d on d.d = jk left join al on al.a = jk left join d v on v.d = al.t""")
def rank_requests(spark, sf):
    """Requests by journal or ISSN answered by the rank table."""
    ranks, aliases = D.rank_tables(spark)
    numbered = ranks.withColumn("issn", F.concat(F.lit("1234-000"), F.regexp_extract("name", r"\d+", 0)))
    even = F.expr("pos % 2 = 0")
    asked = lit(spark, sf).select(F.when(even, "journal").otherwise("issn").alias("kind"), F.when(even, F.col("journal")).otherwise(F.concat(F.lit("1234-000"), F.expr("pos % 12"))).alias("value")).distinct()
    return E.rank_rows(asked, numbered, aliases).select("kind", "value", "rank_name", "rank_source")


@query(f"""with {LIT}, l as (select pos, title, doi, url, ['Fam' || pos, 'B', 'C', 'D'][1:(pos % 5)] as people, case pos % 4 when 0 then '中科院1区' when 1 then '中科院 Top' when 2 then '低风险 Q3' else '' end as tier from lit)
select pos, array_to_string(people[1:3], '; ') as authors, case pos % 4 when 0 then '中科院Q1' when 1 then 'CAS-Top' when 2 then 'LowRisk Q3' else '' end as tier, case when pos % 7 = 0 then '' else 'zotero://select/library/items/K' || pos end as uri, case when pos % 2 = 0 then 'a/b' || pos else '/elsewhere/b' || pos end as path,
case pos % 3 when 0 then 'Mechanisms' when 1 then 'Concepts' else 'Concepts' end as folder, coalesce(nullif({r"lower(regexp_replace(trim(regexp_replace(regexp_replace(trim(doi), '^https?://(dx\.)?doi\.org/', '', 'i'), '^doi:\s*', '', 'i')), '[.,;)\]}]+$', ''))"}, ''), lower({r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(title, '−‐‑‒–—', '------'), 'C\(sp\s*3\s*\)', 'C(sp3)', 'gi'), 'C\s*sp\s*3', 'C(sp3)', 'gi'), 'S\s*H\s*2', 'SH2', 'gi'), '[\s\x0B\x85\p{Z}]+', ' ', 'g'))"})) as article_key from l""")
def column_forms(spark, sf):
    """Names, tiers, links into the library, relative paths, folders and keys of all records."""
    rows = lit(spark, sf)
    people = F.slice(F.array(F.concat(F.lit("Fam"), F.col("pos")), *map(F.lit, "BCD")), F.lit(1), F.expr("cast(pos % 5 as int)"))
    tier = F.expr("case pos % 4 when 0 then '中科院1区' when 1 then '中科院 Top' when 2 then '低风险 Q3' else '' end")
    path = F.when(F.expr("pos % 2 = 0"), F.concat(F.lit("C:\\run\\a\\b"), F.col("pos"))).otherwise(F.concat(F.lit("/elsewhere/b"), F.col("pos")))
    shown = rows.select("pos", "doi", "title", people.alias("people"), tier.alias("tier"), F.when(F.expr("pos % 7 <> 0"), F.concat(F.lit("K"), F.col("pos"))).alias("key"), path.alias("path"), F.expr("case pos % 3 when 0 then 'mechanism' when 1 then 'concept' else 'unknown' end").alias("category"))
    return shown.select("pos", T.first_authors("people").alias("authors"), T.plain_tier("tier").alias("tier"), T.library_uri("key").alias("uri"), T.relative_path("path", F.lit("C:\\run")).alias("path"), G.category_folder("category").alias("folder"), T.article_key("doi", "title").alias("article_key"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as utc, strftime(ts, '%Y%m%d_%H%M%S') as stamp from events")
def event_stamps(spark, sf):
    """Times of events as texts, in a session whose zone is UTC."""
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", T.utc_text("ts").alias("utc"), T.stamp_text("ts").alias("stamp"))


_ASKED_DOIS = tuple(f"10.{1000 + k % 9}/D.{k}" for k in (5, 3, 11, 3, 999999999, 8))


@query(f"""with {LIT}, a(asked, d) as (values {', '.join(f"({i}, '{d.lower()}')" for i, d in enumerate(dict.fromkeys(_ASKED_DOIS)))}), l as (select {DOI} as d, max(pos) as pos from lit group by 1) select asked, d as doi, pos from a join l using (d)""")
def requested_order(spark, sf):
    """Records of the DOIs asked for, in the order asked; of copies the last counts."""
    return Q.in_requested_order(lit(spark, sf), list(_ASKED_DOIS)).select("asked", T.normalize_doi("doi").alias("doi"), "pos")


@query(f"""with {LIT}, s as (select {DOI} as d, max('https://new.org/' || k) as u from lit where {DOI} <> '' and k % 3 = 0 group by 1), o as (select pos, url, s.u from lit left join s on s.d = {DOI}) select count(*) as rows, count_if(u is not null and u <> url) as changed from o""")
def overlay_changes(spark, sf):
    """How many records an overlay of new links changes."""
    rows = lit(spark, sf)
    fresh = rows.filter("k % 3 = 0").select(T.normalize_doi("doi").alias("doi"), F.concat(F.lit("https://new.org/"), "k").alias("url")).filter("doi <> ''").distinct()
    return E.changed_rows(E.overlay(rows, fresh, "doi", ["url"], True))
