"""Registered queries of reports, indexes, items, routing and requests, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import DOI, LIT, hits, lit, query
from .functions import text as T
from .operators import documents as W
from .operators import enrich as E
from .operators import incremental as I
from .plans import profiles as Y
from .sources import derived as D

_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(title, '−‐‑‒–—', '------'), 'C\(sp\s*3\s*\)', 'C(sp3)', 'gi'), 'C\s*sp\s*3', 'C(sp3)', 'gi'), 'S\s*H\s*2', 'SH2', 'gi'), '[\s\x0B\x85\p{Z}]+', ' ', 'g'))"
_STRICT = r"lower(regexp_replace(trim(regexp_replace(regexp_replace(trim(doi), '^https?://(dx\.)?doi\.org/', '', 'i'), '^doi:\s*', '', 'i')), '[.,;)\]}]+$', ''))"
_KEPT = r"regexp_replace(trim(regexp_replace(regexp_replace(trim(doi), '^https?://(dx\.)?doi\.org/', '', 'i'), '^doi:\s*', '', 'i')), '[.,;)\]}，。；）】]+$', '')"


def _lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


@query(f"""with {LIT}, l as (select *, case when pdf_status not in ('', 'downloaded') then 'PDF status: ' || pdf_status else '' end as note from lit)
select pos, {_lines("'## Article ' || pos || ': ' || coalesce(nullif(title, ''), '(untitled)')", "'- Title: ' || title", "'- DOI: ' || doi", "'- Year: ' || year", "'- Journal: ' || journal", "'- Authors: ' || array_to_string(authors, '; ')", "'- Local PDF: '", "'- Source URL: ' || url", "'- Abstract: ' || abstract", "'- Keywords: ' || array_to_string(keywords, '; ')", "'- Concepts: '", "'- PDF status: ' || pdf_status", "'- OA status: '", "'- Source capture dir: run'", "'- Notes: ' || note", "''")} as entry from l""")
def local_index(spark, sf):
    rows = lit(spark, sf)
    return rows.select("pos", W.local_index_entry(rows, "pos", "run").alias("entry"))


@query(f"""with {LIT} select pos, {_lines("'## ' || pos || '. ' || coalesce(nullif(title, ''), '(untitled)')", "''", "'- Authors: ' || array_to_string(authors, '; ')", "case when year <> '' then '- Year: ' || year end", "'- Journal: ' || journal", "case when doi <> '' then '- DOI: ' || doi end", "case when url <> '' then '- URL: ' || url end", "case when pdf_status <> '' then '- PDF: ' || pdf_status end", "'- Keywords: ' || array_to_string(keywords, ', ')", "'- Confidence: ' || confidence", "case when abstract <> '' then chr(10) || abstract end")} as entry from lit""")
def markdown_items(spark, sf):
    from .operators import sinks

    rows = lit(spark, sf).withColumns({"source_page": F.lit(""), "concepts": F.array().cast("array<string>")})
    return rows.select("pos", sinks.markdown_entry("pos").alias("entry"))


@query(f"""with {LIT}, h as (select *, coalesce(try_cast(year as int), 0) as y, case when journal = 'journal 3' then 'Q1' else '' end as tier from lit)
select pos, {_lines("'[' || pos || '] ' || title", "'    Authors   : ' || array_to_string(authors[1:3], '; ')", "'    Year      : ' || y || '  |  Venue: ' || journal || '  |  Source: ' || source || '  ' || case when tier <> '' then '|  Tier: ' || tier else '' end", "'    Citations : ' || coalesce(cast(citations as varchar), '')", "case when doi like 'http%' then '    DOI       : ' || doi when doi <> '' then '    DOI       : https://doi.org/' || doi end", "case when url <> '' then '    OA URL    : ' || url end", "''")} as entry from h""")
def console_entries(spark, sf):
    tier = F.when(F.col("venue") == "journal 3", "Q1").otherwise("")
    return hits(spark, sf).withColumn("tier", tier).select("pos", W.console_entry("pos").alias("entry"))


@query(f"""with {LIT} select pos, {_lines("'### ' || pos || '. ' || coalesce(nullif(title, ''), '(untitled)')", "''", "'- DOI: ' || doi", "'- Year: ' || coalesce(try_cast(year as int), 0)", "'- Venue: ' || journal", "'- Source: ' || source", "'- Citations: ' || coalesce(citations, 0)", "'- Score: 1.5'", "'- Priority hits: a; b'", "'- Reasons: '", "'- OA URL: ' || url", "''")} as entry,
coalesce(case when {_KEPT} <> '' then 'https://doi.org/' || {_KEPT} end, nullif(url, ''), title) as identifier from lit""")
def candidate_entries(spark, sf):
    rows = hits(spark, sf).withColumns({"score": F.lit(1.5), "priority_hits": F.array(F.lit("a"), F.lit("b")), "reasons": F.array().cast("array<string>")})
    return rows.select("pos", W.candidate_entry("pos").alias("entry"), W.identifier_line().alias("identifier"))


@query(f"""with {LIT} select pos, 'journalArticle' as item_type, nullif(trim(title), '') as title, nullif({_STRICT}, '') as doi, coalesce(nullif(url, ''), case when {_KEPT} <> '' then 'https://doi.org/' || {_KEPT} end) as url, nullif(year, '') as date, 2 as n_creators, 'Fam' || (pos % 23) as family,
coalesce(nullif({_STRICT}, ''), title) || ': itemType missing; defaulted to journalArticle' as warning from lit""")
def library_items(spark, sf):
    rows = lit(spark, sf)
    out = rows.select("pos", "title", W.library_item(rows).alias("i"), W.item_warnings(rows).alias("w"))
    return out.select("pos", F.col("i.itemType").alias("item_type"), F.col("i.title").alias("title"), F.col("i.DOI").alias("doi"), F.col("i.url").alias("url"), F.col("i.date").alias("date"), F.size("i.creators").alias("n_creators"), F.col("i.creators")[0]["lastName"].alias("family"), F.col("w")[0].alias("warning"))


_JSON = lambda value, rows: f"(select coalesce('{{' || string_agg('\"' || v || '\": ' || n, ', ' order by v) || '}}', '{{}}') from (select {value} as v, count(*) as n from {rows} group by 1))"
_WHO = "'- ' || coalesce(nullif(title, ''), nullif(doi, ''), '(untitled)')"


@query(f"""with {LIT}, c as (select count(*) as n, count_if(abstract <> '') as a, count_if(confidence < 0.6) as low, count_if(confidence < 0.5) as failed from lit),
h as (select unnest(['# Run Report', '', '- Input source: documents', '- Failed/flagged records: ' || failed, '- Low-confidence records requiring manual check: ' || low, '- Abstract coverage: ' || a || '/' || n,
 '- Abstract source counts: ' || {_JSON("coalesce(nullif(abstract_source, ''), 'unknown')", "lit where abstract <> ''")}, '- Keyword source counts: {{}}', '- Concept source counts: {{}}', '- Metadata warnings count: 0',
 '- PDF status counts: ' || {_JSON("coalesce(nullif(pdf_status, ''), 'unknown')", "lit")}, '- PDF source counts: ' || {_JSON("coalesce(nullif(pdf_source, ''), 'none')", "lit where pdf_status = 'downloaded'")}, '- PDF failure reason counts: ' || {_JSON("pdf_error", "lit where pdf_error <> ''")},
 '- 403 note: publishers may refuse direct requests; save the page from a browser and read it as HTML.']) as value from c),
r as (select 1 as section, pos, {_WHO} as value from lit where confidence < 0.6 union all select 2, pos, {_WHO} || ' | PDF: ' || pdf_status from lit where confidence < 0.6 or pdf_status = 'skipped_non_pdf' union all select 3, pos, {_WHO} || ': low confidence' from lit where confidence < 0.5)
select 0 as section, value, count(*) as n from h group by 2 union all select section, value, count(*) from r group by 1, 2
union all select s, v, 1 from (values (1, '## Low-Confidence Records'), (2, '## Needs Manual Check'), (3, '## Failed or Flagged Records')) as t(s, v) union all select s, '', 2 from (values (1), (2), (3)) as t(s)""")
def run_report_lines(spark, sf):
    none = F.array().cast("array<string>")
    lines = W.run_report(lit(spark, sf).withColumns({"notes": none, "metadata_warnings": none}), {"Input source": "documents"})
    return lines.groupBy("section", "value").agg(F.count("*").alias("n"))


@query(f"with {LIT}, n as (select distinct journal from lit where journal not in ('journal 1', 'journal 10')), r as (select journal, row_number() over (order by journal) as k from n) select cast((k - 1) // 5 as int) as batch, string_agg(journal, '|' order by journal) as keys from r where k <= 20 group by 1")
def rank_request_batches(spark, sf):
    stored = spark.createDataFrame([("journal 1",), ("journal 10",)], "journal string")
    return E.request_batches(lit(spark, sf), stored, "journal").select("batch", F.array_join("keys", "|").alias("keys"))


_KEYED = r"k as (select regexp_replace(lower(name), '^the\s+', '') as key, 1 as turn, tier, level, impact_factor from ranks union all select lower(alias), 0, tier, level, impact_factor from aliases a join ranks r on regexp_replace(lower(r.name), '^the\s+', '') = lower(a.name))"


@query(f"""with {LIT}, {D.RANK_SQL}, {_KEYED}, best as (select key, arg_min('[' || tier || '-' || level || '] IF=' || impact_factor, turn) as label from k group by 1)
select pos, case when journal = 'journal 4' then 'online Q1' else coalesce(label, '') end as tier from lit left join best on best.key = journal""")
def tier_online_first(spark, sf):
    ranks, aliases = D.rank_tables(spark)
    online = spark.createDataFrame([("Journal 4", "online Q1")], "journal string, label string")
    return E.rank_online_first(lit(spark, sf), "journal", online, ranks, aliases).select("pos", "tier")


@query(f"with {LIT} select pos, row_number() over (order by year desc, pos) as number from lit")
def numbered_articles(spark, sf):
    return I.numbered(lit(spark, sf).select("pos", "year"), F.desc("year"), "pos").select("pos", F.col("number").cast("long").alias("number"))


@query(f"with {LIT}, h as (select *, ['q-bio.GN', 'q-biology', 'cs.LG'][1 + pos % 3] as category from lit) select pos, source, category from h where source in ('pubmed', 'openalex') union all select pos, source, category from h where false")
def routed_biology(spark, sf):
    category = F.element_at(F.array(F.lit("q-bio.GN"), F.lit("q-biology"), F.lit("cs.LG")), (F.col("pos") % 3 + 1).cast("int"))
    return Y.routed(lit(spark, sf).withColumn("category", category), "biology", category="category").select("pos", "source", "category")


@query(f"with {LIT}, h as (select *, ['cs.LG', 'cs.LGX', 'cs.CV.a', 'math'][1 + pos % 4] as category from lit) select pos, source, category from h where source = 'openalex' or (source = 'arxiv' and category in ('cs.LG', 'cs.CV.a'))")
def routed_computing(spark, sf):
    category = F.element_at(F.array(F.lit("cs.LG"), F.lit("cs.LGX"), F.lit("cs.CV.a"), F.lit("math")), (F.col("pos") % 4 + 1).cast("int"))
    return Y.routed(lit(spark, sf).withColumn("category", category), "cs", category="category").select("pos", "source", "category")


@query(r"select doc_id, case when regexp_matches(t, '\b(captcha|recaptcha|hcaptcha)\b') then 'Profile stop_on captcha triggered.' when regexp_matches(t, '\b(login required|sign in to access|log in to access|institutional login|institutional sign in|access through your institution)\b') then 'Profile stop_on login_required triggered.' else '' end as reason "
       r"from (select doc_id, lower(coalesce(text, '') || case doc_id % 5 when 1 then ' Solve the CAPTCHA' when 2 then ' Login required' when 3 then ' xcaptcha' else '' end) as t from documents)")  # fmt: skip
def stop_reasons(spark, sf):
    more = F.when(F.col("doc_id") % 5 == 1, " Solve the CAPTCHA").when(F.col("doc_id") % 5 == 2, " Login required").when(F.col("doc_id") % 5 == 3, " xcaptcha").otherwise("")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("t"))
    return docs.select("doc_id", Y.stop_reason("t", ("captcha", "login_required")).alias("reason"))


@query(rf"""with {LIT}, t as (select *, {_NORM} as nt from lit), f as (select *, regexp_replace(substr(regexp_replace(trim(regexp_replace(regexp_replace(nt, '[<>:"/\\|?*]', ' ', 'g'), '[\s\x0B\x85\p{{Z}}]+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g'), 1, 120), '[ .]+$', '') as fn from t)
select pos, coalesce(nullif(fn, ''), 'untitled') || '.md' as note, coalesce(nullif({_STRICT}, ''), lower(nt)) as article_key, case when pos % 2 = 0 then 'zotero://select/library/items/K' || pos else '' end as uri, case when pos % 3 = 0 then 'a/' || pos else 'other/a/' || pos end as path,
 ['CAS-Top', 'Q2 MedRisk', 'MULTI'][1 + pos % 3] as tier, strftime(make_timestamp(pos * 1000000), '%Y-%m-%dT%H:%M:%SZ') as created from f""")
def note_names(spark, sf):
    at = F.timestamp_seconds("pos")
    tier = F.element_at(F.array(F.lit("中科院 Top"), F.lit("2区 中风险"), F.lit("综合性期刊")), (F.col("pos") % 3 + 1).cast("int"))
    path = F.concat(F.when(F.col("pos") % 3 == 0, "run\\a\\").otherwise("other/a/"), F.col("pos"))
    return lit(spark, sf).select("pos", T.note_filename("title").alias("note"), T.article_key("doi", "title").alias("article_key"), T.library_uri(F.when(F.col("pos") % 2 == 0, F.concat(F.lit("K"), F.col("pos")))).alias("uri"), T.relative_path(path, F.lit("run/")).alias("path"), T.plain_tier(tier).alias("tier"), T.utc_text(at).alias("created"))


@query(f"with {LIT}, a as (select *, authors[1] || ', ' || authors[2] as names, coalesce(nullif(year, ''), 'n.d.') as y from lit) select pos, " + ", ".join(
    rf"trim(regexp_replace({form}, '[\s\x0B\x85\p{{Z}}]+', ' ', 'g')) as {style}" for style, form in (
        ("ieee", "names || ', \"' || title || ',\" ' || journal || ', ' || y || '.'"), ("gbt7714", "names || '. ' || title || '[J]. ' || journal || ', ' || y || '.'"), ("mla", "names || '. \"' || title || '.\" ' || journal || ', ' || y || '.'"),
        ("chicago", "names || '. ' || y || '. \"' || title || '.\" ' || journal || '.'"), ("vancouver", "names || '. ' || title || '. ' || journal || '. ' || y || '.'"), ("harvard", "names || ', ' || y || '. ' || title || '. ' || journal || '.'"),
    )) + " from a")
def citations_styles(spark, sf):
    from .operators import sinks

    return lit(spark, sf).select("pos", *[sinks.citation(s).alias(s) for s in ("ieee", "gbt7714", "mla", "chicago", "vancouver", "harvard")])
