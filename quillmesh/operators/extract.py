"""Extraction from pages and texts: meta tags, JSON-LD, identifiers, initial candidates."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_function
from ..functions.scores import pdf_priority
from ..functions.text import arxiv_base, arxiv_id, clean_text, doi_url, extract_dois, nonempty, normalize_doi, pubmed_id, split_terms, text_of, year_text
from ..sources.records import canonicalize

PAGE_PARTS = "title string, title_source string, metas array<struct<key:string,content:string>>, links array<map<string,string>>, jsonld array<string>"

#: Meta names by field, the first that is present wins; fixed values.
META_NAMES = {
    "title": ("citation_title", "dc.title", "prism.title", "og:title"),
    "journal": ("citation_journal_title", "prism.publicationname", "dc.source"),
    "date": ("citation_publication_date", "citation_online_date", "citation_date", "dc.date", "prism.publicationdate", "article:published_time"),
    "volume": ("citation_volume", "prism.volume"),
    "issue": ("citation_issue", "prism.number"),
    "first_page": ("citation_firstpage", "prism.startingpage"),
    "last_page": ("citation_lastpage", "prism.endingpage"),
    "doi": ("citation_doi", "dc.identifier", "prism.doi"),
    "pdf_url": ("citation_pdf_url",),
    "abstract": ("citation_abstract", "dc.description", "og:description", "description"),
    "pmid": ("citation_pmid",),
    "arxiv_id": ("citation_arxiv_id",),
}
AUTHOR_NAMES = ("citation_author", "dc.creator")
KEYWORD_NAMES = ("citation_keywords", "keywords", "article:tag", "dc.subject")


class _Page(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.page = page
        self.title, self.metas, self.links, self.jsonld = "", [], [], []
        self.title_source, self._title_at = None, None
        self._in = None

    def _place(self) -> int:
        """Where in the page the current tag begins."""
        line, column = self.getpos()
        at = 0
        for _ in range(line - 1):
            at = self.page.index("\n", at) + 1
        return at + column

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = (a.get("name") or a.get("property") or a.get("itemprop") or "").strip().lower()
            if key and a.get("content"):
                self.metas.append((key, a["content"].strip()))
        elif tag == "link":
            self.links.append(a)
        elif tag == "title":
            self._in = "title"
            if self._title_at is None:
                self._title_at = self._place() + len(self.get_starttag_text())
        elif tag == "script" and "ld+json" in a.get("type", "").lower():
            self._in = "jsonld"
            self.jsonld.append("")

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == "title" and self._title_at is not None and self.title_source is None:
            self.title_source = self.page[self._title_at : self._place()]
        if tag in ("title", "script"):
            self._in = None

    def handle_data(self, data):
        if self._in == "title":
            self.title += data
        elif self._in == "jsonld":
            self.jsonld[-1] += data


def parse_page(html: str | None) -> dict:
    """Parts of a page. ``title`` has its character references decoded; ``title_source`` is the first title as it stands in the page."""
    p = _Page(html or "")
    p.feed(p.page)
    p.close()
    return {"title": p.title.strip(), "title_source": p.title_source or "", "metas": [{"key": k, "content": v} for k, v in p.metas], "links": p.links, "jsonld": [x.strip() for x in p.jsonld if x.strip()]}


@arrow_function(PAGE_PARTS)
def page_parts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(x) for x in html], columns=["title", "title_source", "metas", "links", "jsonld"])


def meta_values(parts: Column, *names: str) -> Column:
    """Contents of the metas with these names: by order of names, then of the page."""

    def named(name: str) -> Column:
        return F.transform(F.filter(parts["metas"], lambda m: m["key"] == name), lambda m: m["content"])

    return F.flatten(F.array(*map(named, names)))


def meta_first(parts: Column, names) -> Column:
    return F.coalesce(F.get(F.filter(meta_values(parts, *names), lambda v: v != ""), F.lit(0)), F.lit(""))


def meta_articles(pages: DataFrame, parts: str = "parts", source_page: str = "url") -> DataFrame:
    """Articles from meta tags: one row per page whose tags hold a DOI, full-text link, author or abstract."""
    p = F.col(parts)
    v = {k: meta_first(p, names) for k, names in META_NAMES.items()}
    found_in = F.coalesce(*[F.when(F.size(meta_values(p, n)) > 0, F.lit(f"html-meta:{n}")) for n in META_NAMES["abstract"]])
    doi = normalize_doi(F.regexp_extract(v["doi"], r"(?i)10\.\d{4,9}/\S+", 0))
    rows = pages.select(
        *[c for c in pages.columns if c not in (parts, "title")], F.coalesce(nonempty(v["title"]), p["title"]).alias("title"), meta_values(p, *AUTHOR_NAMES).alias("authors"), year_text(v["date"]).alias("year"),
        v["journal"].alias("journal"), v["volume"].alias("volume"), v["issue"].alias("issue"), F.concat_ws("-", nonempty(v["first_page"]), nonempty(v["last_page"])).alias("pages"), doi.alias("doi"),
        v["pdf_url"].alias("pdf_url"), v["abstract"].alias("abstract"), F.when(v["abstract"] != "", found_in).alias("abstract_source"),
        F.flatten(F.transform(meta_values(p, *KEYWORD_NAMES), lambda k: split_terms(k))).alias("keywords"), v["pmid"].alias("pmid"), arxiv_base(v["arxiv_id"]).alias("arxiv_id"),
        F.col(source_page).alias("source_page"), F.lit("html-meta").alias("metadata_source"), F.when(doi != "", 0.88).otherwise(0.75).alias("confidence"),
    )
    return canonicalize(rows.filter((F.col("doi") != "") | (F.col("pdf_url") != "") | (F.size("authors") > 0) | (F.col("abstract") != "")))


def pdf_links(parts: Column, base: Column) -> Column:
    """Full-text candidates among a page's link tags."""
    return _pdf_links(parts["links"], base)


@arrow_function("array<struct<url:string,source:string,license:string,oa_status:string>>")
def _pdf_links(links: pd.Series, base: pd.Series) -> pd.Series:
    out = []
    for rows, b in zip(links, base):
        seen = {}
        for row in rows if rows is not None else ():
            href = dict(row).get("href") or ""
            low = href.lower().split("#")[0]
            if href and (low.split("?")[0].endswith(".pdf") or "/pdf" in low or "pdf" in low.partition("?")[2]):
                url = urljoin(b or "", href)
                seen.setdefault(url, {"url": url, "source": "publisher-pdf-link", "license": "", "oa_status": ""})
        out.append(list(seen.values()))
    return pd.Series(out, dtype=object)


JSONLD_ARTICLE = "title string, authors array<string>, date string, journal string, identifier string, url string, abstract string, keywords array<string>, pdf_urls array<string>"
JSONLD_TYPES = ("scholarlyarticle", "article", "creativework")


def _walk(document):
    """Nodes of a JSON-LD document: those of a graph before the node that holds it."""
    stack = [(document, False)]
    while stack:
        node, done = stack.pop()
        if isinstance(node, list):
            stack.extend((x, False) for x in reversed(node))
        elif isinstance(node, dict):
            if done or "@graph" not in node:
                yield node
            else:
                stack += [(node, True), (node["@graph"], False)]


def _texts(value) -> list[str]:
    out, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            name = x.get("name") or " ".join(y for y in (x.get("givenName"), x.get("familyName")) if isinstance(y, str) and y)
            out += [str(name)] if name else []
        elif x is not None:
            out.append(str(x))
    return out


def _search(value, keys, accept) -> list[str]:
    """Depth-first texts under ``keys`` that are accepted."""
    out, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out += [x] if accept(x) else []
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            stack.extend(x[k] for k in reversed(keys) if k in x)
    return out


def _document(text: str):
    """(document, fault): a script that is no JSON, or nested beyond what the parser takes, is a fault."""
    try:
        return json.loads(text), ""
    except RecursionError:
        return None, "nested too deep"
    except ValueError as e:
        return None, f"no JSON: {e}"[:200]


def jsonld_nodes(text: str) -> list[dict]:
    document, _ = _document(text)
    out = []
    for node in _walk(document):
        kinds = " ".join(_texts(node.get("@type"))).lower()
        if not any(k in kinds for k in JSONLD_TYPES):
            continue
        doi = _search([node.get(k) for k in ("identifier", "@id", "url", "sameAs")], ("value", "identifier", "@id", "url", "sameAs", "name"), lambda s: "10." in s and "/" in s)
        pdfs = _search([node.get(k) for k in ("encoding", "associatedMedia", "hasPart", "mainEntity")], ("contentUrl", "url", "@id", "encoding", "associatedMedia", "hasPart", "mainEntity"), lambda s: "pdf" in s.lower())
        words = [w.strip() for t in _texts(node.get("keywords")) for w in t.replace(";", ",").split(",")]
        first = lambda *keys: next((t for k in keys for t in _texts(node.get(k))), "")
        out.append({"title": first("headline", "name"), "authors": _texts(node.get("author")), "date": first("datePublished", "dateCreated"), "journal": first("isPartOf", "publisher"), "identifier": doi[0] if doi else "", "url": first("url"), "abstract": first("abstract", "description"), "keywords": [w for w in words if w], "pdf_urls": list(dict.fromkeys(pdfs))})
    return out


@arrow_function(f"array<struct<{JSONLD_ARTICLE.replace(' ', ':').replace(',:', ',')}>>")
def jsonld_records(scripts: pd.Series) -> pd.Series:
    return pd.Series([[n for s in (x if x is not None else ()) for n in jsonld_nodes(s)] for x in scripts], dtype=object)


@arrow_function("array<struct<script:int,fault:string>>")
def _script_faults(scripts: pd.Series) -> pd.Series:
    return pd.Series([[{"script": i, "fault": f} for i, s in enumerate(x if x is not None else ()) if (f := _document(s)[1])] for x in scripts], dtype=object)


def jsonld_faults(pages: DataFrame, key: str = "page_id", parts: str = "parts") -> DataFrame:
    """(key, script, fault) of JSON-LD scripts that cannot be read; the page's other scripts and pages go on."""
    return pages.select(key, F.explode(_script_faults(F.col(parts)["jsonld"])).alias("f")).select(key, "f.script", "f.fault")


def jsonld_articles(pages: DataFrame, parts: str = "parts", source_page: str = "url") -> DataFrame:
    """Articles of the pages' JSON-LD scripts: one row per article node."""
    rows = pages.select(*[c for c in pages.columns if c != parts], F.posexplode(jsonld_records(F.col(parts)["jsonld"])).alias("node", "j"))
    doi = normalize_doi(F.regexp_extract("j.identifier", r"(?i)10\.\d{4,9}/\S+", 0))
    made = rows.select(
        *[c for c in rows.columns if c not in ("j", "title", "url")], F.col("j.title").alias("title"), F.col("j.authors").alias("authors"), year_text("j.date").alias("year"), F.col("j.journal").alias("journal"), doi.alias("doi"),
        F.col("j.url").alias("url"), F.col("j.abstract").alias("abstract"), F.col("j.keywords").alias("keywords"), F.coalesce(F.get("j.pdf_urls", F.lit(0)), F.lit("")).alias("pdf_url"),
        F.transform("j.pdf_urls", lambda u: F.struct(u.alias("url"), F.lit("json-ld").alias("source"), F.lit("").alias("license"), F.lit("").alias("oa_status"))).alias("pdf_candidates"),
        F.col(source_page).alias("source_page"), F.lit("json-ld").alias("metadata_source"), F.when(doi != "", 0.82).otherwise(0.68).alias("confidence"),
    )
    return canonicalize(made)


def identifier_articles(pages: DataFrame, content: str = "content", source_page: str = "url") -> DataFrame:
    """Candidates from identifiers in the text: PubMed, arXiv, then every DOI, repeats included."""
    base = pages.select(F.col(source_page).alias("source_page"), text_of(content).alias("content"), *[c for c in pages.columns if c not in (source_page, content)])
    pm, ax = pubmed_id("source_page", "content"), arxiv_base(arxiv_id("source_page", "content"))
    made = base.withColumns({"pmid": pm, "arxiv_id": ax, "_dois": extract_dois("content", unique=False)})
    kinds = F.concat(
        F.when(F.col("pmid") != "", F.array(F.struct(F.lit(4).alias("branch"), F.lit("").alias("doi"), F.lit("pubmed-page").alias("src"), F.lit(0.55).alias("conf")))).otherwise(F.array().cast("array<struct<branch:int,doi:string,src:string,conf:double>>")),
        F.when(F.col("arxiv_id") != "", F.array(F.struct(F.lit(5).alias("branch"), F.lit("").alias("doi"), F.lit("arxiv-page").alias("src"), F.lit(0.65).alias("conf")))).otherwise(F.array().cast("array<struct<branch:int,doi:string,src:string,conf:double>>")),
        F.transform("_dois", lambda d: F.struct(F.lit(6).alias("branch"), d.alias("doi"), F.lit("doi-regex").alias("src"), F.lit(0.55).alias("conf"))),
    )
    first_line = F.substring(clean_text(F.get(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""), F.lit(0))), 1, 240)
    rows = made.select("*", F.posexplode_outer(kinds).alias("found_at", "k"))
    none = F.col("k").isNull()
    out = rows.select(
        *[c for c in made.columns if c not in ("_dois", "content", "pmid", "arxiv_id", "title", "doi", "url")], F.when(none, first_line).otherwise("").alias("title"), F.coalesce("k.doi", F.lit("")).alias("doi"),
        F.when(F.col("k.branch") == 4, F.col("pmid")).otherwise("").alias("pmid"), F.when(F.col("k.branch") == 5, F.col("arxiv_id")).otherwise("").alias("arxiv_id"), doi_url(F.col("k.doi")).alias("url"),
        F.coalesce("k.src", F.lit("plain-text")).alias("metadata_source"), F.coalesce("k.conf", F.lit(0.25)).alias("confidence"), F.coalesce("k.branch", F.lit(7)).alias("branch"), F.coalesce("found_at", F.lit(0)).alias("found_at"),
    )
    return canonicalize(out)


def initial_candidates(pages: DataFrame, key: str = "page_id", content: str = "content", source_page: str = "url") -> DataFrame:
    """All candidates of pages in order of ``key``, branch and place: meta tags, JSON-LD, identifiers."""
    parsed = pages.withColumn("parts", page_parts(F.col(content)))
    meta = meta_articles(parsed.drop(content), source_page=source_page).withColumns({"branch": F.lit(1), "found_at": F.lit(0)})
    ld = jsonld_articles(parsed.drop(content), source_page=source_page).withColumn("branch", F.lit(2)).withColumnRenamed("node", "found_at")
    ids = identifier_articles(pages, content, source_page)
    columns = [key, "branch", "found_at", *[c for c in meta.columns if c in ids.columns and c in ld.columns and c not in (key, "branch", "found_at")]]
    return meta.select(columns).unionByName(ld.select(columns)).unionByName(ids.select(columns))


def ordered_pdf_candidates(candidates) -> Column:
    """Candidates with distinct URLs by source priority, the order kept inside a priority."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    urls = F.transform(c, lambda x: x["url"])
    first = F.filter(c, lambda x, i: (x["url"] != "") & (F.array_position(urls, x["url"]) == i + 1))
    keyed = F.transform(first, lambda x, i: F.struct(pdf_priority(x["source"]).alias("p"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["p"] != b["p"], a["p"] - b["p"]).otherwise(a["i"] - b["i"])), lambda k: k["x"])
