"""Readers of files and mappings from metadata snapshots to the article schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.arrow import decode_html
from ..functions.text import arxiv_base, clean_abstract, clean_text, col, distinct_ci, extract_dois_loose, nonempty, normalize_doi, text_of
from . import schemas


def article_type() -> StructType:
    return StructType.fromDDL(schemas.ARTICLE)


def canonicalize(df: DataFrame) -> DataFrame:
    """All article columns in order: missing ones empty, texts cleaned, DOI normal, lists distinct.

    A value without provenance gets the record's metadata source, or "input". Other columns follow.
    """
    have, out = set(df.columns), {}
    for f in article_type().fields:
        kind = f.dataType
        value = F.col(f.name) if f.name in have else F.lit(None)
        if isinstance(kind, ArrayType):
            value = F.coalesce(value.cast(kind), F.array().cast(kind))
        elif kind.simpleString() == "string":
            value = text_of(value)
        else:
            value = value.cast(kind)
        out[f.name] = value
    for c in ("title", "year", "journal", "volume", "issue", "pages", "metadata_source"):
        out[c] = clean_text(out[c])
    out["abstract"], out["doi"] = clean_abstract(out["abstract"]), normalize_doi(out["doi"])
    out["authors"] = F.filter(F.transform(out["authors"], lambda t: clean_text(t)), lambda x: x != "")
    for c in ("keywords", "keywords_source", "concepts", "concepts_source", "enrichment_sources", "metadata_warnings", "notes"):
        out[c] = distinct_ci(out[c])
    origin = F.coalesce(nonempty(out["metadata_source"]), F.lit("input"))
    out["abstract_source"] = F.when((out["abstract"] != "") & (out["abstract_source"] == ""), origin).otherwise(out["abstract_source"])
    for c in ("keywords", "concepts"):
        out[f"{c}_source"] = F.when((F.size(out[c]) > 0) & (F.size(out[f"{c}_source"]) == 0), F.array(origin)).otherwise(out[f"{c}_source"])
    out["enrichment_sources"] = F.when(out["metadata_source"] != "", distinct_ci(F.concat(out["enrichment_sources"], F.array(out["metadata_source"])))).otherwise(out["enrichment_sources"])
    out["confidence"] = F.coalesce(out["confidence"], F.lit(0.0))
    out["pdf_status"] = F.coalesce(nonempty(out["pdf_status"]), F.lit("not_requested"))
    rest = [F.col(c) for c in df.columns if c not in out]
    return df.select(*[v.alias(k) for k, v in out.items()], *rest)


# --- files --------------------------------------------------------------------------------------


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): one row per HTML file, decoded by its mark, declaration or best fit."""
    return spark.read.format("binaryFile").load(path).select("path", decode_html("content").alias("content"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_input(pages: DataFrame, url="url", content="content") -> DataFrame:
    """Content, or the URL itself where nothing was fetched and the URL holds an identifier."""
    has_id = text_of(url).rlike(r"10\.\d{4,9}/|arxiv\.org/|pubmed\.ncbi")
    missing = text_of(content) == ""
    return pages.withColumns({
        "is_html": ~missing & text_of(content).rlike(r"(?is)<(html|head|meta|body)\b"),
        "warning": F.when(missing & has_id, "fetch failed; identifiers taken from the URL").when(missing, "nothing to read").otherwise(""),
        "content": F.when(missing & has_id, text_of(url)).otherwise(text_of(content)),
    })


def read_json_items(spark: SparkSession, path: str, schema: str, keys=("items", "articles", "results", "candidates", "references", "pending")) -> DataFrame:
    """Rows of JSON files that hold a list, or an object with the list under one of ``keys``."""
    raw = read_texts(spark, path).withColumn("content", F.trim("content"))
    listed = F.from_json("content", f"ARRAY<STRUCT<{schema}>>")
    wrapped = F.from_json("content", ", ".join(f"`{k}` ARRAY<STRUCT<{schema}>>" for k in keys))
    items = F.when(F.col("content").startswith("["), listed).otherwise(F.coalesce(*[wrapped[k] for k in keys]))
    return raw.select("path", F.posexplode(items).alias("pos", "item")).filter("item is not null").select("path", "pos", "item.*")


def read_notes(spark: SparkSession, path: str, block_mark: str = "<!-- managed:begin -->") -> DataFrame:
    """(path, title, text, dois, has_managed_block, sha256) of Markdown notes."""
    return note_inventory(read_texts(spark, path), "path", "content", block_mark)


def note_inventory(notes: DataFrame, path="path", text="text", block_mark: str = "<!-- managed:begin -->") -> DataFrame:
    stem = F.regexp_replace(F.regexp_replace(F.col(path), r"^.*/", ""), r"\.md$", "")
    return notes.select(F.col(path).alias("path"), stem.alias("title"), F.col(text).alias("text"), extract_dois_loose(text).alias("dois"), F.contains(text_of(text), F.lit(block_mark)).alias("has_managed_block"), F.sha2(text_of(text), 256).alias("sha256"))


def notes_by_doi(inventory: DataFrame) -> DataFrame:
    """Inverted index: notes of each DOI, in path order."""
    rows = inventory.select(F.explode("dois").alias("doi"), "path", "has_managed_block")
    return rows.groupBy("doi").agg(F.count("*").alias("n_notes"), F.array_sort(F.collect_list("path")).alias("paths"), F.min_by("has_managed_block", "path").alias("has_managed_block"))


# --- metadata snapshots -------------------------------------------------------------------------


def parsed(df: DataFrame, c: str, schema: str) -> DataFrame:
    """JSON text column ``c`` as struct column ``w``."""
    return df.withColumn("w", F.from_json(c, schema))


def inverted_index(df: DataFrame, text: str, key: str = "pos") -> DataFrame:
    """(key, j): JSON with the word → positions map of each whole text, words split at single spaces.

    Keys are unique. A text moves once, by key; its words are gathered where it lies.
    """
    words = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).repartition(key).select(key, F.posexplode(F.split("_text", " ", -1)).alias("i", "w"))
    places = words.groupBy(key, "w").agg(F.array_sort(F.collect_list("i")).alias("at"))
    index = F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("abstract_inverted_index")
    return places.groupBy(key).agg(F.to_json(F.struct(index)).alias("j"))


def inverted_abstract(index) -> Column:
    """Text of a word → positions map by rising position; of words at one position the first wins.

    Values that are no list of integers are left out, the rest stays.
    """
    lists = F.transform(F.map_entries(col(index)), lambda e: F.struct(F.try_variant_get(e["value"], "$", "array<int>").alias("at"), e["key"].alias("word")))
    spots = F.flatten(F.transform(F.filter(lists, lambda e: e["at"].isNotNull()), lambda e: F.transform(e["at"], lambda p: F.struct(p.alias("p"), e["word"].alias("word")))))
    spots = F.array_sort(F.filter(spots, lambda s: s["p"].isNotNull()), lambda a, b: a["p"] - b["p"])
    # as a lambda's variable the sorted list is made once, not again for each word
    kept = F.transform(F.array(spots), lambda all: F.filter(all, lambda s, i: (i == 0) | (F.get(all, i - 1)["p"] != s["p"])))[0]
    return F.coalesce(F.array_join(F.transform(kept, lambda s: s["word"]), " "), F.lit(""))


def names_of(*lists: Column) -> Column:
    none = F.array().cast("array<string>")
    return distinct_ci(F.concat(*[F.coalesce(F.transform(x, lambda s: s["display_name"]), none) for x in lists]))


def openalex_articles(works: DataFrame, work: str = "w") -> DataFrame:
    """Articles of parsed OpenAlex works (struct column ``work``)."""
    w = F.col(work)
    oa_url = w["open_access"]["oa_url"]
    pdf = F.coalesce(nonempty(w["best_oa_location"]["pdf_url"]), nonempty(w["primary_location"]["pdf_url"]), F.when(F.lower(oa_url).endswith(".pdf"), oa_url), F.lit(""))
    doi = normalize_doi(w["doi"])
    abstract = inverted_abstract(w["abstract_inverted_index"])
    pages = F.concat_ws("-", nonempty(w["biblio"]["first_page"]), nonempty(w["biblio"]["last_page"]))
    rows = works.select(
        *[c for c in works.columns if c != work], w["title"].alias("title"), F.transform(w["authorships"], lambda a: a["author"]["display_name"]).alias("authors"),
        w["publication_year"].cast("string").alias("year"), w["primary_location"]["source"]["display_name"].alias("journal"), w["biblio"]["volume"].alias("volume"), w["biblio"]["issue"].alias("issue"),
        pages.alias("pages"), doi.alias("doi"), w["id"].alias("url"), pdf.alias("pdf_url"), w["open_access"]["oa_status"].alias("oa_status"),
        F.coalesce(w["best_oa_location"]["license"], w["primary_location"]["license"]).alias("license"), F.lit("openalex").alias("metadata_source"), abstract.alias("abstract"),
        F.when(abstract != "", "openalex").alias("abstract_source"), names_of(w["concepts"], w["topics"], w["keywords"]).alias("concepts"), w["cited_by_count"].alias("citation_count"),
        F.when(doi != "", 0.9).otherwise(0.68).alias("confidence"),
    )
    return canonicalize(rows)


def crossref_articles(works: DataFrame, work: str = "w") -> DataFrame:
    w = F.col(work)
    year = F.coalesce(*[F.get(F.get(w[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "published")])
    doi = normalize_doi(w["DOI"])
    rows = works.select(
        *[c for c in works.columns if c != work], F.get(w["title"], F.lit(0)).alias("title"), F.transform(w["author"], lambda a: F.concat_ws(" ", nonempty(a["given"]), nonempty(a["family"]))).alias("authors"),
        year.cast("string").alias("year"), F.get(w["container-title"], F.lit(0)).alias("journal"), w["volume"].alias("volume"), w["issue"].alias("issue"), w["page"].alias("pages"), doi.alias("doi"),
        w["URL"].alias("url"), w["abstract"].alias("abstract"), w["subject"].alias("concepts"), w["is-referenced-by-count"].alias("citation_count"), F.lit("crossref").alias("metadata_source"),
        F.when(doi != "", 0.95).otherwise(0.7).alias("confidence"),
    )
    return canonicalize(rows)


def pubmed_articles(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Articles of PubMed XML documents, one per row."""
    x = lambda path: F.xpath_string(xml, F.lit(path))
    many = lambda path: F.xpath(xml, F.lit(path))
    doi = normalize_doi(x("//ArticleId[@IdType='doi']"))
    names = F.transform(F.arrays_zip(many("//Author/ForeName/text()").alias("a"), many("//Author/LastName/text()").alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    pmid = x("//PMID")
    rows = docs.select(
        *[c for c in docs.columns if c != xml], x("//ArticleTitle").alias("title"), names.alias("authors"), F.regexp_extract(F.concat_ws(" ", x("//PubDate/Year"), x("//PubDate/MedlineDate")), r"\d{4}", 0).alias("year"),
        x("//Journal/Title").alias("journal"), x("//JournalIssue/Volume").alias("volume"), x("//JournalIssue/Issue").alias("issue"), x("//MedlinePgn").alias("pages"), doi.alias("doi"),
        F.when(pmid != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).alias("url"), F.array_join(many("//AbstractText/text()"), " ").alias("abstract"),
        many("//Keyword/text()").alias("keywords"), many("//DescriptorName/text()").alias("concepts"), pmid.alias("pmid"), F.lit("pubmed").alias("metadata_source"), F.when(doi != "", 0.9).otherwise(0.78).alias("confidence"),
    )
    return canonicalize(rows)


def arxiv_articles(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Articles of arXiv Atom documents with one entry per row."""
    x = lambda path: F.xpath_string(xml, F.lit(path))
    ident = arxiv_base(F.regexp_extract(x("//entry/id"), r"abs/(.+)$", 1))
    rows = docs.select(
        *[c for c in docs.columns if c != xml], x("//entry/title").alias("title"), F.xpath(xml, F.lit("//entry/author/name/text()")).alias("authors"), F.substring(x("//entry/published"), 1, 4).alias("year"),
        F.lit("arXiv").alias("journal"), normalize_doi(x("//entry/doi")).alias("doi"), x("//entry/id").alias("url"), F.concat(F.lit("https://arxiv.org/pdf/"), ident).alias("pdf_url"), x("//entry/summary").alias("abstract"),
        F.xpath(xml, F.lit("//entry/category/@term")).alias("concepts"), ident.alias("arxiv_id"), F.lit("arxiv").alias("metadata_source"), F.lit("green").alias("oa_status"), F.lit(0.86).alias("confidence"),
    )
    return canonicalize(rows)


def arxiv_hits(feeds: DataFrame, xml: str = "xml", source: str = "arxiv") -> DataFrame:
    """Search hits of Atom feeds: one row per entry, in order; titles over several lines included."""
    entries = F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))).alias("pos", "e")
    part = lambda tag: clean_text(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    names = F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), lambda t: clean_text(t))
    return feeds.select(entries).select(part("title").alias("title"), F.array_join(F.slice(names, 1, 3), "; ").alias("authors"), F.coalesce(F.substring(part("published"), 1, 4).try_cast("int"), F.lit(0)).alias("year"), F.lit("arXiv").alias("venue"), part("arxiv:doi").alias("doi"), F.lit(0).alias("citations"), F.lit(source).alias("source"), part("id").alias("oa_url"), F.col("pos").cast("long").alias("pos"))


def search_hits(articles: DataFrame, source: str, rank: int) -> DataFrame:
    """Articles as federated search hits: first three authors, year and citations as numbers."""
    return articles.select("title", F.array_join(F.slice("authors", 1, 3), "; ").alias("authors"), F.coalesce(F.col("year").try_cast("int"), F.lit(0)).alias("year"), F.col("journal").alias("venue"), "doi", F.coalesce(F.col("citation_count"), F.lit(0)).cast("int").alias("citations"), F.lit(source).alias("source"), F.col("pdf_url").alias("oa_url"), F.lit(rank).alias("src_rank"), F.col("pos").cast("long").alias("pos"))


PDF_CANDIDATES = "array<struct<url:string,source:string,license:string,oa_status:string>>"


def _candidate(url, source: str, license_, status) -> Column:
    return F.struct(text_of(url).alias("url"), F.lit(source).alias("source"), text_of(license_).alias("license"), text_of(status).alias("oa_status"))


def unpaywall_candidates(w: Column) -> Column:
    best = F.array(_candidate(w["best_oa_location"]["url_for_pdf"], "unpaywall", w["best_oa_location"]["license"], w["oa_status"]))
    rest = F.transform(F.coalesce(w["oa_locations"], F.array().cast("array<struct<url_for_pdf:string,license:string>>")), lambda x: _candidate(x["url_for_pdf"], "unpaywall", x["license"], w["oa_status"]))
    return F.filter(F.concat(best, rest), lambda c: c["url"] != "")


def openalex_candidates(w: Column) -> Column:
    places = F.array(*[_candidate(w[k]["pdf_url"], "openalex", w[k]["license"], w["open_access"]["oa_status"]) for k in ("best_oa_location", "primary_location")])
    return F.filter(places, lambda c: c["url"] != "")


def europepmc_candidates(w: Column) -> Column:
    open_ = F.filter(w["resultList"]["result"], lambda r: (r["isOpenAccess"] == "Y") & (text_of(r["pmcid"]) != ""))
    made = F.transform(open_, lambda r: _candidate(F.concat(F.lit("https://europepmc.org/articles/"), r["pmcid"], F.lit("?pdf=render")), "europepmc", r["license"], F.lit("green")))
    return F.coalesce(made, F.array().cast(PDF_CANDIDATES))


def journal_hits(records: DataFrame, record: str = "r") -> DataFrame:
    """Search hits of parsed records of a Chinese periodical service (Title, Author, Year, PeriodicalName, Doi, ObjectId)."""
    r = F.col(record)
    link = F.when(text_of(r["Doi"]) != "", F.concat(F.lit("https://doi.org/"), text_of(r["Doi"]))).otherwise(F.concat(F.lit("https://d.wanfangdata.com.cn/periodical/"), text_of(r["ObjectId"])))
    return records.select(
        *[c for c in records.columns if c != record], text_of(r["Title"]).alias("title"), F.array_join(r["Author"], "; ").alias("authors"), F.coalesce(r["Year"].try_cast("int"), F.lit(0)).alias("year"), text_of(r["PeriodicalName"]).alias("venue"),
        text_of(r["Doi"]).alias("doi"), F.lit(0).alias("citations"), F.lit("wanfang").alias("source"), link.alias("oa_url"),
    )


def arxiv_summaries(feeds: DataFrame, xml: str = "xml", longest: int = 200) -> DataFrame:
    """``arxiv_hits`` with the first characters of each summary."""
    entries = F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))).alias("pos", "e")
    summary = clean_text(F.regexp_extract("e", r"(?s)<summary[^>]*>(.*?)</summary>", 1))
    title = clean_text(F.regexp_extract("e", r"(?s)<title[^>]*>(.*?)</title>", 1))
    return feeds.select(entries).select(title.alias("title"), F.substring(summary, 1, longest).alias("summary"), F.col("pos").cast("long").alias("pos"))


def crossref_hits(works: DataFrame, work: str = "w", year_from: int = 0, year_to: int = 0) -> DataFrame:
    """Search hits of parsed works: journal articles with an abstract and a title, within the years.

    Authors are given as "Family, G", the first three; a work without a type or an abstract field in
    its schema is not tested for it.
    """
    w = F.col(work)
    fields = works.schema[work].dataType.names
    kept = works
    if "type" in fields:
        kept = kept.filter(w["type"] == "journal-article")
    if "abstract" in fields:
        kept = kept.filter(text_of(w["abstract"]) != "")
    year = F.coalesce(F.get(F.get(w["published"]["date-parts"], F.lit(0)), F.lit(0)).cast("int"), F.lit(0))
    people = F.transform(F.slice(F.coalesce(w["author"], F.array().cast(works.schema[work].dataType["author"].dataType)), 1, 3), lambda a: F.concat(text_of(a["family"]), F.lit(", "), F.substring(text_of(a["given"]), 1, 1)))
    hits = kept.select(
        *[c for c in works.columns if c != work], text_of(F.get(w["title"], F.lit(0))).alias("title"), F.array_join(people, "; ").alias("authors"), year.alias("year"), F.coalesce(F.get(w["container-title"], F.lit(0)), F.lit("N/A")).alias("venue"),
        text_of(w["DOI"]).alias("doi"), F.coalesce(w["is-referenced-by-count"], F.lit(0)).cast("int").alias("citations"), F.lit("crossref").alias("source"), F.lit("").alias("oa_url"),
    )
    inside = F.lit(True)
    if year_from > 0:
        inside = inside & (F.col("year") >= year_from)
    if year_to > 0:
        inside = inside & (F.col("year") <= year_to)
    return hits.filter((F.col("title") != "") & inside)


def pubmed_hits(ids: DataFrame, summaries: DataFrame, summary: str = "d") -> DataFrame:
    """Search hits of a two-step service: found ids (pos, id) looked up among summaries (id, struct), in found order."""
    d = F.col(summary)
    digits = F.substring(F.regexp_replace(text_of(d["pubdate"]), r"\D", ""), 1, 4)
    return ids.join(summaries, "id").select(
        "pos", "id", text_of(d["title"]).alias("title"), F.array_join(F.transform(F.slice(d["authors"], 1, 3), lambda a: a["name"]), "; ").alias("authors"), F.coalesce(digits.try_cast("int"), F.lit(0)).alias("year"), F.coalesce(nonempty(text_of(d["source"])), F.lit("N/A")).alias("venue"),
        F.replace(text_of(d["elocationid"]), F.lit("doi: "), F.lit("")).alias("doi"), F.lit(0).alias("citations"), F.lit("pubmed").alias("source"), F.lit("").alias("oa_url"),
    )


def read_ranks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ranks, aliases) of a JSON file with "journals" (name to tier, level, if) and "_aliases" (alias to name); empty where there is no file."""
    from pyspark.errors import AnalysisException

    schema = "journals map<string,struct<tier:string,level:string,`if`:double>>, _aliases map<string,string>"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        text = spark.createDataFrame([], "value string")
    both = text.select(F.from_json("value", schema).alias("j"))
    ranks = both.select(F.explode("j.journals").alias("name", "r")).select("name", F.col("r.tier").alias("tier"), F.col("r.level").alias("level"), F.col("r.if").alias("impact_factor"))
    return ranks, both.select(F.explode("j._aliases").alias("alias", "name"))
