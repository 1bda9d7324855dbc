"""Reports, indexes and notes as lines of text, and files written whole.

Lines are rows (section, pos, value) that sort into the file, so a report over any number of articles
is made and written in parallel; only counts are gathered.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import creator, doi_url, first_authors, nonempty, normalize_doi_strict, note_filename, note_front, text_of, wikilink
from . import reports, sinks
from .incremental import broken_links, diff_snapshots, doi_uniqueness, replace_block
from .research import category_folder

# The columns of the CSV file, in their order.
CSV_COLUMNS = (
    "title", "authors", "year", "journal", "volume", "issue", "pages", "doi", "url", "pdf_url", "source_page", "abstract", "abstract_source", "keywords", "keywords_source", "concepts", "concepts_source", "citation_count", "metadata_source",
    "metadata_warnings", "confidence", "notes", "pdf_candidates", "pdf_status", "pdf_source", "pdf_path", "pdf_error", "license", "oa_status", "arxiv_id", "pmid", "pmcid", "rank_name",
)
BYTE_ORDER_MARK = "﻿"
#: Statuses of a full text that someone should look at; fixed values.
CHECK_STATUSES = ("found_url_download_failed", "skipped_non_pdf", "skipped_unsafe_url")


def _list(articles: DataFrame, c: str, by: str = "; ") -> Column:
    return F.coalesce(F.array_join(c, by), F.lit("")) if c in articles.columns else F.lit("")


def _text(articles: DataFrame, c: str) -> Column:
    return text_of(c) if c in articles.columns else F.lit("")


def local_index_entry(articles: DataFrame, position: str = "number", folder: str = "") -> Column:
    """Entry of an article in the local index."""
    status = _text(articles, "pdf_status")
    notes = F.concat_ws("; ", nonempty(_list(articles, "notes")), F.when((status != "") & (status != "downloaded"), F.concat(F.lit("PDF status: "), status)))
    items = (
        ("Title", _text(articles, "title")), ("DOI", _text(articles, "doi")), ("Year", _text(articles, "year")), ("Journal", _text(articles, "journal")), ("Authors", _list(articles, "authors")), ("Local PDF", _text(articles, "pdf_path")),
        ("Source URL", F.coalesce(nonempty(_text(articles, "url")), _text(articles, "source_page"))), ("Abstract", _text(articles, "abstract")), ("Keywords", _list(articles, "keywords")), ("Concepts", _list(articles, "concepts")), ("PDF status", status),
        ("OA status", _text(articles, "oa_status")), ("Source capture dir", F.lit(folder)), ("Notes", notes),
    )
    head = F.concat(F.lit("## Article "), F.col(position).cast("string"), F.lit(": "), F.coalesce(nonempty(_text(articles, "title")), F.lit("(untitled)")))
    return F.concat_ws("\n", head, *[F.concat(F.lit(f"- {name}: "), c) for name, c in items], F.lit(""))


def import_guide(bibliography: str = "references.bib", ris: str = "references.ris") -> str:
    """How to take a run's files into a reference manager."""
    return "\n".join((
        "# Importing the references", "", f"- Reference managers that read BibTeX: import `{bibliography}`, then merge what they report as duplicates.", f"- Those that read RIS: import `{ris}`, then check DOI, title, journal, year and authors.",
        "- Full texts lie in `pdfs/`; attach those that are not matched by DOI or title by hand.", "", "Only full texts that are openly and lawfully available are fetched.", "",
    ))


def counts_text(df: DataFrame, value: str = "value", n: str = "n") -> str:
    """Counts as a JSON object, names sorted; for the few distinct values of a status or source."""
    return json.dumps({r[value]: r[n] for r in df.orderBy(value).select(value, n).collect()}, ensure_ascii=False)


def run_report(articles: DataFrame, settings: dict, pos: str = "pos") -> DataFrame:
    """Lines of a capture's report: settings, counts, then records of low confidence, to check, and failed ones.

    ``settings``: label to value, shown first. A section without records says "- None".
    """
    spark = articles.sparkSession
    head = reports.run_counters(articles).first()
    pdf = reports.pdf_counts(articles)
    kinds = {k: counts_text(pdf.filter(F.col("kind") == k)) for k in ("status", "source", "error")}
    listed = lambda c: counts_text(reports.list_source_counts(articles, c), "source") if c in articles.columns else "{}"
    lines = ["# Run Report", "", *[f"- {k}: {v}" for k, v in settings.items()]]
    lines += [f"- Failed/flagged records: {head['failed']}", f"- Low-confidence records requiring manual check: {head['low_confidence']}", f"- Abstract coverage: {head['with_abstract']}/{head['captured']}"]
    lines += [f"- Abstract source counts: {counts_text(reports.abstract_source_counts(articles), 'source')}", f"- Keyword source counts: {listed('keywords_source')}", f"- Concept source counts: {listed('concepts_source')}", f"- Metadata warnings count: {head['warnings']}"]
    lines += [f"- PDF {name} counts: {kinds[k]}" for k, name in (("status", "status"), ("source", "source"), ("error", "failure reason")) if kinds[k] != "{}"]
    if articles.filter(F.contains(text_of("pdf_error"), F.lit("403"))).limit(1).count():
        lines.append("- 403 note: publishers may refuse direct requests; save the page from a browser and read it as HTML.")
    made = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "section int, pos long, value string")

    who = F.concat(F.lit("- "), F.coalesce(nonempty(text_of("title")), nonempty(text_of("doi")), F.lit("(untitled)")))
    low, noted = F.coalesce("confidence", F.lit(0.0)) < 0.6, F.coalesce(F.size("notes") > 0, F.lit(False))
    check = low | text_of("pdf_status").isin(*CHECK_STATUSES) | noted | F.coalesce(F.size("metadata_warnings") > 0, F.lit(False))
    why = F.when(noted, F.array_join("notes", "; ")).when(F.coalesce("confidence", F.lit(0.0)) < 0.5, "low confidence")
    sections = (("Low-Confidence Records", low, who), ("Needs Manual Check", check, F.concat(who, F.lit(" | PDF: "), text_of("pdf_status"))), ("Failed or Flagged Records", why.isNotNull(), F.concat(who, F.lit(": "), why)))
    # each article gives its lines of all sections at once; one pass
    entries = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(i + 1).alias("section"), line.alias("value"))) for i, (_, holds, line) in enumerate(sections)]))
    rows = articles.select(F.col(pos).cast("long").alias("pos"), F.explode(entries).alias("e")).select("e.section", "pos", "e.value")
    heads = spark.createDataFrame([(i + 1, k - 3, x) for i, (name, _, _) in enumerate(sections) for k, x in enumerate(("", f"## {name}", ""))], "section int, pos long, value string")
    empty = spark.range(1, len(sections) + 1).select(F.col("id").cast("int").alias("section")).join(rows.select("section").distinct(), "section", "left_anti").select("section", F.lit(0).cast("long").alias("pos"), F.lit("- None").alias("value"))
    return made.union(heads).union(rows).union(empty)


def candidate_entry(position: str = "number") -> Column:
    """Entry of a selected candidate in the list of a discovery."""
    items = (("DOI", text_of("doi")), ("Year", text_of("year")), ("Venue", text_of("venue")), ("Source", text_of("source")), ("Citations", F.coalesce(F.col("citations").cast("string"), F.lit("0"))), ("Score", text_of("score")), ("Priority hits", F.array_join("priority_hits", "; ")), ("Reasons", F.array_join("reasons", "; ")), ("OA URL", text_of("oa_url")))
    head = F.concat(F.lit("### "), F.col(position).cast("string"), F.lit(". "), F.coalesce(nonempty(text_of("title")), F.lit("(untitled)")))
    return F.concat_ws("\n", head, F.lit(""), *[F.concat(F.lit(f"- {name}: "), c) for name, c in items], F.lit(""))


def identifier_line() -> Column:
    """What a selected candidate is captured by: its DOI link, else its open link, else its title."""
    return F.coalesce(nonempty(doi_url("doi")), nonempty(text_of("oa_url")), text_of("title"))


def console_entry(position: str = "number", tier: str = "tier") -> Column:
    """Entry of a search result as shown to a reader."""
    shown = F.when(text_of(tier) != "", F.concat(F.lit("  |  Tier: "), text_of(tier))).otherwise("")
    doi = F.when(F.startswith(text_of("doi"), F.lit("http")), text_of("doi")).otherwise(F.concat(F.lit("https://doi.org/"), text_of("doi")))
    lines = [
        F.concat(F.lit("["), F.col(position).cast("string"), F.lit("] "), text_of("title")), F.concat(F.lit("    Authors   : "), text_of("authors")), F.concat(F.lit("    Year      : "), text_of("year"), F.lit("  |  Venue: "), text_of("venue"), F.lit("  |  Source: "), text_of("source"), F.lit("  "), F.trim(shown)),
        F.concat(F.lit("    Citations : "), text_of("citations")), F.when(text_of("doi") != "", F.concat(F.lit("    DOI       : "), doi)), F.when(text_of("oa_url") != "", F.concat(F.lit("    OA URL    : "), text_of("oa_url"))),
    ]
    return F.concat_ws("\n", *lines, F.lit(""))


def library_item(articles: DataFrame) -> Column:
    """Article as an item of a reference manager, empty fields null; to_json leaves those out."""
    doi = normalize_doi_strict("doi")
    people = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: creator(a)), lambda c: (c["firstName"] != "") | (c["lastName"] != ""))
    url = F.coalesce(nonempty(_text(articles, "url")), nonempty(_text(articles, "doi_url")), nonempty(doi_url("doi")))
    fields = {
        "itemType": F.coalesce(nonempty(F.trim(_text(articles, "itemType"))), F.lit("journalArticle")), "title": nonempty(F.trim(_text(articles, "title"))), "creators": F.when(F.size(people) > 0, people),
        "publicationTitle": F.coalesce(nonempty(_text(articles, "journal")), nonempty(_text(articles, "venue"))), "date": F.coalesce(nonempty(_text(articles, "date")), nonempty(_text(articles, "year"))), "year": nonempty(_text(articles, "year")),
        "DOI": nonempty(doi), "url": url, "abstractNote": nonempty(_text(articles, "abstract")),
    }
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def item_warnings(articles: DataFrame) -> Column:
    """Warnings of ``library_item``: a missing type is taken as a journal article."""
    missing = F.trim(_text(articles, "itemType")) == ""
    return F.when(missing, F.array(F.concat(F.coalesce(nonempty(normalize_doi_strict("doi")), text_of("title")), F.lit(": itemType missing; defaulted to journalArticle")))).otherwise(F.array().cast("array<string>"))


# --- notes ----------------------------------------------------------------------------------------


def node_notes(nodes: DataFrame, network: str, tags: tuple[str, ...] = ("knowledge-node",)) -> DataFrame:
    """(path, front, block) of the note of every node: links to articles, questions and experiments."""
    listed = lambda head, c: F.concat_ws("\n", F.lit(f"## {head}"), F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), wikilink(x))), "\n")).otherwise("- None"))
    block = F.concat_ws("\n", F.concat(F.lit("- Network: "), wikilink(F.lit(network))), F.concat(F.lit("- Articles: "), F.col("n_articles").cast("string")), listed("Articles", "articles"), listed("Questions", "questions"), listed("Experiments", "experiments"))
    front = F.concat(note_front("name", F.concat(F.lit("knowledge_"), F.col("category")), tags), F.lit("\n# "), F.col("name"), F.lit("\n"))
    return nodes.select(F.concat_ws("/", category_folder("category"), note_filename("name")).alias("path"), front.alias("front"), block.alias("block"))


def preview(notes: DataFrame, made: DataFrame) -> DataFrame:
    """Notes (path, text) as they would stand: blocks replaced in those that exist, further notes begun.

    ``made``: path, front, block; one row a path. Doing it again changes nothing.
    """
    both = notes.select("path", "text").join(made.select("path", "front", "block"), "path", "full")
    base = both.withColumn("text", F.coalesce("text", "front"))
    return base.select("path", F.when(F.col("block").isNull(), F.col("text")).otherwise(replace_block("text", "block")).alias("text"))


def hashed(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, before, after) of notes that a preview changes."""
    return diff_snapshots(hashed(before), hashed(after))


def verification(capture: DataFrame, inventory: DataFrame, most: int = 100) -> DataFrame:
    """(check, detail) of what is wrong with a corpus of notes: DOIs not in exactly one note, broken links (the first)."""
    dois = doi_uniqueness(capture, inventory).select(F.lit("doi_not_unique").alias("check"), F.concat_ws(" ", "doi", F.col("n_notes").cast("string")).alias("detail"))
    links = broken_links(inventory).orderBy("path", "target").limit(most).select(F.lit("broken_link").alias("check"), F.concat_ws(" -> ", "path", "target").alias("detail"))
    return dois.union(links)


# --- files ----------------------------------------------------------------------------------------


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write every (path, text) as a file below a folder that all executors mount; returns lazily (path, bytes).

    A file appears under its name once it is whole. Paths that leave the folder raise an error.
    """

    def run(batches):
        for b in batches:
            done = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                full = os.path.normpath(os.path.join(folder, path))
                if not full.startswith(os.path.normpath(folder) + os.sep):
                    raise ValueError(f"{path} lies outside the folder")
                os.makedirs(os.path.dirname(full), exist_ok=True)
                data = (text or "").encode("utf-8")
                with open(part := f"{full}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(part, full)
                done.append((path, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    return files.select("path", "text").mapInArrow(run, "path string, bytes long")


def apply_notes(before: DataFrame, after: DataFrame, folder: str, backup: str) -> DataFrame:
    """Write the notes that changed, after a copy of their former text under ``backup``; (path, change)."""
    changed = changes(before, after).filter("change <> 'removed'")
    old = before.select("path", "text").join(changed.filter("change = 'changed'").select("path"), "path", "left_semi")
    write_files(old, backup).count()
    write_files(after.select("path", "text").join(changed.select("path"), "path", "left_semi"), folder).count()
    return changed.select("path", "change")


def replace_table(df: DataFrame, path: str, keep: bool = True) -> str:
    """Write ``df`` as JSON at ``path`` so that readers see the old rows or the new ones; the backup's path, or ''.

    Rows are written beside the table first, then two renames put them in place. ``df`` may read ``path``.
    """
    spark = df.sparkSession
    fresh, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.backup-{uuid.uuid4().hex}"
    df.write.json(fresh)
    jvm = spark.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = files.exists(place(path))
    if had and not files.rename(place(path), place(old)):
        raise OSError(f"{path} cannot be moved")
    if not files.rename(place(fresh), place(path)):
        raise OSError(f"{fresh} cannot be moved to {path}")
    if had and not keep:
        files.delete(place(old), True)
    return old if had and keep else ""


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines as text files whose names sort like the lines."""
    lines.orderBy(*order).select("value").write.text(path)


def csv_form(articles: DataFrame) -> DataFrame:
    """The CSV columns in their order, absent ones empty, nested ones as JSON; the first name carries a byte order mark."""
    flat = sinks.flat(articles)
    out = flat.select(*[F.col(c) if c in flat.columns else F.lit("").alias(c) for c in CSV_COLUMNS])
    return out.withColumnRenamed(CSV_COLUMNS[0], BYTE_ORDER_MARK + CSV_COLUMNS[0])


def write_capture(articles: DataFrame, folder: str, settings: dict, number: str = "number") -> None:
    """All eleven forms of a capture: those of ``sinks.write_all``, the PDF manifest, index, guide and report."""
    spark = articles.sparkSession
    sinks.write_all(articles, folder, number)
    csv_form(articles).write.mode("overwrite").option("header", True).csv(f"{folder}/articles.csv")
    picked = [c for c in ("title", "doi", "pdf_status", "pdf_source", "pdf_url", "pdf_path", "license", "oa_status") if c in articles.columns]
    articles.select(*picked).write.json(f"{folder}/pdf_manifest/items")
    reports.pdf_manifest(articles).write.json(f"{folder}/pdf_manifest/totals")
    articles.select(local_index_entry(articles, number, folder).alias("value")).write.text(f"{folder}/local_index.md", lineSep="\n")
    spark.createDataFrame([(import_guide(),)], "value string").write.text(f"{folder}/import_guide.md")
    write_lines(run_report(articles, settings, number), f"{folder}/run_report.md", "section", "pos")


def write_discovery(candidates: DataFrame, selected: DataFrame, settings: dict, folder: str) -> None:
    """A discovery: its settings, all candidates, the selected ones as JSON and Markdown, and their identifiers."""
    spark = candidates.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in settings.items()], "name string, value string").write.json(f"{folder}/settings.json")
    candidates.write.json(f"{folder}/candidates.json")
    selected.write.json(f"{folder}/selected.json")
    selected.orderBy("number").select(candidate_entry().alias("value")).write.text(f"{folder}/candidates.md")
    selected.orderBy("number").select(identifier_line().alias("value")).write.text(f"{folder}/selected_identifiers.txt")


def write_network(parts: dict[str, DataFrame], folder: str, settings: dict) -> None:
    """A network: one JSON table a part (analyses, relations, members, nodes, questions, experiments) and a report of their sizes."""
    spark = next(iter(parts.values())).sparkSession
    lines = ["# Network Report", "", *[f"- {k}: `{v}`" for k, v in settings.items()]]
    for name, df in parts.items():
        df.write.json(f"{folder}/{name}.json")
        lines.append(f"- {name}: `{spark.read.schema(df.schema).json(f'{folder}/{name}.json').count()}`")
    write_lines(spark.createDataFrame(list(enumerate(lines)), "pos long, value string").coalesce(1), f"{folder}/run_report.md", "pos")


def search_json(hits: DataFrame) -> DataFrame:
    """Search results as JSON rows."""
    return hits.select(F.to_json(F.struct(*hits.columns)).alias("value"))


def authors_of(hits: DataFrame, authors: str = "authors") -> DataFrame:
    """``hits`` with its author lists as the first three names."""
    return hits.withColumn(authors, first_authors(authors))
