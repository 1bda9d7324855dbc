"""Text forms of records and their writers. Rows become text in Spark; files are written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.text import bibtex_escape, citation_key, collapse, nonempty, text_of, yaml_quote

BIBTEX_FIELDS = (("title", "title"), ("author", None), ("journal", "journal"), ("year", "year"), ("volume", "volume"), ("number", "issue"), ("pages", "pages"), ("doi", "doi"), ("url", None), ("abstract", "abstract"))


def _url() -> Column:
    return F.coalesce(nonempty(text_of("url")), text_of("source_page"))


def bibtex_entry(position: str = "number") -> Column:
    """BibTeX entry of an article: article with a journal that is no preprint server, else misc."""
    kind = F.when((text_of("journal") != "") & ~F.contains(F.lower(text_of("journal")), F.lit("arxiv")), "article").otherwise("misc")
    special = {"author": F.array_join("authors", " and "), "url": _url()}
    lines = [F.when(v != "", F.concat(F.lit(f"  {name} = {{"), bibtex_escape(v), F.lit("}"))) for name, v in ((n, special.get(n, text_of(c) if c else None)) for n, c in BIBTEX_FIELDS)]
    return F.concat(F.lit("@"), kind, F.lit("{"), citation_key("authors", "year", "title", position), F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def ris_lines() -> Column:
    """RIS lines of an article as an array."""
    def line(tag, c):
        return F.when(text_of(c) != "", F.array(F.concat(F.lit(f"{tag}  - "), text_of(c)))).otherwise(F.array().cast("array<string>"))

    kind = F.when(text_of("journal") != "", "TY  - JOUR").otherwise("TY  - GEN")
    authors = F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a))
    rest = [line(t, c) for t, c in (("JO", "journal"), ("PY", "year"), ("VL", "volume"), ("IS", "issue"), ("SP", "pages"), ("DO", "doi"), ("UR", _url()), ("AB", "abstract"))]
    return F.concat(F.array(kind), line("T1", "title"), authors, *rest, F.array(F.lit("ER  - "), F.lit("")))


def markdown_entry(position: str = "number") -> Column:
    def item(name, c):
        return F.when(text_of(c) != "", F.concat(F.lit(f"- {name}: "), text_of(c)))

    head = F.concat(F.lit("## "), F.col(position).cast("string"), F.lit(". "), F.coalesce(nonempty(text_of("title")), F.lit("(untitled)")))
    items = [item("Authors", F.array_join("authors", "; ")), item("Year", "year"), item("Journal", "journal"), item("DOI", "doi"), item("URL", _url()), item("PDF", "pdf_status"), item("Keywords", F.array_join("keywords", ", ")), item("Concepts", F.array_join("concepts", ", ")), item("Confidence", F.col("confidence").cast("string"))]
    body = F.when(text_of("abstract") != "", F.concat(F.lit("\n"), F.col("abstract")))
    return F.concat_ws("\n", head, F.lit(""), *items, body)


def front_matter(fields: dict[str, str]) -> Column:
    """YAML block of quoted text fields."""
    lines = [F.concat(F.lit(f"{name}: "), yaml_quote(c)) for name, c in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def citation(style: str) -> Column:
    """One-line citation in a common style: apa, ieee, gbt7714, mla, chicago, vancouver or harvard."""
    names, year = F.array_join("authors", ", "), F.coalesce(nonempty(text_of("year")), F.lit("n.d."))
    forms = {
        "apa": F.concat(names, F.lit(" ("), year, F.lit("). "), text_of("title"), F.lit(". "), text_of("journal"), F.lit(".")),
        "ieee": F.concat(names, F.lit(', "'), text_of("title"), F.lit(',"'), F.lit(" "), text_of("journal"), F.lit(", "), year, F.lit(".")),
        "mla": F.concat(names, F.lit('. "'), text_of("title"), F.lit('." '), text_of("journal"), F.lit(", "), year, F.lit(".")),
        "chicago": F.concat(names, F.lit(". "), year, F.lit('. "'), text_of("title"), F.lit('." '), text_of("journal"), F.lit(".")),
        "vancouver": F.concat(names, F.lit(". "), text_of("title"), F.lit(". "), text_of("journal"), F.lit(". "), year, F.lit(".")),
        "harvard": F.concat(names, F.lit(", "), year, F.lit(". "), text_of("title"), F.lit(". "), text_of("journal"), F.lit(".")),
        "gbt7714": F.concat(names, F.lit(". "), text_of("title"), F.lit("[J]. "), text_of("journal"), F.lit(", "), year, F.lit(".")),
    }
    return collapse(forms[style])


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def without_empty(df: DataFrame) -> DataFrame:
    """Empty texts and lists as null, so that JSON output leaves the fields out."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType
        if kind.simpleString() == "string":
            out.append(nonempty(c).alias(f.name))
        else:
            out.append((F.when(F.size(c) > 0, c) if isinstance(kind, (ArrayType, MapType)) else c).alias(f.name))
    return df.select(*out)


def write_all(articles: DataFrame, folder: str, number: str = "number") -> None:
    """All forms of a run under one folder: JSON, CSV, BibTeX, RIS, Markdown, DOI list, failures."""
    articles.write.json(f"{folder}/articles.json")
    flat(articles).write.option("header", True).csv(f"{folder}/articles.csv")
    articles.select(bibtex_entry(number).alias("value")).write.text(f"{folder}/references.bib", lineSep="\n\n")
    articles.select(F.explode(ris_lines()).alias("value")).write.text(f"{folder}/references.ris")
    articles.select(markdown_entry(number).alias("value")).write.text(f"{folder}/articles.md", lineSep="\n\n")
    articles.filter("doi <> ''").select(F.col("doi").alias("value")).write.text(f"{folder}/dois.txt")
    failed_lines(articles).write.text(f"{folder}/failed.txt")


def failed_lines(articles: DataFrame) -> DataFrame:
    who = F.coalesce(nonempty(text_of("title")), nonempty(text_of("doi")), F.lit("(untitled)"))
    why = F.when(F.size("notes") > 0, F.array_join("notes", "; ")).when(F.coalesce("confidence", F.lit(0.0)) < 0.5, "low confidence")
    return articles.filter(why.isNotNull()).select(F.concat(F.lit("- "), who, F.lit(": "), why).alias("value"))
