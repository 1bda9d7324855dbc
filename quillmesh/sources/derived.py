"""Literature-shaped records derived from the driver's tables, the same in Spark and in SQL.

Every document becomes a record: ids in groups of three share a DOI in different spellings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CASES = """
  case when ({k}) % 7 = 0 then '' when doc_id % 5 = 0 then concat('https://doi.org/10.', cast(1000 + ({k}) % 9 as {s}), '/D.', cast({k} as {s}))
    when doc_id % 5 = 1 then concat('DOI: 10.', cast(1000 + ({k}) % 9 as {s}), '/D.', cast({k} as {s})) when doc_id % 5 = 3 then concat('10.', cast(1000 + ({k}) % 9 as {s}), '/D.', cast({k} as {s}), ').')
    else concat('10.', cast(1000 + ({k}) % 9 as {s}), '/D.', cast({k} as {s})) end as doi,
  case when doc_id % 11 = 0 then '' else substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) end as title,
  case when doc_id % 13 = 0 then '' else cast(1995 + doc_id % 30 as {s}) end as year,
  concat('journal ', cast(doc_id % 12 as {s})) as journal,
  case (doc_id * 7) % 4 when 0 then cast(0.3 as double) when 1 then cast(0.55 as double) when 2 then cast(0.75 as double) else cast(0.88 as double) end as confidence,
  case when doc_id % 13 = 5 then null else cast(n_chars % 500 as bigint) end as citations,
  case doc_id % 4 when 0 then 'openalex' when 1 then 'crossref' when 2 then 'pubmed' else 'arxiv' end as source, cast(doc_id % 4 as int) as src_rank,
  coalesce(text, '') as abstract,
  case doc_id % 5 when 0 then 'html-meta:citation_abstract' when 1 then 'crossref' when 2 then 'json-ld' when 3 then 'html-meta:og:description' else '' end as abstract_source,
  case doc_id % 6 when 0 then 'https://h.org/a.pdf' when 1 then 'http://h.org/pdf/1' when 2 then 'ftp://h.org/x.pdf' when 3 then 'https://blocked.example/a?x=pdf' when 4 then 'https://h.org/page' else '' end as url,
  case doc_id % 4 when 0 then 'downloaded' when 1 then 'skipped_non_pdf' when 2 then 'not_requested' else '' end as pdf_status,
  case when doc_id % 3 = 0 then '' else concat('src', cast(doc_id % 3 as {s})) end as pdf_source,
  case when doc_id % 9 = 0 then 'http 403' else '' end as pdf_error
"""

LIT_SQL = "lit as (select doc_id as pos, doc_id // 3 as k, " + _CASES.format(k="doc_id // 3", s="varchar") + ", ['Ann Fam' || (doc_id % 23), 'Bo Lee' || (doc_id % 5)] as authors, ['Kw' || (doc_id % 6), 'kw' || (doc_id % 4)] as keywords from documents)"


def lit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cases = _CASES.format(k="doc_id div 3", s="string").strip()
    docs.createOrReplaceTempView("_lit_documents")
    base = spark.sql(f"select doc_id as pos, doc_id div 3 as k, {cases} from _lit_documents")
    return base.withColumns({
        "authors": F.array(F.concat(F.lit("Ann Fam"), F.col("pos") % 23), F.concat(F.lit("Bo Lee"), F.col("pos") % 5)),
        "keywords": F.array(F.concat(F.lit("Kw"), F.col("pos") % 6), F.concat(F.lit("kw"), F.col("pos") % 4)),
    })


RANKS = [(f"journal {i}", ("CAS", "JCR", "CCF")[i % 3], f"Q{i % 4 + 1}", 1.5 * i + 0.5) for i in range(8)] + [("the journal 8", "JCR", "Q1", 9.9)]
ALIASES = [("journal 9", "journal 1"), ("journal 2", "journal 3"), ("journal 10", "journal 99")]


def rank_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A small synthetic rank table and its aliases; real ones are loaded from a user's file."""
    return spark.createDataFrame(RANKS, "name string, tier string, level string, impact_factor double"), spark.createDataFrame(ALIASES, "alias string, name string")


RANK_SQL = (
    "ranks(name, tier, level, impact_factor) as (values " + ", ".join(f"('{n}', '{t}', '{lv}', cast({f} as double))" for n, t, lv, f in RANKS) + "), "
    "aliases(alias, name) as (values " + ", ".join(f"('{a}', '{n}')" for a, n in ALIASES) + ")"
)


def lit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for every record: a third hold a DOI, some DOIs stand in two, half have a managed block, some links are dead."""
    lit = lit_records(spark, sf_dir).withColumn("doi", F.expr("case when pos % 3 = 0 or pos % 24 = 1 then concat('10.', cast(1000 + k % 9 as string), '/D.', cast(k as string)) else 'none' end"))
    text = F.concat(F.lit("DOI "), F.col("doi"), F.lit("\n[[note "), F.col("pos") + 3, F.lit("|next]] [[dir/note "), F.col("pos") * 2, F.lit("#part]]"), F.when(F.col("pos") % 2 == 0, "\n<!-- managed:begin -->x<!-- managed:end -->").otherwise(""))
    return lit.select(F.concat(F.lit("vault/note "), F.col("pos"), F.lit(".md")).alias("path"), text.alias("text"))


NOTES_SQL = (
    "notes as (select 'vault/note ' || doc_id || '.md' as path, 'note ' || doc_id as title, case when doc_id % 3 = 0 or doc_id % 24 = 1 then '10.' || (1000 + (doc_id // 3) % 9) || '/d.' || (doc_id // 3) end as doi, doc_id % 2 = 0 as has_managed_block, "
    "['note ' || (doc_id + 3), 'note ' || (doc_id * 2)] as targets from documents)"
)


#: What research records say before the text of their document; picked by position.
PHRASES = (
    "A radical clock supports SH2 homolytic substitution.", "Reductive elimination from nickel is slow.", "Photoredox and Ni-catalyzed C(sp3)–C(sp3) coupling reaction.", "An enantioselective, chiral nickel complex gives high ee.",
    "Palladium catalysis as a control experiment.", "NHPI esters undergo single-electron reduction.", "The heterogeneous electrode keeps the oxidation state; cyclic voltammetry shows it.", "Organonickel intermediate was isolated; DFT agrees.",
    "Radical recombination and radical cross-coupling compete.", "Decarboxylation of a carboxylic acid ester.", "An overview without terms.", "Alkyl iodide and alkene react; Stern–Volmer data.",
)


def research_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lit_records`` with two phrases of chemistry before the abstract, some reviews, preprints and concepts."""
    lit = lit_records(spark, sf_dir)
    phrases = F.array(*map(F.lit, PHRASES))
    pick = lambda step: F.element_at(phrases, (F.expr(f"({step}) % {len(PHRASES)} + 1")).cast("int"))
    return lit.withColumns({
        "abstract": F.concat_ws(" ", pick("pos"), pick("pos div 12"), "abstract"),
        "title": F.when(F.expr("pos % 9 = 4"), F.concat(F.lit("Review: "), "title")).when(F.expr("pos % 9 = 5"), F.concat("title", F.lit(" amination"))).otherwise(F.col("title")),
        "journal": F.when(F.expr("pos % 10 = 7"), "ChemRxiv").otherwise(F.col("journal")),
        "concepts": F.when(F.expr("pos % 8 = 3"), F.array(F.lit("Alkyl radical"), F.lit("EPR"))).otherwise(F.array().cast("array<string>")),
    })


RESEARCH_SQL = (
    "ph as (select [" + ", ".join(f"'{x}'" for x in PHRASES) + f"] as ph), research as (select lit.* replace (concat_ws(' ', ph[pos % {len(PHRASES)} + 1], ph[pos // 12 % {len(PHRASES)} + 1], abstract) as abstract, "
    "case when pos % 9 = 4 then 'Review: ' || title when pos % 9 = 5 then title || ' amination' else title end as title, case when pos % 10 = 7 then 'ChemRxiv' else journal end as journal), "
    "case when pos % 8 = 3 then ['Alkyl radical', 'EPR'] else [] end as concepts from lit, ph)"
)
