"""Questions and experiments as records, and the Markdown notes of a research network.

Blocks of articles are column expressions over their analyses. The index is rows (section, pos, sub,
value) that sort into the note, so that a corpus of any size is written in parallel; only counts, the
shown terms and the shown relations are limited, as they are reports of the first ones.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import nonempty, note_filename, note_front, text_of, wikilink
from . import vocabulary as V

#: Folders of the notes, and the state of a new question and of an analysis.
QUESTION_FOLDER, EXPERIMENT_FOLDER, INDEX_FOLDER = "Research Questions", "Experiment Suggestions", "Research Networks"
QUESTION_STATUS, ANALYSIS_STATUS = "research_question_not_literature_conclusion", "local_metadata_analysis"
NOTHING = "- None"


class Question(NamedTuple):
    id: str
    title: str
    why: str
    concepts: tuple[str, ...]


class Experiment(NamedTuple):
    id: str
    question: str
    title: str
    rationale: str
    concepts: tuple[str, ...]
    readouts: tuple[str, ...]
    controls: tuple[str, ...]
    risks: tuple[str, ...]
    caution: str


def default_questions(entries=V.QUESTIONS) -> tuple[Question, ...]:
    """Questions of a vocabulary, worded by their concepts; a caller with prose makes its own."""
    return tuple(Question(i, " and ".join(c[:2]), f"How do {', '.join(c)} bear on one another?", tuple(c)) for i, c in entries)


def default_experiments(entries=V.EXPERIMENTS) -> tuple[Experiment, ...]:
    """Experiments of a vocabulary, worded by their concepts; a caller with prose makes its own."""
    caution = "An outline only; hazards and conditions are to be checked before any work."
    return tuple(
        Experiment(i, q, " with ".join(c[:2]), f"Bears on {q} by way of {c[0]}.", tuple(c), tuple(f"change in {x}" for x in c), tuple(f"without {x}" for x in c), (f"no effect of {c[0]}",), caution)
        for i, q, c in entries
    )


def titled(entry: Question | Experiment) -> str:
    """Title of the note of a question or an experiment."""
    return f"{entry.id} - {entry.title}"


def _evidence(evidence: DataFrame) -> DataFrame:
    """(id, evidence_articles) of numbered evidence, which is limited for each id already."""
    shown = F.array_sort(F.collect_list(F.struct("number", "note_title", "doi")))
    return evidence.groupBy("id").agg(F.transform(shown, lambda e: F.struct(e["note_title"].alias("note_title"), e["doi"].alias("doi"))).alias("evidence_articles"))


def _with_evidence(records: DataFrame, evidence: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<note_title:string,doi:string>>")
    return records.join(_evidence(evidence), "id", "left").withColumn("evidence_articles", F.coalesce("evidence_articles", none))


def question_records(spark: SparkSession, questions, evidence: DataFrame) -> DataFrame:
    """Questions with their evidence (``research.question_evidence``); an empty list where there is none."""
    rows = [(q.id, titled(q), QUESTION_STATUS, q.why, list(q.concepts)) for q in questions]
    return _with_evidence(spark.createDataFrame(rows, "id string, title string, status string, why string, concepts array<string>"), evidence)


def experiment_records(spark: SparkSession, experiments, questions, evidence: DataFrame) -> DataFrame:
    """Experiments with the evidence of their questions (``research.experiment_evidence``)."""
    names = {q.id: titled(q) for q in questions}
    rows = [(e.id, titled(e), e.question, names.get(e.question, e.question), e.rationale, list(e.concepts), list(e.readouts), list(e.controls), list(e.risks), e.caution) for e in experiments]
    lists = "concepts array<string>, readouts array<string>, controls array<string>, risks array<string>"
    return _with_evidence(spark.createDataFrame(rows, f"id string, title string, question string, question_title string, rationale string, {lists}, caution string"), evidence)


# --- notes ----------------------------------------------------------------------------------------


def _items(lines: Column, empty: str | None = NOTHING) -> Column:
    """Lines of a list, or what stands for an empty one (null: no line)."""
    joined = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(lines) > 0, joined).otherwise(F.lit(empty))


def _evidence_items() -> Column:
    return _items(F.transform("evidence_articles", lambda e: F.concat(wikilink(e["note_title"]), F.lit(" ("), e["doi"], F.lit(")"))))


def _links(names: Column, empty: str = "none") -> Column:
    return F.coalesce(nonempty(F.array_join(F.transform(names, lambda n: wikilink(n)), ", ")), F.lit(empty))


def _note(folder: str, title, text: Column) -> tuple[Column, Column]:
    return F.concat(F.lit(f"{folder}/"), note_filename(title)).alias("path"), text.alias("text")


def question_notes(records: DataFrame, network: str, tags: tuple[str, ...] = ("research-question",)) -> DataFrame:
    """(path, text) of the note of every question record."""
    text = F.concat_ws(
        "\n", F.concat(note_front("title", F.lit("research_question"), tags), F.lit("\n# "), F.col("title"), F.lit("\n")), F.concat(F.lit("- Network: "), wikilink(F.lit(network))), F.concat(F.lit("- Status: `"), F.col("status"), F.lit("`\n")),
        F.lit("## Why it matters"), F.concat("why", F.lit("\n")), F.lit("## Concepts"), F.concat(_links(F.col("concepts")), F.lit("\n")), F.lit("## Evidence"), _evidence_items(), F.lit("\nOpen until experiments or full texts support an answer.\n"),
    )
    return records.select(*_note(QUESTION_FOLDER, "title", text))


def experiment_notes(records: DataFrame, network: str, tags: tuple[str, ...] = ("experiment-suggestion",)) -> DataFrame:
    """(path, text) of the note of every experiment record."""
    listed = lambda head, c: (F.lit(f"## {head}"), F.concat(_items(F.col(c)), F.lit("\n")))
    text = F.concat_ws(
        "\n", F.concat(note_front("title", F.lit("experiment_suggestion"), tags), F.lit("\n# "), F.col("title"), F.lit("\n")), F.concat(F.lit("- Network: "), wikilink(F.lit(network))), F.concat(F.lit("- Question: "), wikilink("question_title"), F.lit("\n")),
        F.lit("## Rationale"), F.concat("rationale", F.lit("\n")), F.lit("## Concepts"), F.concat(_links(F.col("concepts")), F.lit("\n")), *listed("Readouts", "readouts"), *listed("Controls", "controls"), *listed("Risks", "risks"),
        F.lit("## Evidence"), _evidence_items(), F.concat(F.lit("\n"), F.col("caution"), F.lit("\n")),
    )
    return records.select(*_note(EXPERIMENT_FOLDER, "title", text))


def _asked(entries, *names: Column, most: int = 4) -> Column:
    """Note titles of the entries that share a concept with the first names, then with the next ones."""
    table = F.array(*[F.struct(F.lit(titled(e)).alias("title"), F.array(*map(F.lit, e.concepts)).alias("concepts")) for e in entries])
    sharing = lambda n: F.transform(F.filter(table, lambda e: F.arrays_overlap(e["concepts"], n)), lambda e: e["title"])
    found = [sharing(n) for n in names]
    return F.slice(F.array_distinct(F.concat(*found)), 1, most)


def article_block(questions, experiments, terms: int = 14, connectors: int = 10) -> Column:
    """Managed block of an analysis: role, summary, terms, methods, and the first questions and experiments it bears on."""
    names, project = (F.transform(c, lambda t: t["name"]) for c in ("terms", "project_relevance_terms"))
    methods = F.transform("evidence_methods", lambda m: F.concat(wikilink(m["name"]), F.lit(": `"), m["source_field"], F.lit("`")))
    asked = [F.transform(_asked(e, names, project), lambda t: wikilink(t)) if e else F.array().cast("array<string>") for e in (questions, experiments)]
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    facts = (("Basis", F.lit("metadata and notes held locally, no full text")), ("Status", code(F.lit(ANALYSIS_STATUS))), ("Corpus role", code(F.col("corpus_role"))), ("Relevance", F.col("relevance_to_project")), ("Mechanism", F.col("mechanistic_summary")), ("Terms", _links(F.slice(names, 1, terms))), ("Connectors", _links(F.slice(project, 1, connectors))))
    parts = [F.lit("## Literature analysis\n"), *[F.concat(F.lit(f"- {k}: "), c) for k, c in facts]]
    for head, lines in (("Evidence methods", methods), ("Questions", asked[0]), ("Experiments", asked[1])):
        parts += [F.lit(f"\n### {head}"), _items(lines)]
    limits = F.when(F.size("limitations") > 0, F.concat(F.lit("\n### Limits\n"), _items(F.col("limitations"))))
    return F.concat_ws("\n", *parts, limits)


def article_notes(analyses: DataFrame, paths: DataFrame, questions, experiments, key: str = "pos") -> DataFrame:
    """(path, front, block) for ``documents.preview``: blocks of the articles that have a note.

    ``paths``: (key, path). An article without a note gets none, so fronts are empty; of articles that
    share a note the first one's block is taken.
    """
    made = analyses.select(key, article_block(questions, experiments).alias("block")).join(paths.select(key, "path"), key).filter(text_of("path") != "")
    return made.groupBy("path").agg(F.min_by("block", key).alias("block")).select("path", F.lit("").alias("front"), "block")


# --- the index ------------------------------------------------------------------------------------


def corpus_lines(analyses: DataFrame, key: str = "pos") -> DataFrame:
    """(pos, sub, value): a line per article, versions of one work below its main version.

    Versions share a key of the title, else the DOI; articles with neither stand alone. The main version
    is the first that is no preprint, else the first. A work stands where its first version does. Two
    aggregates and a join, so that no key's articles are ordered in one task.
    """
    work = F.coalesce(nonempty("version_group_key"), nonempty("doi"), F.concat(F.lit("#"), F.col(key).cast("string")))
    rows = analyses.select(F.col(key).cast("long").alias("_at"), "note_title", "year", "doi", "corpus_role", work.alias("_work"))
    preprint = F.contains(F.lower("doi"), F.lit("chemrxiv"))
    works = rows.groupBy("_work").agg(F.min("_at").alias("pos"), F.min(F.struct(preprint.alias("late"), F.col("_at").alias("at"))).alias("_main"))
    code = lambda c: F.concat(F.lit(" - `"), text_of(c), F.lit("`"))
    main = F.col("_at") == F.col("_main.at")
    line = F.when(main, F.concat(F.lit("- "), wikilink("note_title"), F.lit(" - "), text_of("year"), code("doi"), code("corpus_role")))
    line = line.otherwise(F.concat(F.lit("  - version pair: "), wikilink("note_title"), code("doi"), code("corpus_role")))
    return rows.join(works, "_work").select("pos", F.when(main, F.lit(0).cast("long")).otherwise(F.col("_at") + 1).alias("sub"), line.alias("value"))


def frequent_terms(analyses: DataFrame, terms: str = "terms", most: int = 15, key: str = "pos") -> DataFrame:
    """(number, name, n): the most frequent names; of equal counts the one met first."""
    rows = analyses.select(key, F.posexplode(F.transform(terms, lambda t: t["name"])).alias("_i", "name"))
    counts = rows.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct(key, "_i")).alias("_first"))
    first = counts.orderBy(F.desc("n"), "_first").limit(most)
    return first.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).select("number", "name", "n")


def relation_highlights(relations: DataFrame, members: DataFrame, notes: DataFrame, most: int = 20, key: str = "pos") -> DataFrame:
    """(number, type, source, target, detail): the first relations, each by its first two different articles.

    ``relations`` and ``members`` are those of ``research``, ``notes`` has (key, note_title). Version pairs
    come first, then shared terms, then contrasts, by class. A contrast whose one article stands on both
    sides relates nothing and has no line.
    """
    rank = F.when(F.col("kind") == "version", 0).when(F.col("kind") == "terms", 1).otherwise(2)
    order = ("_rank", "class_a", "class_b")
    first = relations.withColumn("_rank", rank).orderBy(*order).limit(most)
    shown = first.select("kind", F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    near = members.join(F.broadcast(shown), ["kind", "class"], "left_semi").select("kind", "class", key)  # at most twice ``most`` classes
    two = near.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "class").orderBy(key))).filter("_n <= 2").join(notes.select(key, "note_title"), key)
    at = lambda n: F.max(F.when(F.col("_n") == n, F.struct(F.col(key).alias("at"), F.col("note_title").alias("title"))))
    two = two.groupBy("kind", "class").agg(at(1).alias("one"), at(2).alias("two"))
    side = lambda s: two.select("kind", F.col("class").alias(f"class_{s}"), F.col("one").alias(f"_{s}1"), F.col("two").alias(f"_{s}2"))
    both = first.join(side("a"), ["kind", "class_a"]).join(side("b"), ["kind", "class_b"])
    source = F.when(F.col("_b2").isNull() & (F.col("_b1.at") == F.col("_a1.at")), F.col("_a2")).otherwise(F.col("_a1"))
    both = both.withColumn("_s", source).withColumn("_t", F.when(F.col("_b1.at") != F.col("_s.at"), F.col("_b1")).otherwise(F.col("_b2"))).filter("_s is not null and _t is not null")
    detail = F.coalesce(nonempty(F.array_join("shared_terms", ", ")), nonempty("contrast"), F.col("version_note"))
    numbered = both.withColumn("number", F.row_number().over(Window.orderBy(*order)))
    return numbered.select("number", "type", F.col("_s.title").alias("source"), F.col("_t.title").alias("target"), detail.alias("detail"))


def index_lines(analyses: DataFrame, relations: DataFrame, members: DataFrame, questions, experiments, network: str, scope: str = "A network of articles by their metadata.", tags: tuple[str, ...] = ("research-network",), key: str = "pos") -> DataFrame:
    """Lines (section, pos, sub, value) of the index note of a network; an empty part says so."""
    spark = analyses.sparkSession
    at = lambda df, value: df.select(F.col("number").cast("long").alias("pos"), F.lit(0).cast("long").alias("sub"), value.alias("value"))
    counted = lambda df: at(df, F.concat(F.lit("- "), wikilink("name"), F.lit(": "), F.col("n")))
    roles = analyses.groupBy("corpus_role").agg(F.count("*").alias("n"))  # one row a role
    roles = at(roles.withColumn("number", F.row_number().over(Window.orderBy("corpus_role"))), F.concat(F.lit("- `"), F.col("corpus_role"), F.lit("`: "), F.col("n")))
    named = lambda entries: spark.createDataFrame([(i + 1, 0, f"- [[{titled(e)}]]") for i, e in enumerate(entries)], "pos long, sub long, value string")
    high = relation_highlights(relations, members, analyses, key=key)
    high = at(high, F.concat(F.lit("- "), wikilink("source"), F.lit(" -> "), wikilink("target"), F.lit(": `"), F.col("type"), F.lit("` "), F.col("detail")))
    sections = (
        ("Corpus", corpus_lines(analyses, key)), ("Corpus roles", roles), ("Frequent terms", counted(frequent_terms(analyses, "terms", key=key))), ("Connectors", counted(frequent_terms(analyses, "project_relevance_terms", key=key))),
        ("Questions", named(questions)), ("Experiments", named(experiments)), ("Relations", high),
    )
    one = spark.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("sub"))
    out = one.withColumn("value", F.concat(note_front(F.lit(network), F.lit("research_network_index"), tags), F.lit(f"\n# {network}\n\n{scope}")))
    for i, (head, rows) in enumerate(sections, 1):
        out = out.union(rows.select(F.lit(i).alias("section"), "pos", "sub", "value"))
        # a head stands before its rows; "None" is the one row of an empty part
        heads = spark.createDataFrame([(i, -1, 0, f"\n## {head}")], "section int, pos long, sub long, value string")
        empty = rows.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(i), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(NOTHING))
        out = out.union(heads).union(empty)
    return out


def write_index(lines: DataFrame, path: str) -> None:
    """The index as text files whose names sort like its lines."""
    lines.orderBy("section", "pos", "sub").select("value").write.text(path)
