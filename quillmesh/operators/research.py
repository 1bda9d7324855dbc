"""The research network: analysis records of articles, their relations, questions, experiments and nodes.

An analysis is one row per article, made of column expressions only. Relations are given between
classes of articles (sets of terms, version keys) with the membership beside them, so their number is
bounded by what occurs, not by pairs of articles; every pair follows by joining the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import folded
from ..functions.text import compact_title_key, last_name, nonempty, normalize_doi, normalize_text, text_of
from ..sources.folders import written_once
from . import vocabulary as V
from .network import first_label, once, overlapping, tagged

FIELDS = ("title", "abstract", "keywords", "concepts")


def field_texts(articles: DataFrame) -> dict[str, Column]:
    """Normalised texts to search; lists are joined by "; ", absent columns are left out."""
    out = {}
    for f in FIELDS:
        if f in articles.columns:
            is_list = articles.schema[f].dataType.simpleString().startswith("array")
            out[f] = normalize_text(F.array_join(f, "; ") if is_list else F.col(f))
    return out


def _has(names: Column, *wanted: str) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


def _all(names: Column, *wanted: str) -> Column:
    return F.size(F.array_intersect(names, F.array(*map(F.lit, wanted)))) == len(wanted)


def project_terms(names: Column, text: Column) -> Column:
    """Connectors that hold by an article's term names or its lower-case text, without those it has as terms.

    An array of (name, category, source_field, excerpt); the excerpt says why, as no text is quoted.
    """
    # fixed values: name, when it holds, the reason given
    cases = (
        ("radical flux", _has(names, "radical cross-coupling", "photoredox catalysis", "decarboxylation", "alkyl radical", "single electron transfer"), "project connector inferred from local radical/redox context; not a direct flux measurement claim"),
        ("electrode-catalyst decoupling", _all(names, "electrochemistry", "nickel catalyst") | (F.contains(text, F.lit("electrode")) & F.contains(text, F.lit("nickel"))), "project connector for separating electrode redox activation from nickel catalysis"),
        ("SH2 vs reductive elimination", _has(names, "SH2 mechanism", "homolytic substitution", "reductive elimination"), "project connector for distinguishing stereodefining mechanism hypotheses"),
        ("enantioselective radical capture", _has(names, "stereocontrol", "chiral nickel catalyst"), "project connector for asymmetric radical capture and stereocontrol"),
        ("NHPI ester SET axis", F.contains(text, F.lit("nhpi")) | _has(names, "carboxylic acid", "carboxylic acid ester"), "project connector for redox-active ester radical generation hypotheses"),
    )
    low = F.transform(names, F.lower)
    made = [F.when(holds & ~F.array_contains(low, name.lower()), F.struct(F.lit(name).alias("name"), F.lit("concept").alias("category"), F.lit("project_relevance").alias("source_field"), F.lit(why).alias("excerpt"))) for name, holds, why in cases]
    return F.array_compact(F.array(*made))


def corpus_role(names: Column, title: Column, doi: Column, journal: Column) -> Column:
    """What an article is to the corpus; ``title`` and ``journal`` in lower case."""
    any_in = lambda c, *parts: F.greatest(*[F.contains(c, F.lit(p)) for p in parts], F.lit(False))
    return first_label(  # fixed values
        (
            (F.contains(doi, F.lit("chemrxiv")) | F.contains(journal, F.lit("chemrxiv")), "preprint_version"),
            (any_in(title, "review", "paradigm shift"), "review_context"),
            (_has(names, "palladium catalyst", "bismuth radical"), "contrast_control"),
            (any_in(title, "c-n", "carbon-nitrogen", "amination"), "adjacent_method"),
            (_has(names, "chiral nickel catalyst", "stereocontrol"), "core_asymmetric_ni_relevance"),
            (_all(names, "nickel catalyst", "C(sp3)-C(sp3) cross-coupling"), "core_ni_csp3_csp3_context"),
            (_has(names, "C(sp3)-C(sp3) cross-coupling", "radical cross-coupling"), "near_core_radical_coupling"),
        ),
        "background_context",
    )


def summary(names: Column, title: Column) -> Column:
    """One sentence on an article's mechanism; ``title`` in lower case."""
    return first_label(  # fixed values
        (
            (_has(names, "SH2 mechanism", "homolytic substitution"), "Local capture directly flags SH2/homolytic substitution as a mechanistic motif."),
            (_has(names, "alkylnickel intermediate"), "Local capture supports organonickel/alkylnickel intermediate formation as a mechanistic anchor."),
            (_has(names, "radical recombination"), "Local capture supports radical recombination or radical-pair control as the main mechanistic clue."),
            (_all(names, "photoredox catalysis", "nickel catalyst"), "Local capture supports metallaphotoredox radical generation coupled to nickel catalysis."),
            (_has(names, "electrochemistry", "photoelectrochemistry"), "Local capture supports electro/photo-mediated redox control as a method context."),
            (F.contains(title, F.lit("review")) | F.contains(title, F.lit("paradigm shift")), "Local capture is best treated as review/background context rather than a primary mechanistic result."),
        ),
        "Local capture provides contextual chemistry terms, but mechanism remains underdetermined from metadata alone.",
    )


def note_title(articles: DataFrame) -> Column:
    """Stem of the article's note, else "Author Year - title" with 60 characters of the title."""
    author = last_name(F.get("authors", F.lit(0))) if "authors" in articles.columns else F.lit("Unknown")
    made = F.concat(author, F.lit(" "), F.coalesce(nonempty(text_of("year")), F.lit("n.d.")), F.lit(" - "), F.substring(normalize_text("title"), 1, 60))
    if "note_path" not in articles.columns:
        return made
    return F.coalesce(nonempty(F.regexp_replace(F.regexp_replace(text_of("note_path"), r"^.*[/\\]", ""), r"\.[^.]*$", "")), made)


def by_category(terms: str) -> Column:
    """Sorted map of category to its term names, of an array of terms."""
    groups = F.array_sort(F.array_distinct(F.transform(terms, lambda t: t["category"])))
    names = lambda c: F.transform(F.filter(terms, lambda t: t["category"] == c), lambda t: t["name"])
    return F.map_from_entries(F.transform(groups, lambda c: F.struct(c.alias("category"), names(c).alias("names"))))


def analysis_records(articles: DataFrame, term_rules=V.TERM_RULES, evidence_rules=V.EVIDENCE_RULES, key: str = "pos", excerpts: bool = True) -> DataFrame:
    """One analysis per article: terms and evidence methods with excerpts, unless told not to, connectors, role, summary, limits."""
    found = field_texts(articles)
    # texts become columns, so that the rules do not each normalise them again
    base = articles.withColumns({f"_t_{f}": t for f, t in found.items()}).withColumns({f"_l_{f}": folded(F.col(f"_t_{f}")) for f in found})
    texts, low = ({f: F.col(f"_{k}_{f}") for f in found} for k in "tl")
    base = base.select("*", once(F.struct(tagged(texts, term_rules, low, excerpts).alias("terms"), tagged(texts, evidence_rules, low, excerpts).alias("methods"))).alias("_found"))
    base = base.withColumns({"_terms": F.col("_found.terms"), "_methods": F.col("_found.methods"), "_text": F.concat_ws(" ", *low.values())})
    base = base.withColumn("_names", F.transform("_terms", lambda t: t["name"]))
    base = base.withColumns({"_project": project_terms(F.col("_names"), F.col("_text")), "_title": normalize_text("title"), "_doi": normalize_doi("doi"), "_journal": text_of("journal")})
    names, title = F.col("_names"), F.lower("_title")
    category = lambda c: F.exists("_terms", lambda t: t["category"] == c)
    limits = F.array_compact(F.array(  # fixed values
        F.when(normalize_text("abstract") == "", "No abstract in local capture; analysis is limited to title/metadata."),
        F.when(F.size("_methods") == 0, "No explicit DFT/CV/radical-clock/stoichiometric evidence method was detected in local capture text."),
        F.when(~_has(names, "stereocontrol"), "No direct ee/stereocontrol evidence was detected in local capture text."),
    ))
    relevance = F.concat_ws("; ", F.when(category("mechanism"), "mechanistic radical or organometallic clue"), F.when(category("method"), "C(sp3) coupling or redox method"), F.when(category("catalyst"), "metal or catalyst context"), F.when(F.size("_project") > 0, "project-hypothesis connector"))
    return base.select(
        key, F.col("_doi").alias("doi"), F.col("_title").alias("title"), text_of("year").alias("year"), F.col("_journal").alias("journal"), note_title(articles).alias("note_title"), F.col("_terms").alias("terms"), F.col("_project").alias("project_relevance_terms"),
        by_category("_terms").alias("terms_by_category"), by_category("_project").alias("project_terms_by_category"), F.col("_methods").alias("evidence_methods"), summary(names, title).alias("mechanistic_summary"),
        F.coalesce(nonempty(relevance), F.lit("background context only")).alias("relevance_to_project"), corpus_role(names, title, F.col("_doi"), F.lower(normalize_text("_journal"))).alias("corpus_role"), compact_title_key("_title").alias("version_group_key"), limits.alias("limitations"),
    )


# --- relations ------------------------------------------------------------------------------------


def relation_members(analyses: DataFrame, contrasts=V.CONTRASTS, key: str = "pos") -> DataFrame:
    """(kind, class, key, doi): the classes an article belongs to.

    They are its set of terms ("terms"), its version key ("version") and each term of it that stands
    on a side of a contrast ("term").
    """
    names = F.array_distinct(F.transform("terms", lambda t: t["name"]))
    sides = F.array_intersect(names, F.array(*map(F.lit, sorted({n for pair in contrasts for n in pair}))))
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("class"))
    entries = F.concat(F.array(entry("terms", F.array_join(F.array_sort(names), "|")), entry("version", F.col("version_group_key"))), F.transform(sides, lambda n: entry("term", n)))
    return analyses.select(key, "doi", F.explode(entries).alias("e")).filter("e.class <> ''").select("e.kind", "e.class", key, "doi")


RELATION = ("type", "kind", "class_a", "class_b", "shared_terms", "contrast", "confidence", "version_note", "n_a", "n_b")


def relations(analyses: DataFrame, contrasts=V.CONTRASTS, least: int = 2, key: str = "pos") -> DataFrame:
    """All relations, as rows of ``RELATION``.

    Each row stands for all pairs of an article of class_a and another one of class_b, see
    ``relation_members``; a contrast leads from the articles of its first term to those of the second.
    Rows are bounded by the classes that occur: sets of terms meet on pairs of terms, articles never meet.
    """
    # each kind reads the groups, and a filter on the kind would reach below them into the analyses
    groups = written_once(relation_members(analyses, contrasts, key).groupBy("kind", "class").agg(F.count("*").alias("n")), "relation-groups")
    none, empty = F.array().cast("array<string>"), F.lit("")
    same = "same normalized title; treat as article/preprint version pair rather than independent evidence"  # fixed value
    versions = groups.filter("kind = 'version' and n > 1").select(
        F.lit("version_pair").alias("type"), "kind", F.col("class").alias("class_a"), F.col("class").alias("class_b"), none.alias("shared_terms"), empty.alias("contrast"), F.lit("high").alias("confidence"), F.lit(same).alias("version_note"), F.col("n").alias("n_a"), F.col("n").alias("n_b")
    )
    sets = groups.filter("kind = 'terms'").select("class", "n", F.split("class", r"\|").alias("names"))
    a, b = sets.select(F.col("class").alias("class_a"), F.col("n").alias("n_a"), "names"), sets.select(F.col("class").alias("class_b"), F.col("n").alias("n_b"), F.col("names").alias("others"))
    met = overlapping(a, b, least).filter("class_a < class_b or (class_a = class_b and n_a > 1)")
    shared = met.select(F.lit("shared_mechanistic_or_method_terms").alias("type"), F.lit("terms").alias("kind"), "class_a", "class_b", "shared_terms", empty.alias("contrast"), F.lit("medium").alias("confidence"), empty.alias("version_note"), "n_a", "n_b")
    rules = analyses.sparkSession.createDataFrame(list(contrasts), "class_a string, class_b string")
    side = groups.filter("kind = 'term'")
    sides = rules.join(side.select(F.col("class").alias("class_a"), F.col("n").alias("n_a")), "class_a").join(side.select(F.col("class").alias("class_b"), F.col("n").alias("n_b")), "class_b")
    contrast = sides.select(F.lit("contrast_for_hypothesis_testing").alias("type"), F.lit("term").alias("kind"), "class_a", "class_b", none.alias("shared_terms"), F.concat_ws(" vs ", "class_a", "class_b").alias("contrast"), F.lit("low").alias("confidence"), empty.alias("version_note"), "n_a", "n_b")
    return versions.select(*RELATION).unionByName(shared).unionByName(contrast)


# --- questions, experiments, nodes ----------------------------------------------------------------


def concept_table(spark, entries) -> DataFrame:
    """(id, concept_no, concept) of (id, ..., concepts) entries."""
    rows = [(e[0], i, c) for e in entries for i, c in enumerate(e[-1])]
    return spark.createDataFrame(rows, "id string, concept_no int, concept string")


def labels(analyses: DataFrame, key: str = "pos") -> DataFrame:
    """(key, name, category, source_type, excerpt, label_no) of every term, connector and method of an article."""

    def entries(c: str, source: str, base: int) -> Column:
        return F.transform(c, lambda t, i: F.struct(t["name"].alias("name"), t["category"].alias("category"), F.lit(source).alias("source_type"), t["excerpt"].alias("excerpt"), (i + base).alias("label_no")))

    rows = [entries("terms", "term", 0), entries("project_relevance_terms", "project_relevance", 1 << 10), entries("evidence_methods", "evidence_method", 1 << 20)]
    return analyses.select(key, "doi", "note_title", F.explode(F.concat(*rows)).alias("l")).select(key, "doi", "note_title", "l.*")


def question_evidence(concepts: DataFrame, analyses: DataFrame, most: int = 6, key: str = "pos") -> DataFrame:
    """(id, number, doi, note_title): the first ``most`` articles with a DOI for each question.

    ``concepts``: id, concept_no, concept. Articles of an earlier concept come first, then by
    position; a DOI counts once.
    """
    asked = F.broadcast(concepts.select("id", "concept_no", F.lower("concept").alias("low")))
    hits = labels(analyses, key).filter("doi <> ''").select(key, "doi", "note_title", F.lower("name").alias("low")).join(asked, "low")
    first = hits.groupBy("id", "doi").agg(F.min(F.struct("concept_no", key, "note_title")).alias("at"))
    ranked = first.withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("at.concept_no", f"at.{key}")))
    return ranked.filter(F.col("number") <= most).select("id", "number", "doi", F.col("at.note_title").alias("note_title"))


def experiment_evidence(experiments: DataFrame, evidence: DataFrame, most: int = 4) -> DataFrame:
    """(id, question, number, doi, note_title): an experiment shows the first articles of its question."""
    found = evidence.filter(F.col("number") <= most).withColumnRenamed("id", "question")
    return F.broadcast(experiments.select("id", "question")).join(found, "question").select("id", "question", "number", "doi", "note_title")


def nodes(analyses: DataFrame, question_concepts: DataFrame, experiment_concepts: DataFrame, most: int = 12, key: str = "pos") -> DataFrame:
    """(category, name, n_articles, articles, questions, experiments) of every label and every concept asked for.

    A concept's category is that of the label first met with its name, else "concept". The first
    ``most`` article titles are shown; counts come from a grouped aggregate, so a frequent term is no
    hot task. The analyses are computed once.
    """
    analyses = written_once(analyses.select(key, "doi", "note_title", "terms", "project_relevance_terms", "evidence_methods"), "node-labels")
    rows = labels(analyses, key).withColumn("low", F.lower("name"))
    at = F.struct(key, "label_no")
    category = rows.groupBy("low").agg(F.min_by("category", at).alias("of_low"))
    found = rows.groupBy("category", "low").agg(F.min_by("name", at).alias("name"), F.count("*").alias("n_articles"))
    order = Window.partitionBy("category", "low").orderBy(key, "label_no")
    shown = rows.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= most)
    shown = shown.groupBy("category", "low").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "note_title"))), lambda x: x["note_title"]).alias("articles"))
    out = found.join(shown, ["category", "low"])
    for name, concepts in (("questions", question_concepts), ("experiments", experiment_concepts)):
        asked = concepts.select("id", F.col("concept").alias("asked_name"), F.lower("concept").alias("low")).join(category, "low", "left").withColumn("category", F.coalesce("of_low", F.lit("concept")))
        asked = asked.groupBy("category", "low").agg(F.array_sort(F.collect_list("id")).alias(name), F.min("asked_name").alias("asked_name"))
        out = out.join(asked, ["category", "low"], "full").withColumn("name", F.coalesce("name", "asked_name")).drop("asked_name")
    empty = F.array().cast("array<string>")
    return out.select("category", "name", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), *[F.coalesce(c, empty).alias(c) for c in ("articles", "questions", "experiments")])


def category_folder(category) -> Column:
    """Folder of a category's notes, "Concepts" where it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in V.CATEGORY_FOLDERS.items() for x in pair])
    return F.coalesce(F.element_at(table, text_of(category)), F.lit("Concepts"))
