"""Notes and index of a network: empty tables, nulls, versions, relations of one article, blocks written twice."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import documents, research
from quillmesh.operators import network_notes as N

ARTICLE = "pos long, title string, abstract string, year string, journal string, doi string, authors array<string>, keywords array<string>, concepts array<string>"
ROWS = [
    (0, "Nickel and palladium", "nickel catalyst, palladium catalyst, alkyl radical and SH2", "2020", "J", "10.1/a", ["Ann Lee"], [], []),
    (1, "One work", "photoredox catalysis with a nickel catalyst", "2019", "ChemRxiv", "10.26434/chemrxiv-1", ["Bo Ray"], [], []),
    (2, "One work!", "photoredox catalysis with a nickel catalyst", "2021", "J", "10.1/c", ["Bo Ray"], [], []),
    (3, None, None, None, None, None, None, None, None),
    (4, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def analyses(spark):
    return research.analysis_records(spark.createDataFrame(ROWS, ARTICLE)).cache()


def test_versions_below_their_work(analyses):
    lines = [r.value for r in N.corpus_lines(analyses).orderBy("pos", "sub").collect()]
    assert len(lines) == 5
    assert "10.1/c" in lines[1] and lines[1].startswith("- [[Ray 2021") and lines[2].startswith("  - version pair: [[Ray 2019")
    assert all(x.startswith("- [[Unknown n.d. - ]]") for x in lines[3:])  # neither title nor DOI: each stands alone


def test_index(spark, analyses):
    q, e = N.default_questions(), N.default_experiments()
    rows = N.index_lines(analyses, research.relations(analyses), research.relation_members(analyses), q, e, "Net").orderBy("section", "pos", "sub").collect()
    text = "\n".join(r.value for r in rows)
    assert text.count("\n## ") == 7 and "## Corpus roles" in text and f"- [[{N.titled(q[0])}]]" in text
    high = [r.value for r in rows if r.section == 7 and r.pos > 0]
    assert "`version_pair`" in high[0] and "[[Ray 2019 - One work]] -> [[Ray 2021 - One work!]]" in high[0]
    # article 0 alone holds palladium, three hold nickel: its contrast leads from another article
    assert any("nickel catalyst vs palladium catalyst" in x and "-> [[Lee 2020" in x and not x.startswith("- [[Lee") for x in high)


def test_contrast_of_one_article_with_itself(spark):
    a = research.analysis_records(spark.createDataFrame(ROWS[:1], ARTICLE))
    assert research.relations(a).filter("type like 'contrast%'").count() == 1
    assert N.relation_highlights(research.relations(a), research.relation_members(a), a).count() == 0


def test_empty(spark):
    a = research.analysis_records(spark.createDataFrame([], ARTICLE))
    rows = N.index_lines(a, research.relations(a), research.relation_members(a), N.default_questions(), (), "Net").filter("pos >= 0").collect()
    assert {r.section for r in rows if r.value == N.NOTHING} == {1, 2, 3, 4, 6, 7}
    none = research.question_evidence(research.concept_table(spark, (("RQ1", ("a",)),)), a)
    notes = N.question_notes(N.question_records(spark, N.default_questions(), none), "Net").collect()
    assert len(notes) == 6 and all("## Evidence\n- None\n" in r.text for r in notes)


def test_blocks_twice(spark, analyses):
    paths = spark.createDataFrame([(0, "a.md"), (1, "b.md"), (2, "b.md"), (3, ""), (4, None), (9, "z.md")], "pos long, path string")
    made = N.article_notes(analyses, paths, N.default_questions(), ())
    assert {r.path for r in made.collect()} == {"a.md", "b.md"}
    notes = spark.createDataFrame([("a.md", "# a"), ("b.md", "# b"), ("z.md", "z")], "path string, text string")
    once = documents.preview(notes, made)
    twice = documents.preview(once, made)
    assert documents.changes(once, twice).count() == 0
    text = {r.path: r.text for r in once.collect()}
    assert text["z.md"] == "z" and "### Experiments\n- None" in text["a.md"] and "[[nickel catalyst]]" in text["b.md"]


def test_own_words(spark):
    q = (N.Question("Q1", 'Is "a" b?', "Because.", ()),)
    e = (N.Experiment("E1", "Q9", "try", "r", ("c",), (), (), (), "care"),)
    none = spark.createDataFrame([], "id string, number int, doi string, note_title string")
    note = N.question_notes(N.question_records(spark, q, none), "Net").first()
    assert 'title: "Q1 - Is \\"a\\" b?"' in note.text and "## Concepts\nnone\n" in note.text and '"' not in note.path and "?" not in note.path
    text = N.experiment_notes(N.experiment_records(spark, e, q, none), "Net").select(F.col("text")).first().text
    assert "- Question: [[Q9]]" in text and "## Readouts\n- None\n" in text and text.endswith("\ncare\n")
