"""The research network, profiles, reports and files against plain versions on small inputs."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import documents, enrich, incremental, network, research, vocabulary
from quillmesh.plans import profiles
from quillmesh.sources import records

ARTICLE = "pos long, doi string, title string, year string, journal string, abstract string, keywords array<string>, concepts array<string>, authors array<string>"
ARTICLES = [
    (1, "https://doi.org/10.1/A.", "SH2 steps at nickel", "2020", "J One", "x " * 60 + "Homolytic substitution beats reductive elimination; a radical clock and DFT agree. " + "y " * 90, ["Ni"], [], ["Ann Fam"]),
    (2, "10.26434/chemrxiv.2", "SH2 steps at  Nickel!", "2019", "ChemRxiv", "A palladium complex; Csp3 – Csp3 links. NHPI.", [], ["alkyl radical"], []),
    (3, "", "Review of S H 2", "", "", None, None, None, None),
    (4, "10.1/d", "Electrode meets nickel", "2021", "J", "The electrode keeps its oxidation state. Single-electron steps. Enantioselective.", ["EPR", "Stern-Volmer"], [], ["Bo von Lee"]),
]


def norm(t):
    t = str(t or "")
    for d in "−‐‑‒–—":
        t = t.replace(d, "-")
    for p, by in ((r"C\(sp\s*3\s*\)", "C(sp3)"), (r"C\s*sp\s*3", "C(sp3)"), (r"S\s*H\s*2", "SH2")):
        t = re.sub(p, by, t, flags=re.I)
    return " ".join(t.split())


def plain_tags(row, rules):
    fields = (("title", norm(row[2])), ("abstract", norm(row[5])), ("keywords", norm("; ".join(row[6] or []))), ("concepts", norm("; ".join(row[7] or []))))
    out = []
    for r in rules:
        found = next(((f, t, m) for f, t in fields for p in r.patterns if (m := re.search(p, t, re.I))), None)
        if found:
            f, t, m = found
            out.append((r.name, r.category, f, t[max(0, m.start() - 90) : m.end() + 140].strip()))
    return out


@pytest.fixture(scope="module")
def analyses(spark):
    return research.analysis_records(spark.createDataFrame(ARTICLES, ARTICLE)).cache()


def test_terms_and_excerpts(analyses):
    got = {r.pos: r for r in analyses.collect()}
    for row in ARTICLES:
        for column, rules in (("terms", vocabulary.TERM_RULES), ("evidence_methods", vocabulary.EVIDENCE_RULES)):
            assert [(t["name"], t["category"], t["source_field"], t["excerpt"]) for t in got[row[0]][column]] == plain_tags(row, rules)
    assert len(got[1].terms) >= 4 and {t["name"] for t in got[1].evidence_methods} == {"DFT", "radical clock"}
    assert list(got[1].terms_by_category["mechanism"]) == [t["name"] for t in got[1].terms if t["category"] == "mechanism"]


def test_analysis_fields(analyses):
    got = {r.pos: r for r in analyses.collect()}
    assert [got[i].corpus_role for i in (1, 2, 3, 4)] == ["background_context", "preprint_version", "review_context", "core_asymmetric_ni_relevance"]
    assert got[1].note_title == "Fam 2020 - SH2 steps at nickel" and got[3].note_title == "Unknown n.d. - Review of SH2" and got[4].note_title.startswith("Lee 2021")
    assert got[1].doi == "10.1/a" and got[1].version_group_key == got[2].version_group_key == "sh2stepsatnickel"
    assert [p["name"] for p in got[2].project_relevance_terms][-1] == "NHPI ester SET axis" and got[4].project_relevance_terms[0]["source_field"] == "project_relevance"
    assert "electrode-catalyst decoupling" not in [p["name"] for p in got[4].project_relevance_terms]  # it is a term there
    assert len(got[3].limitations) == 3 and got[4].limitations == []
    assert got[3].mechanistic_summary.startswith("Local capture directly flags SH2") and got[3].relevance_to_project.startswith("mechanistic")


def test_relations_give_every_pair(analyses):
    """Class relations joined with the members are the pairs of articles that a plain comparison finds."""
    rows = sorted(analyses.collect(), key=lambda r: r.pos)
    names = {r.pos: {t["name"] for t in r.terms} for r in rows}
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a.version_group_key and a.version_group_key == b.version_group_key:
                want.add((a.pos, b.pos, "version_pair", ""))
            both = sorted(names[a.pos] & names[b.pos])
            if len(both) >= 2:
                want.add((a.pos, b.pos, "shared_mechanistic_or_method_terms", "|".join(both)))
            for x, y in vocabulary.CONTRASTS:
                for p, q in ((a.pos, b.pos), (b.pos, a.pos)):
                    if x in names[p] and y in names[q]:
                        want.add((p, q, "contrast_for_hypothesis_testing", f"{x} vs {y}"))
    members = {}
    for m in research.relation_members(analyses).collect():
        members.setdefault((m.kind, m["class"]), []).append(m.pos)
    got = set()
    for r in research.relations(analyses).collect():
        a, b = members[r.kind, r.class_a], members[r.kind, r.class_b]
        assert (r.n_a, r.n_b) == (len(a), len(b))
        for p in a:
            for q in b:
                if p != q and (r.contrast or p < q or r.class_a != r.class_b):
                    pair = (p, q) if r.contrast else (min(p, q), max(p, q))
                    got.add((*pair, r.type, r.contrast or "|".join(r.shared_terms)))
    assert got == want and len(want) >= 4


def test_analyses_are_computed_once(spark, analyses):
    """Relations and nodes read each analysis once, and excerpts are left out on demand."""
    asked = research.concept_table(spark, vocabulary.QUESTIONS)
    for column, make in (("version_group_key", research.relations), ("note_title", lambda a: research.nodes(a, asked, asked))):
        seen = spark.sparkContext.accumulator(0)

        def counted(x, seen=seen):
            seen.add(1)
            return x

        found = make(analyses.withColumn(column, F.udf(counted, "string")(column))).collect()
        assert sorted(map(str, found)) == sorted(map(str, make(analyses).collect())) and seen.value == analyses.count()


def test_tags_without_excerpts(spark):
    texts = spark.createDataFrame([("Nickel and DFT",), ("none",)], "t string")
    rows = texts.select(*(network.tagged({"title": F.col("t")}, vocabulary.TERM_RULES, excerpts=e).alias(n) for n, e in (("long", True), ("short", False)))).collect()
    for r in rows:
        assert [x[:-1] for x in r.long] == [x[:-1] for x in r.short] and all(x.excerpt is None for x in r.short)
    assert len(rows[0].short) == 1


def test_questions_experiments_nodes(spark, analyses):
    asked = research.concept_table(spark, vocabulary.QUESTIONS)
    rows = sorted(analyses.collect(), key=lambda r: r.pos)
    labels = {r.pos: {t["name"].lower() for c in ("terms", "project_relevance_terms", "evidence_methods") for t in r[c]} for r in rows}
    got = {}
    for r in research.question_evidence(asked, analyses, 6).collect():
        got.setdefault(r.id, {})[r.number] = r.doi
    for qid, concepts in vocabulary.QUESTIONS:
        want = list(dict.fromkeys(r.doi for c in concepts for r in rows if c.lower() in labels[r.pos] and r.doi))
        assert [got.get(qid, {}).get(i + 1) for i in range(len(want[:6]))] == want[:6]
    experiments = spark.createDataFrame([e[:2] for e in vocabulary.EXPERIMENTS], "id string, question string")
    shown = research.experiment_evidence(experiments, research.question_evidence(asked, analyses), 1).collect()
    assert {(r.id, r.doi) for r in shown} == {(e, got[q][1]) for e, q, _ in vocabulary.EXPERIMENTS if q in got}
    nodes = {(n.category, n.name): n for n in research.nodes(analyses, asked, research.concept_table(spark, vocabulary.EXPERIMENTS)).collect()}
    assert nodes["mechanism", "SH2 mechanism"].questions == ["RQ2"] and nodes["mechanism", "SH2 mechanism"].experiments == ["EX1", "EX6"]
    assert nodes["concept", "radical clock"].n_articles == 1 and nodes["concept", "stoichiometric intermediate"].n_articles == 0


def test_rules_of_a_table(spark):
    table = spark.createDataFrame([(1, "b", "x", ["bb+"]), (0, "a", "x", ["a{3}"]), (2, "A", "y", ["q"])], "rule_no int, name string, category string, patterns array<string>")
    df = spark.createDataFrame([(1, "abb aaa q")], "pos long, title string")
    assert [(r.name, r.excerpt) for r in network.tag_terms(df, vocabulary.rules_from(table), ("title",)).collect()] == [("a", "abb aaa q"), ("b", "abb aaa q")]


PROFILE = """# a profile
profile_name: campus
network:
  mode: system
  proxy: ~
retrieval:
  metadata_sources:
    - crossref
    - 'openalex'
  publisher_access:
    acme:
      enabled: true
      mode: browser_assisted
      minimum_interval_seconds: 12
  stop_on:
    - captcha
downloads:
  directory: pdfs
  overwrite: false
"""


def test_profiles(spark, tmp_path):
    (tmp_path / "campus.yml").write_text(PROFILE)
    p = profiles.read_profile(spark, str(tmp_path / "campus.yml"))
    assert p["network"] == {"mode": "system", "proxy": None} and p["retrieval"]["metadata_sources"] == ["crossref", "openalex"] and p["retrieval"]["publisher_access"]["acme"]["minimum_interval_seconds"] == 12
    check = lambda d: profiles.profile_faults(d, ("crossref", "openalex"), (), ("captcha",), ("read_cookies",))
    assert check(p) == [] and profiles.parse_profile("") == {}
    bad = profiles.parse_profile(PROFILE.replace("system", "vpn").replace("12", "3").replace("captcha", "x").replace("pdfs", "../up").replace("overwrite: false", "overwrite: true") + "security:\n  read_cookies: true\n")
    assert len(check(bad)) == 6
    for text in ("- a\n", "a: 1\n  b: 2\n", "a b\n"):
        with pytest.raises(ValueError):
            profiles.parse_profile(text)
    assert profiles.year_from(2001) == 2001 and profiles.year_from(0, True, 5, 2026) == 0 and profiles.year_from(0, False, 5, 2026) == 2022 and profiles.year_from() == 0
    assert profiles.sources_for("physics") == ("arxiv", "openalex", "crossref") and profiles.sources_for("none") == ("openalex", "crossref", "pubmed") and profiles.sources_for("cs", " ArXiv, x ") == ("arxiv", "x")


def test_runtime_files(spark, tmp_path):
    second = tmp_path / "b.json"
    second.write_text('[{"doi": "1"}]')
    assert [r.doi for r in profiles.first_readable(spark, "doi string", str(tmp_path / "a.json"), str(second)).collect()] == ["1"]
    assert profiles.first_readable(spark, "doi string", str(tmp_path / "a.json")).count() == 0
    lines = spark.createDataFrame([(1, "x"), (2, "  Output:  /run/1  "), (3, "Output: /run/2")], "number int, value string")
    assert [r.path for r in profiles.output_path(lines).collect()] == ["/run/1"] and profiles.output_path(lines.filter("number = 1")).count() == 0
    pages = profiles.paged(spark.range(25).withColumnRenamed("id", "pos"), 10, 22)
    assert sorted((r.page, r.pos) for r in pages.collect()) == [(i // 10, i) for i in range(22)]


def test_search_payloads(spark):
    work = "w struct<title:array<string>,published:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string>>,`container-title`:array<string>,DOI:string,`is-referenced-by-count`:int,type:string,abstract:string>"
    w = lambda t, y, kind="journal-article", a="x": ((t, ([[y]],), [("Ann", "Lee"), (None, "Bo")], None, "10.1/x", None, kind, a),)
    got = records.crossref_hits(spark.createDataFrame([w(["T"], 2020), w([""], 2020), w(None, 2020), w(["Old"], 1990), w(["B"], 2020, "book"), w(["N"], 2020, a="")], work), year_from=2000).collect()
    assert [(r.title, r.authors, r.year, r.venue) for r in got] == [("T", "Lee, A; Bo, ", 2020, "N/A")]
    ids = spark.createDataFrame([(0, "7"), (1, "8"), (2, "9")], "pos long, id string")
    details = spark.createDataFrame([("8", ("B", "2021 Mar", [("X Y",)], "J", "doi: 10.1/b")), ("7", ("A", "", None, None, None))], "id string, d struct<title:string,pubdate:string,authors:array<struct<name:string>>,source:string,elocationid:string>")
    assert [(r.title, r.year, r.venue, r.doi) for r in records.pubmed_hits(ids, details).orderBy("pos").collect()] == [("A", 0, "N/A", ""), ("B", 2021, "J", "10.1/b")]
    r = spark.createDataFrame([(("标题", ["甲", "乙"], "2020", "刊", "10.2/z", "id1"),), (("无", None, None, None, None, "id2"),)], "r struct<Title:string,Author:array<string>,Year:string,PeriodicalName:string,Doi:string,ObjectId:string>")
    assert [(x.authors, x.year, x.oa_url) for x in records.journal_hits(r).collect()] == [("甲; 乙", 2020, "https://doi.org/10.2/z"), (None, 0, "https://d.wanfangdata.com.cn/periodical/id2")]
    feed = spark.createDataFrame([("<entry><title>A\n b</title><summary>" + "s " * 300 + "</summary></entry>",)], "xml string")
    assert [(x.title, len(x.summary)) for x in records.arxiv_summaries(feed).collect()] == [("A b", 200)]


def test_ranks(spark):
    ranks = spark.createDataFrame([("J One", "JCR", "Q1", 2.0, "1234-5678")], "name string, tier string, level string, impact_factor double, issn string")
    aliases = spark.createDataFrame([("J1", "J One")], "alias string, name string")
    asked = spark.createDataFrame([("journal", "j1"), ("issn", "1234-5678"), ("issn", "0"), ("journal", "x")], "kind string, value string")
    got = {(r.kind, r.value): (r.rank_name, r.rank_source) for r in enrich.rank_rows(asked, ranks, aliases).collect()}
    assert got == {("journal", "j1"): ("J One", "offline"), ("issn", "1234-5678"): ("J One", "offline"), ("issn", "0"): (None, "not_found"), ("journal", "x"): (None, "not_found")}
    cache = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "key string, value string, fetched_at int")
    assert {(r.key, r.value) for r in enrich.stored_entries(cache, spark.createDataFrame([("a", "2", 2)], cache.schema)).collect()} == {("a", "2"), ("b", "1")}
    left = spark.createDataFrame([("10.1/a", ""), ("10.1/b", "z")], "doi string, url string")
    over = enrich.overlay(left, spark.createDataFrame([("10.1/A", "u")], "doi string, url string"), "doi", ["url"], True)
    assert enrich.changed_rows(over).first().asDict() == {"rows": 2, "changed": 1}


def test_rank_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"journals": {"j one": {"tier": "JCR", "level": "Q1", "if": 2}}, "_aliases": {"j1": "j one"}}')
    ranks, aliases = records.read_ranks(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in ranks.collect()] == [("j one", "JCR", "Q1", 2.0)] and [tuple(r) for r in aliases.collect()] == [("j1", "j one")]
    looked = enrich.rank_lookup(spark.createDataFrame([("J1",)], "j string"), "j", ranks, aliases).select(enrich.rank_label().alias("t"))
    assert looked.first().t == "[JCR-Q1] IF=2.0"
    assert [d.count() for d in records.read_ranks(spark, str(tmp_path / "none.json"))] == [0, 0]


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x int").repartition(5)
    assert sorted((r.x, r.number) for r in incremental.numbered(df, "x", parts=7).collect()) == [(i, i + 1) for i in range(1000)]


def test_preview_and_apply(spark, tmp_path):
    folder, backup = tmp_path / "vault", tmp_path / "backup"
    notes = spark.createDataFrame([("a.md", "hello\n<!-- managed:begin -->old<!-- managed:end -->\nrest"), ("b.md", "kept")], "path string, text string")
    made = spark.createDataFrame([("a.md", "F", "new $1 \\x"), ("Concepts/c.md", "front\n", "block")], "path string, front string, block string")
    after = documents.preview(notes, made)
    text = {r.path: r.text for r in after.collect()}
    assert text["a.md"] == "hello\n<!-- managed:begin -->\nnew $1 \\x\n<!-- managed:end -->\nrest" and text["b.md"] == "kept" and text["Concepts/c.md"].startswith("front\n\n<!-- managed:begin -->\nblock")
    assert {(r.path, r.text) for r in documents.preview(after, made).collect()} == set(text.items())
    documents.write_files(notes, str(folder)).count()
    done = {r.path: r.change for r in documents.apply_notes(notes, after, str(folder), str(backup)).collect()}
    assert done == {"a.md": "changed", "Concepts/c.md": "added"}
    assert (folder / "Concepts/c.md").read_text() == text["Concepts/c.md"] and (folder / "a.md").read_text() == text["a.md"] and os.listdir(backup) == ["a.md"] and "old" in (backup / "a.md").read_text()
    with pytest.raises(Exception, match="outside"):
        documents.write_files(spark.createDataFrame([("../x", "")], "path string, text string"), str(folder)).count()


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "queue.json")
    read = lambda p: sorted(r.x for r in spark.read.schema("x int").json(p).collect())
    assert documents.replace_table(spark.createDataFrame([(1,)], "x int"), path) == ""
    old = documents.replace_table(spark.read.schema("x int").json(path).union(spark.createDataFrame([(2,)], "x int")), path)
    assert read(path) == [1, 2] and read(old) == [1]


def test_written_forms(spark, tmp_path):
    none = F.array().cast("array<string>")
    articles = spark.createDataFrame([(1, 'A "q", b', ["X Y"], "10.1/a", "2020", "J", "abs", 0.9, "downloaded"), (2, "", ["Z"], "", "", "", "", 0.2, "skipped_non_pdf")], "number long, title string, authors array<string>, doi string, year string, journal string, abstract string, confidence double, pdf_status string")
    articles = articles.withColumns({**{c: F.lit("") for c in ("volume", "issue", "pages", "url", "source_page", "abstract_source", "pdf_source", "pdf_error")}, **{c: none for c in ("keywords", "concepts", "notes", "metadata_warnings", "keywords_source", "concepts_source")}})
    documents.write_capture(articles, str(tmp_path / "run"), {"Input source": "test"})
    assert sorted(os.listdir(tmp_path / "run")) == ["articles.csv", "articles.json", "articles.md", "dois.txt", "failed.txt", "import_guide.md", "local_index.md", "pdf_manifest", "references.bib", "references.ris", "run_report.md"]
    text = lambda p: "".join((tmp_path / "run" / p / f).read_text("utf-8") for f in sorted(os.listdir(tmp_path / "run" / p)) if f.startswith("part"))
    assert text("articles.csv").startswith("﻿title,authors,year,") and text("run_report.md").startswith("# Run Report\n\n- Input source: test\n") and text("run_report.md").rstrip().endswith("- (untitled): low confidence")
    assert "- Abstract coverage: 1/2" in text("run_report.md") and '- PDF status counts: {"downloaded": 1, "skipped_non_pdf": 1}' in text("run_report.md")
    item = json.loads(articles.select(F.to_json(documents.library_item(articles)).alias("j")).orderBy("j").collect()[-1].j)
    assert item["creators"] == [{"firstName": "X", "lastName": "Y"}] and item["DOI"] == "10.1/a" and item["url"] == "https://doi.org/10.1/a" and "abstractNote" in item
    hits = spark.createDataFrame([(1, "T", "10.1/a", 2020, "J", "s", 3, 1.0, "")], "number long, title string, doi string, year int, venue string, source string, citations int, score double, oa_url string").withColumns({"priority_hits": none, "reasons": none})
    documents.write_discovery(hits, hits, {"query": "q"}, str(tmp_path / "found"))
    assert sorted(os.listdir(tmp_path / "found")) == ["candidates.json", "candidates.md", "selected.json", "selected_identifiers.txt", "settings.json"]
    documents.write_network({"nodes": hits.select("title")}, str(tmp_path / "net"), {"Created": "now"})
    assert sorted(os.listdir(tmp_path / "net")) == ["nodes.json", "run_report.md"]
    assert json.loads(documents.search_json(hits).first().value)["title"] == "T"


def test_note_of_a_node(spark, analyses):
    nodes = research.nodes(analyses, research.concept_table(spark, vocabulary.QUESTIONS), research.concept_table(spark, vocabulary.EXPERIMENTS))
    notes = {r.path: r for r in documents.node_notes(nodes, "Net").collect()}
    note = notes["Mechanisms/SH2 mechanism.md"]
    assert note.front == '---\ntitle: "SH2 mechanism"\ntype: "knowledge_mechanism"\ntags:\n  - knowledge-node\n---\n\n# SH2 mechanism\n' and "- [[RQ2]]" in note.block and "- Network: [[Net]]" in note.block
    assert "Methods/C(sp3)-C(sp3) cross-coupling.md" in notes


def test_text_functions(spark):
    df = spark.createDataFrame([("run\\a\\b.pdf", "/x/run"), ("/x/run/a", "/x/run/"), ("y", "x")], "p string, b string")
    assert [r.r for r in df.select(T.relative_path("p", "b").alias("r")).collect()] == ["run/a/b.pdf", "a", "y"]
    row = spark.range(1).select(T.stamp_text(F.timestamp_seconds(F.lit(86400))).alias("s"), T.utc_text(F.timestamp_seconds(F.lit(86400))).alias("u"), T.plain_tier(F.lit("1区 新锐 Top 高风险")).alias("t"), T.note_filename(F.lit('..a<b>:"c"/..')).alias("n"), T.first_authors(F.array(*map(F.lit, "abcd"))).alias("a")).first()
    assert (row.s, row.u, row.t, row.n, row.a) == ("19700102_000000", "1970-01-02T00:00:00Z", "Q1 XR-Top HighRisk", "a b c.md", "a; b; c")
