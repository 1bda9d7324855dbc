"""Operators on small inputs: identifiers, extraction, merging, planning, queues, sinks, streams."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmesh import catalog
from quillmesh.functions import arrow as A
from quillmesh.functions import text as T
from quillmesh.operators import enrich, extract, incremental, network, reports, resolve, search, sinks, tasks
from quillmesh.plans import runs
from quillmesh.sources import records, schemas
from quillmesh.streaming import incremental as stream

PAGE = """<html><head><title>T</title><meta name="citation_title" content="My A &amp; B"><meta name="citation_author" content="Ann Lee">
<meta name="citation_doi" content="10.1234/ABC.5"><meta name="citation_pdf_url" content="https://x.org/a.pdf"><meta name="citation_date" content="2021/03">
<meta name="keywords" content="a; b, c"><link rel="alternate" href="/files/a.pdf"><link href="/style.css"><script type="application/ld+json">
{"@graph":[{"@type":"ScholarlyArticle","headline":"JL","author":[{"givenName":"Q","familyName":"R"}],"identifier":{"value":"doi:10.9999/q"},"encoding":{"contentUrl":"https://y.org/z.pdf"}}]}
</script><script type="application/ld+json">not json</script></head><body>See 10.5555/zz. PMID: 1234567 arXiv:2101.00001v2</body></html>"""


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column("x").alias("y")).first().y


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, ""), ("", ""), ("https://doi.org/10.1000/AbC(1)).", "10.1000/abc(1)"), ("http://dx.doi.org/10.1/X", "10.1/x"), ("DOI:  10.1/x%2Fy;", "10.1/x/y"), ("10.2/a&amp;b", "10.2/a&b"),
        ('"<10.3/c>"', "10.3/c"), ("10.4/d+e", "10.4/d+e"), ("10.5/%zz", "10.5/%zz"), ("10.6/(a)b(c))),", "10.6/(a)b(c)"), ("10.7/x]}", "10.7/x"),
    ],
)
def test_normalize_doi(spark, raw, want):
    assert one(spark, T.normalize_doi, raw) == want


def test_doi_variants(spark):
    raw = "https://doi.org/10.1000/AbC(1)."
    assert one(spark, T.normalize_doi_anchored, raw) == raw.lower()
    assert one(spark, T.normalize_doi_unanchored, raw) == "10.1000/abc(1)."
    assert one(spark, T.normalize_doi_casekeep, raw + "）。") == "10.1000/AbC(1"
    assert one(spark, T.normalize_doi_strict, raw) == "10.1000/abc(1"


def test_text_functions(spark):
    assert one(spark, T.clean_text, "<p>H<sub>2</sub>O &amp; <script>x()</script>ice </p>") == "H2O & ice"
    assert one(spark, T.clean_abstract, "<jats:sup>1</jats:sup> C ( sp 3 ) S H 2") == "1 C(sp3) SH2"
    assert one(spark, T.match_key, "C(sp3)–C(sp3) <i>Bond</i>") == "c sp3 c sp3 bond"
    assert one(spark, T.split_terms, "a; b|a,  c") == ["a", "b", "c"]
    assert one(spark, T.extract_dois, "see 10.1234/a, (10.1234/B) and 10.1234/a.") == ["10.1234/a", "10.1234/b"]
    assert one(spark, T.wikilink_targets, "[[a|b]] [[dir/c.md#x]] [[ ]]") == ["a", "c"]
    assert one(spark, T.creator, "Lee, Ann B.").asDict() == {"firstName": "Ann B.", "lastName": "Lee"}
    assert one(spark, T.creator, "Ann B. Lee").asDict() == {"firstName": "Ann B.", "lastName": "Lee"}
    assert one(spark, T.creator, "Lee").asDict() == {"firstName": "", "lastName": "Lee"}
    assert one(spark, T.safe_filename, "a/b: c?") == "a_b_c"
    assert one(spark, lambda c: T.journal_key(c), "The Hydrogels") == "hydrogels"
    assert one(spark, lambda c: T.journal_key(c, True), "Hydrogels") == "ydrogels"
    assert one(spark, A.html_unescape, "&eacute;&#x41;") == "éA"
    assert one(spark, A.casefold, "Straße") == "strasse"


def test_decode_page():
    text = "<html><head><meta charset='gb18030'></head>中文</html>"
    for name in ("utf-8", "gb18030", "utf-8-sig", "utf-16"):
        assert "中文" in A.decode_page(text.encode(name))
    assert A.decode_page(None) is None and A.decode_page(b"") == ""


def test_decoding_compares_four_parts():
    head = "<html>"
    assert A.decode_quality(head + "x\ufffdÂ", "utf-8", []) == (120, 1, 1, 0)
    assert A.decode_quality("x", "cp1252", ["utf-8"]) == (6, 0, 0, 1) and A.decode_quality("", "utf-8", ["utf-8"]) == (5, 0, 0, 0)
    assert A.best_decoding("\ufeff<html>é".encode("utf-16-le"))[:2] == ((0, 0, 0, 0), "utf-16-le")
    assert A.best_decoding(b"<meta charset=cp1252>caf\xe9")[1:] == ("cp1252", "<meta charset=cp1252>café")
    assert A.best_decoding("<html>caf\u00e9 – x".encode())[1] == "utf-8"
    # equal costs: fewer replaced characters decide, then the order
    assert A.encoding_candidates(b"<?xml encoding='latin-1'?><meta charset=nosuch>") == ["iso8859-1", "utf-8", "utf-8-sig", "gb18030", "cp1252"]


def test_character_references_equal_the_standard(spark):
    import html
    from html.entities import html5

    r = random.Random(3)
    names = sorted(html5)
    bits = ["&", ";", "#", "x", "X", "0", "41", "128", "159", "129", "13", "0", "55296", "1114112", "99999999999", "xD", "x1F600", "x110000", "11", "65534", "x2FFFF", "64976", " ", "<", "a", "é", "&amp;lt;", "&notin", "&notit;", "&ampx", "&#", "&#x;", "&#;", "\t"]
    texts = ["&" + n for n in names] + ["&" + n.rstrip(";") + "z" for n in names[::7]] + ["".join(r.choice(bits + ["&" + r.choice(names)]) for _ in range(r.randrange(1, 12))) for _ in range(1500)] + [f"&#{i};" for i in range(0, 260)] + ["", "no reference"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.unescape_all("t").alias("u")).collect()
    wrong = [(x.t, x.u, html.unescape(x.t)) for x in rows if x.u != html.unescape(x.t)]
    assert not wrong, wrong[:5]
    assert spark.createDataFrame([(None,)], "t string").select(T.unescape_all("t").alias("u")).first().u == ""


def test_page_extraction(spark):
    pages = spark.createDataFrame([(1, "https://a.org/p", PAGE), (2, "u", "plain first line\nmore"), (3, None, None)], "page_id long, url string, content string")
    got = {(r.page_id, r.metadata_source, r.doi): r for r in extract.initial_candidates(pages).collect()}
    meta = got[1, "html-meta", "10.1234/abc.5"]
    assert (meta.title, meta.authors, meta.year, meta.keywords, meta.confidence) == ("My A & B", ["Ann Lee"], "2021", ["a", "b", "c"], 0.88)
    ld = got[1, "json-ld", "10.9999/q"]
    assert (ld.title, ld.authors, ld.pdf_url, ld.confidence) == ("JL", ["Q R"], "https://y.org/z.pdf", 0.82)
    assert got[1, "pubmed-page", ""].pmid == "1234567" and got[1, "arxiv-page", ""].arxiv_id == "2101.00001"
    assert (1, "doi-regex", "10.5555/zz") in got and got[2, "plain-text", ""].title == "plain first line"
    links = pages.limit(1).select(extract.pdf_links(extract.page_parts(F.col("content")), F.col("url")).alias("l")).first().l
    assert [x.url for x in links] == ["https://a.org/files/a.pdf"]
    assert runs.capture(pages).filter("doi = '10.1234/abc.5'").count() == 1


def test_arxiv_numbers_are_read_whole(spark):
    rows = [("https://arxiv.org/abs/2101.100003v2", "", "2101.100003"), ("", "see arXiv:2101.1234567, and", "2101.1234567"), ("", "arXiv: 0704.0001v3", "0704.0001"), ("", "arXiv:2101.123", ""), ("", "arXiv:hep-th/9901001v1", "hep-th/9901001")]
    got = spark.createDataFrame(rows, "url string, text string, want string").select("want", T.arxiv_base(T.arxiv_id("url", "text")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("before", ["", "<html>\n<!-- a\nb -->\n<p>é & < b", "a & b\n\n"])
@pytest.mark.parametrize("title", [" a&amp;&amp", "&quot;b&quot \n &lt c", "", "x < y &amp;amp;"])
def test_first_title_as_it_stands(before, title):
    page = f"{before}<TITLE >{title}</Title>\n<title>other</title>{'z' * 50}&am"
    assert extract.parse_page(page)["title_source"] == title
    assert extract.parse_page(f"{before}<title>{title}")["title_source"] == ""


def test_parsed_titles_keep_references_that_are_cut_off(spark, tmp_path):
    """Pages whose title ends inside a reference, against the query's SQL."""
    titles = ["The&amp;&amp;&amp", "a &amp; b", "token = &quot;e1", " &lt;b&gt; ", ""]
    made = [(i, "u", f"<html><head><title>{t}</title></head><body>x</body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["page_parts_parsed"](spark, str(tmp_path)).orderBy("page_id").collect()
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in got] == duck.execute(f"select * from ({catalog.SQL['page_parts_parsed']}) order by page_id").fetchall()


def fold(rows):
    """Reference fold of a group: the newer record is the base unless its confidence is higher."""
    acc = None
    for r in sorted(rows, key=lambda r: r["pos"]):
        if acc is None:
            acc = dict(r)
            continue
        base, extra = (acc, r) if r["confidence"] > acc["confidence"] else (r, acc)
        out = dict(base)
        for k in ("title", "journal"):
            out[k] = base[k] or extra[k]
        out["citation_count"] = extra["citation_count"] if extra["citation_count"] is not None else base["citation_count"]
        out["authors"] = extra["authors"] if len(extra["authors"]) > len(base["authors"]) else base["authors"]
        out["keywords"] = list(dict.fromkeys(base["keywords"] + extra["keywords"]))
        out["confidence"], out["pos"] = max(r["confidence"], acc["confidence"]), acc["pos"]
        acc = out
    return acc


def test_merge_equals_fold(spark):
    r, rows = random.Random(2), []
    for pos in range(400):
        rows.append({"pos": pos, "doi": f"10.1000/g{r.randrange(90)}", "title": r.choice(["", "a", "b", "c"]), "journal": r.choice(["", "x", "y"]), "citation_count": r.choice([None, 0, 5, 9]), "confidence": r.choice([0.3, 0.55, 0.75]), "authors": ["p", "q", "r"][: r.randrange(4)], "keywords": r.sample(["k", "l", "m"], r.randrange(3))})
    df = spark.createDataFrame(rows, "pos long, doi string, title string, journal string, citation_count long, confidence double, authors array<string>, keywords array<string>")
    got = {x.doi: x.asDict() for x in resolve.dedupe_articles(df).collect()}
    groups = {}
    for x in rows:
        groups.setdefault(x["doi"], []).append(x)
    assert len(got) == len(groups)
    for doi, group in groups.items():
        want = fold(group)
        for k in ("pos", "title", "journal", "citation_count", "confidence", "keywords"):
            assert got[doi][k] == want[k], (k, group)
        assert len(got[doi]["authors"]) == len(want["authors"]) and got[doi]["n_merged"] == len(group)


def test_snapshot_mappings(spark):
    def works(j, ddl):
        return records.parsed(spark.createDataFrame([(json.dumps(j),)], "j string"), "j", ddl).drop("j")

    oa = records.openalex_articles(works({"id": "W1", "doi": "https://doi.org/10.1000/A", "title": "T", "publication_year": 2020, "cited_by_count": 3, "abstract_inverted_index": {"b": [1], "a": [0, 2], "late": [1], "bad": "x"}, "concepts": [{"display_name": "C1"}], "topics": [{"display_name": "c1"}], "authorships": [{"author": {"display_name": "Ann"}}], "open_access": {"oa_url": "http://x/y.pdf"}, "biblio": {"first_page": "1", "last_page": "9"}}, schemas.OPENALEX_WORK)).first()
    assert (oa.doi, oa.concepts, oa.pdf_url, oa.pages, oa.confidence, oa.citation_count) == ("10.1000/a", ["C1"], "http://x/y.pdf", "1-9", 0.9, 3)
    assert oa.abstract.split(" ")[0] == "a" and len(oa.abstract.split(" ")) == 3
    cr = records.crossref_articles(works({"title": ["T"], "author": [{"given": "Ann", "family": "Lee"}], "published-online": {"date-parts": [[2019, 1]]}, "published": {"date-parts": [[2018]]}, "DOI": "10.1/B", "is-referenced-by-count": 7}, schemas.CROSSREF_WORK)).first()
    assert (cr.year, cr.authors, cr.confidence, cr.citation_count) == ("2019", ["Ann Lee"], 0.95, 7)
    feed = "<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>Two\n lines</title><author><name>A B</name></author><published>2021-01-01</published><summary>S</summary></entry></feed>"
    x = spark.createDataFrame([(feed,)], "xml string")
    assert records.arxiv_articles(x).first().arxiv_id == "2101.00001" and records.arxiv_hits(x).first().title == "Two lines"
    xml = "<P><PMID>12345</PMID><ArticleTitle>Q</ArticleTitle><Author><ForeName>A</ForeName><LastName>B</LastName></Author><PubDate><MedlineDate>2001 Jan</MedlineDate></PubDate><ArticleId IdType='doi'>10.1/Z</ArticleId></P>"
    pm = records.pubmed_articles(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (pm.pmid, pm.authors, pm.year, pm.doi) == ("12345", ["A B"], "2001", "10.1/z")
    up = works({"oa_status": "gold", "best_oa_location": {"url_for_pdf": "u1"}, "oa_locations": [{"url_for_pdf": "u1"}, {"url_for_pdf": ""}, {"url_for_pdf": "u2"}]}, schemas.UNPAYWALL)
    assert [c.url for c in up.select(resolve.dedupe_by_url(records.unpaywall_candidates(F.col("w"))).alias("c")).first().c] == ["u1", "u2"]
    ep = works({"resultList": {"result": [{"isOpenAccess": "N", "pmcid": "P1"}, {"isOpenAccess": "Y", "pmcid": "P2"}]}}, schemas.EUROPEPMC)
    assert [c.source for c in ep.select(records.europepmc_candidates(F.col("w")).alias("c")).first().c] == ["europepmc"]


def test_enrichment_by_title_and_links(spark):
    art = records.canonicalize(spark.createDataFrame([(0, "A Title", "", 0.3), (1, "Other", "10.1/x", 0.9)], "pos long, title string, doi string, confidence double"))
    source = records.canonicalize(spark.createDataFrame([("a title", "10.9/t", 0.72, "crossref")], "title string, doi string, confidence double, metadata_source string"))
    got = {r.pos: r for r in enrich.enrich(art, by_title=[source]).collect()}
    assert got[0].doi == "10.9/t" and got[0].confidence == 0.72 and got[1].doi == "10.1/x"
    tried = spark.createDataFrame([(1, 0, "u0", "a", "failed"), (1, 1, "u1", "b", "downloaded"), (2, 0, "v0", "a", "failed"), (2, 1, "v1", "b", "failed")], "k long, attempt int, url string, source string, status string")
    assert {r.k: r.url for r in enrich.best_attempt(tried, "k").collect()} == {1: "u1", 2: "v1"}
    cache = spark.sql("select 'a' as key, '1' as value, timestamp'2024-01-01' as fetched_at union all select 'a', '2', timestamp'2024-01-20' union all select 'b', '3', timestamp'2023-01-01'")
    assert [(r.key, r.value) for r in enrich.fresh_entries(cache, F.lit("2024-01-25").cast("timestamp")).collect()] == [("a", "2")]


def test_rules_and_labels(spark):
    df = spark.createDataFrame([(1, "about cats", "dogs and cats"), (2, "nothing", "")], "pos long, title string, abstract string")
    rules = (network.Rule("cat", "animal", ("cats?",)), network.Rule("dog", "animal", ("dogs?",)))
    terms = network.tag_terms(df, rules, ("title", "abstract"))
    assert sorted((r.pos, r.name, r.source_field) for r in terms.collect()) == [(1, "cat", "title"), (1, "dog", "abstract")]
    assert network.categories_map(terms).first().terms_by_category == {"animal": ["cat", "dog"]}
    extra = df.select(network.derived_terms(F.array(F.lit("cat"), F.lit("dog")), [("pets", ("cat",), ("dog", "fish")), ("cat", (), ())]).alias("d")).first().d
    assert extra == ["pets"]
    assert df.select(network.tag_names("title", rules).alias("t")).first().t == ["cat"]


def test_blocks_and_snapshots(spark):
    df = spark.createDataFrame([("intro", "new"), ("a <!-- managed:begin -->old<!-- managed:end --> z", "new")], "t string, b string")
    once = df.withColumn("t", incremental.replace_block("t", "b"))
    twice = once.withColumn("t", incremental.replace_block("t", "b"))
    assert once.collect() == twice.collect() and once.collect()[1].t.startswith("a <!--") and once.collect()[1].t.endswith("--> z")
    before = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    after = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, sha256 string")
    assert {r.path: r.change for r in incremental.diff_snapshots(before, after).collect()} == {"a": "removed", "b": "changed", "c": "added"}


def test_queue_merge(spark):
    ddl = "state string, type string, doi string, zoteroKey string, status string, title string, pos long"
    old = spark.createDataFrame([("pending", "pdf", "10.1/A", "", "", "t", 1), ("processed", "pdf", "10.1/b", "", "done", "t", 2), ("pending", "nope", "10.1/z", "", "", "t", 3), ("pending", "si", "", "", "", "t", 4)], ddl)
    new = spark.createDataFrame([("", "PDF", "doi:10.1/a", "", "", "better", 10), ("", "pdf", "10.1/B", "", "", "x", 11), ("", "pdf", "10.1/c", "", "", "y", 12), ("", "pdf", "10.1/c", "", "", "", 13)], ddl)
    got = sorted((r.outcome, r.doi, r.title) for r in tasks.merge_queue(old, new).collect())
    assert got == [("added", "10.1/c", "y"), ("kept", "10.1/b", "t"), ("skipped", "10.1/b", "x"), ("upgraded", "10.1/a", "better")]


def test_requested_order(spark):
    items = spark.createDataFrame([("10.1/a", 1), ("10.1/b", 2), ("10.1/a", 3)], "doi string, pos long")
    got = search.in_requested_order(items, ["10.1/B", "10.1/a", "10.1/zz"]).orderBy("asked").collect()
    assert [(r.doi, r.pos) for r in got] == [("10.1/b", 2), ("10.1/a", 3)]


def test_sinks(spark, tmp_path):
    art = records.canonicalize(spark.createDataFrame([(1, "T {x}", ["Ann Lee"], "2020", "J", "10.1/a", 0.9), (2, "", [], "", "", "", 0.1)], "number int, title string, authors array<string>, year string, journal string, doi string, confidence double"))
    sinks.write_all(art, str(tmp_path / "run"))
    bib = "".join(p.read_text() for p in sorted((tmp_path / "run/references.bib").glob("part-*")))
    assert "@article{lee2020t," in bib and "title = {T \\{x\\}}" in bib and "@misc{papernoyear2," in bib
    assert spark.read.text(str(tmp_path / "run/failed.txt")).first().value == "- (untitled): low confidence"
    assert spark.read.option("header", True).csv(str(tmp_path / "run/articles.csv")).count() == 2
    assert sinks.without_empty(art).filter("number = 2").first().title is None
    assert reports.pdf_manifest(art).first().total_articles == 2


def test_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"title": "a"}, {"title": "b"}]')
    (tmp_path / "wrapped.json").write_text('{"articles": [{"title": "c"}]}')
    got = records.read_json_items(spark, f"{tmp_path}/*.json", "title string")
    assert sorted(r.title for r in got.collect()) == ["a", "b", "c"]
    (tmp_path / "n.md").write_text("10.1234/X and [[other]]\n<!-- managed:begin -->")
    note = records.read_notes(spark, f"{tmp_path}/*.md").first()
    assert (note.title, note.dois, note.has_managed_block) == ("n", ["10.1234/x"], True)
    (tmp_path / "p.html").write_bytes("<p>é</p>".encode("cp1252"))
    assert records.read_pages(spark, f"{tmp_path}/*.html").first().content == "<p>é</p>"
    pages = spark.createDataFrame([("https://doi.org/10.1234/q", None), ("x", None), ("y", "<html>")], "url string, content string")
    assert [r.warning[:5] for r in records.read_input(pages).orderBy("url").collect()] == ["fetch", "nothi", ""]


def test_stream(spark, tmp_path):
    src, notes, out = tmp_path / "in", tmp_path / "notes", str(tmp_path / "out")
    src.mkdir()
    notes.mkdir()
    (notes / "a.md").write_text("10.1234/a")
    spark.createDataFrame([(0, "10.1234/A", "t", "2020", "j"), (1, "10.1234/b", "u", "2020", "j")], "pos long, doi string, title string, year string, journal string").write.mode("append").parquet(str(src))
    feed = spark.readStream.schema("pos long, doi string, title string, year string, journal string").parquet(str(src))
    stream.plan_stream(feed, f"{notes}/*.md", out, str(tmp_path / "cp")).awaitTermination()
    assert {r.doi: r.action for r in spark.read.parquet(out).collect()} == {"10.1234/a": "update", "10.1234/b": "new"}
    events = feed.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    q = stream.first_of_each_doi(events, "ts").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_term_set_links_give_all_pairs(spark):
    held = {1: "a b", 2: "a b", 3: "a b c", 4: "c", 5: "b c", 6: "a", 7: "d e", 8: "e"}
    terms = spark.createDataFrame([(k, n) for k, v in held.items() for n in v.split()] + [(1, "a")], "pos long, name string")
    sets: dict = {}
    for r in network.term_sets(terms).collect():
        sets.setdefault(tuple(r.names), []).append(r.pos)
    got = {(min(i, j), max(i, j), tuple(r.shared_terms)) for r in network.term_set_links(terms).collect() for i in sets[tuple(r.names_a)] for j in sets[tuple(r.names_b)] if i != j}
    assert got == {(r.source, r.target, tuple(r.shared_terms)) for r in network.shared_term_relations(terms).collect()}
    assert got == {(i, j, tuple(sorted(set(held[i].split()) & set(held[j].split())))) for i in held for j in held if i < j and len(set(held[i].split()) & set(held[j].split())) >= 2}


def test_members_give_contrast_and_version_pairs(spark):
    terms = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (3, "y"), (4, "z")], "pos long, name string")
    rows = network.contrast_members(terms, spark.createDataFrame([("x", "y", "n")], "term_a string, term_b string, note string")).collect()
    assert {(a.pos, b.pos) for a in rows for b in rows if a.side == "a" and b.side == "b" and a.pos != b.pos} == {(1, 2), (1, 3), (3, 2)}
    articles = spark.createDataFrame([(1, "One title", "10.1/a"), (2, "One Title.", "10.1/b"), (3, "one title", "10.1/a"), (4, "other", "10.1/c"), (5, "", "")], "pos long, title string, doi string")
    got = network.version_members(articles).collect()
    assert {(a.pos, b.pos) for a in got for b in got if a.version_key == b.version_key and a.pos < b.pos} == {(1, 2), (1, 3), (2, 3)}
    assert {r.pos: r.doi for r in got} == {1: "10.1/a", 2: "10.1/b", 3: "10.1/a"}


def test_inverted_index_of_whole_texts(spark):
    texts = ["", " ", 'say "x" and \\ y\n\tz say', "a  b a " * 400, "long " * 3000 + "end", "é \u2028 \x1f 'q'"]
    index = records.inverted_index(spark.createDataFrame(list(enumerate(texts)), "pos long, text string"), "text")
    got = records.parsed(index, "j", "abstract_inverted_index MAP<STRING,VARIANT>").select("pos", records.inverted_abstract(F.col("w.abstract_inverted_index")).alias("t")).collect()
    assert {r.pos: r.t for r in got} == dict(enumerate(texts))
