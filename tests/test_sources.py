"""Paged services, containment of strings, and faults of single pages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import containment, documents, extract, incremental
from quillmesh.sources import paged

SERVICE = "https://s.example/w"


def recorded(spark, tmp_path, rows, **options):
    hits = spark.createDataFrame(rows, "pos long, source string, publication_year int, title string")
    documents.write_files(paged.recorded_pages(hits, SERVICE, 10, **options), str(tmp_path)).count()
    paged.register(spark)
    return spark.read.format("paged_hits").option("service", SERVICE).option("recorded", str(tmp_path)).option("page_size", 10).option("pages_per_partition", 2).option("pause", 0.0)


def works(n):
    return [(i, ("a", "b")[i % 2], 2000 + i % 7, f't "{i}" \\ é') for i in range(n)]


def test_pages_are_partitions_and_the_second_try_succeeds(spark, tmp_path):
    read = recorded(spark, tmp_path, works(57), failing_every=2)
    df = read.load()
    assert df.rdd.getNumPartitions() == 3
    got = sorted((r.pos, r.source, r.year, r.page, json.loads(r.payload)["title"]) for r in df.collect())
    assert got == [(i, s, y, i // 10 + 1, t) for i, s, y, t in works(57)]
    assert sorted(r.pos for r in read.option("most", 23).load().collect()) == list(range(23))
    with pytest.raises(Exception, match="no answer for"):
        read.option("most", 57).option("retries", 0).load().collect()
    assert sorted({r.page for r in read.option("retries", 0).option("failed_pages", "skip").load().collect()}) == [1, 3, 5]
    with pytest.raises(Exception, match="status_503"):
        read.option("retries", 2).option("stop_on", "429, 503").load().collect()


def test_conditions_go_into_the_request(spark, tmp_path, capsys):
    """Only the request with the conditions is recorded: any other would find no answer."""
    kept = [r for r in works(80) if r[1] == "b" and 2002 <= r[2] < 2006]
    read = recorded(spark, tmp_path, kept, asked={"year_from": 2002, "year_to": 2005, "source": "b"})
    df = read.load().filter("source = 'b' and year > 2001 and year < 2006 and length(payload) > 3")
    assert sorted(json.loads(r.payload)["title"] for r in df.collect()) == sorted(r[3] for r in kept)
    df.explain("formatted")
    plan = capsys.readouterr().out
    condition = plan.partition("Condition : ")[2].partition("\n")[0]
    assert "BatchScan paged_hits" in plan and "length(payload" in condition and "2001" not in condition and "= b" not in condition


def test_a_service_that_ignores_conditions_does_no_harm(spark, tmp_path):
    read = recorded(spark, tmp_path, works(35), asked={"year_from": 2003, "year_to": 2004, "source": "a"})
    got = {(r.pos, r.year, r.source) for r in read.load().filter("source = 'a' and year between 2003 and 2004").collect()}
    assert got == {(i, y, s) for i, s, y, _ in works(35) if s == "a" and 2003 <= y <= 2004}


def test_reads_without_conditions_ask_for_everything(spark, tmp_path):
    read = recorded(spark, tmp_path, works(15), asked={"source": "a"})
    with pytest.raises(Exception, match="no answer for"):
        read.load().collect()


def test_service_without_hits_or_counts(spark, tmp_path):
    assert recorded(spark, tmp_path / "none", []).load().count() == 0
    folder = tmp_path / "plain"
    folder.mkdir()
    for page, n in ((1, 10), (2, 10), (3, 4)):
        body = json.dumps({"results": [{"source": "a", "publication_year": 2001, "n": page}] * n})
        (folder / paged.exchange_name(paged.request_url(SERVICE, page, 10))).write_text(json.dumps([[200, body]]))
    df = spark.read.format("paged_hits").option("service", SERVICE).option("recorded", str(folder)).option("page_size", 10).option("pause", 0.0).load()
    assert df.groupBy("page").count().orderBy("page").collect() == [(1, 10), (2, 10), (3, 4)]


def test_tries_pause_longer_each_time(monkeypatch):
    slept, answers = [], iter([(500, ""), (0, ""), (200, "x")])
    monkeypatch.setattr(paged.time, "sleep", slept.append)
    assert paged.fetched(lambda url, i: next(answers), "u") == "x" and slept == [1.2, 2.4]

    def broken(url, attempt):
        raise OSError

    assert paged.fetched(broken, "u") is None and slept == [1.2, 2.4, 1.2, 2.4]


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_containing_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(containment, "CHUNK", chunk)
    r = random.Random(chunk)
    strings = ["10.1000/d.5", "10.1000/d.55", "10.1000/d.555", "a", "é", "ab", "日本", "aé", "xyz", "abcd", "d.5", "no such string at all", "", None, "a", "needle" * 40]
    texts = [(i, "".join(r.choice(["10.1000/d.5", "10.1000/d.55", "5", "a", "b", "é", "日本", "日", "xyz", " ", "abcd", "needle" * r.choice((1, 39, 40, 41))]) for _ in range(r.randrange(30)))) for i in range(60)]
    texts += [(100, None), (101, ""), (None, "a"), (102, "z" * 500 + "10.1000/d.555" + "z" * 500), (0, texts[0][1])]
    got = containment.containing(spark.createDataFrame(texts, "path long, text string"), spark.createDataFrame([(s,) for s in strings], "doi string")).collect()
    want = {(s, k) for s in strings if s for k, t in texts if k is not None and t is not None and s in t}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    none = spark.createDataFrame([], "doi string")
    assert containment.containing(spark.createDataFrame(texts, "path long, text string"), none).count() == 0
    assert containment.containing(spark.createDataFrame([], "path long, text string"), spark.createDataFrame([("a",)], "doi string")).count() == 0


def test_notes_that_hold_a_doi_anywhere(spark):
    notes = spark.createDataFrame([("a.md", "see(10.1234/AB.1x)"), ("b.md", "10.1234/ab.12 and 10.77/q"), ("c.md", "https://doi.org/10.77/Q!")], "path string, text string")
    articles = spark.createDataFrame([(1, "10.1234/ab.1"), (2, "10.1234/ab.1x"), (3, "doi: 10.1234/AB.12"), (4, "10.77/q"), (5, ""), (6, None), (7, "10.9/none")], "pos long, doi string")
    assert sorted(containment.notes_containing_doi(articles, notes).collect()) == [(2, "10.1234/ab.1x", "a.md"), (3, "10.1234/ab.12", "b.md")]


def test_deep_documents_do_not_fail_the_job(spark):
    deep = '{"@graph":' * 900 + '{"@type":"Article","headline":"inner"}' + "}" * 900
    lists = '{"@type":"Article","headline":"h","author":' + "[" * 900 + '"A"' + "]" * 900 + "}"
    bad = "[" * 100_000
    page = lambda *scripts: "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
    pages = spark.createDataFrame([(1, "u1", page(deep)), (2, "u2", page(bad, lists)), (3, "u3", page("{oops", bad + "]" * 100_000))], "page_id long, url string, content string")
    parsed = pages.withColumn("parts", extract.page_parts(F.col("content")))
    found = {r.page_id: (r.title, r.authors) for r in extract.jsonld_articles(parsed.drop("content")).collect()}
    assert found == {1: ("inner", []), 2: ("h", ["A"])}
    faults = sorted((r.page_id, r.script, r.fault[:7]) for r in extract.jsonld_faults(parsed).collect())
    assert faults == [(2, 0, "nested "), (3, 0, "no JSON"), (3, 1, "nested ")]


@pytest.mark.parametrize("text", ["E x B y", "B no end", "a B 1 E b B 2 E c", "E", "", None, "B B x E y", "text E B old E tail", "B x E E"])
def test_replacing_a_block_twice_changes_nothing(spark, text):
    begin, end = "<!-- b -->", "<!-- e -->"
    text = text and text.replace("B", begin).replace("E", end)
    df = spark.createDataFrame([(text, "new")], "t string, b string")
    once = df.withColumn("t", incremental.replace_block("t", "b", begin, end))
    first, twice = once.first().t, once.withColumn("t", incremental.replace_block("t", "b", begin, end)).first().t
    assert first == twice and first.count(f"{begin}\nnew\n{end}") == 1
    assert first.count(begin) in ((text or "").count(begin), (text or "").count(begin) + 1)
