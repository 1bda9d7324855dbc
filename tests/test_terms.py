"""Literals of patterns, canonical terms, the merge of hot keys and joins of term sets."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions.patterns import folded, needed
from quillmesh.operators import network, resolve, terms, vocabulary
from quillmesh.sources import records

RULES = [*vocabulary.TERM_RULES, *vocabulary.EVIDENCE_RULES, *vocabulary.CANONICAL_RULES]


@pytest.mark.parametrize(
    "pattern,want",
    [
        (r"\bnickel catalysis\b", {"nickel catalysis"}), (r"ab?c", {"a"}), (r"ab+cd", {"ab"}), (r"a(?:bc|de)?", {"a"}), (r"(?:abc|de)f?", {"abc", "de"}), (r"x|yy", {"x", "yy"}), (r"a*|b", set()), (r".*", set()),
        (r"[abc]de[^]]fgh", {"fgh"}), (r"(?<![A-Za-z])SET(?![A-Za-z])", {"set"}), (r"(?i:\bNHPI esters?\b)", {"nhpi ester"}), (r"C\(sp3\)\s*[- ]\s*C\(sp3\)", {"c(sp3)"}), (r"(?:^|[^\p{L}\p{N}_])(?:of)(?:$|[^\p{L}])", {"of"}),
        (r"ab{0,2}c{2}", {"a"}), (r"a\.b", {"a.b"}), (r"", set()),
    ],
)
def test_needed_literals(pattern, want):
    got = needed(pattern)
    assert got == want or (len(want) == 1 and got and all(len(x) >= len(next(iter(want))) for x in got))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["nickel", "Ni", "-", " ", "catalyst", "catalyzed", "SET", "set", "single", "electron", "transfer", "C(sp3)", "C ( sp 3 )", "cross", "coupling", "radical", "RAE", "rae", "esters", "redox", "active", "photoredox", "catalysis", "S H 2", "SH2", "ſ", "K", "chemistry", "é"]), max_size=12).map("".join))
def test_a_match_holds_a_needed_literal(text):
    low = text.lower().translate({ord("ſ"): "s", ord("K"): "k"}).replace("i̇", "i")
    for r in RULES:
        for p in r.patterns:
            if re.search(p, text, 0 if r.exact else re.IGNORECASE) and (lits := needed(p)):
                assert any(x in low for x in lits), (p, lits)


def test_canonical_terms_equal_plain_search(spark):
    r = random.Random(2)
    words = ["Nickel catalysis", "nickel-catalyzed", "ni catalysed", "chiral  nickel catalyst", "redox active esters", "RAE", "RAEs", "raes", "NHPI ester", "SET", "set", "OFFSET", "SET2", "SH2", "sh2", "S  H 2", "cross coupling", "C(sp3) – C ( sp3 ) cross-coupling", "C(sp 3) chemistry", "Fe porphyrin", "electrochemistries", "enantioSelective", "decarboxylative functionalisation", "ſingle-electron tranſfer", "einzel", ",", "é"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(8))) for _ in range(150)] + [""]
    rows = [(i, t, r.choice([None, "", "SET theory"]), [w for w in (r.choice(words),) if w != ","], []) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "pos long, title string, abstract string, keywords array<string>, concepts array<string>")
    got = {x.pos: x.canonical_terms for x in terms.with_canonical_terms(df).collect()}
    for i, title, abstract, keywords, _ in rows:
        whole = "\n".join(x for x in (title.strip(), abstract or "", " ".join(keywords)) if x)
        want = [c.name for c in vocabulary.CANONICAL_RULES if any(re.search(p, whole, 0 if c.exact else re.IGNORECASE) for p in c.patterns)]
        assert got[i] == want, whole


def test_enriched_records_name_their_sources(spark):
    rows = [("SH2 and Alkyl halides", ["alkyl halide", "x"], "A homolytic substitution.", "crossref"), ("Nothing here", [], "", "")]
    df = spark.createDataFrame(rows, "title string, keywords array<string>, abstract string, abstract_source string").withColumn("metadata_source", F.lit("openalex"))
    a, b = terms.enriched(df).collect()
    assert a.keywords == ["alkyl halide", "x", "SH2", "homolytic substitution"] and a.concepts == ["alkyl halide", "SH2", "homolytic substitution"]
    assert a.keywords_source == ["openalex", "conservative-text-rules"] and a.concepts_source == ["conservative-text-rules"]
    assert a.enrichment_sources == ["openalex", "conservative-text-rules", "crossref"]
    assert b.keywords == [] and b.keywords_source == [] and b.enrichment_sources == ["openalex"]


def fold(rows):
    """The merge as a fold: (title, url, citation count, confidence) of rows in order."""
    base = dict(rows[0])
    for r in rows[1:]:
        lead, other = (base, r) if r["confidence"] > base["confidence"] else (r, base)
        made = {k: lead[k] or other[k] for k in ("title", "url")}
        made["confidence"] = max(r["confidence"], base["confidence"])
        base = made
    return base  # the newer record leads unless its confidence is higher


def test_one_key_with_half_the_rows(spark):
    """A hot key merges like any other, and no task gets its rows: they are dealt out by place."""
    r = random.Random(6)
    rows = []
    for i in range(4000):
        hot = i % 2 == 0
        rows.append((i, "10.1/hot" if hot else f"10.2/{i // 6}", r.choice(["", f"t{i}"]), r.choice(["", f"u{i}"]), None, r.choice([0.1, 0.3, 0.55, 0.7, 0.9]) if i > 40 else 0.1 + i / 100))
    df = spark.createDataFrame(rows, "pos long, doi string, title string, url string, citation_count long, confidence double")
    articles = records.canonicalize(df)
    merged = resolve.dedupe_articles(articles)
    got = {x.doi: (x.pos, x.title, x.url, x.confidence, x.n_merged) for x in merged.collect()}
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    for doi, group in groups.items():
        want = fold([dict(zip(("pos", "doi", "title", "url", "citation_count", "confidence"), g)) for g in group])
        assert got[doi] == (group[0][0], want["title"], want["url"], want["confidence"], len(group))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1 or all("_p" in line and "title" not in line for line in windows)  # only keys, confidences and places are ordered


@pytest.mark.parametrize("least", [1, 2, 3])
def test_sets_meet_on_pairs_of_names(spark, least):
    r = random.Random(least)
    sets = [(i, sorted(r.sample("abcdefgh", r.randrange(0, 6)) + ["hot"])) for i in range(60)]
    df = spark.createDataFrame(sets, "pos long, names array<string>")
    other = df.select(F.col("pos").alias("p2"), F.col("names").alias("others"))
    got = [(x.pos, x.p2, tuple(x.shared_terms)) for x in network.overlapping(df, other, least).collect()]
    want = {(i, j, tuple(sorted(set(a) & set(b)))) for i, a in sets for j, b in sets if len(set(a) & set(b)) >= least}
    assert len(got) == len(want) and set(got) == want
    if least == 2:
        keys = df.select(F.explode(network._keys(F.col("names"), 2)).alias("k"))
        assert keys.count() == sum(len(n) * (len(n) - 1) // 2 for _, n in sets)


def test_folded_text(spark):
    assert spark.createDataFrame([("KſTİ x",)], "t string").select(folded(F.col("t")).alias("t")).first().t == "ksti x"
