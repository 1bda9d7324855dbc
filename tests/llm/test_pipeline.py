"""The corpus pipeline: each stage against a plain version of its decision, and the whole run."""

import subprocess
import sys
from pathlib import Path
import corpus_pipeline
from pyspark.sql import functions as F

from quillmesh.llm.jaccard_join import jaccard_components
from quillmesh.llm.shared import Scratch

from .test_llm import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        before = {r.doc_id: r for r in docs.collect()}
        if name == "packing":
            pieces = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
            assert {r.doc_id for r in pieces} == set(before) and all(r.n == r.t for r in pieces)
            break
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and after
        gone = set(before) - set(after)
        if name == "quality":
            assert sum(labels[i].quality == 1 for i in gone if i in labels) <= 2
        elif name == "toxicity":
            assert sum(labels[i].toxic == 0 for i in gone if i in labels) <= 2
        elif name == "near_duplicates":
            ids = sorted(before)
            _, label = brute_components([before[i].text for i in ids], 5, 80)
            assert set(after) == {ids[k] for k in set(label)}
        else:
            assert not gone and all(r.n_chars == len(r.text) for r in after.values())
        docs = spark.createDataFrame(list(after.values()), docs.schema)


def test_odd_documents(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (3, "word " * 30_000, "en", "s", 150_000), (4, "word " * 30_000, "en", "s", 150_000), (4, "word " * 30_000, "en", "s", 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]
    for stage in (corpus_pipeline.quality, corpus_pipeline.toxicity, corpus_pipeline.secrets):
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0


def test_tables_for_repeated_ids_are_made_only_where_ids_repeat(spark, monkeypatch):
    """Each further table costs the driver joins and exchanges, and so threads and memory."""
    labels, written = [], Scratch.written
    monkeypatch.setattr(Scratch, "written", lambda self, df, label: (labels.append(label), written(self, df, label))[1])
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard_components(docs).select("doc_id", "component_id").collect()} == {(1, 1), (2, 1)}
    assert "jaccard-signatures" in labels and "jaccard-held" not in labels


def test_unlike_texts_under_one_id_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(7, long, 0.1), (7, other, 0.2), (7, other, 0.2), (3, long + " x", 0.3), (9, other + " y", 0.4), (5, "un like this text at all", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score double").withColumn("_stays", F.lit(1)).withColumn("digest", F.lit(2))
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._score) for r in kept.collect()) == [(3, 0.3), (5, 0.5), (7, 0.2)]
    for stage in (corpus_pipeline.quality, corpus_pipeline.toxicity):
        assert {r._score for r in stage(spark, docs, SF).collect()} <= {0.1, 0.2, 0.3, 0.4, 0.5}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.filter("length > 4096 or offset <> 0").count() == 0


def test_entry_imports_without_the_vocabularies():
    """Without the tokenizer files' package only the queries that need it fail, and only when they run."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print('pipeline' in q, 'op5_packing' in q, 'search_topk' in q)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=120)
    assert done.stdout.strip() == "True True True", done.stderr[-500:]
