"""Corpus pipeline: quality, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``; all stages but the
last return these columns. The stages' decisions take effect: rejected documents and further copies
go, secrets are replaced by a mark. SQL cannot express the stages; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.jaccard_join import jaccard_components
from quillmesh.llm.labelled import labelled_sample
from quillmesh.llm.packing import pack_power_of_two
from quillmesh.llm.quality import MAX_TRAINING_ROWS as QUALITY_ROWS
from quillmesh.llm.quality import fit_quality, score_quality
from quillmesh.llm.secrets_cnn import fit_secrets, redact
from quillmesh.llm.shared import Scratch, table, written
from quillmesh.llm.toxicity import MAX_TRAINING_ROWS as TOXICITY_ROWS
from quillmesh.llm.toxicity import fit_toxicity, score_toxicity

QUALITY_LEAST = 0.3
TOXICITY_MOST = 0.7
NEAR_WORDS, NEAR_PERCENT = 5, 80


def free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    return "score_" + "_" * max(len(c) for c in [*docs.columns, ""])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY_LEAST."""
    model = fit_quality(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, QUALITY_ROWS))
    name = free_name(docs)
    return score_quality(docs, model, score_col=name).filter(F.col(name) >= QUALITY_LEAST).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXICITY_MOST."""
    model = fit_toxicity(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1, TOXICITY_ROWS))
    name = free_name(docs)
    return score_toxicity(docs, model, score_col=name).filter(F.col(name) < TOXICITY_MOST).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id, once.

    Documents without words and those with a null id are groups of their own. Of rows that repeat an id
    with its text one stays; different texts under one id are different documents.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    nameless = docs.filter(F.col("doc_id").isNull())
    if not named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        groups = jaccard_components(named, NEAR_WORDS, NEAR_PERCENT)
        stay = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("stays"))
        return named.join(stay, F.col("doc_id") == F.col("stays"), "left_semi").select(docs.columns).union(nameless)
    # a node for each text: the id, and for further texts under an id a hash of both
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = named.select("doc_id", digest.alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last"))
    several = texts.filter("first <> last").select(F.col("doc_id").alias("id"), "first")
    node = F.when(F.col("digest") != F.col("first"), F.xxhash64("doc_id", "digest")).otherwise(F.col("doc_id").cast("long"))
    nodes = named.select("doc_id", "text", digest.alias("digest")).join(several, F.col("doc_id") == F.col("id"), "left")
    nodes = written(nodes.select(node.alias("node"), "doc_id", "text", "digest"), "pipeline-nodes")
    groups = jaccard_components(nodes, NEAR_WORDS, NEAR_PERCENT, id_col="node").distinct()
    members = groups.select("node", "component_id").join(nodes.select(F.col("node").alias("n"), "doc_id", "digest").distinct(), F.col("node") == F.col("n"))
    stay = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest")).alias("s")).select(F.col("s.doc_id").alias("stays"), F.col("s.digest").alias("stays_digest"))
    kept = named.join(stay, (F.col("doc_id") == F.col("stays")) & (digest == F.col("stays_digest")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(docs.columns).union(nameless)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in their texts replaced by a mark."""
    clean = redact(docs, fit_secrets(docs))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return clean.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length with their token ids."""
    import public_tokenizers

    return pack_power_of_two(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        now = Scratch(spark)
        docs = now.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        before.drop()  # what this stage has read
        before = now
    return docs
