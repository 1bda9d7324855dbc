"""Keyed task queue: validation, per-state dedupe, merge of incoming tasks, link classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nonempty, normalize_doi, normalize_doi_strict, text_of

STATES = ("pending", "processing", "processed", "failed")
TYPES = ("si", "pdf", "fill-missing-pdf", "list-missing-pdf-doi")


def task_key(kind="type", doi="doi", parent="zoteroKey") -> Column:
    return F.concat_ws("|", F.lower(F.trim(F.coalesce(nonempty(text_of(kind)), F.lit("si")))), normalize_doi_strict(doi), F.trim(text_of(parent)))


def normalize_tasks(tasks: DataFrame) -> DataFrame:
    """Valid tasks with normal type, DOI, status and key; per state the first of each key.

    Types outside the list go; "si" and "pdf" need a DOI or a parent key.
    """
    kind = F.lower(F.trim(F.coalesce(nonempty(text_of("type")), F.lit("si"))))
    doi, parent = normalize_doi_strict("doi"), F.trim(text_of("zoteroKey"))
    ok = kind.isin(*TYPES) & (~kind.isin("si", "pdf") | (doi != "") | (parent != ""))
    rows = tasks.filter(ok).withColumns({"type": kind, "doi": doi, "zoteroKey": parent, "status": F.coalesce(nonempty(text_of("status")), F.lit("pending"))}).withColumn("task_key", task_key())
    w = Window.partitionBy("state", "task_key").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_queue(existing: DataFrame, incoming: DataFrame, fields=("title",)) -> DataFrame:
    """Queue after a merge, with ``outcome``: kept, upgraded, added or skipped.

    A key that is processing or processed locks: its incoming tasks are skipped. A pending key takes
    the non-empty values of its incoming tasks, in order; a new key is added, later ones upgrade it.
    Skipped tasks are returned with state "skipped".
    """
    old, new = normalize_tasks(existing), incoming.withColumn("state", F.lit("pending")).transform(_valid)
    locked = old.filter(F.col("state").isin("processing", "processed")).select("task_key").distinct().withColumn("_locked", F.lit(True))
    marked = new.join(locked, "task_key", "left")
    last = marked.filter("_locked is null").groupBy("task_key").agg(
        F.min("pos").alias("_pos"), F.min_by("type", "pos").alias("_type"), F.min_by("doi", "pos").alias("_doi"), F.min_by("zoteroKey", "pos").alias("_zk"), F.min_by("status", "pos").alias("_status"), *[F.max_by(F.when(text_of(f) != "", F.col(f)), F.when(text_of(f) != "", F.col("pos"))).alias(f"_{f}") for f in fields]
    )
    pending = old.filter("state = 'pending'").join(last, "task_key", "full")
    is_new = F.col("state").isNull()
    columns = ["state", "task_key", "type", "doi", "zoteroKey", "status", "pos", *fields]
    merged = pending.select(
        F.lit("pending").alias("state"), "task_key", F.coalesce("type", "_type").alias("type"), F.coalesce("doi", "_doi").alias("doi"), F.coalesce("zoteroKey", "_zk").alias("zoteroKey"), F.coalesce("status", "_status").alias("status"),
        F.coalesce("pos", "_pos").alias("pos"), *[F.coalesce(nonempty(F.col(f"_{f}")), F.col(f)).alias(f) for f in fields], F.when(is_new, "added").when(F.col("_pos").isNotNull(), "upgraded").otherwise("kept").alias("outcome"),
    )
    rest = old.filter("state <> 'pending'").select(*columns).withColumn("outcome", F.lit("kept"))
    skipped = marked.filter("_locked").withColumn("state", F.lit("skipped")).select(*columns).withColumn("outcome", F.lit("skipped"))
    return merged.unionByName(rest).unionByName(skipped)


def _valid(tasks: DataFrame) -> DataFrame:
    kind = F.lower(F.trim(F.coalesce(nonempty(text_of("type")), F.lit("si"))))
    doi, parent = normalize_doi_strict("doi"), F.trim(text_of("zoteroKey"))
    ok = kind.isin(*TYPES) & (~kind.isin("si", "pdf") | (doi != "") | (parent != ""))
    return tasks.filter(ok).withColumns({"type": kind, "doi": doi, "zoteroKey": parent, "status": F.coalesce(nonempty(text_of("status")), F.lit("pending"))}).withColumn("task_key", task_key())


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("state").agg(F.count("*").alias("n"))


def classify_links(records: DataFrame, library: DataFrame) -> DataFrame:
    """(pos, doi, link_status, parent_key): exact DOI matches among library items that are no attachments.

    ``library``: item_key, item_type, doi, trashed. One match outside the trash is unique.
    """
    items = library.filter(F.col("item_type") != "attachment").select(normalize_doi("doi").alias("d"), "item_key", F.coalesce("trashed", F.lit(False)).alias("trashed")).filter("d <> ''")
    found = items.groupBy("d").agg(F.count("*").alias("n"), F.count_if("trashed").alias("t"), F.min_by("item_key", F.struct("trashed", "item_key")).alias("item_key"))
    rows = records.select("pos", normalize_doi("doi").alias("doi")).join(found, F.col("doi") == F.col("d"), "left")
    status = F.when(F.col("doi") == "", "no_doi").when(F.col("n").isNull(), "not_found").when((F.col("n") == 1) & (F.col("t") == 0), "unique").otherwise("ambiguous_or_trashed")
    return rows.select("pos", "doi", status.alias("link_status"), F.when(status == "unique", F.col("item_key")).otherwise("").alias("parent_key"))


def handoff_tasks(items: DataFrame, task_type: str = "pdf", created_at: str = "") -> DataFrame:
    """Tasks of selected items with a title and a DOI; empty fields are null, so JSON leaves them out."""
    doi = normalize_doi("doi")
    rows = items.filter((text_of("title") != "") & (doi != ""))
    return rows.select(F.lit(task_type).alias("type"), doi.alias("doi"), F.lit("pending").alias("status"), F.lit(created_at).alias("createdAt"), F.col("title"), F.concat(F.lit("doi:"), doi).alias("sourceItemId"), nonempty(text_of("pdf_url")).alias("pdfUrl"), F.col("pos"))
