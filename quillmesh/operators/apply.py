"""Applying a preview of notes to a folder, with a manifest, a check that nothing changed, and a way back.

A preview says for each path what hash the note had and what text it shall have. The manifest is a table
that is written before the first note: from it, and from the folder as it is, one can see at any time which
notes are as they were, which are written and which someone else has changed. Going back needs nothing else.

The folder is one that all executors mount; a task that runs again writes the same files again.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import write_files

MANIFEST = "path string, change string, before string, after string, batch int"
MISSING = "MISSING"


class NotesChanged(RuntimeError):
    """Notes are not as the preview saw them; nothing was written."""


def notes_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the Markdown files below a folder, paths relative to it; none where there is no folder.

    Spark's readers pass over empty files, so an empty note counts as none throughout this module.
    """
    if not os.path.isdir(folder):
        return spark.createDataFrame([], "path string, text string")
    root = os.path.realpath(folder).rstrip("/") + "/"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    uri = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:(//)?(?=/)", "")
    return files.select(F.substring(uri, F.lit(len(root) + 1), F.length(uri)).alias("path"), F.col("value").alias("text"))


def _hash(text: str):
    return F.when(F.coalesce(F.col(text), F.lit("")) == "", MISSING).otherwise(F.sha2(text, 256))


def planned_writes(before: DataFrame, after: DataFrame, batches: int = 8) -> DataFrame:
    """The manifest's rows, and the new text, of the notes that a preview adds or changes. Paths are unique on each side."""
    b = before.select(F.col("path").alias("old_path"), _hash("text").alias("old"))
    rows = after.select("path", "text", _hash("text").alias("after")).join(b, F.col("path") == F.col("old_path"), "left")
    rows = rows.withColumn("before", F.coalesce("old", F.lit(MISSING))).filter("before <> after")
    change = F.when(F.col("before") == MISSING, "added").otherwise("changed")
    return rows.select("path", change.alias("change"), "before", "after", F.pmod(F.xxhash64("path"), F.lit(batches)).cast("int").alias("batch"), "text")


def states(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """The manifest's rows with ``state``: "pending" as before, "written" as planned, "foreign" for anything else."""
    n = now.select(F.col("path").alias("at"), _hash("text").alias("is"))
    met = manifest.join(n, F.col("path") == F.col("at"), "left").withColumn("is", F.coalesce("is", F.lit(MISSING)))
    state = F.when(F.col("is") == F.col("after"), "written").when(F.col("is") == F.col("before"), "pending").otherwise("foreign")
    return met.select(*manifest.columns, state.alias("state"))


def batch_report(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(batch, state, n): how many notes of each batch are pending, written or changed by others."""
    return states(manifest, now).groupBy("batch", "state").agg(F.count("*").alias("n"))


def _manifest(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{log}/manifest")


def apply_preview(before: DataFrame, after: DataFrame, folder: str, log: str, batches: int = 8) -> DataFrame:
    """Write what a preview changes into ``folder``; the batch report of what was done.

    ``log`` is a new folder for the manifest and the backup. In order: the preview's texts and the manifest
    are written to ``log``; the notes in the folder are compared with the hashes that the preview saw, and
    if one differs NotesChanged is raised and no note is written; their texts are copied; then batch after
    batch is written and looked at again. If a batch fails, all that was written is taken back and the
    error raised. After a crash ``roll_back`` does the same, or ``resume`` goes on.
    """
    spark = before.sparkSession
    planned_writes(before, after, batches).write.parquet(f"{log}/planned")
    planned = spark.read.parquet(f"{log}/planned")
    planned.drop("text").write.parquet(f"{log}/manifest")
    foreign = [r["path"] for r in states(_manifest(spark, log), notes_in(spark, folder)).filter("state <> 'pending'").orderBy("path").limit(10).select("path").collect()]
    if foreign:
        raise NotesChanged(f"changed since the preview: {', '.join(foreign)}")
    changed = planned.filter("change = 'changed'").select("path")
    write_files(notes_in(spark, folder).join(changed, "path", "left_semi"), f"{log}/backup").count()
    return resume(spark, folder, log)


def resume(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """Write the pending notes of a manifest, batch by batch; notes that others changed stop it before the first."""
    planned, manifest = spark.read.parquet(f"{log}/planned"), _manifest(spark, log)
    now = states(manifest, notes_in(spark, folder))
    if now.filter("state = 'foreign'").limit(1).count():
        raise NotesChanged("notes were changed by others since the preview")
    todo = sorted(r["batch"] for r in now.filter("state = 'pending'").select("batch").distinct().collect())
    try:
        for batch in todo:
            write_files(planned.filter(F.col("batch") == batch).select("path", "text"), folder).count()
            left = states(manifest.filter(F.col("batch") == batch), notes_in(spark, folder)).filter("state <> 'written'").limit(1).count()
            if left:
                raise OSError(f"batch {batch} is not as planned after writing")
    except Exception:
        roll_back(spark, folder, log)
        raise
    return batch_report(manifest, notes_in(spark, folder))


def _removed(paths: DataFrame, folder: str) -> DataFrame:
    """Delete the files of ``path``; files that are gone already do no harm."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                full = os.path.normpath(os.path.join(folder, path))
                if full.startswith(os.path.normpath(folder) + os.sep) and os.path.isfile(full):
                    os.replace(full, gone := f"{full}.{uuid.uuid4().hex}")
                    os.unlink(gone)
            yield pa.RecordBatch.from_arrays([b.column(0)], ["path"])

    return paths.select("path").mapInArrow(run, "path string")


def roll_back(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """Take back what was written: former texts return, added notes go. (path, state) of notes that others changed meanwhile, which stay."""
    now = states(_manifest(spark, log), notes_in(spark, folder))
    written = now.filter("state = 'written'").select("path", "change")
    old = notes_in(spark, f"{log}/backup").join(written.filter("change = 'changed'").select("path"), "path", "left_semi")
    add = [r["path"] for r in written.filter("change = 'added'").limit(1).collect()]
    # which notes are to go is decided before any is touched
    if add:
        written.filter("change = 'added'").select("path").write.mode("overwrite").parquet(f"{log}/taken-back")
    write_files(old, folder).count()
    if add:
        _removed(spark.read.parquet(f"{log}/taken-back"), folder).count()
    left = states(_manifest(spark, log), notes_in(spark, folder)).filter("state = 'foreign'").select("path", "state")
    return left
