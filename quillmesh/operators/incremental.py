"""Incremental planning against an existing corpus, snapshot differences and link checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_title_key, normalize_doi, wikilink_targets
from ..sources.folders import shared_folder
from ..sources.records import notes_by_doi
from .resolve import duplicate_groups, version_pairs

#: Actions of a plan; fixed values.
ACTIONS = ("conflict_missing_doi", "duplicate_in_capture", "conflict_duplicate_vault_notes", "new", "update", "noop")


def capture_inventory(articles: DataFrame) -> DataFrame:
    return articles.select("pos", normalize_doi("doi").alias("doi"), "title", compact_title_key("title").alias("title_key"), "year", "journal")


def build_plan(capture: DataFrame, inventory: DataFrame) -> DataFrame:
    """Action of every captured record: all copies of a DOI are duplicates, then by the notes that hold it."""
    rows = capture_inventory(capture)
    repeated = duplicate_groups(rows, F.col("doi")).select(F.col("value").alias("doi"), F.lit(True).alias("repeated"))
    notes = notes_by_doi(inventory)
    found = rows.join(repeated, "doi", "left").join(notes, "doi", "left")
    n = F.coalesce("n_notes", F.lit(0))
    action = (
        F.when(F.col("doi") == "", ACTIONS[0]).when(F.col("repeated"), ACTIONS[1]).when(n > 1, ACTIONS[2]).when(n == 0, ACTIONS[3]).when(~F.col("has_managed_block"), ACTIONS[4]).otherwise(ACTIONS[5])
    )
    return found.select("pos", "doi", "title", "title_key", action.alias("action"), F.coalesce("paths", F.array().cast("array<string>")).alias("matched_notes"))


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: items, conflicts and whether the plan can be applied."""
    bad = F.col("action").startswith("conflict") | F.col("action").startswith("duplicate")
    return plan.agg(F.count("*").alias("items"), F.count_if(bad).alias("conflicts"), (F.count_if(bad) == 0).alias("safe_to_apply"))


def analysis_queue(plan: DataFrame, *records: DataFrame) -> DataFrame:
    """Items that are new or to be updated, or that belong to a version pair and are not done."""
    dois = version_pairs(*records).select(F.explode("dois").alias("doi")).distinct().withColumn("paired", F.lit(True))
    joined = plan.join(dois, "doi", "left")
    return joined.filter(F.col("action").isin("new", "update") | (F.coalesce("paired", F.lit(False)) & (F.col("action") != "noop"))).drop("paired")


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, before, after) of paths whose hash differs; a missing side is "MISSING"."""
    b, a = (d.groupBy("path").agg(F.max("sha256").alias(c)) for d, c in ((before, "before"), (after, "after")))
    both = b.join(a, "path", "full").select("path", F.coalesce("before", F.lit("MISSING")).alias("before"), F.coalesce("after", F.lit("MISSING")).alias("after"))
    change = F.when(F.col("before") == "MISSING", "added").when(F.col("after") == "MISSING", "removed").otherwise("changed")
    return both.filter("before <> after").select("path", change.alias("change"), "before", "after")


def links(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.explode(wikilink_targets("text")).alias("target"))


def broken_links(notes: DataFrame) -> DataFrame:
    """(path, target) of links to no note's title, distinct."""
    titles = notes.select(F.col("title").alias("target")).distinct()
    return links(notes).distinct().join(titles, "target", "left_anti").select("path", "target")


def doi_uniqueness(capture: DataFrame, inventory: DataFrame) -> DataFrame:
    """(doi, n_notes) of captured DOIs that do not stand in exactly one note."""
    want = capture.select(normalize_doi("doi").alias("doi")).filter("doi <> ''").distinct()
    have = inventory.select(F.explode("dois").alias("doi"), "path").distinct().groupBy("doi").agg(F.count("*").alias("n_notes"))
    return want.join(have, "doi", "left").select("doi", F.coalesce("n_notes", F.lit(0)).alias("n_notes")).filter("n_notes <> 1")


def replace_block(text, block, begin: str = "<!-- managed:begin -->", end: str = "<!-- managed:end -->"):
    """Text with its managed block replaced, or the block appended; doing it twice changes nothing.

    The block reaches from a begin mark to the next end mark, with no other begin mark between; end marks
    that stand before every begin mark, and begin marks without an end, are ordinary text.
    """
    t, made = F.coalesce(F.col(text), F.lit("")), F.concat(F.lit(begin + "\n"), F.col(block), F.lit("\n" + end))
    some = F.locate(begin, t)
    stop = F.when(some > 0, F.position(F.lit(end), t, some + len(begin))).otherwise(0)
    # the last begin mark before that end
    at = stop - len(begin) + 1 - F.locate(begin[::-1], F.reverse(F.substring(t, F.lit(1), stop - 1)))
    inside = F.concat(F.substring(t, F.lit(1), at - 1), made, F.substring(t, stop + len(end), F.length(t)))
    added = F.concat(F.rtrim(F.regexp_replace(t, r"\s+$", "")), F.lit("\n\n"), made, F.lit("\n"))
    return F.when(stop > 0, inside).otherwise(added)


def numbered(df: DataFrame, *order, parts: int = 32) -> DataFrame:
    """``df`` with ``number``, from 1 in the given order, without gathering rows in one task.

    Rows are dealt out by ranges of the order; counts of the ranges give each its first number. Both
    readings must see the same ranges, so the dealt rows are written as a checkpoint, which Spark deletes
    when nothing refers to it any more; a local session without a checkpoint folder gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "numbered"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("number", inside).join(F.broadcast(offsets), "_part").withColumn("number", F.col("number") + F.col("_before")).drop("_part", "_before")
