"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold_of, small_batches


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``max_rows`` labelled ids outside the held-out fold.

    Ids are drawn in hash order, so the sample does not depend on how tables are laid out. At most
    ``max_rows`` ids and labels are broadcast (16 bytes each), whatever the size of the tables; texts
    do not move. Null labels and ids are left out; of conflicting labels of an id the larger counts;
    rows of ``docs`` that repeat an id are all given. Either table may be empty.
    """
    small_batches(docs.sparkSession)
    rule = fold_of(id_col, folds)
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (rule != held_out))
    drawn = known.groupBy(id_col).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    drawn = drawn.select(F.col(id_col).alias("_labelled"), "y")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(drawn), F.col("_id") == F.col("_labelled")).select("_id", "_text", "y")
