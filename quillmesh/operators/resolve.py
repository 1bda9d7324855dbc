"""Entity resolution: keys, survivor merge, and first- or best-of-group selections.

The merge is a fold over a group's records in order, written in closed form so that it is one
aggregation: a record becomes the base when its confidence is not above all earlier ones, the base's
non-empty values win, and the rest fills gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.scores import abstract_priority, abstract_score
from ..functions.text import compact_title_key, match_key, nonempty, normalize_doi, text_of, title_key

LIST_FIELDS = ("keywords", "keywords_source", "concepts", "concepts_source", "enrichment_sources", "metadata_warnings", "notes")
INCOMING_WINS = ("citation_count", "journal_rank")


def dedupe_key(mode: str = "doi", doi="doi", title="title") -> Column:
    """"doi:..." or "title:..." with the mode's key first; null when the record has neither."""
    d, t = nonempty(normalize_doi(doi)), nonempty(title_key(title))
    by_doi, by_title = F.concat(F.lit("doi:"), d), F.concat(F.lit("title:"), t)
    return F.coalesce(by_doi, by_title) if mode == "doi" else F.coalesce(by_title, by_doi)


def dedupe_articles(articles: DataFrame, mode: str = "doi", pos: str = "pos") -> DataFrame:
    """Merge the records of each key; others stay. Adds ``n_merged``; ``pos`` is that of the first.

    Per field: ordinary values from the latest base that has one, else the earliest filler; citation
    counts and ranks from the latest incoming one; authors the longest list; confidence the greatest;
    lists united without repeats; the abstract of the best source and score.

    No key is gathered or sorted by row. A record fills gaps, where others are bases, if no earlier one of its
    key has its confidence or a higher one: first places by (key, confidence) are a map-side minimum, and
    among them a running minimum from the highest confidence down leaves the fillers. Rows meet them by key and place, so one key
    with most rows spreads; merged values are aggregates, combined on the map side. Lists are united by
    their distinct values, so a group holds its vocabulary in memory, not its rows. What one task orders
    is the distinct confidences of a key.
    """
    # never null, and known not to be: else the join would test the whole expression of the key again
    keyed = articles.withColumn("_key", F.coalesce(dedupe_key(mode), F.concat(F.lit("row:"), F.col(pos).cast("string")), F.lit("row:")))
    places = keyed.filter(F.col("confidence").isNotNull()).groupBy("_key", "confidence").agg(F.min(pos).alias("_p"))
    higher = Window.partitionBy("_key").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    fillers = places.withColumn("_m", F.min("_p").over(higher)).filter("_p = _m").select(F.col("_key").alias("_k"), "_p")
    # a shuffle, whatever the sizes: it deals rows out by key and place, and cleaned texts are made once, before it
    marked = keyed.join(fillers.hint("shuffle_merge"), (F.col("_key") == F.col("_k")) & (F.col(pos) == F.col("_p")), "left")
    marked = marked.withColumn("_over", F.col("_k").isNull() & F.col("confidence").isNotNull()).drop("_k", "_p")
    over, fill = F.col("_over"), ~F.col("_over")
    # bases from the latest back, then fillers from the earliest on
    rank = F.when(over, -F.col(pos).cast("long")).otherwise(F.col(pos).cast("long"))
    marked = marked.withColumn("_rank", F.struct(F.when(over, 0).otherwise(1).alias("g"), rank.alias("r")))
    out, united = [], []
    for f in articles.schema.fields:
        c, kind = F.col(f.name), f.dataType
        if f.name == pos:
            out.append(F.min(pos).alias(pos))
        elif f.name == "confidence":
            out.append(F.max(c).alias(f.name))
        elif f.name == "authors":
            longest = F.struct(F.size(c).alias("n"), F.when(over, F.col(pos).cast("long")).otherwise(-F.col(pos).cast("long") - (1 << 40)).alias("p"))
            out.append(F.max_by(c, longest).alias(f.name))
        elif f.name in ("abstract", "abstract_source"):
            better = F.struct((text_of("abstract") != "").alias("a"), abstract_priority("abstract_source").alias("p"), abstract_score("abstract", "title", "abstract_source").alias("s"), F.when(over, F.col(pos).cast("long")).otherwise(-F.col(pos).cast("long") - (1 << 40)).alias("o"))
            out.append(F.max_by(c, better).alias(f.name))
        elif f.name in LIST_FIELDS or f.name == "pdf_candidates":
            united.append(f)
        elif f.name in INCOMING_WINS:
            late = F.struct(F.when(fill, 1).otherwise(0).alias("g"), F.when(fill, F.col(pos).cast("long")).otherwise(-F.col(pos).cast("long")).alias("r"))
            out.append(F.max_by(c, F.when(c.isNotNull(), late)).alias(f.name))
        elif isinstance(kind, ArrayType) or kind.simpleString() != "string":
            out.append(F.min_by(c, F.when(c.isNotNull(), F.col("_rank"))).alias(f.name))
        else:
            out.append(F.coalesce(F.min_by(c, F.when(text_of(c) != "", F.col("_rank"))), F.lit("")).alias(f.name))
    merged = marked.groupBy("_key").agg(*out, F.count("*").alias("n_merged"))
    for fields, identity in (([f for f in united if f.name != "pdf_candidates"], lambda v: F.lower(v)), ([f for f in united if f.name == "pdf_candidates"], lambda v: v["url"])):
        if fields:
            merged = merged.join(_united(marked, fields, identity), "_key", "left")
    for f in united:
        merged = merged.withColumn(f.name, F.coalesce(f.name, F.array().cast(f.dataType)))
    return merged.select(*articles.columns, "n_merged")


def _united(marked: DataFrame, fields, identity) -> DataFrame:
    """(_key, field, ...): each field's distinct values in the order of their first row and place."""
    def places(f, number: int) -> Column:
        values = F.filter(F.coalesce(F.col(f.name), F.array().cast(f.dataType)), lambda v: v.isNotNull() & (identity(v) != ""))
        return F.transform(values, lambda v, i: F.struct(F.lit(number).alias("field"), i.alias("i"), v.alias("v")))

    rows = marked.select("_key", "_rank", F.explode(F.concat(*[places(f, k) for k, f in enumerate(fields)])).alias("e"))
    rows = rows.select("_key", F.col("e.field").alias("field"), identity(F.col("e.v")).alias("_id"), F.struct("_rank", "e.i").alias("at"), F.col("e.v").alias("v"))
    first = rows.groupBy("_key", "field", "_id").agg(F.min("at").alias("at"), F.min_by("v", "at").alias("v"))

    def in_order(number: int) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == number, F.struct("at", "v")))), lambda x: x["v"])

    return first.groupBy("_key").agg(*[in_order(k).alias(f.name) for k, f in enumerate(fields)])


def dedupe_by_url(candidates: Column) -> Column:
    """Candidates with distinct non-empty URLs, first wins."""
    urls = F.transform(candidates, lambda x: x["url"])
    return F.filter(candidates, lambda x, i: (x["url"] != "") & (F.array_position(urls, x["url"]) == i + 1))


def best_by_doi(hits: DataFrame, doi: Column, best: str = "citations", pos: str = "pos") -> DataFrame:
    """Per DOI the hit with the most citations (the earliest of equals) in the place of the first; others stay."""
    key = F.coalesce(nonempty(doi), F.concat(F.lit("row:"), F.col(pos).cast("string")))
    order = F.struct(F.coalesce(F.col(best), F.lit(0)).alias("b"), (-F.col(pos).cast("long")).alias("p"))
    # one aggregate, combined on the map side: a DOI of any number of hits moves one row a task
    one = hits.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*hits.columns), order).alias("_hit"), F.min(pos).alias("_slot"))
    return one.select(*[F.col("_slot").alias(c) if c == pos else F.col(f"_hit.`{c}`").alias(c) for c in hits.columns])


def dedupe_candidates(hits: DataFrame, doi: Column, pos: str = "pos") -> DataFrame:
    """As ``best_by_doi``; of hits without a DOI, the first of each title."""
    has = doi != ""
    with_doi = best_by_doi(hits.filter(has), doi, pos=pos)
    rest = hits.filter(~has).withColumn("_key", F.coalesce(nonempty(match_key("title")), F.concat(F.lit("row:"), F.col(pos).cast("string"))))
    first = rest.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(pos))).filter("_n = 1").drop("_key", "_n")
    return with_doi.unionByName(first)


def duplicate_groups(df: DataFrame, value: Column) -> DataFrame:
    """(value, n) of non-empty values that occur more than once."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).filter("n > 1 and value <> ''")


def version_pairs(*records: DataFrame) -> DataFrame:
    """(version_key, dois): titles that occur under more than one DOI among all records."""
    rows = None
    for r in records:
        r = r.select(compact_title_key("title").alias("version_key"), normalize_doi("doi").alias("doi"))
        rows = r if rows is None else rows.union(r)
    groups = rows.filter("version_key <> '' and doi <> ''").groupBy("version_key").agg(F.array_sort(F.collect_set("doi")).alias("dois"))
    return groups.filter(F.size("dois") > 1)
