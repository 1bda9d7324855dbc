"""Enrichment by lookups: journal ranks, metadata snapshots, links, open-access places.

Dimensions come as DataFrames of any size: Spark broadcasts one only when its size estimate is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, so no hint is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import abstract_priority, abstract_score
from ..functions.text import distinct_ci, journal_key, nonempty, normalize_doi, text_of
from .resolve import dedupe_by_url


def _dimension(ranks: DataFrame, key: str) -> DataFrame:
    keyed = ranks.withColumn(key, journal_key("name"))
    return keyed.groupBy(key).agg(*[F.min_by(c, F.struct("name", "tier", "level")).alias(f"_{key}_{c}") for c in ("name", "tier", "level", "impact_factor")])


def rank_lookup(df: DataFrame, journal: str, ranks: DataFrame, aliases: DataFrame, alias_first: bool = True, strip_characters: bool = False) -> DataFrame:
    """Left lookup of journals in the rank table, directly and through aliases.

    Adds rank_name, rank_tier, rank_level, rank_if and rank_source (offline or not_found). With
    ``alias_first`` an alias beats a direct name.
    """
    direct = _dimension(ranks, "d")
    named = aliases.select(journal_key("alias").alias("a"), journal_key("name").alias("t")).groupBy("a").agg(F.min("t").alias("t"))
    via = named.join(_dimension(ranks, "d").toDF(*["t", *[f"_a_{c}" for c in ("name", "tier", "level", "impact_factor")]]), "t").drop("t")
    out = df.withColumn("_j", journal_key(journal, strip_characters)).join(direct, F.col("_j") == F.col("d"), "left").join(via, F.col("_j") == F.col("a"), "left")
    pick = ("_a", "_d_") if alias_first else ("_d_", "_a")
    sides = {"_a": lambda c: F.col(f"_a_{c}"), "_d_": lambda c: F.col(f"_d_{c}")}
    found = {c: F.when(sides[pick[0]]("name").isNotNull(), sides[pick[0]](c)).otherwise(sides[pick[1]](c)) for c in ("name", "tier", "level", "impact_factor")}
    out = out.withColumns({"rank_name": found["name"], "rank_tier": found["tier"], "rank_level": found["level"], "rank_if": found["impact_factor"]})
    out = out.withColumn("rank_source", F.when(F.col("rank_name").isNull(), "not_found").otherwise("offline"))
    return out.drop("_j", "d", "a", *[f"_{s}_{c}" for s in ("a", "d") for c in ("name", "tier", "level", "impact_factor")])


def rank_label() -> Column:
    """"[tier-level] IF=x" of a looked-up rank, '' when not found."""
    factor = F.when(F.col("rank_if").isNotNull(), F.concat(F.lit(" IF="), F.col("rank_if").cast("string"))).otherwise("")
    return F.when(F.col("rank_source") == "offline", F.concat(F.lit("["), F.col("rank_tier"), F.lit("-"), F.col("rank_level"), F.lit("]"), factor)).otherwise("")


def missing_keys(requested: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Requested keys that a cache or table does not hold yet."""
    return requested.select(key).distinct().join(stored.select(key).distinct(), key, "left_anti")


def fresh_entries(cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Cache entries not older than ``days``; newest of each key."""
    live = cache.filter(F.col("fetched_at") >= now - F.make_dt_interval(F.lit(days)))
    return live.groupBy("key").agg(F.max_by("value", "fetched_at").alias("value"), F.max("fetched_at").alias("fetched_at"))


def merge_articles(left: DataFrame, right: DataFrame, on: str = "doi") -> DataFrame:
    """Fill articles from one further snapshot: base values stay, gaps are filled, lists united.

    ``right`` holds at most one row per key; repeated ones are reduced to the most confident.
    """
    names = [c for c in left.columns if c in right.columns and c not in (on, "pos")]
    extra = right.filter(text_of(on) != "").groupBy(on).agg(*[F.max_by(c, F.struct(F.coalesce("confidence", F.lit(0.0)), text_of("title"))).alias(f"_r_{c}") for c in names]).withColumnRenamed(on, "_k")
    both = left.join(extra, (F.col(on) == F.col("_k")) & (F.col(on) != ""), "left")
    hit, out = F.col("_k").isNotNull(), []
    for c in left.columns:
        b, e = F.col(c), F.col(f"_r_{c}")
        kind = left.schema[c].dataType.simpleString()
        if c not in names:
            out.append(b)
        elif c == "confidence":
            out.append(F.greatest(b, e).alias(c))
        elif c == "citation_count":
            out.append(F.coalesce(e, b).alias(c))
        elif c == "journal_rank":
            out.append(F.coalesce(e, b).alias(c))
        elif c == "authors":
            out.append(F.when(hit & (F.size(e) > F.size(b)), e).otherwise(b).alias(c))
        elif c in ("abstract", "abstract_source"):
            ra, rs = F.col("_r_abstract"), F.col("_r_abstract_source")
            better = (text_of("abstract") == "") | (abstract_priority(rs) > abstract_priority("abstract_source")) | ((abstract_priority(rs) == abstract_priority("abstract_source")) & (abstract_score(ra, F.col("title"), rs) > abstract_score("abstract", "title", "abstract_source")))
            out.append(F.when(hit & (text_of(ra) != "") & better, e).otherwise(b).alias(c))
        elif c == "metadata_source":
            out.append(F.when(hit & (text_of(e) != "") & ~F.array_contains(F.split(text_of(b), r"\+"), text_of(e)), F.concat_ws("+", nonempty(b), nonempty(e))).otherwise(b).alias(c))
        elif kind == "array<string>":
            out.append(F.when(hit, distinct_ci(F.concat(b, e))).otherwise(b).alias(c))
        elif c == "pdf_candidates":
            out.append(F.when(hit, dedupe_by_url(F.concat(b, e))).otherwise(b).alias(c))
        elif kind == "string":
            out.append(F.coalesce(nonempty(b), nonempty(e), F.lit("")).alias(c))
        else:
            out.append(F.coalesce(b, e).alias(c))
    return both.select(*out)


def enrich(articles: DataFrame, by_doi: list[DataFrame] = (), by_pmid: DataFrame | None = None, by_arxiv: DataFrame | None = None, by_title: list[DataFrame] = ()) -> DataFrame:
    """Chain of lookups: DOI snapshots in order, PubMed and arXiv ids, then titles while the DOI is empty."""
    from ..functions.text import title_key

    out = articles
    for source in by_doi:
        out = merge_articles(out, source, "doi")
    if by_pmid is not None:
        out = merge_articles(out, by_pmid, "pmid")
    if by_arxiv is not None:
        out = merge_articles(out, by_arxiv, "arxiv_id")
    for source in by_title:
        keyed = out.withColumn("_title_key", F.when(F.col("doi") == "", title_key("title")).otherwise(""))
        donor = source.withColumn("_title_key", title_key("title"))
        found = merge_articles(keyed.drop("doi").withColumn("_doi", F.col("_title_key")), donor.drop("doi"), "_title_key").drop("_doi")
        dois = donor.filter("doi <> ''").groupBy("_title_key").agg(F.min("doi").alias("_new"))
        back = keyed.select("pos", F.col("doi").alias("_old"))
        out = found.join(back, "pos").join(dois, "_title_key", "left").withColumn("doi", F.coalesce(nonempty(F.col("_old")), F.col("_new"), F.lit(""))).select(articles.columns)
    return out


def overlay(left: DataFrame, right: DataFrame, on: str, fields, right_wins: bool, last_by: str | None = None) -> DataFrame:
    """Left join that merges ``fields``: non-empty values of the right (or left) side win.

    Of right rows that repeat a key the last by ``last_by`` counts. Adds ``changed``: whether any field differs.
    """
    order = F.col(last_by) if last_by else F.struct(*[text_of(c) for c in fields])
    keyed = right.withColumn("_k", normalize_doi(on) if on == "doi" else F.col(on)).filter(text_of("_k") != "").groupBy("_k").agg(*[F.max_by(c, order).alias(f"_r_{c}") for c in fields])
    both = left.join(keyed, (normalize_doi(on) if on == "doi" else F.col(on)) == F.col("_k"), "left")
    merged = {c: F.coalesce(*((nonempty(F.col(f"_r_{c}")), F.col(c)) if right_wins else (nonempty(F.col(c)), F.col(f"_r_{c}"))), F.lit("")) for c in fields}
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~text_of(c).eqNullSafe(text_of(merged[c]))
    both = both.withColumn("changed", changed)
    return both.withColumns(merged).select(*left.columns, "changed")


def open_access_candidates(articles: DataFrame, *lookups: Column) -> DataFrame:
    """``pdf_candidates`` completed: own ones, the PDF link, arXiv, then the given lookup columns; distinct URLs."""
    def one(url, source, status=None):
        c = F.struct(text_of(url).alias("url"), F.lit(source).alias("source") if isinstance(source, str) else source.alias("source"), text_of("license").alias("license"), (text_of("oa_status") if status is None else F.coalesce(nonempty("oa_status"), F.lit(status))).alias("oa_status"))
        return F.array(c)

    arx = F.when(F.col("arxiv_id") != "", F.concat(F.lit("https://arxiv.org/pdf/"), F.col("arxiv_id"))).otherwise("")
    link = one("pdf_url", F.when(F.col("arxiv_id") != "", "arXiv").otherwise("publisher-provided PDF link"))
    parts = [F.col("pdf_candidates"), link, one(arx, "arXiv", "green"), *[F.coalesce(x, F.array().cast(articles.schema["pdf_candidates"].dataType)) for x in lookups]]
    return articles.withColumn("pdf_candidates", dedupe_by_url(F.concat(*parts)))


def first_available(*lookups: Column) -> Column:
    """First non-empty of several lookups, in order."""
    return F.coalesce(*map(nonempty, lookups), F.lit(""))


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """Per record the first attempt that downloaded, else the last one tried."""
    ok = F.col("status") == "downloaded"
    rank = F.when(ok, F.col("attempt")).otherwise(1_000_000 - F.col("attempt"))
    return attempts.groupBy(key).agg(*[F.min_by(c, F.struct((~ok).alias("f"), rank.alias("r"))).alias(c) for c in ("url", "source", "status")])


def downloaded_kind(content: Column) -> Column:
    """Whether bytes are a PDF, by their first four."""
    return F.when(F.hex(F.substring(content, 1, 4)) == "25504446", "downloaded").otherwise("skipped_non_pdf")


def rank_rows(requested: DataFrame, ranks: DataFrame, aliases: DataFrame, kind: str = "kind", value: str = "value") -> DataFrame:
    """A row per request (kind "journal" or "issn"): its rank and source, "not_found" where the table lacks it.

    The table is by journal name; an ISSN is found where ``ranks`` has a column issn.
    """
    if "issn" in ranks.columns:
        names = ranks.select(F.explode(F.split(F.lower("issn"), r"[;,\s]+")).alias("_i"), F.col("name").alias("_n")).filter("_i <> ''").groupBy("_i").agg(F.min("_n").alias("_n"))
        asked = requested.join(names, (F.lower(kind) == "issn") & (F.lower(F.trim(value)) == F.col("_i")), "left")
        asked = asked.withColumn("_journal", F.when(F.lower(kind) == "issn", F.col("_n")).otherwise(F.col(value))).drop("_i", "_n")
    else:
        asked = requested.withColumn("_journal", F.when(F.lower(kind) != "issn", F.col(value)))
    return rank_lookup(asked, "_journal", ranks, aliases).drop("_journal")


def rank_online_first(df: DataFrame, journal: str, online: DataFrame, ranks: DataFrame, aliases: DataFrame) -> DataFrame:
    """``df`` with ``tier``: the label of an online snapshot (journal, label), else that of the offline table."""
    live = online.select(F.lower(F.trim("journal")).alias("_live"), "label").groupBy("_live").agg(F.max("label").alias("_label"))
    both = rank_lookup(df, journal, ranks, aliases).join(live, F.lower(F.trim(journal)) == F.col("_live"), "left")
    return both.withColumn("tier", F.coalesce(nonempty("_label"), rank_label())).select(*df.columns, "tier")


def request_batches(requested: DataFrame, stored: DataFrame, key: str, size: int = 5, most: int = 20) -> DataFrame:
    """(batch, keys) of what an online service is to be asked: the first distinct keys not stored, a few at a time."""
    from pyspark.sql import Window

    first = missing_keys(requested, stored, key).filter(text_of(key) != "").orderBy(key).limit(most)
    placed = first.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size).cast("int"))
    return placed.groupBy("batch").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def stored_entries(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache (key, value, fetched_at) after a fetch: of each key the newest entry."""
    return cache.unionByName(fetched).groupBy("key").agg(F.max_by("value", "fetched_at").alias("value"), F.max("fetched_at").alias("fetched_at"))


def changed_rows(overlaid: DataFrame) -> DataFrame:
    """One row (rows, changed) of an overlay."""
    return overlaid.agg(F.count("*").alias("rows"), F.count_if("changed").alias("changed"))
