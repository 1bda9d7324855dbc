"""Term tagging by rule tables and the article-term network.

Rules are data: (name, category, patterns). Expressions are generated from them, so a new rule needs
no code. Relations between articles come from equi-joins on terms, never from all pairs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import folded, may_match
from ..functions.text import col, compact_title_key, nonempty, normalize_doi, text_of

BEFORE, AFTER = 90, 140


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    patterns: tuple[str, ...]
    exact: bool = False  # case counts, but where a pattern says otherwise

    @property
    def pattern(self) -> str:
        return f"({'?U' if self.exact else '?iU'})(?:" + "|".join(f"(?:{p})" for p in self.patterns) + ")"

    def found_in(self, text: Column, low: Column) -> Column:
        """Whether a pattern matches; ``low`` is the text as ``folded`` gives it.

        Patterns are tried where the text holds a literal that they need; plain letters are found faster in lower case.
        """
        joined = "|".join(f"(?:{p})" for p in self.patterns)
        if self.exact or re.search(r"\\[A-Zp]|\(\?", joined.replace("(?:", "")):
            hit = text.rlike(self.pattern)  # lowering the pattern would change what an escape or a group means
        else:
            hit = low.rlike("(?U)(?:" + joined.lower() + ")")
        first = may_match(low, self.patterns)
        return hit if first is None else F.when(first, hit).otherwise(False)


def tag_names(text, rules) -> Column:
    """Names of the rules that match, in rule order."""
    return F.array_compact(F.array(*[F.when(text_of(text).rlike(r.pattern), r.name) for r in rules]))


def tagged(texts: dict[str, Column], rules, low: dict[str, Column] | None = None, excerpts: bool = True) -> Column:
    """Array of (rule_no, name, category, source_field, excerpt): the rules that match, in their order.

    ``texts``: column by field name, in the order in which fields are searched; evidence is the first
    field with a match, of its match by the first pattern that has one. The excerpt reaches from 90
    characters before it to 140 after. Rules of one name count once, by the first that matches.
    Each rule tests a field once; excerpts are cut for the rules that match only. The texts should be
    plain columns: an expression would be evaluated for each rule. Without ``excerpts`` these are null.
    """
    fields, columns = F.array(*map(F.lit, texts)), F.array(*texts.values())
    lows = low or {f: folded(t) for f, t in texts.items()}
    hits = []
    for i, r in enumerate(rules):
        where = None
        for k, (f, t) in enumerate(texts.items()):
            where = (F if where is None else where).when(r.found_in(t, lows[f]), F.struct(F.lit(i).alias("rule_no"), F.lit(k + 1).alias("field_no")))
        hits.append(where)
    table = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.category).alias("category"), F.array(*[F.lit(f"({'?U' if r.exact else '?iU'}){p}") for p in r.patterns]).alias("patterns")) for r in rules])

    def full(h: Column) -> Column:
        rule, text = F.element_at(table, h["rule_no"] + 1), F.element_at(columns, h["field_no"])
        known = (h["rule_no"].alias("rule_no"), rule["name"].alias("name"), rule["category"].alias("category"), F.element_at(fields, h["field_no"]).alias("source_field"))
        if not excerpts:
            return F.struct(*known, F.lit(None).cast("string").alias("excerpt"))
        pattern = F.get(F.filter(rule["patterns"], lambda p: F.regexp_instr(text, p) > 0), F.lit(0))
        at, size = F.regexp_instr(text, pattern), F.length(F.regexp_substr(text, pattern))
        start = F.greatest(at - BEFORE, F.lit(1))
        excerpt = F.trim(F.substring(text, start, at - start + size + AFTER))
        return F.struct(*known, excerpt.alias("excerpt"))

    out = F.transform(F.array_compact(F.array(*hits)), full)
    if len({r.name.lower() for r in rules}) == len(rules):
        return out
    names = F.transform(out, lambda t: F.lower(t["name"]))
    return F.filter(out, lambda t, i: F.array_position(names, F.lower(t["name"])) == i + 1)


def once(c: Column) -> Column:
    """The value as a generated column: expressions above read it, where a projected one would be computed in each."""
    return F.explode(F.array(c))


def tag_terms(df: DataFrame, rules, fields, key: str = "pos") -> DataFrame:
    """(key, rule_no, name, category, source_field, excerpt): a row per article and matching rule, see ``tagged``."""
    texts = {f: text_of(F.array_join(col(f), " ") if df.schema[f].dataType.simpleString().startswith("array") else col(f)) for f in fields}
    made = df.select(key, *[t.alias(f"_t_{f}") for f, t in texts.items()], *[folded(t).alias(f"_l_{f}") for f, t in texts.items()])
    hits = tagged({f: F.col(f"_t_{f}") for f in texts}, rules, {f: F.col(f"_l_{f}") for f in texts})
    return made.select(key, once(hits).alias("hits")).select(key, F.explode("hits").alias("h")).select(key, "h.*")


def derived_terms(names, rules) -> Column:
    """Names that set rules add: (name, all of these, any of those), not in the list already."""
    n = col(names)
    out = []
    for name, required, alternatives in rules:
        hit = F.lit(True)
        for r in required:
            hit = hit & F.array_contains(n, r)
        if alternatives:
            hit = hit & F.arrays_overlap(n, F.array(*map(F.lit, alternatives)))
        out.append(F.when(hit, name))
    return F.array_except(F.array_compact(F.array(*out)), n)


def first_label(cases, default: str) -> Column:
    """Label of the first condition that holds."""
    out = None
    for condition, label in cases:
        out = (F if out is None else out).when(condition, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def categories_map(terms: DataFrame, key: str = "pos") -> DataFrame:
    """(key, terms_by_category): sorted map of category to term names in rule order."""
    by = terms.groupBy(key, "category").agg(F.array_sort(F.collect_list(F.struct("rule_no", "name"))).alias("t"))
    by = by.select(key, "category", F.transform("t", lambda x: x["name"]).alias("names"))
    return by.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "names")))).alias("terms_by_category"))


def shared_term_relations(terms: DataFrame, key: str = "pos", least: int = 2, most_articles: int | None = None) -> DataFrame:
    """(source, target, n_shared, shared_terms) of article pairs with at least ``least`` terms in common.

    The output has a row per linked pair, so it is for vocabularies of specific terms: two terms that
    mark most of a corpus link most pairs (``term_set_links`` gives the same between sets). ``most_articles`` names a bound above which a term is
    taken as unspecific (none by default: every term counts).
    """
    t = terms.select(key, "name").distinct()
    if most_articles is not None:
        common = t.groupBy("name").count().filter(F.col("count") > most_articles).select("name")
        t = t.join(common, "name", "left_anti")
    sets = t.groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("names"))
    met = overlapping(sets.select(key, "names"), sets.select(F.col(key).alias("other"), F.col("names").alias("others")), least).filter(F.col(key) < F.col("other"))
    return met.select(F.col(key).alias("source"), F.col("other").alias("target"), F.size("shared_terms").cast("long").alias("n_shared"), "shared_terms")


def _keys(names: Column, least: int) -> Column:
    """Join keys of a sorted set: its names, or its pairs of names if two or more must agree."""
    if least < 2:
        return F.transform(names, lambda x: F.struct(x.alias("x"), F.lit("").alias("y")))
    pairs = F.transform(names, lambda x, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    return F.flatten(pairs)


def overlapping(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """Rows of ``left`` (with ``names``) and of ``right`` (with ``others``) whose sorted sets share ``least`` names, and ``shared_terms``.

    From two names on sets meet on pairs of names, so a name that most sets hold joins only in combination
    and, for two, what meets is what links. A pair of rows is given where its first common pair meets.
    """
    first = F.struct(F.get("shared_terms", F.lit(0)).alias("x"), (F.get("shared_terms", F.lit(1)) if least >= 2 else F.lit("")).alias("y"))
    a = left.withColumn("_k", F.explode(_keys(F.col("names"), least)))
    b = right.withColumn("_j", F.explode(_keys(F.col("others"), least)))
    met = a.join(b, (F.col("_k.x") == F.col("_j.x")) & (F.col("_k.y") == F.col("_j.y"))).withColumn("shared_terms", F.array_intersect("names", "others"))
    return met.filter((F.size("shared_terms") >= least) & (F.col("_k") == first)).drop("_k", "_j")


def term_sets(terms: DataFrame, key: str = "pos") -> DataFrame:
    """(key, names): the sorted set of an article's terms, a row per article with terms."""
    return terms.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("names"))


def term_set_links(terms: DataFrame, key: str = "pos", least: int = 2) -> DataFrame:
    """(names_a, names_b, shared_terms, n_a, n_b) of term sets with at least ``least`` terms in common, names_a <= names_b.

    Every pair of ``shared_term_relations`` is a pair of articles of linked sets, found by joining
    ``term_sets``; a set is linked to itself when two articles have it. Rows are bounded by the sets
    that occur, not by articles.
    """
    sets = term_sets(terms, key).groupBy("names").agg(F.count("*").alias("n")).filter(F.size("names") >= least)
    met = overlapping(sets.select("names", F.col("n").alias("n_a")), sets.select(F.col("names").alias("others"), F.col("n").alias("n_b")), least)
    kept = met.filter("names < others or (names = others and n_a > 1)")
    return kept.select(F.col("names").alias("names_a"), F.col("others").alias("names_b"), "shared_terms", "n_a", "n_b")


def term_cooccurrence(terms: DataFrame, key: str = "pos") -> DataFrame:
    """(term_a, term_b, n) of terms in the same article: bounded by the vocabulary, whatever the corpus."""
    names = terms.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("n"))
    pairs = names.select(F.explode(F.flatten(F.transform("n", lambda x, i: F.transform(F.slice("n", i + 2, F.size("n")), lambda y: F.struct(x.alias("term_a"), y.alias("term_b")))))).alias("p"))
    return pairs.groupBy("p.term_a", "p.term_b").agg(F.count("*").alias("n"))


def contrast_relations(terms: DataFrame, contrasts: DataFrame, key: str = "pos") -> DataFrame:
    """(term_a, term_b, note, n_a, n_b): for each contrast rule, how many articles stand on each side.

    Sides instead of article pairs: a pair list of two large sides would be their product.
    """
    n = terms.select(key, "name").distinct().groupBy("name").agg(F.count("*").alias("n"))
    left = contrasts.join(n.withColumnRenamed("name", "term_a").withColumnRenamed("n", "n_a"), "term_a")
    return left.join(n.withColumnRenamed("name", "term_b").withColumnRenamed("n", "n_b"), "term_b").select("term_a", "term_b", "note", "n_a", "n_b")


def contrast_members(terms: DataFrame, contrasts: DataFrame, key: str = "pos") -> DataFrame:
    """(term_a, term_b, note, side, key): the articles on each side of each contrast rule.

    Every article of side a with every other one of side b is a contrast pair.
    """
    t = terms.select(key, "name").distinct()
    sides = contrasts.select("term_a", "term_b", "note", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("term_a").alias("name")), F.struct(F.lit("b").alias("side"), F.col("term_b").alias("name")))).alias("s")).select("term_a", "term_b", "note", "s.*")
    return t.join(F.broadcast(sides), "name").select("term_a", "term_b", "note", "side", key)


def version_members(articles: DataFrame, key: str = "pos") -> DataFrame:
    """(version_key, key, doi): all records of titles that two or more records share; any two are a version pair."""
    a = articles.select(compact_title_key("title").alias("version_key"), key, normalize_doi("doi").alias("doi")).filter("version_key <> ''")
    groups = a.groupBy("version_key").agg(F.count("*").alias("n")).filter("n > 1").select("version_key")
    return a.join(groups, "version_key").select("version_key", key, "doi")


def version_relations(articles: DataFrame, key: str = "pos") -> DataFrame:
    """(source, target): every further record of a title points to the first with another DOI."""
    a = articles.select(F.col(key).alias("k"), compact_title_key("title").alias("v"), normalize_doi("doi").alias("d")).filter("v <> ''")
    w = Window.partitionBy("v")
    lead = a.withColumns({"source": F.min("k").over(w), "lead_doi": F.min_by("d", "k").over(w)})
    return lead.filter("k > source and d <> lead_doi").select("source", F.col("k").alias("target"))


def fold_versions(articles: DataFrame, is_preprint: Column, key: str = "pos") -> DataFrame:
    """(version_key, primary, n_versions): the first record that is no preprint, else the first."""
    rows = articles.select(F.coalesce(nonempty(compact_title_key("title")), F.concat(F.lit("row:"), F.col(key).cast("string"))).alias("version_key"), F.col(key), is_preprint.cast("int").alias("p"))
    return rows.groupBy("version_key").agg(F.min_by(key, F.struct("p", key)).alias("primary"), F.count("*").alias("n_versions"))


def build_nodes(terms: DataFrame, articles: DataFrame, key: str = "pos", most: int = 12) -> DataFrame:
    """(category, name, n_articles, articles): term nodes with their first ``most`` articles.

    Names agree in lower case; the first display name counts. Articles are ranked before they are
    gathered, so a frequent term's list never grows beyond ``most`` in memory.
    """
    one = terms.select("category", F.lower("name").alias("low"), F.col(key), "rule_no", "name").groupBy("category", "low", key).agg(F.min_by("name", "rule_no").alias("name"))
    total = one.groupBy("category", "low").agg(F.count("*").alias("n_articles"), F.min_by("name", key).alias("name"))
    ranked = one.withColumn("n", F.row_number().over(Window.partitionBy("category", "low").orderBy(key))).filter(F.col("n") <= most)
    titled = ranked.select("category", "low", key).join(articles.select(key, "title"), key)
    shown = titled.groupBy("category", "low").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "title"))), lambda x: x["title"]).alias("articles"))
    return total.join(shown, ["category", "low"]).select("category", F.col("low").alias("name_key"), "name", "n_articles", "articles")


def top_terms(terms: DataFrame, n: int = 15, key: str = "pos") -> DataFrame:
    """(name, n, first_seen) of the most frequent terms; ties by first appearance."""
    seen = F.min(F.struct(key, "rule_no")).alias("first")
    return terms.groupBy("name").agg(F.count("*").alias("n"), seen).select("name", "n", F.col(f"first.{key}").alias("first_seen"), F.col("first.rule_no").alias("rule_no")).orderBy(F.desc("n"), "first_seen", "rule_no").limit(n)


def evidence_links(questions: DataFrame, terms: DataFrame, articles: DataFrame, most: int, key: str = "pos") -> DataFrame:
    """(question, number, doi, title): distinct articles for each question's terms, the first ``most``.

    ``questions``: question, term (one row per term).
    """
    q = questions.select("question", F.lower("term").alias("low"))
    hit = terms.select(key, F.lower("name").alias("low")).distinct().join(q, "low").select("question", key).distinct()
    rows = hit.join(articles.select(key, normalize_doi("doi").alias("doi"), "title"), key).withColumn("ident", F.coalesce(nonempty("doi"), F.lower("title")))
    first = rows.groupBy("question", "ident").agg(F.min(key).alias(key), F.min_by("doi", key).alias("doi"), F.min_by("title", key).alias("title"))
    ranked = first.withColumn("number", F.row_number().over(Window.partitionBy("question").orderBy(key)))
    return ranked.filter(F.col("number") <= most).select("question", "number", "doi", "title")


def notes_holding_doi(articles: DataFrame, inventory: DataFrame, key: str = "pos") -> DataFrame:
    """(key, doi, path) where exactly one note holds the article's DOI: an equi-join on extracted DOIs."""
    a = articles.select(key, normalize_doi("doi").alias("doi")).filter("doi <> ''")
    n = inventory.select(F.explode("dois").alias("doi"), "path").distinct().groupBy("doi").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    return a.join(n, "doi").select(key, "doi", "path")


def literal(text: str) -> str:
    return re.escape(text)
