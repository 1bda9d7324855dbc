"""Registered queries of the research network: the default vocabulary over records with terms in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import LIT, query
from .operators import research as G
from .operators import terms as M
from .operators import vocabulary as V
from .sources import derived as D


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm(c: str) -> str:
    out = f"translate(coalesce({c}, ''), '−‐‑‒–—', '------')"
    for pattern, by in ((r"C\(sp\s*3\s*\)", "C(sp3)"), (r"C\s*sp\s*3", "C(sp3)"), (r"S\s*H\s*2", "SH2")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'gi')"
    return rf"trim(regexp_replace({out}, '[\s\x0B\x85\p{{Z}}]+', ' ', 'g'))"


def _rules(name: str, rules) -> str:
    rows = ", ".join(f"({i}, {_text(r.name)}, {_text(r.category)}, [{', '.join(map(_text, r.patterns))}])" for i, r in enumerate(rules))
    return f"{name}(rule_no, name, category, pats) as (values {rows})"


def _tagged(name: str, rules: str) -> str:
    """Terms of ``rr`` by the rules, with excerpts."""
    any_of = "'(?:' || array_to_string(pats, ')|(?:') || ')'"
    hit = " ".join(f"when regexp_matches(t{k}, {any_of}, 'i') then {k}" for k in (1, 2, 3, 4))
    return (
        f"{name}0 as (select *, case when f = 1 then t1 when f = 2 then t2 when f = 3 then t3 else t4 end as txt from (select pos, rule_no, name, category, pats, t1, t2, t3, t4, case {hit} end as f from rr, {rules}) where f is not null), "
        f"{name}1 as (select *, list_filter(pats, lambda p: regexp_matches(txt, p, 'i'))[1] as p from {name}0), "
        f"{name}2 as (select *, length(regexp_extract(txt, '^(.*?)(?:' || p || ')', 1, 'is')) as pre, length(regexp_extract(txt, p, 0, 'i')) as m from {name}1), "
        f"{name} as (select pos, rule_no, name, category, ['title', 'abstract', 'keywords', 'concepts'][f] as source_field, trim(substr(txt, greatest(pre - 89, 1), pre + 1 - greatest(pre - 89, 1) + m + 140)) as excerpt from {name}2)"
    )


_RR = f"{LIT}, {D.RESEARCH_SQL}, rr as (select *, {_norm('title')} as t1, {_norm('abstract')} as t2, {_norm(chr(34) + 'kw' + chr(34))} as t3, {_norm('cc')} as t4 from (select *, array_to_string(keywords, '; ') as kw, array_to_string(concepts, '; ') as cc from research))"
_TR, _ER = _rules("tr", V.TERM_RULES), _rules("er", V.EVIDENCE_RULES)
_TERMS = f"{_RR}, {_TR}, {_tagged('te', 'tr')}"
_METHODS = f"{_RR}, {_ER}, {_tagged('ev', 'er')}"


def _has(*names: str) -> str:
    return f"list_has_any(names, [{', '.join(map(_text, names))}])"


def _all(*names: str) -> str:
    return f"list_has_all(names, [{', '.join(map(_text, names))}])"


_NAMED = "nm as (select rr.*, coalesce(names, []) as names, coalesce(cats, []) as cats, lower(t1 || ' ' || t2 || ' ' || t3 || ' ' || t4) as low from rr left join (select pos, list(name order by rule_no) as names, list_distinct(list(category)) as cats from te group by 1) using (pos))"
_PROJECT = f"""pt as (select pos, names, list_filter([
 case when {_has('radical cross-coupling', 'photoredox catalysis', 'decarboxylation', 'alkyl radical', 'single electron transfer')} then 'radical flux' end,
 case when {_all('electrochemistry', 'nickel catalyst')} or (contains(low, 'electrode') and contains(low, 'nickel')) then 'electrode-catalyst decoupling' end,
 case when {_has('SH2 mechanism', 'homolytic substitution', 'reductive elimination')} then 'SH2 vs reductive elimination' end,
 case when {_has('stereocontrol', 'chiral nickel catalyst')} then 'enantioselective radical capture' end,
 case when contains(low, 'nhpi') or {_has('carboxylic acid', 'carboxylic acid ester')} then 'NHPI ester SET axis' end], lambda x: x is not null and not list_contains(names, x)) as project from nm)"""
_NDOI = r"lower(regexp_replace(regexp_replace(regexp_replace(doi, '^https?://(dx\.)?doi\.org/', '', 'i'), '^doi:\s*', '', 'i'), '\)?[.,;:]*$', ''))"
_ROLE = f"""case when contains({_NDOI}, 'chemrxiv') or contains(lower(journal), 'chemrxiv') then 'preprint_version' when contains(lower(t1), 'review') or contains(lower(t1), 'paradigm shift') then 'review_context'
 when {_has('palladium catalyst', 'bismuth radical')} then 'contrast_control' when contains(lower(t1), 'c-n') or contains(lower(t1), 'carbon-nitrogen') or contains(lower(t1), 'amination') then 'adjacent_method'
 when {_has('chiral nickel catalyst', 'stereocontrol')} then 'core_asymmetric_ni_relevance' when {_all('nickel catalyst', 'C(sp3)-C(sp3) cross-coupling')} then 'core_ni_csp3_csp3_context'
 when {_has('C(sp3)-C(sp3) cross-coupling', 'radical cross-coupling')} then 'near_core_radical_coupling' else 'background_context' end"""
_SUMMARY = f"""case when {_has('SH2 mechanism', 'homolytic substitution')} then 'SH2/homolytic substitution' when {_has('alkylnickel intermediate')} then 'organonickel/alkylnickel' when {_has('radical recombination')} then 'radical-pair control'
 when {_all('photoredox catalysis', 'nickel catalyst')} then 'metallaphotoredox' when {_has('electrochemistry', 'photoelectrochemistry')} then 'electro/photo-mediated' when contains(lower(t1), 'review') or contains(lower(t1), 'paradigm shift') then 'review/background'
 else 'underdetermined' end"""
_MARKS = ("SH2/homolytic substitution", "organonickel/alkylnickel", "radical-pair control", "metallaphotoredox", "electro/photo-mediated", "review/background", "underdetermined")
_VKEY = "regexp_replace(lower(t1), '[^a-z0-9]+', '', 'g')"


def records(spark, sf):
    return D.research_records(spark, sf)


def analyses(spark, sf, excerpts: bool = True):
    return G.analysis_records(records(spark, sf), excerpts=excerpts)


@query(f"with {_TERMS} select pos, name, category, source_field, excerpt from te")
def research_terms(spark, sf):
    return analyses(spark, sf).select("pos", F.explode("terms").alias("t")).select("pos", "t.name", "t.category", "t.source_field", "t.excerpt")


@query(f"with {_METHODS} select pos, name, source_field, excerpt from ev")
def research_methods(spark, sf):
    return analyses(spark, sf).select("pos", F.explode("evidence_methods").alias("t")).select("pos", "t.name", "t.source_field", "t.excerpt")


@query(f"""with {_TERMS}, {_ER}, {_tagged('ev', 'er')}, {_NAMED}, {_PROJECT}, n as (select pos, count(*) as methods from ev group by 1)
select nm.pos, {_NDOI} as doi, array_to_string(names, '|') as terms, array_to_string(project, '|') as project_terms, coalesce(methods, 0) as n_methods, {_ROLE} as corpus_role, {_SUMMARY} as summary_mark, {_VKEY} as version_group_key,
 coalesce(nullif(concat_ws('; ', case when list_contains(cats, 'mechanism') then 'mechanistic radical or organometallic clue' end, case when list_contains(cats, 'method') then 'C(sp3) coupling or redox method' end, case when list_contains(cats, 'catalyst') then 'metal or catalyst context' end,
 case when len(project) > 0 then 'project-hypothesis connector' end), ''), 'background context only') as relevance_to_project, cast((t2 = '') as int) + cast((methods is null) as int) + cast((not list_contains(names, 'stereocontrol')) as int) as n_limitations
from (select * exclude (names) from nm) nm join pt using (pos) left join n using (pos)""")
def analysis_records(spark, sf):
    a, none = analyses(spark, sf), F.lit(None).cast("string")
    mark = F.coalesce(*[F.when(F.contains("mechanistic_summary", F.lit(m)), m) for m in _MARKS], none)
    names = lambda c: F.array_join(F.transform(c, lambda t: t["name"]), "|")
    return a.select("pos", "doi", names("terms").alias("terms"), names("project_relevance_terms").alias("project_terms"), F.size("evidence_methods").cast("long").alias("n_methods"), "corpus_role", mark.alias("summary_mark"), "version_group_key", "relevance_to_project", F.size("limitations").alias("n_limitations"))


@query(f"with {_TERMS} select category, string_agg(name, '|' order by pos, rule_no) as names from (select * from (select *, row_number() over (partition by category order by pos, rule_no) as k from te) where k <= 20) group by 1")
def research_categories(spark, sf):
    """The first names of each category, out of the articles' category maps."""
    from pyspark.sql import Window

    each = analyses(spark, sf).select("pos", F.explode("terms_by_category").alias("category", "names")).select("pos", "category", F.posexplode("names").alias("i", "name"))
    ranked = each.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("pos", "i"))).filter("k <= 20")
    return ranked.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), "|").alias("names"))


@query(f"with {_TERMS}, {_NAMED} select corpus_role, count(*) as n from (select {_ROLE} as corpus_role from nm) group by 1")
def corpus_roles(spark, sf):
    return analyses(spark, sf).groupBy("corpus_role").agg(F.count("*").alias("n"))


_SIDES = ", ".join(sorted({_text(n) for pair in V.CONTRASTS for n in pair}))
_CLASSES = f"""ms as (select 'terms' as kind, array_to_string(list_sort(names), '|') as class, pos from nm where len(names) > 0 union all select 'version', {_VKEY}, pos from nm where {_VKEY} <> ''
 union all select 'term', x, pos from (select pos, unnest(names) as x from nm) where x in ({_SIDES})), gs as (select kind, class, count(*) as n from ms group by 1, 2)"""


@query(f"with {_TERMS}, {_NAMED}, {_CLASSES} select ms.kind, class, ms.pos, {_NDOI} as doi from ms join nm on nm.pos = ms.pos")
def relation_members(spark, sf):
    return G.relation_members(analyses(spark, sf))


@query(f"""with {_TERMS}, {_NAMED}, {_CLASSES}, sets as (select class, n, string_split(class, '|') as names from gs where kind = 'terms'), c(class_a, class_b) as (values {', '.join(f'({_text(a)}, {_text(b)})' for a, b in V.CONTRASTS)})
select 'version_pair' as type, class as class_a, class as class_b, '' as shared_terms, '' as contrast, 'high' as confidence, n as n_a, n as n_b from gs where kind = 'version' and n > 1
union all select 'shared_mechanistic_or_method_terms', a.class, b.class, array_to_string(list_sort(list_intersect(a.names, b.names)), '|'), '', 'medium', a.n, b.n from sets a join sets b on (a.class < b.class or (a.class = b.class and a.n > 1)) and len(list_intersect(a.names, b.names)) >= 2
union all select 'contrast_for_hypothesis_testing', class_a, class_b, '', class_a || ' vs ' || class_b, 'low', a.n, b.n from c join gs a on a.kind = 'term' and a.class = class_a join gs b on b.kind = 'term' and b.class = class_b""")
def relations_all(spark, sf):
    return G.relations(analyses(spark, sf, excerpts=False)).select("type", "class_a", "class_b", F.array_join("shared_terms", "|").alias("shared_terms"), "contrast", "confidence", "n_a", "n_b")


_CONCEPTS = lambda name, entries: f"{name}(id, concept_no, concept) as (values " + ", ".join(f"('{e[0]}', {i}, {_text(c)})" for e in entries for i, c in enumerate(e[-1])) + ")"
_LABELS = f"""lb as (select pos, name, category, rule_no as label_no from te union all select pos, name, 'concept', 1024 + i from (select pos, unnest(project) as name, generate_subscripts(project, 1) as i from pt) union all select pos, name, 'concept', 1048576 + rule_no from ev)"""
_NOTE = "'Fam' || (nm.pos % 23) || ' ' || coalesce(nullif(year, ''), 'n.d.') || ' - ' || substr(t1, 1, 60)"
_ASKED = f"""{_TERMS}, {_ER}, {_tagged('ev', 'er')}, {_NAMED}, {_PROJECT}, {_LABELS}, {_CONCEPTS('qc', V.QUESTIONS)},
qe as (select id, doi, min(struct_pack(c := concept_no, p := pos)) as best from (select qc.id, qc.concept_no, nm.pos, {_NDOI} as doi from lb join qc on lower(qc.concept) = lower(lb.name) join nm on nm.pos = lb.pos) where doi <> '' group by 1, 2),
qn as (select qe.id, cast(row_number() over (partition by qe.id order by best.c, best.p) as int) as number, doi, best.p as pos from qe)"""


@query(f"with {_ASKED} select qn.id, number, qn.doi, {_NOTE} as note_title from qn join nm on nm.pos = qn.pos where number <= 6")
def research_questions(spark, sf):
    return G.question_evidence(G.concept_table(spark, V.QUESTIONS), analyses(spark, sf))


@query(f"with {_ASKED}, ex(id, question) as (values {', '.join(f'({_text(e)}, {_text(q)})' for e, q, _ in V.EXPERIMENTS)}) select ex.id, question, number, doi from ex join qn on qn.id = question where number <= 4")
def experiment_evidence(spark, sf):
    evidence = G.question_evidence(G.concept_table(spark, V.QUESTIONS), analyses(spark, sf))
    experiments = spark.createDataFrame([e[:2] for e in V.EXPERIMENTS], "id string, question string")
    return G.experiment_evidence(experiments, evidence).select("id", "question", "number", "doi")


@query(f"""with {_ASKED}, {_CONCEPTS('xc', V.EXPERIMENTS)}, f as (select category, lower(name) as low, arg_min(name, struct_pack(p := pos, l := label_no)) as name, count(*) as n_articles from lb group by 1, 2),
cat as (select lower(name) as low, arg_min(category, struct_pack(p := pos, l := label_no)) as category from lb group by 1),
q as (select coalesce(category, 'concept') as category, lower(concept) as low, min(concept) as name, string_agg(id, '|' order by id) as ids from qc left join cat on cat.low = lower(concept) group by 1, 2),
x as (select coalesce(category, 'concept') as category, lower(concept) as low, min(concept) as name, string_agg(id, '|' order by id) as ids from xc left join cat on cat.low = lower(concept) group by 1, 2),
k as (select category, low from f union select category, low from q union select category, low from x)
select k.category, coalesce(f.name, q.name, x.name) as name, coalesce(f.n_articles, 0) as n_articles, coalesce(q.ids, '') as questions, coalesce(x.ids, '') as experiments from k left join f using (category, low) left join q using (category, low) left join x using (category, low)""")
def research_nodes(spark, sf):
    n = G.nodes(analyses(spark, sf, excerpts=False), G.concept_table(spark, V.QUESTIONS), G.concept_table(spark, V.EXPERIMENTS))
    return n.select("category", "name", "n_articles", F.array_join("questions", "|").alias("questions"), F.array_join("experiments", "|").alias("experiments"))


# --- canonical terms ------------------------------------------------------------------------------


def _re2(pattern: str, exact: bool) -> str:
    """A rule's pattern for DuckDB, which knows no look-around."""
    p = pattern.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])").replace("(?![A-Za-z])", "(?:$|[^A-Za-z])")
    return p if exact else f"(?i:{p})"


_CANONICAL = "[" + ", ".join(f"case when regexp_matches(txt, {_text('|'.join(_re2(p, r.exact) for p in r.patterns))}) then {_text(r.name)} end" for r in V.CANONICAL_RULES) + "]"
_CANON = f"""cn as (select *, list_filter({_CANONICAL}, lambda x: x is not null) as names from (select *, concat_ws(chr(10), nullif(title, ''), nullif(abstract, ''), array_to_string(keywords, ' '), nullif(array_to_string(concepts, ' '), '')) as txt from research))"""


@query(f"with {LIT}, {D.RESEARCH_SQL}, {_CANON} select pos, array_to_string(names, '|') as names from cn")
def canonical_terms(spark, sf):
    return M.with_canonical_terms(D.research_records(spark, sf)).select("pos", F.array_join("canonical_terms", "|").alias("names"))


@query(f"""with {LIT}, {D.RESEARCH_SQL}, {_CANON}, kw as (select *, case when lower(keywords[1]) = lower(keywords[2]) then [keywords[1]] else keywords end as kws from cn)
select pos, array_to_string(list_concat(kws, names), '|') as keywords, array_to_string(list_concat(concepts, names), '|') as concepts,
case when len(names) > 0 then 'input|conservative-text-rules' else 'input' end as keywords_source,
array_to_string(list_sort(list_distinct(list_concat(case when len(names) > 0 then ['conservative-text-rules'] else [] end, ['input', coalesce(nullif(abstract_source, ''), 'input')]))), '|') as sources from kw""")
def terms_enriched(spark, sf):
    found = M.enriched(D.research_records(spark, sf).drop("source", "src_rank", "k"))
    return found.select("pos", *(F.array_join(c, "|").alias(c) for c in ("keywords", "concepts", "keywords_source")), F.array_join(F.array_sort("enrichment_sources"), "|").alias("sources"))
