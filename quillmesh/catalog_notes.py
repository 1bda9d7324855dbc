"""Registered queries of the network's notes, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .catalog_research import _ASKED, _CLASSES, _CONCEPTS, _ER, _NAMED, _NDOI, _NOTE, _PROJECT, _ROLE, _SUMMARY, _TERMS, _VKEY, _tagged, _text, analyses
from .operators import documents as O
from .operators import network_notes as W
from .operators import research as G
from .operators import vocabulary as V
from .sources.folders import written_once

NETWORK = "Network of the corpus"
QUESTIONS, EXPERIMENTS = W.default_questions(), W.default_experiments()

# what the analyses of ``catalog_research`` say in words, for the SQL
_SENTENCES = {
    "SH2/homolytic substitution": "Local capture directly flags SH2/homolytic substitution as a mechanistic motif.",
    "organonickel/alkylnickel": "Local capture supports organonickel/alkylnickel intermediate formation as a mechanistic anchor.",
    "radical-pair control": "Local capture supports radical recombination or radical-pair control as the main mechanistic clue.",
    "metallaphotoredox": "Local capture supports metallaphotoredox radical generation coupled to nickel catalysis.",
    "electro/photo-mediated": "Local capture supports electro/photo-mediated redox control as a method context.",
    "review/background": "Local capture is best treated as review/background context rather than a primary mechanistic result.",
    "underdetermined": "Local capture provides contextual chemistry terms, but mechanism remains underdetermined from metadata alone.",
}
_LIMITS = (
    ("t2 = ''", "No abstract in local capture; analysis is limited to title/metadata."),
    ("methods is null", "No explicit DFT/CV/radical-clock/stoichiometric evidence method was detected in local capture text."),
    ("not list_contains(names, 'stereocontrol')", "No direct ee/stereocontrol evidence was detected in local capture text."),
)


def stored(spark, sf):
    """The analyses, written once to the shared folder, as an index reads them several times."""
    return written_once(analyses(spark, sf), "analyses")


def _front(title: str, kind: str, tag: str) -> str:
    return f'---\ntitle: "{title}"\ntype: "{kind}"\ntags:\n  - {tag}\n---\n'


def _linked(names) -> str:
    return ", ".join(f"[[{n}]]" for n in names)


def _bullets(lines) -> str:
    return "\n".join(f"- {x}" for x in lines) or W.NOTHING


_EVIDENCE = "coalesce((select string_agg('- [[' || note || '] (' || doi || ')', chr(10) order by number) from shown where shown.id = {id} and number <= {most}), '- None')".replace("']", "']]")
_SHOWN = f"{_ASKED}, shown as (select qn.id, number, qn.doi, {_NOTE} as note from qn join nm on nm.pos = qn.pos)"


def _question_row(q: W.Question) -> str:
    title = W.titled(q)
    head = f"{_front(title, 'research_question', 'research-question')}\n# {title}\n\n- Network: [[{NETWORK}]]\n- Status: `{W.QUESTION_STATUS}`\n\n## Why it matters\n{q.why}\n\n## Concepts\n{_linked(q.concepts)}\n\n## Evidence\n"
    return f"({_text(q.id)}, {_text(f'{W.QUESTION_FOLDER}/{title}.md')}, {_text(head)}, {_text(chr(10) * 2 + 'Open until experiments or full texts support an answer.' + chr(10))})"


def _experiment_row(e: W.Experiment) -> str:
    title, asked = W.titled(e), {q.id: W.titled(q) for q in QUESTIONS}[e.question]
    lists = "".join(f"## {head}\n{_bullets(x)}\n\n" for head, x in (("Readouts", e.readouts), ("Controls", e.controls), ("Risks", e.risks)))
    head = f"{_front(title, 'experiment_suggestion', 'experiment-suggestion')}\n# {title}\n\n- Network: [[{NETWORK}]]\n- Question: [[{asked}]]\n\n## Rationale\n{e.rationale}\n\n## Concepts\n{_linked(e.concepts)}\n\n{lists}## Evidence\n"
    return f"({_text(e.question)}, {_text(f'{W.EXPERIMENT_FOLDER}/{title}.md')}, {_text(head)}, {_text(chr(10) * 2 + e.caution + chr(10))})"


def _evidence(spark, sf):
    return G.question_evidence(G.concept_table(spark, V.QUESTIONS), analyses(spark, sf))


@query(f"with {_SHOWN}, w(id, path, head, tail) as (values {', '.join(map(_question_row, QUESTIONS))}) select path, head || {_EVIDENCE.format(id='w.id', most=6)} || tail as text from w")
def question_notes(spark, sf):
    return W.question_notes(W.question_records(spark, QUESTIONS, _evidence(spark, sf)), NETWORK)


@query(f"with {_SHOWN}, w(id, path, head, tail) as (values {', '.join(map(_experiment_row, EXPERIMENTS))}) select path, head || {_EVIDENCE.format(id='w.id', most=4)} || tail as text from w")
def experiment_notes(spark, sf):
    experiments = spark.createDataFrame([(e.id, e.question) for e in EXPERIMENTS], "id string, question string")
    found = G.experiment_evidence(experiments, _evidence(spark, sf))
    return W.experiment_notes(W.experiment_records(spark, EXPERIMENTS, QUESTIONS, found), NETWORK)


# --- blocks of articles ---------------------------------------------------------------------------

_CODE = "chr(96)"
_LIST = "array_to_string(list_transform({0}, lambda x: '[[' || x || ']]'), ', ')"
_TABLE = lambda entries: "[" + ", ".join(f"{{'t': {_text(W.titled(e))}, 'c': [{', '.join(map(_text, e.concepts))}]}}" for e in entries) + "]"


def _asked_sql(entries) -> str:
    table = _TABLE(entries)
    both = f"list_concat(list_filter({table}, lambda q: list_has_any(q.c, names)), list_filter({table}, lambda q: list_has_any(q.c, project) and not list_has_any(q.c, names)))"
    return f"coalesce(nullif(array_to_string(list_transform(({both})[1:4], lambda q: '- [[' || q.t || ']]'), chr(10)), ''), '- None')"


_SENTENCE = "case " + " ".join(f"when {_SUMMARY} = {_text(k)} then {_text(v)}" for k, v in _SENTENCES.items()) + " end"
_RELEVANT = """coalesce(nullif(concat_ws('; ', case when list_contains(cats, 'mechanism') then 'mechanistic radical or organometallic clue' end, case when list_contains(cats, 'method') then 'C(sp3) coupling or redox method' end, case when list_contains(cats, 'catalyst') then 'metal or catalyst context' end,
 case when len(project) > 0 then 'project-hypothesis connector' end), ''), 'background context only')"""
_BLOCK = f"""concat_ws(chr(10), '## Literature analysis' || chr(10), '- Basis: metadata and notes held locally, no full text', '- Status: ' || {_CODE} || '{W.ANALYSIS_STATUS}' || {_CODE}, '- Corpus role: ' || {_CODE} || {_ROLE} || {_CODE}, '- Relevance: ' || {_RELEVANT},
 '- Mechanism: ' || {_SENTENCE}, '- Terms: ' || coalesce(nullif({_LIST.format('names[1:14]')}, ''), 'none'), '- Connectors: ' || coalesce(nullif({_LIST.format('project[1:10]')}, ''), 'none'), chr(10) || '### Evidence methods', coalesce(methods, '- None'),
 chr(10) || '### Questions', {_asked_sql(QUESTIONS)}, chr(10) || '### Experiments', {_asked_sql(EXPERIMENTS)}, case when {' or '.join(c for c, _ in _LIMITS)} then chr(10) || '### Limits' || chr(10) || concat_ws(chr(10), {', '.join(f"case when {c} then {_text('- ' + s)} end" for c, s in _LIMITS)}) end)"""
_BLOCKS = f"""{_TERMS}, {_ER}, {_tagged('ev', 'er')}, {_NAMED}, {_PROJECT}, ms as (select pos, string_agg('- [[' || name || ']]: ' || chr(96) || source_field || chr(96), chr(10) order by rule_no) as methods from ev group by 1),
bl as (select nm.pos, {_BLOCK} as block from (select * exclude (names) from nm) nm join pt using (pos) left join ms using (pos))"""


@query(f"with {_BLOCKS} select pos, block from bl")
def article_blocks(spark, sf):
    return analyses(spark, sf).select("pos", W.article_block(QUESTIONS, EXPERIMENTS).alias("block"))


@query(f"""with {_BLOCKS}, n as (select pos, 'note ' || pos || '.md' as path, '# ' || coalesce(title, '') || case when pos % 2 = 0 then chr(10) || '<!-- managed:begin -->old<!-- managed:end -->' || chr(10) || 'kept' else '' end as old from lit where pos % 3 <> 1)
select path, case when pos % 2 = 0 then replace(old, '<!-- managed:begin -->old<!-- managed:end -->', '<!-- managed:begin -->' || chr(10) || block || chr(10) || '<!-- managed:end -->') else regexp_replace(old, '\\s+$', '') || chr(10) || chr(10) || '<!-- managed:begin -->' || chr(10) || block || chr(10) || '<!-- managed:end -->' || chr(10) end as text from n join bl using (pos)""")
def article_notes_preview(spark, sf):
    """Notes of two thirds of the articles, half with an old block, as they would stand."""
    from .sources import derived as D

    old = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.when(F.col("pos") % 2 == 0, "\n<!-- managed:begin -->old<!-- managed:end -->\nkept").otherwise(""))
    notes = D.lit_records(spark, sf).filter("pos % 3 <> 1").select("pos", F.concat(F.lit("note "), F.col("pos"), F.lit(".md")).alias("path"), old.alias("text"))
    return O.preview(notes, W.article_notes(analyses(spark, sf), notes, QUESTIONS, EXPERIMENTS))


# --- nodes and index ------------------------------------------------------------------------------

_IDS = lambda c: f"case when {c} = '' then '- None' else array_to_string(list_transform(string_split({c}, '|'), lambda x: '- [[' || x || ']]'), chr(10)) end"
_FOLDER = "case category " + " ".join(f"when '{k}' then '{v}'" for k, v in V.CATEGORY_FOLDERS.items()) + " else 'Concepts' end"
_NODES = f"""{_ASKED}, {_CONCEPTS('xc', V.EXPERIMENTS)}, f as (select category, lower(name) as low, arg_min(name, struct_pack(p := pos, l := label_no)) as name, count(*) as n_articles from lb group by 1, 2),
fa as (select category, low, string_agg('- [[' || note || ']]', chr(10) order by k) as shown from (select category, lower(name) as low, {_NOTE} as note, row_number() over (partition by category, lower(name) order by lb.pos, label_no) as k from lb join nm on nm.pos = lb.pos) where k <= 12 group by 1, 2),
cat as (select lower(name) as low, arg_min(category, struct_pack(p := pos, l := label_no)) as category from lb group by 1),
q as (select coalesce(category, 'concept') as category, lower(concept) as low, min(concept) as name, string_agg(id, '|' order by id) as ids from qc left join cat on cat.low = lower(concept) group by 1, 2),
x as (select coalesce(category, 'concept') as category, lower(concept) as low, min(concept) as name, string_agg(id, '|' order by id) as ids from xc left join cat on cat.low = lower(concept) group by 1, 2),
k as (select category, low from f union select category, low from q union select category, low from x),
nd as (select k.category, coalesce(f.name, q.name, x.name) as name, coalesce(f.n_articles, 0) as n_articles, coalesce(fa.shown, '- None') as shown, coalesce(q.ids, '') as questions, coalesce(x.ids, '') as experiments from k left join f using (category, low) left join fa using (category, low) left join q using (category, low) left join x using (category, low))"""


_NAME_FILE = r"""regexp_replace(trim(regexp_replace(name, '[<>:"/\\|?*]+', ' ', 'g')), '\s+', ' ', 'g')"""


@query(f"""with {_NODES} select {_FOLDER} || '/' || {_NAME_FILE} || '.md' as path, concat_ws(chr(10), '- Network: [[{NETWORK}]]', '- Articles: ' || n_articles, '## Articles', shown, '## Questions', {_IDS('questions')}, '## Experiments', {_IDS('experiments')}) as block from nd""")
def node_note_blocks(spark, sf):
    n = G.nodes(analyses(spark, sf, excerpts=False), G.concept_table(spark, V.QUESTIONS), G.concept_table(spark, V.EXPERIMENTS))
    return O.node_notes(n, NETWORK).select("path", "block")


_HEADS = ("Corpus", "Corpus roles", "Frequent terms", "Connectors", "Questions", "Experiments", "Relations")
_NAMED_LINES = lambda i, entries: " union all ".join(f"select {i}, {n + 1}, 0, {_text(f'- [[{W.titled(e)}]]')}" for n, e in enumerate(entries))
_INDEX = f"""{_TERMS}, {_ER}, {_tagged('ev', 'er')}, {_NAMED}, {_PROJECT}, {_CLASSES}, ar as (select nm.pos, {_NOTE} as note, coalesce(year, '') as year, {_NDOI} as doi, {_ROLE} as role, coalesce(nullif({_VKEY}, ''), nullif({_NDOI}, ''), '#' || nm.pos) as work from nm),
wk as (select work, min(pos) as place, arg_min(pos, struct_pack(l := contains(doi, 'chemrxiv'), p := pos)) as main from ar group by 1),
l1 as (select place, case when pos = main then 0 else pos + 1 end, case when pos = main then '- [[' || note || ']] - ' || year || ' - ' || chr(96) || doi || chr(96) || ' - ' || chr(96) || role || chr(96) else '  - version pair: [[' || note || ']] - ' || chr(96) || doi || chr(96) || ' - ' || chr(96) || role || chr(96) end from ar join wk using (work)),
l2 as (select row_number() over (order by role), 0, '- ' || chr(96) || role || chr(96) || ': ' || count(*) from ar group by role),
l3 as (select * from (select row_number() over (order by count(*) desc, min(struct_pack(p := pos, r := rule_no))) as k, 0, '- [[' || name || ']]: ' || count(*) from te group by name) where k <= 15),
pc as (select pos, unnest(project) as name, generate_subscripts(project, 1) as i from pt),
l4 as (select * from (select row_number() over (order by count(*) desc, min(struct_pack(p := pos, r := i))) as k, 0, '- [[' || name || ']]: ' || count(*) from pc group by name) where k <= 15),
sets as (select class, n, string_split(class, '|') as names from gs where kind = 'terms'), c(class_a, class_b) as (values {', '.join(f'({_text(a)}, {_text(b)})' for a, b in V.CONTRASTS)}),
rl as (select 0 as rank, 'version' as kind, 'version_pair' as type, class as class_a, class as class_b, 'same normalized title; treat as article/preprint version pair rather than independent evidence' as detail from gs where kind = 'version' and n > 1
 union all select 1, 'terms', 'shared_mechanistic_or_method_terms', a.class, b.class, array_to_string(list_sort(list_intersect(a.names, b.names)), ', ') from sets a join sets b on (a.class < b.class or (a.class = b.class and a.n > 1)) and len(list_intersect(a.names, b.names)) >= 2
 union all select 2, 'term', 'contrast_for_hypothesis_testing', class_a, class_b, class_a || ' vs ' || class_b from c join gs a on a.kind = 'term' and a.class = class_a join gs b on b.kind = 'term' and b.class = class_b),
rf as (select *, row_number() over (order by rank, class_a, class_b) as k from rl), rt as (select * from rf where k <= 20),
tw as (select kind, class, list(pos order by pos)[1:2] as ps from ms group by 1, 2),
rs as (select rt.*, case when len(b.ps) = 1 and b.ps[1] = a.ps[1] then a.ps[2] else a.ps[1] end as s, b.ps as bs from rt join tw a on a.kind = rt.kind and a.class = class_a join tw b on b.kind = rt.kind and b.class = class_b),
ru as (select *, case when bs[1] <> s then bs[1] else bs[2] end as t from rs where s is not null),
l7 as (select row_number() over (order by rank, class_a, class_b), 0, '- [[' || x.note || ']] -> [[' || y.note || ']]: ' || chr(96) || type || chr(96) || ' ' || detail from ru join ar x on x.pos = s join ar y on y.pos = t),
ln(section, pos, sub, value) as (select 1, * from l1 union all select 2, * from l2 union all select 3, * from l3 union all select 4, * from l4 union all {_NAMED_LINES(5, QUESTIONS)} union all {_NAMED_LINES(6, EXPERIMENTS)} union all select 7, * from l7)
select section, pos, sub, value from ln union all select 0, 0, 0, {_text(_front(NETWORK, 'research_network_index', 'research-network') + chr(10) + '# ' + NETWORK + chr(10) * 2 + 'A network of articles by their metadata.')}
union all select s, -1, 0, v from (values {', '.join(f'({i}, chr(10) || {_text("## " + h)})' for i, h in enumerate(_HEADS, 1))}) as t(s, v) union all select s, 0, 0, '- None' from unnest([{', '.join(str(i) for i in range(1, len(_HEADS) + 1))}]) as t(s) where s not in (select section from ln)"""


@query(f"with {_INDEX}")
def network_index(spark, sf):
    a = stored(spark, sf)
    return W.index_lines(a, G.relations(a), G.relation_members(a), QUESTIONS, EXPERIMENTS, NETWORK)
