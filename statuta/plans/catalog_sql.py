"""DuckDB SQL equal to the catalog's queries."""

from __future__ import annotations

from statuta.functions.payloads import ANSWER, CONTEXT_END, CONTEXT_HEADER
from statuta.operators.curate import ANSWER_KEY, GENERATE
from statuta.operators.golden import DIFFICULTY_SHARES, PRIORITY, TYPE_SHARES
from statuta.operators.judges import PARTS, TASKS
from statuta.operators.costs import INPUT_DEFAULT, INPUT_PRICE, OUTPUT_DEFAULT, OUTPUT_PRICE

STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ''), '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '')"
TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
CITATION = r"Article\s+\d+(?:\((?:\d+|[a-z]{1,4})\))*|Annex\s+[IVX]+(?:[,\s]+Section\s+[0-9A-Z]\b)?|Recital\s+\d+"
OTHER_ACT = r",?\s*(?:(?:of|in)\s+(?:that\s+|the\s+)?(?:Regulation|Directive|Decision|Treaty|Charter|Council)|(?:TFEU|TEU)\b)"
CORPUS = "corpus as (select * from chunks where chunk_id is not null qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last, ingestion_run_id desc nulls last) = 1)"


def _distinct(x: str) -> str:
    """Elements of a list once each, in order of first appearance."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _citations(c: str) -> str:
    raw = rf"regexp_extract_all(regexp_replace(coalesce({c}, ''), '(?i)\b(?:{CITATION}){OTHER_ACT}', '#', 'g'), '(?i)\b(?:{CITATION})')"
    return _distinct(raw)


def _bm25(docs: str, queries: str, key: str, q: str, k: int, name: str = "top") -> str:
    """CTEs that end in `name` (q, key, score, rank); docs and queries are (key, text) and (q, text) relations."""
    return f"""
t as (select {key}, {TOKENS.format('text')} as w from {docs}),
st as (select count(*) as n, avg(len(w)) as avgdl from t),
p as (select {key}, dl, term, count(*) as tf from (select {key}, len(w) as dl, unnest(w) as term from t) group by all),
raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from p cross join st group by term),
idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
qt as (select {q}, term, count(*) as qf from (select {q}, unnest({TOKENS.format('text')}) as term from {queries}) group by all),
hits as (select {q}, {key}, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from qt join p using (term) join idf using (term) cross join st group by all),
few as (select x.{q} from {queries} x left join hits h on h.{q} = x.{q} and h.score > 0 group by 1 having count(h.score) < {k}),
filled as (select * from hits union all select few.{q}, t.{key}, 0.0 from few cross join t where not exists (select 1 from hits h where h.{q} = few.{q} and h.{key} = t.{key})),
{name} as (select {q}, {key}, score, row_number() over (partition by {q} order by score desc, {key}) - 1 as rank from filled qualify rank < {k})"""


def _near(queries: str, docs: str, q: str, key: str, k: int, name: str, where: str = "true") -> str:
    d = "round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (x.vector[i]::double - v.embedding[i]::double) * (x.vector[i]::double - v.embedding[i]::double))), 6)"
    return f"""
{name}_all as (select x.{q}, v.{key}, {d} as score from {queries} x cross join {docs} v where {where}),
{name} as (select {q}, {key}, score, row_number() over (partition by {q} order by score, {key}) - 1 as rank from {name}_all qualify rank < {k})"""


def _rrf(one: str, two: str, q: str, key: str, k: int, name: str) -> str:
    return f"""
{name}_u as (select {q}, {key}, rank as r1, null::bigint as r2 from {one} union all select {q}, {key}, null, rank from {two}),
{name}_g as (select {q}, {key}, round(sum(coalesce(1.0 / (61 + r1), 0) + coalesce(1.0 / (61 + r2), 0)), 9) as score, min(r1) as r1, min(r2) as r2 from {name}_u group by all),
{name} as (select {q}, {key}, score, row_number() over (partition by {q} order by score desc, r1 nulls last, r2 nulls first, {key}) - 1 as rank from {name}_g qualify rank < {k})"""


QUESTIONS = "qs as (select item_id, query as text, gold_provisions from golden_dataset where item_id % 20 = 0 and query is not null)"
ASKED = "qs as (select item_id, query as text, gold_provisions from golden_dataset where query is not null)"
VECTORS = "qv as (select vec_id as query_id, embedding as vector from embeddings where vec_id % 20 = 0)"
HYBRID = f"""
docs as (select doc_id as chunk_id, text, doc_kind, embedding from documents join embeddings on doc_id = vec_id where text is not null),
qs as (select chunk_id as query_id, text, embedding as vector from docs where chunk_id % 20 = 0),
{_near('qs', 'docs', 'query_id', 'chunk_id', 60, 'dn')},
{_bm25('docs', 'qs', 'chunk_id', 'query_id', 60, 'lx')},
{_rrf('dn', 'lx', 'query_id', 'chunk_id', 20, 'fused')}"""
GRAMS = f"""
w as (select article_number, chunk_id, {WORDS.format('text')} as w from corpus),
wo as (select article_number as owner, case when regexp_full_match(article_number, 'Article \\d+\\(\\d+\\)') then w[4:] else w end as w from w where article_number is not null),
go as (select distinct owner, array_to_string(w[i:i+11], ' ') as gram from (select owner, w, unnest(range(1, len(w) - 10)) as i from wo where len(w) >= 12)),
own as (select gram, min(owner) as owner from go group by gram having count(distinct owner) = 1),
held as (select chunk_id, owner as label, min(pos) as first from (select chunk_id, i - 1 as pos, array_to_string(w[i:i+11], ' ') as gram from (select chunk_id, w, unnest(range(1, len(w) - 10)) as i from w where len(w) >= 12)) join own using (gram) group by all)"""


def _ref(c: str) -> str:
    p = r"(?i)^(Article|Annex|Recital)\s+(\d+|[IVXLC]+)(.*)$"
    c = STRIP.format(c)
    kind, number, rest = f"lower(regexp_extract({c}, '{p}', 1))", f"upper(regexp_extract({c}, '{p}', 2))", f"regexp_extract({c}, '{p}', 3)"
    parts = rf"list_transform(regexp_extract_all({rest}, '(?i)\((?:\d+|[a-z]{{1,4}})\)|Section\s+[\p{{L}}\p{{N}}_]+'), lambda x: lower(case when x[1] = '(' then replace(replace(x, '(', ''), ')', '') else regexp_replace(x, '(?i)^section\s+', 'section ') end))"
    return f"case when {kind} = 'annex' or ({kind} <> '' and regexp_full_match({number}, '[0-9]+')) then {{'kind': {kind}, 'number': {number}, 'path': {parts}}} end"


OVERLAPS = "({0}.kind = {1}.kind and {0}.number = {1}.number and {0}.path[1:least(len({0}.path), len({1}.path))] = {1}.path[1:least(len({0}.path), len({1}.path))])"
IR = f"""
{CORPUS}, {ASKED}, {GRAMS}, {_bm25('corpus', 'qs', 'chunk_id', 'item_id', 5)},
g as (select item_id, unnest(gold_provisions) as t from qs),
gp as (select item_id, t, {_ref('t')} as r from g),
hp as (select chunk_id, label, {_ref('label')} as r from held),
rel as (select distinct item_id, chunk_id from top join hp using (chunk_id) join gp using (item_id) where case when gp.r is null or hp.r is null then gp.t = hp.label else {OVERLAPS.format('gp.r', 'hp.r')} end),
h as (select top.item_id, rank, rel.chunk_id is not null as hit from top left join rel using (item_id, chunk_id)),
m as (select qs.item_id,
  coalesce(max(case when rank < 1 and hit then 1.0 else 0.0 end), 0)::double as recall_at_1, coalesce(max(case when rank < 3 and hit then 1.0 else 0.0 end), 0)::double as recall_at_3,
  coalesce(max(case when rank < 5 and hit then 1.0 else 0.0 end), 0)::double as recall_at_5, coalesce(1.0 / (min(case when hit then rank end) + 1), 0)::double as mrr,
  coalesce(avg(case when rank < 5 then hit::int end), 0)::double as precision_at_5 from qs left join h using (item_id) group by 1)"""
NAMED = r"regexp_matches({1}, '(?i)\b' || {0}.kind || '\s+' || {0}.number || '(?:[^\dIVXLC]|$)')"
GIVEN = f"""
{CORPUS},
r as (select response_id, query_id, answer, model, {_citations('answer')} as cs from llm_responses where answer is not null),
given as (select response_id, article_number, text from (select response_id, unnest(retrieved_chunk_ids) as chunk_id from llm_responses where answer is not null) join corpus using (chunk_id)),
c as (select response_id, unnest(cs) as c, generate_subscripts(cs, 1) as i from r),
cp as (select response_id, c, i, {_ref('c')} as ref from c),
gl as (select distinct response_id, article_number, {_ref('article_number')} as lref from given where article_number is not null and article_number <> ''),
met as (select distinct response_id, i from cp join gl using (response_id) where {OVERLAPS.format('cp.ref', 'gl.lref')}),
same as (select distinct response_id, i from cp join gl using (response_id) where case when cp.ref is null or gl.lref is null then cp.c = gl.article_number else {OVERLAPS.format('cp.ref', 'gl.lref')} end),
named as (select distinct response_id, i from cp join given using (response_id) where {NAMED.format('cp.ref', 'given.text')})"""
FRAMING = "(" + " or ".join(f"regexp_matches(coalesce(answer, ''), '(?i){p}')" for p in (
    r"based on (the )?(documents?|transcripts?|text|files?|materials?) you provided", r"(the )?(documents?|transcripts?|files?) (you|the user) (provided|shared|uploaded|sent)",
    r"according to (the )?(documents?|files?) you", r"from (the )?(documents?|files?) provided by you")) + ")"
DECLINED = r"regexp_matches(regexp_replace(coalesce(answer, ''), '^[\s\x{00a0}]+', '')[1:120], '(?i)does not contain (sufficient|enough) information to answer')"
SENTENCES = r"string_split(regexp_replace(coalesce(answer, ''), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))"
FACTUAL = f"len(list_filter({SENTENCES}, lambda s: length({STRIP.format('s')}) > 20 and not ({' or '.join(f'starts_with({STRIP.format(chr(115))}, {chr(39)}{x}{chr(39)})' for x in ('Note', 'Disclaimer', '⚠️', 'This is informational'))})))"
COMPLETENESS = f"case when {FACTUAL} = 0 then 1.0 else least(len(cs) / {FACTUAL}, 1.0) end"
RECORDS = f"""
{GIVEN}, {GRAMS},
ids as (select response_id, query_id, unnest(ids) as chunk_id, generate_subscripts(ids, 1) - 1 as rank from (select response_id, query_id, {_distinct('retrieved_chunk_ids')} as ids from llm_responses where answer is not null)),
shown as (select distinct response_id, label, {_ref('label')} as r from ids join held using (chunk_id) where chunk_id in (select chunk_id from corpus)),
ret as (select distinct response_id, i from cp join shown using (response_id) where case when cp.ref is null or shown.r is null then cp.c = shown.label else {OVERLAPS.format('cp.ref', 'shown.r')} end),
ctx as (select response_id, sum(length(text)) + count(*) - 1 as chars, string_agg(text, chr(10) order by text) as context from ids join corpus using (chunk_id) group by 1),
named_all as (select distinct response_id, i from cp join ctx using (response_id) where {NAMED.format('cp.ref', 'ctx.context')}),
st as (select cp.response_id, cp.i, case when ret.i is not null then 'retrieved' when same.i is not null then 'wrong_label' when named_all.i is not null then 'cross_reference' else 'unsupported' end as s
  from cp left join ret on ret.response_id = cp.response_id and ret.i = cp.i left join same on same.response_id = cp.response_id and same.i = cp.i left join named_all on named_all.response_id = cp.response_id and named_all.i = cp.i),
n as (select response_id, count(*) as n, sum((s = 'retrieved')::int) as re, sum((s = 'wrong_label')::int) as wl, sum((s = 'cross_reference')::int) as cr, sum((s = 'unsupported')::int) as un from st group by 1),
gold as (select query_id, gold_provisions from golden_dataset where query_id is not null qualify row_number() over (partition by query_id order by loaded_at desc nulls last, item_id desc) = 1),
asked as (select response_id, query_id, gold_provisions from (select response_id, query_id from llm_responses where answer is not null) join gold using (query_id)),
gr as (select response_id, t, {_ref('t')} as r from (select response_id, unnest(gold_provisions) as t from asked)),
hr as (select chunk_id, label, {_ref('label')} as r from held),
rel as (select distinct ids.response_id, ids.chunk_id from ids join hr using (chunk_id) join gr using (response_id) where case when gr.r is null or hr.r is null then gr.t = hr.label else {OVERLAPS.format('gr.r', 'hr.r')} end),
hit as (select ids.response_id, rank, rel.chunk_id is not null as hit from ids left join rel using (response_id, chunk_id)),
ir as (select asked.response_id,
  coalesce(max(case when rank < 1 and hit then 1.0 else 0.0 end), 0)::double as recall_at_1, coalesce(max(case when rank < 3 and hit then 1.0 else 0.0 end), 0)::double as recall_at_3,
  coalesce(max(case when rank < 5 and hit then 1.0 else 0.0 end), 0)::double as recall_at_5, coalesce(1.0 / (min(case when hit then rank end) + 1), 0)::double as mrr,
  coalesce(avg(case when rank < 5 then hit::int end), 0)::double as precision_at_5 from asked left join hit using (response_id) group by 1),
rec as (select r.response_id, r.model as tag, r.query_id is null as un_q, {DECLINED} as declined, coalesce(n, 0) as n, coalesce(re, 0) as re, coalesce(wl, 0) as wl, coalesce(cr, 0) as cr, coalesce(un, 0) as un, {COMPLETENESS} as completeness, {FRAMING} as framing,
  coalesce(ctx.chars, 0) as chars, cost.cost_usd, ir.* exclude (response_id)
  from r left join n using (response_id) left join ctx using (response_id) left join ir using (response_id) join (select response_id, cost_usd from llm_responses) cost using (response_id)),
summary as (select tag, count(*) as n_questions, sum((not un_q)::int)::bigint as n_answerable, sum(un_q::int)::bigint as n_unanswerable,
  {', '.join(f"round(avg(case when not un_q then {m} end), 3) as {m}" for m in ('recall_at_1', 'recall_at_3', 'recall_at_5', 'mrr'))},
  round(avg(case when un_q then declined::int::double end), 3) as unanswerable_declined, round(avg(case when not un_q then declined::int::double end), 3) as answerable_declined,
  {', '.join(f"round(sum(case when not declined then {c} end) / nullif(sum(case when not declined then n end), 0), 3) as citations_{m}" for c, m in (('re', 'grounded'), ('wl', 'wrong_label'), ('cr', 'cross_reference'), ('un', 'unsupported')))},
  coalesce(sum(case when not declined then n end), 0)::bigint as n_citations, round(avg(case when not un_q and not declined then completeness end), 3) as citation_completeness, round(avg(framing::int::double), 3) as bad_framing_rate,
  round(avg(chars), 3) as avg_context_chars, round(avg(cost_usd), 5) as avg_cost_usd
  from rec where tag is not null group by tag)"""
KIND = "case when regexp_matches(coalesce(title, ''), '(?i)\\b(prohibited|forbidden|shall not|must not|ban)\\b') then 'prohibition' when regexp_matches(coalesce(title, ''), '(?i)\\b(means|definition|defined as|for the purposes of)\\b') then 'definition' when regexp_matches(coalesce(title, ''), '(?i)\\b(shall|must|required|obligation|comply)\\b') then 'obligation' when regexp_matches(coalesce(title, ''), '(?i)\\b(procedure|process|step|assessment|conformity|notify|register)\\b') then 'procedural' else 'general' end"
STRUCTURE = f"""
{CORPUS},
k0 as (select parent_document, article_number as a, case when regexp_matches(article_number, '^Article \\d+\\(\\d+\\)') then 'definition' else lower(regexp_extract(article_number, '^(Article|Annex|Recital) ', 1)) end as kind from corpus where parent_document is not null and article_number is not null),
k1 as (select parent_document, kind, case when kind = 'definition' then regexp_extract(a, '\\((\\d+)\\)', 1) else regexp_extract(a, '^\\w+ (\\d+|[IVXLC]+)', 1) end as number from k0 where kind <> ''),
roman as (select r, i + 1 as v from (select unnest(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX']) as r, unnest(range(0, 20)) as i)),
k as (select distinct parent_document, kind, case when kind = 'annex' then v else try_cast(number as int) end as value from k1 left join roman on kind = 'annex' and r = number where number <> '')"""
SCORE = "(case when len(coalesce(gold_provisions, [])) > 0 then 3.0 else 0 end + case when len(coalesce(gold_provisions, [])) > 1 then 1.0 else 0 end + least(len(coalesce(expected_answer_elements, [])), 3) + case when contains(coalesce(notes, ''), 'llm-verified') then 2 else 0 end - case when contains(coalesce(notes, ''), 'fallback') or contains(coalesce(notes, ''), 'no retrieval') then 2 else 0 end - case when length(coalesce(query, '')) < 40 then 1 else 0 end)::double"
SCORED = f"s as (select item_id, query_type, difficulty, source_article, {SCORE} as score from golden_dataset)"
STRATA = f"s as (select item_id, query_type, difficulty, source_article, {SCORE} as score from golden_dataset where query_type is not null and difficulty is not null)"


def _comparison() -> str:
    """(label, tag, shown) of each metric that a comparison lists; the judges weren't run."""
    run = {
        "Recall@1": "recall_at_1", "Recall@3": "recall_at_3", "Recall@5": "recall_at_5", "MRR": "mrr",
        "Citations: cited text was retrieved": "citations_grounded", "Citations: label of a passage whose text is another provision": "citations_wrong_label", "Citations: cross-reference named in retrieved text": "citations_cross_reference",
        "Citations: unsupported": "citations_unsupported", "Unanswerable questions declined": "unanswerable_declined", "Answerable questions declined": "answerable_declined",
    }
    missing = ("Completeness vs the Act (judge)", "Faithfulness to retrieved text (judge)", "Factual consistency (judge)", "Answer relevance (judge)")
    rows = [f"select '{n}' as label, tag, printf('%.2f', {c}) as shown from summary" for n, c in run.items()]
    rows += ["select 'Avg characters sent to the LLM', tag, case when avg_context_chars > 100 then format('{:,}', round_even(avg_context_chars, 0)::bigint) else printf('%.2f', avg_context_chars) end from summary"]
    rows += ["select 'Avg cost per question (USD)', tag, '$' || printf('%.4f', avg_cost_usd) from summary"]
    return " union all ".join(rows + [f"select '{n}', tag, null from summary" for n in missing])


def _shown(tag: str) -> str:
    return f"coalesce(max(case when tag = '{tag}' then shown end), 'not run') as \"{tag}\""


def _price(table: dict[str, float], default: float) -> str:
    return "case model " + " ".join(f"when '{m}' then {v}::double" for m, v in table.items()) + f" else {default}::double end"


def _judges() -> str:
    """CTEs that end in v (response_id, tag, a score for each judge, null if not judged)."""
    part = lambda p: len(f"\n\n[{p}]\n")
    n = {j: len(TASKS[j]) + sum(part(p) for p in PARTS[j]) for j in TASKS}
    size = {"query": "length(coalesce(query, ''))", "answer": "length(answer)", "context": "ctx", "facts": "fl"}
    lengths = ", ".join(f"{n[j]} + {' + '.join(size[p] for p in PARTS[j])} as l_{j}" for j in TASKS)
    score = lambda j: f"case when not declined then (l_{j} % 101) / 100.0 end as {j}"
    covered = "len(list_filter(range(1, least(2 + l_completeness % 4, nf + 1)), lambda i: (l_completeness + i) % 2 = 0)) / nf"
    return f"""
{CORPUS},
g as (select query_id, is_unanswerable, coalesce(expected_answer_elements, []) as fs from golden_dataset where query_id is not null qualify row_number() over (partition by query_id order by loaded_at desc nulls last, item_id desc) = 1),
r as (select response_id, model as tag, query, answer, {DECLINED} as declined, {_distinct('retrieved_chunk_ids')} as ids, fs from llm_responses join g using (query_id) where answer is not null and not coalesce(is_unanswerable, false)),
pi as (select response_id, unnest(ids) as chunk_id, generate_subscripts(ids, 1) as i from r),
ps as (select response_id, coalesce(nullif(article_number, ''), '(unlabelled)') as label, text, row_number() over (partition by response_id order by i) as k from pi join corpus using (chunk_id)),
cx as (select response_id, sum(length(text) + length(label) + length(k::varchar) + 4)::bigint + 2 * (count(*) - 1) as ctx from ps group by 1),
f as (select response_id, tag, query, answer, declined, coalesce(ctx, 0)::bigint as ctx, len(fs) as nf, length(array_to_string(list_transform(fs, lambda x, i: i || '. ' || x), chr(10))) as fl from r left join cx using (response_id)),
l as (select *, {lengths} from f),
v as (select response_id, tag, declined, {', '.join(score(j) for j in TASKS if j != 'completeness')}, case when not declined and nf > 0 then {covered} end as completeness from l)"""


def _entries() -> str:
    """Priority picks, then quotas of what is left of the target, one unanswerable, trimmed by score."""
    ps = "', '".join(PRIORITY)
    return f"""
s as (select item_id, query_type, difficulty, source_article, is_unanswerable, {SCORE} as score from golden_dataset where query_type is not null and difficulty is not null and len(gold_provisions) > 0),
lv as (select *, case when difficulty = 'easy' then 'easy' when difficulty in ('medium', 'hard') then 'harder' end as level from s where source_article in ('{ps}')),
pk as (select * from lv where level is not null qualify row_number() over (partition by source_article, level order by score desc, item_id) = 1),
t as (select 45 - count(*) as n from pk),
q as (select a.k as query_type, b.k as difficulty, greatest(1, round_even((select n from t) * a.w * b.w, 0))::int as quota
  from (values {', '.join(f"('{k}', {v}::double)" for k, v in TYPE_SHARES.items())}) a(k, w), (values {', '.join(f"('{k}', {v}::double)" for k, v in DIFFICULTY_SHARES.items())}) b(k, w)),
o as (select s.*, coalesce(quota, 1) as quota, row_number() over (partition by s.query_type, s.difficulty order by score desc, item_id) as rn from s left join q using (query_type, difficulty) where item_id not in (select item_id from pk)),
qs as (select *, row_number() over (order by query_type, difficulty, rn) as place from o where rn <= quota),
ch as (select item_id, score, is_unanswerable from pk union all select item_id, score, is_unanswerable from qs where place <= greatest(1, (select n from t))),
un as (select item_id, score from s where is_unanswerable and not exists (select 1 from ch where is_unanswerable) order by item_id limit 1),
fin as (select item_id, score from ch where item_id not in (select item_id from ch where exists (select 1 from un) order by score, item_id desc limit 1) union all select * from un)"""


def _quotas() -> str:
    rows = []
    for t, a in (("factual", 0.35), ("procedural", 0.30), ("conceptual", 0.20), ("cross_reference", 0.15)):
        for d, b in (("easy", 0.40), ("medium", 0.40), ("hard", 0.20)):
            rows.append(f"('{t}', '{d}', {max(1, round(45 * a * b))})")
    return f"quota(query_type, difficulty, quota) as (values {', '.join(rows)})"


def oracle_sql() -> dict[str, str]:
    fixed = rf"""
        w as (select doc_id, doc_kind, regexp_split_to_array({STRIP.format('text')}, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+') as w from documents where text is not null),
        x as (select doc_id, doc_kind, w, unnest(range(0, len(w), 450)) as a from w)"""
    return {
        "bm25_term_stats": f"with {CORPUS}, q0 as (select '' as q, '' as text where false), {_bm25('corpus', 'q0', 'chunk_id', 'q', 5)} select term, df, round(idf, 6) as idf from idf",
        "bm25_topk": f"with {CORPUS}, {QUESTIONS}, {_bm25('corpus', 'qs', 'chunk_id', 'item_id', 5)} select item_id, chunk_id, score, rank from top",
        "dense_topk_l2": f"with {VECTORS}, {_near('qv', 'embeddings', 'query_id', 'vec_id', 10, 'dn')} select * from dn",
        "dense_topk_filtered": f"with {VECTORS}, {_near('qv', 'embeddings', 'query_id', 'vec_id', 10, 'dn', 'v.label = 3')} select * from dn",
        "rrf_from_two_orders": f"with {VECTORS}, {_near('qv', 'embeddings', 'query_id', 'vec_id', 20, 'da')}, {_near('qv', 'embeddings', 'query_id', 'vec_id', 20, 'db', 'v.label in (1, 2, 3)')}, {_rrf('da', 'db', 'query_id', 'vec_id', 10, 'f')} select * from f",
        "hybrid_rrf": f"with {HYBRID} select * from fused",
        "rerank_penalty_topk": f"""with {HYBRID},
            sc as (select f.query_id, f.chunk_id, f.rank as r0, d.doc_kind, len(list_intersect(list_distinct({TOKENS.format('q.text')}), list_distinct({TOKENS.format('d.text')})))::double as score from fused f join docs d using (chunk_id) join qs q using (query_id)),
            rr as (select *, row_number() over (partition by query_id order by score desc, r0) - 1 as r1 from sc)
            select query_id, chunk_id, score, row_number() over (partition by query_id order by score - case when doc_kind = 'minutes' then 3.0 else 0.0 end desc, r1) - 1 as rank from rr qualify rank < 3""",
        "chunk_structural_ids": f"select distinct sha256({STRIP.format('text')}) as chunk_id, parent_document, chunk_index from chunks where {STRIP.format('text')} <> ''",
        "chunk_fixed_size": f"with {fixed} select doc_id as parent_document, a // 450 as chunk_index, doc_kind as section_type, sha256({STRIP.format(chr(97) + 'rray_to_string(w[a+1:a+500], ' + chr(39) + ' ' + chr(39) + ')')}) as chunk_id from x",
        "upsert_latest": """with v as (select chunk_id, article_number, ingestion_run_id, (ingestion_run_id = (select max(ingestion_run_id) from chunks)) is true as put, ingested_at from chunks where chunk_id is not null)
            select chunk_id, ingestion_run_id, article_number from v qualify row_number() over (partition by chunk_id order by put desc, ingested_at desc nulls last, ingestion_run_id desc nulls last) = 1""",
        "collection_count": "select count(distinct chunk_id) as n from chunks",
        "point_lookup": f"with {CORPUS} select chunk_id, article_number, title from corpus where chunk_id = (select min(chunk_id) from chunks)",
        "store_codec": f"with {CORPUS} select chunk_id, coalesce(article_number, '') as article_number, coalesce(title, '') as title, coalesce(array_to_string(cross_references, '|'), '') as cross_references from corpus",
        "shingle_owner_unique": f"with {CORPUS}, {GRAMS} select owner, count(*) as grams from own group by 1",
        "provision_containment": f"with {CORPUS}, {GRAMS} select chunk_id, label, first from held",
        "ir_metrics_per_query": f"with {IR} select * from m",
        "ir_metrics_summary": f"with {IR} select count(*) as n, round(avg(recall_at_1), 3) as recall_at_1, round(avg(recall_at_3), 3) as recall_at_3, round(avg(recall_at_5), 3) as recall_at_5, round(avg(mrr), 3) as mrr, round(avg(precision_at_5), 3) as precision_at_5 from m",
        "run_summary": f"with {RECORDS} select tag, n_questions, n_answerable, n_unanswerable, unanswerable_declined, answerable_declined, citations_grounded, citations_wrong_label, citations_cross_reference, citations_unsupported, n_citations, citation_completeness, bad_framing_rate, recall_at_1, recall_at_3, recall_at_5, mrr, avg_context_chars, avg_cost_usd from summary",
        "compare_runs_pivot": f"with {RECORDS}, l as ({_comparison()}) select label as metric, {', '.join(_shown(t) for t in ('answerer-large', 'answerer-small', 'answerer-trial'))} from l group by label",
        "run_join_ab": "with a as (select query_id, min(response_id) as a from llm_responses where query_id is not null and model = 'answerer-large' group by 1), b as (select query_id, min(response_id) as b from llm_responses where query_id is not null and model = 'answerer-small' group by 1) select query_id, a, b from a left join b using (query_id)",
        "dedup_normalized_text": f"select min(item_id) as item_id from golden_dataset where query is not null group by lower({STRIP.format('query')})[1:80]",
        "antijoin_new": "with c as (select record_id, max(case when regexp_replace(lower(e.key), '[^a-z0-9]', '', 'g') = 'query' then e.value ->> '$' end) as query from candidate_records, json_each(payload) e group by 1) select * from c where query is not null and query not in (select query from golden_dataset where query is not null)",
        "set_gaps": f"with {STRUCTURE}, m as (select parent_document, kind, max(value) as top from k group by all), e as (select parent_document, kind, unnest(range(1, top + 1)) as number from m) select e.parent_document, e.kind, e.number::int as number from e left join k on k.parent_document = e.parent_document and k.kind = e.kind and k.value = e.number where k.value is null",
        "duplicate_labels": f"with {CORPUS} select parent_document, article_number, count(*) as n from corpus where parent_document is not null and article_number is not null group by all having count(*) > 1",
        "sentence_completeness": f"with r as (select response_id, answer, {_citations('answer')} as cs from llm_responses where answer is not null) select response_id, {FACTUAL} as factual, round({COMPLETENESS}, 6) as completeness from r",
        "citation_extract": f"with r as (select response_id, {_citations('answer')} as cs from llm_responses) select response_id, generate_subscripts(cs, 1) - 1 as pos, unnest(cs) as citation from r",
        "parse_reference": f"with s as (select distinct source_article, {_ref('source_article')} as r from golden_dataset where source_article is not null) select source_article, r.kind as kind, r.number as number, array_to_string(r.path, '/') as path from s",
        "citation_verify": f"""with {GIVEN}
            select r.response_id, count(met.i) as matched, count(cp.i) - count(met.i) as missing, sum((cp.i is not null and met.i is null and named.i is not null)::int)::bigint as cross_referenced,
              round(case when count(cp.i) = 0 then 1.0 else count(met.i) / count(cp.i) end, 6) as accuracy, any_value({FRAMING}) as bad_framing
            from r left join cp using (response_id) left join met on met.response_id = cp.response_id and met.i = cp.i left join named on named.response_id = cp.response_id and named.i = cp.i group by 1""",
        "citation_statuses": f"with {RECORDS} select response_id, re as n_retrieved, wl as n_wrong_label, cr as n_cross_reference, un as n_unsupported from rec",
        "decline_framing": f"select response_id, {DECLINED} as declined, {FRAMING} as bad_framing from llm_responses",
        "cross_reference_edges": rf"with {CORPUS} select distinct chunk_id, unnest(regexp_extract_all(text, '(?i)\b(?:Article\s+\d+(?:\(\d+\))?|Annex\s+[IVX]+|Recital\s+\d+)\b')) as target from corpus",
        "classify_section": f"with {CORPUS} select distinct title, {KIND} as section_type from corpus where title is not null",
        "structure_summary": f"with {STRUCTURE} select parent_document, kind, list_sort(list(distinct value::int)) as numbers from k group by all",
        "candidate_score": f"with {SCORED} select item_id, score from s",
        "stratified_split": f"with {SCORED}, o as (select *, row_number() over (partition by query_type, difficulty order by sha256('42|' || item_id), item_id) as rn, count(*) over (partition by query_type, difficulty) as n from s) select item_id, query_type, difficulty, case when rn <= greatest(1, round_even(n * 0.7::double, 0)) then 'dev' else 'test' end as split from o",
        "priority_pick": f"with {STRATA}, l as (select *, case when difficulty = 'easy' then 'easy' when difficulty in ('medium', 'hard') then 'harder' end as level from s) select source_article, level, item_id, score from l where level is not null and source_article in ('Article 5', 'Article 6', 'Article 9', 'Article 10', 'Article 13', 'Article 14', 'Article 17', 'Article 50') qualify row_number() over (partition by source_article, level order by score desc, item_id) = 1",
        "quota_select": f"with {STRATA}, {_quotas()}, o as (select s.*, coalesce(quota, 1) as quota, row_number() over (partition by s.query_type, s.difficulty order by score desc, item_id) as rn from s left join quota using (query_type, difficulty)), p as (select *, row_number() over (order by query_type, difficulty, rn) as place from o where rn <= quota) select item_id, query_type, difficulty, score from p where place <= 45",
        "golden_left_join": f"with {CORPUS}, i as (select article_number, count(distinct chunk_id) as n, arg_min(chunk_id, (chunk_index, chunk_id)) as f from corpus where article_number is not null group by 1) select item_id, coalesce(n, 0) as chunks, coalesce(f, '') as first from golden_dataset left join i on source_article = article_number",
        "missing_gold_labels": "select distinct label from (select unnest(gold_provisions) as label from golden_dataset) where label not in (select article_number from chunks where article_number is not null)",
        "golden_counters": "select 'query_type' as field, query_type as value, count(*) as n from golden_dataset group by all union all select 'difficulty', difficulty, count(*) from golden_dataset group by all union all select 'split', split, count(*) from golden_dataset group by all",
        "text_page_quality": f"select source_file, count(*) as pages, sum(length(coalesce(text, '')))::bigint as chars, sum((length({STRIP.format('coalesce(text, chr(32))')}) < 50)::int)::bigint as short_pages, round(avg((length({STRIP.format('coalesce(text, chr(32))')}) >= 50)::int), 6) as filled_share from raw_pages group by 1",
        "embedding_cost": "select round(sum(length(text[1:32000])) / 4 / 1e6 * 0.02, 9) as usd from documents",
        "answer_cost": f"select response_id, round((input_tokens * {_price(INPUT_PRICE, INPUT_DEFAULT)} + output_tokens * {_price(OUTPUT_PRICE, OUTPUT_DEFAULT)}) / 1e6::double, 9) as usd from llm_responses",
        "judge_scores": f"with {_judges()} select response_id, {', '.join(f'round({j}::double, 6) as {j}' for j in TASKS)} from v where not declined",
        "judge_means": f"with {_judges()} select tag, round(avg(coalesce(completeness, 0)), 3) as completeness, {', '.join(f'round(avg({j})::double, 3) as {j}' for j in TASKS if j != 'completeness')}, sum((answer_relevance is not null)::int)::bigint as n_judged from v where tag is not null group by tag",
        "select_entries": f"with {_entries()} select item_id, score from fin order by score desc, item_id limit 45",
        "selection_coverage": f"""with p as (select unnest({list(PRIORITY)}) as a) select count(*) as entries, sum(coalesce(is_unanswerable, false)::int)::bigint as unanswerable, sum((coalesce(len(gold_provisions), 0) = 0)::int)::bigint as no_match,
            (select count(*) from p where a in (select source_article from golden_dataset))::int as covered, (select coalesce(string_agg(a, '|' order by a), '') from p where a not in (select source_article from golden_dataset where source_article is not null)) as missing, round(avg(coalesce(len(gold_provisions), 0)), 1) as mean_ids from golden_dataset""",
        "generation_prompts": f"with {CORPUS} select chunk_id, sha256('{GENERATE}' || article_number || chr(10) || text[1:2000]) as hash from corpus where starts_with(article_number, 'Article') and length(text) > 200",
        "answer_key_prompts": f"""with {CORPUS}, t as (select article_number as label, max(text) as text from corpus where article_number is not null group by 1),
            p as (select item_id, unnest(gold_provisions) as label, generate_subscripts(gold_provisions, 1) as i from golden_dataset), b as (select item_id, string_agg('[' || label || ']' || chr(10) || text, chr(10) || chr(10) order by i) as b from p join t using (label) group by 1)
            select item_id as query_id, sha256('{ANSWER_KEY}Question: ' || coalesce(query, '') || chr(10) || chr(10) || coalesce(b, '')) as hash from golden_dataset left join b using (item_id)""",
        "failure_counts": "select event_type, count(*) as n from events group by 1",
        "judge_json_parse": "select event_id, (props ->> '$.k')::double as score from events",
        "tolerant_objects": "select record_id, 1 as objects from candidate_records",
        "events_windowed": "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
        "prompt_context": rf"""with {CORPUS},
            u as (select response_id, query, {_distinct('retrieved_chunk_ids')} as ids from llm_responses where query is not null),
            h as (select response_id, query, unnest(ids) as chunk_id, generate_subscripts(ids, 1) as i from u),
            b as (select response_id, query, i, '[' || i || '] Source: ' || case when article_number <> '' then article_number else '(unlabelled)' end || case when title <> '' then ' — ' || title else '' end || chr(10) || {STRIP.format('text')} || chr(10) as b from h join corpus using (chunk_id)),
            p as (select response_id, '{CONTEXT_HEADER}' || string_agg(b, chr(10) order by i) || '{CONTEXT_END}' || any_value(query) || '{ANSWER}' as prompt from b group by 1)
            select response_id, length(prompt) as chars, sha256(prompt) as hash from p""",
    }
