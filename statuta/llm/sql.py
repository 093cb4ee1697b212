"""DuckDB SQL equal to the queries that SQL can express."""

from __future__ import annotations

LABEL = r"""nullif(nullif(regexp_replace(regexp_replace(lower({0}), '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'), '[\s\x{{00a0}}_-]+', '_', 'g'), ''), '_')"""
SPLIT = """case when {0} in ('train', 'training') then 'train' when {0} in ('dev', 'development', 'val', 'valid', 'validation') then 'dev'
 when {0} in ('test', 'testing') then 'test' end""".format(LABEL.format("split"))
KEY = r"regexp_replace(lower(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g')), '[^\p{{L}}\p{{Nd}}]', '', 'g')"

REQUIRED = f"""
pool as (
  select coalesce(query_id, 'item:' || item_id) as q, min({LABEL.format('query_type')}) as query_type, min({LABEL.format('difficulty')}) as difficulty, min({LABEL.format('persona')}) as persona
  from golden_dataset group by 1),
have as (
  select 'query_type' as field_name, query_type as k, count(*) as n from pool group by 2
  union all select 'difficulty', difficulty, count(*) from pool group by 2
  union all select 'persona', persona, count(*) from pool group by 2),
report as (
  select plan_name, t.field_name, category, sample_size, target_share, min_rows, greatest(round(target_share * sample_size, 6), min_rows::double) as required, coalesce(n, 0) as available
  from sample_targets t left join have h on h.field_name = t.field_name and h.k = {LABEL.format('category')})
"""

SOURCES = rf"""
s as (
  select regexp_replace(regexp_replace(parent_document, '[\s\x{{00a0}}]+', ' ', 'g'), '^ | $', '', 'g') as act,
    regexp_replace(source_article, '[\s\x{{00a0}}]+', ' ', 'g') as a, {SPLIT} as today
  from golden_dataset),
k as (
  select act, today, lower(regexp_extract(a, '(?i)^ ?(art|rec|ann)[a-z]*\.? ?([0-9]+|[ivxlc]+)(?:[^0-9a-z]|$)', 1)) as kind,
    upper(regexp_extract(a, '(?i)^ ?(art|rec|ann)[a-z]*\.? ?([0-9]+|[ivxlc]+)(?:[^0-9a-z]|$)', 2)) as number from s),
sources as (
  select act, today, case kind when 'art' then 'Article' when 'rec' then 'Recital' when 'ann' then 'Annex' end || ' ' || coalesce(nullif(ltrim(number, '0'), ''), number) as provision
  from k where kind <> '' and number <> '' and act <> '')
"""

TERMS = r"""
once as (select chunk_id, max(text) as t, count(*) as rows from chunks group by 1),
w as (select chunk_id, rows, list_filter(regexp_split_to_array(lower(coalesce(t, '')), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') as w from once),
total as (select sum(rows) as n, sum(len(w) * rows) / sum(rows) as av from w),
tf as (select chunk_id, term, rows, words, count(*) as tf from (select chunk_id, rows, len(w) as words, unnest(w) as term from w) group by all),
stats as (select term, sum(tf * rows) as f, sum(rows) as df from tf group by 1),
scores as (
  select chunk_id, tf.term, tf, words, df,
    (log2(1 + f / n) - tf * log2(1 + av / words) * log2((f / n) / (1 + f / n))) / (tf * log2(1 + av / words) + 1) as score
  from tf join stats on tf.term = stats.term cross join total where df <= n * 0.1)
"""


def _groups() -> str:
    fields = ("query", "querytype", "difficulty", "persona", "sourcearticle")
    entries = ", ".join(f"max(case when regexp_replace(lower(e.key), '[^a-z0-9]', '', 'g') = '{f}' then {KEY.format('e.value ->> chr(36)')} end) as {f}" for f in fields)
    return f"""
members as (
  select 'golden_dataset' as table_name, item_id as id, {KEY.format('query')} as form from golden_dataset
  union all
  select 'candidate_records', record_id, case when concat({', '.join(fields)}) <> '' then concat_ws('|', {', '.join(f"coalesce({f}, '')" for f in fields)}) else '' end
  from (select record_id, {entries} from candidate_records, json_each(payload) e group by record_id)),
grouped as (select table_name, id, min(id) over (partition by table_name, form) as keep_id, count(*) over (partition by table_name, form) as copies from members where form <> '')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {REQUIRED} select distinct plan_name, field_name, category from report where available < required",
        "p1_targets": f"with {REQUIRED} select plan_name, field_name, category, sample_size, target_share, min_rows, required, available, least(available, ceil(required))::bigint as drawn, available < required as unmet from report",
        "p3_found": f"with {SOURCES} select act as parent_document, provision as source_article from sources where today is not null group by all having count(distinct today) > 1",
        "p5_found": f"with {TERMS} select chunk_id, term from scores where words >= 30 qualify row_number() over (partition by chunk_id order by score desc, tf desc, df, term desc) = 1",
        "p5_scores": f"with {TERMS} select * from scores",
        "p7_found": f"with {_groups()} select table_name, keep_id, id as copy_id from grouped where id <> keep_id",
        "p7_groups": f"with {_groups()} select distinct table_name, keep_id, copies from grouped",
    }


