"""DuckDB SQL of the training-data queries that SQL can express."""

from ..queries.problems import INSTANTS_SQL, TREE_SQL
from .survivors import MISSING

_TERM = r"""
term as (
  select distinct bug_id, stack_no, depth, case when t similar to '<(.|\n)*>' then t else nullif(nullif(
    regexp_replace(trim(regexp_replace(t, '[(@.](.|\n)*$', '')), '^(_*GI_+|_+)', ''), ''), '??') end as term
  from (select *, nullif(nullif(trim("function"), ''), '??') as t from stack_frame)),
lib as (
  select distinct bug_id, stack_no, depth,
    nullif(nullif(regexp_replace(regexp_replace(trim(dylib), '^(.|\n)*/', ''), '\.so(.|\n)*$', ''), ''), '??') as term from stack_frame),
total as (select count(distinct bug_id) as n from stack_frame)"""
_COUNTS = f"""{_TERM},
cnt as (select bug_id, term, count(*) as n from term where term is not null group by all),
df as (select term, count(*) as d, sum(n)::double as cf from cnt group by term)"""
_FIELDS = f"""{_TERM},
both_ as (
  select 'function' as field_name, term, bug_id from term where term is not null
  union all select 'dylib', term, bug_id from lib where term is not null),
cnt as (select field_name, term, count(*) as occurrences, count(distinct bug_id) as records from both_ group by all)"""
_MARK = "case when records = 1 then 'rare' when records > 0.1 * (select n from total) then 'common' end"
_G = "case when {k} > 0 then {k} * ln({k} * tot / ({r} * {c})) else 0 end"

SQL = {
    "p2_found": f"""with {_COUNTS},
s as (select bug_id, term, round(n * ln((select n from total)::double / d), 6) as score from cnt join df using (term) where d >= 2)
select bug_id, term from (select *, row_number() over (partition by bug_id order by score desc, term) as r from s) where r = 1""",
    "p2_llr": f"""with {_COUNTS},
size as (select bug_id, sum(n)::double as size from cnt group by all),
cells as (select bug_id, term, n::double as n, cf, size, (select sum(cf) from df) as tot from cnt join df using (term) join size using (bug_id) where d >= 2),
g as (select *, 2 * ({_G.format(k="n", r="size", c="cf")} + {_G.format(k="(cf - n)", r="(tot - size)", c="cf")}
  + {_G.format(k="(size - n)", r="size", c="(tot - cf)")} + {_G.format(k="(tot - size - cf + n)", r="(tot - size)", c="(tot - cf)")}) as g2 from cells),
s as (select bug_id, term, round(case when n * tot >= size * cf then g2 else -g2 end, 6) as llr from g)
select bug_id, term, llr from (select *, row_number() over (partition by bug_id order by llr desc, term) as r from s) where r = 1""",
    "p3_counts": f"with {_FIELDS} select *, {_MARK} as mark from cnt",
    "p3_found": f"with {_FIELDS} select field_name, term, mark from (select *, {_MARK} as mark from cnt) where mark is not null",
    "p3_ngrams": f"""with {_TERM},
named as (select * from term where term is not null),
gram as (
  select bug_id, term as ngram from named
  union all select a.bug_id, a.term || chr(10) || b.term from named a join named b
    on a.bug_id = b.bug_id and a.stack_no = b.stack_no and b.depth = a.depth + 1
  union all select a.bug_id, a.term || chr(10) || b.term || chr(10) || c.term from named a join named b
    on a.bug_id = b.bug_id and a.stack_no = b.stack_no and b.depth = a.depth + 1
    join named c on a.bug_id = c.bug_id and a.stack_no = c.stack_no and c.depth = a.depth + 2)
select ngram, count(*) as occurrences, count(distinct bug_id) as records from gram group by ngram""",
    "p4_found": f"""with {_TERM},
step as (
  select *, depth - row_number() over (partition by bug_id, stack_no, term order by depth) as run from term where term is not null)
select bug_id, stack_no, min(depth) as first_depth, max(depth) as last_depth from step group by bug_id, stack_no, term, run having count(*) > 1""",
    "p9_found": r"""with w as (
  select doc_id, null::bigint as item_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z!][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') as w from documents where text is not null
  union all
  select null, item_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z!][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') from eval_item where text is not null),
g as (select doc_id, item_id, array_to_string(w[i : i + 12], ' ') as g from w, unnest(range(1, len(w) - 11)) as t(i))
select distinct a.doc_id, b.item_id from g a join g b using (g) where a.doc_id is not null and b.item_id is not null""",
}
_SPACE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+"
_GONE = ", ".join(f"'{m}'" for m in MISSING)
_VALUES = " union all ".join(f"select root_id, delivery_id, trust, us, ingest_ts, '{f}' as field_name, {f} as value from member" for f in ("short_desc", "version", "os", "bug_severity"))
_MEMBERS = rf"""{TREE_SQL},
tree as (select bug_id, case when ring then list_min(path[1 : list_position(path, top)]) else top end as root_id from walk where ring or top not in (select bug_id from edge)),
{INSTANTS_SQL},
ranks as (select tracker_id, min(trust_rank) as trust from tracker group by tracker_id),
times as (select delivery_id, max(us)::bigint as us from instant_ts group by delivery_id),
member as (select distinct coalesce(root_id, bug_id) as root_id, delivery_id, trust, us, ingest_ts, short_desc, version, os, bug_severity
  from bug_report left join tree using (bug_id) left join ranks using (tracker_id) left join times using (delivery_id) where bug_id is not null)"""
SQL["p6_found"] = rf"""{_MEMBERS},
big as (select root_id from member group by root_id having count(distinct delivery_id) > 1),
long_ as (select * from ({_VALUES}) join big using (root_id)),
told as (select * from long_ where value is not null and regexp_matches(value, '[\p{{L}}\p{{N}}]') and lower(trim(regexp_replace(value, '{_SPACE}', ' ', 'g'))) not in ({_GONE}))
select root_id, field_name, delivery_id from told
qualify row_number() over (partition by root_id, field_name order by trust asc nulls last, us desc nulls last, ingest_ts desc nulls last, delivery_id desc) = 1"""
SQL["p6_votes"] = rf"""{_MEMBERS},
long_ as (select root_id, delivery_id, trust, us, field_name, lower(trim(regexp_replace(value, '{_SPACE}', ' ', 'g'))) as v, value from ({_VALUES})),
once as (select distinct root_id, field_name, delivery_id, trust, us, v from long_ where value is not null and regexp_matches(value, '[\p{{L}}\p{{N}}]') and v not in ({_GONE})),
votes as (select root_id, field_name, v, sum(exp(-ln(2.0) * coalesce(((select max(us) from long_) - us) / 86400e6, 7305.0) / 365.0) / coalesce(trust, 100)) as vote from once group by all),
won as (select root_id, field_name, v from votes qualify row_number() over (partition by root_id, field_name order by vote desc, v) = 1)
select root_id, max(v) filter (field_name = 'short_desc') as short_desc, max(v) filter (field_name = 'version') as version, max(v) filter (field_name = 'os') as os,
  max(v) filter (field_name = 'bug_severity') as bug_severity from won group by root_id"""
